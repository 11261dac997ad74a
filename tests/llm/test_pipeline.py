import random
import re
import zlib

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tarnlake.llm import forest, kneser, packing, queries, secrets
from test_decontam import slow as slow_hits
from test_jaccard import slow_set
from test_toxicity_kneser import slow_costs

rng = random.Random(8)
PARTS = ["ta", "re", "mi", "so", "lan", "de", "ver", "ci", "on"]


def prose(n):
    return " ".join("".join(rng.choices(PARTS, k=rng.randrange(1, 4))) for _ in range(n))


def tables(spark, folder):
    bench = [(i, prose(40)) for i in range(5)]
    docs = [(i, prose(rng.randrange(30, 200)), "en", "src0", 0) for i in range(200)]
    same = prose(300)
    extra = {
        "junk": (500, "%%% ||| $$$ " * 50), "copy1": (501, same), "copy2": (502, same), "near": (503, same.replace("ta", "ta", 1) + " end"),
        "dirty": (504, prose(60) + " " + bench[0][1]), "secret": (505, prose(400) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(20)), "null": (506, None), "noid": (None, prose(50)),
    }
    docs += [(i, t, "en", "src1", len(t) if t else None) for i, t in extra.values()]
    docs += [docs[3]]  # a repeated row
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 500), 0) for i in [*range(200), 500]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "packing":
            assert out.columns == kept.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        kept = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = kept.collect()
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    assert 500 not in ids["quality"] and len(ids["quality"]) >= 205
    assert {501, 506, None} <= set(ids["near_duplicates"]) and 502 not in ids["near_duplicates"]
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"]))
    assert set(range(200)) & set(ids["quality"]) == set(range(200)) & set(ids["near_duplicates"])
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {504}
    assert sorted(ids["decontamination"], key=str) == sorted(ids["secret_scan"], key=str)
    texts = {r["doc_id"]: r for r in seen["secret_scan"]}
    assert secrets.MASK in texts[505]["text"] and not re.search("24be6443", texts[505]["text"]) and texts[505]["n_chars"] == len(texts[505]["text"])
    before = {i: t for i, t, *_ in docs}
    assert all(r["text"] == before[i] for i, r in texts.items() if i != 505)
    assert {r["doc_id"] for r in seen["packing"]} == set(ids["secret_scan"])


#: Columns that stages use inside.
CLASHES = ["path", "row", "symbols", "nats", "n_words", "n_hit", "spans", "items", "keep", "perplexity", "threshold", "before", "found", "line", "k1", "k2", "group", "own", "mean", "limit", "a.b"]


def slow_quality(docs, labels):
    """Which rows stay: dictionaries for the model, sorted lists for the quantiles."""
    good = [i for i in {i for i, _ in labels} if all(q == 1 for j, q in labels if j == i)]
    held = {i for i in good if zlib.crc32(str(i).encode()) % kneser.HELD_OUT == 0}
    p = slow_costs([t or "" for i, t, _ in docs if i in good and i not in held])
    known = {}

    def cost(text):
        codes, _ = kneser.grams(pa.array([text]))
        out = 0.0
        for c in codes.tolist():
            if c not in known:
                gram, rest = [], c
                for _ in range(kneser.ORDER):
                    rest, x = divmod(rest, kneser.SYMBOLS)
                    gram.append(x)
                known[c] = -np.log(p(tuple(reversed(gram))))
            out += known[c]
        return out, len(codes)

    costs = [cost(t or "") for _, t, _ in docs]
    by = {}
    for (i, _, lang), c in zip(docs, costs, strict=True):
        if i in held:
            by.setdefault(lang, []).append(c)
    means = {k: sum(c for c, _ in v) / sum(n for _, n in v) for k, v in by.items()}
    flat = [c for v in by.values() for c in v]
    every = sum(c for c, _ in flat) / sum(n for _, n in flat)
    value = lambda c, lang: (c[0] + kneser.PRIOR * means.get(lang, every)) / (c[1] + kneser.PRIOR)
    quantile = lambda x: sorted(x)[max(0, int(np.ceil(kneser.QUANTILE * len(x))) - 1)]
    limits = {k: quantile([value(c, k) for c in v]) for k, v in by.items() if len(v) >= kneser.LEAST}
    at_all = quantile([value(c, k) for k, v in by.items() for c in v])
    return [value(c, lang) <= limits.get(lang, at_all) * kneser.MARGIN for (_, _, lang), c in zip(docs, costs, strict=True)]


def slow_masked(text, path):
    trees, out, at = list(secrets.default_forest()), [], 0
    for m in re.finditer(secrets.PATTERN, text or ""):
        issued = bool(re.search(secrets.ISSUED, m[0]))
        value = m[0] if issued else re.search(secrets.VALUE, m[0])[1]
        around = text[max(0, m.start() - secrets.AROUND) : m.start()] + " " + text[m.end() : m.end() + secrets.AROUND]
        if forest.predict(trees, secrets.describe(value, around, path, issued)) >= secrets.THRESHOLD:
            out += [text[at : m.end() - len(value)], secrets.MASK]
            at = m.end()
    return text if not out else "".join(out) + text[at:]


def test_each_stage_against_plain_python(spark, tmp_path):
    """With columns that bear the stages' own names: these come back as they are."""
    docs = tables(spark, str(tmp_path))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()]
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} "), F.hash("text").cast("string")) for c in CLASHES})
    ids, hits = [tuple(map(str, (r["doc_id"], r["text"]))) for r in rows.collect()], {}
    kept = sorted((tuple(r) for r in rows.collect()), key=str)
    names = rows.columns

    def stage(fn):
        out = fn(spark, spark.createDataFrame(kept, rows.schema), str(tmp_path))
        assert out.columns == names
        return sorted(map(tuple, out.collect()), key=str)

    want = [r for r, ok in zip(kept, slow_quality([(r[0], r[1], r[2]) for r in kept], labels), strict=True) if ok]
    kept = stage(cp.quality)
    assert kept == want and len(kept) < len(ids)
    first = []
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        own = slow_set(r[1])
        if not any(own == x or (own | x and 100 * len(own & x) >= 80 * len(own | x)) for _, x in first):
            first.append((r, own))
    want = sorted((r for r, _ in first), key=str)
    kept = stage(cp.near_duplicates)
    assert kept == want and len(kept) < len(ids) - 2
    hits = slow_hits([r[1] for r in kept], bench)
    want = [r for r, (n, hit, _) in zip(kept, hits, strict=True) if not hit or 20 * hit < n]
    kept = stage(cp.decontamination)
    assert kept == want
    at = names.index("n_chars")
    want = []
    for r in kept:
        text = slow_masked(r[1], r[3])
        want.append((r[0], text, *r[2:at], len(text) if text != r[1] else r[at], *r[at + 1 :]))
    out = stage(cp.secret_scan)
    assert out == sorted(want, key=str) and out != kept
    packed = cp.pack(spark, spark.createDataFrame(out, rows.schema), str(tmp_path)).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    pieces = sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in packed)
    told = []
    for r in out:
        own = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, packing.END], "<u4")
        told += [(r[0] or -1, i, len(own[i : i + 2048]), zlib.crc32(own[i : i + 2048].tobytes())) for i in range(0, len(own), 2048)]
    assert pieces == sorted(told)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 2048


def test_run_and_empty(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert cp.run(spark, str(tmp_path)).count() > 190
    assert queries.op9_quality(spark, str(tmp_path)).filter("keep").count() >= 205  # the query keeps what the stage keeps
    assert queries.op10_packing(spark, str(tmp_path)).select("doc_id").distinct().count() == 208
    assert queries.op4_lm_scoring(spark, str(tmp_path)).filter("tokens > 0 AND log_likelihood < 0").count() == 207  # but the null and the junk
    empty = tmp_path / "empty"
    for n in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{n}.parquet").limit(0).write.parquet(f"{empty}/{n}.parquet")
    assert cp.run(spark, str(empty)).count() == 0
