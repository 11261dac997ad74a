"""Word pairs of the quality model: the sharded join against dictionaries, and what symbols alone cannot tell."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tarnlake.llm import kneser
from tarnlake.llm import words as W


def slow_pair_cost(texts, vocabulary):
    """-ln p(word | word before) by dictionaries."""
    rare = lambda w: w if w in vocabulary else None
    n = Counter()
    for t in texts:
        ws = [rare(w) for w in t.split()]
        n.update(zip(["<begin>", *ws], ws, strict=False))
    follows = Counter(w for _, w in n)
    size = len(vocabulary) + 1

    def discounts(level):
        c = [sum(v == k for v in level.values()) for k in range(1, 5)]
        if 0 in c:
            return (0.5, 0.75, 0.9)
        y = c[0] / (c[0] + 2 * c[1])
        return tuple(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))

    d1, d2 = discounts(follows), discounts(n)
    off = lambda d, v: d[min(v, 3) - 1] if v else 0

    def p(v, w):
        all_ = sum(follows.values())
        p1 = (follows[w] - off(d1, follows[w]) + sum(off(d1, x) for x in follows.values()) / size) / all_
        own = [x for (a, _), x in n.items() if a == v]
        return (n[v, w] - off(d2, n[v, w]) + sum(off(d2, x) for x in own) * p1) / sum(own) if own else p1

    return lambda v, w: -math.log(p(rare(v) if v != "<begin>" else v, rare(w)))


def test_joined_pairs_match_dictionaries(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cd", "ef gh", "ef", "ij", f"once{i}"]) for _ in range(12)) for i in range(40)]
    asked = [*texts[:5], "ab never cd cd", "", None, "ef gh ef gh", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cost = np.zeros(kneser.SYMBOLS**kneser.ORDER, np.float32)  # spelling and spaces for nothing
    seen = Counter(w for t in texts for w in t.split())
    vocabulary = {w for w, c in seen.items() if c > 1}
    want = slow_pair_cost(texts, vocabulary)
    keyed = spark.createDataFrame([(zlib.crc32(str(t).encode()), t) for t in asked], "key long, text string")
    for sent in (0, 8, 1000):
        model = kneser.WordModel(docs, None, f"{tmp_path}/pairs-{sent}", pairs_sent=sent)
        assert len(model.vocabulary) == len(vocabulary) and len(model.sent) <= sent and (model.rest is None) == (sent == 1000)
        got = {r["key"]: r["nats"] for r in kneser.measure(keyed, cost, model).collect()}
        assert len(got) == len(asked) - 1  # copies are told once
        for t in asked:
            ws = (t or "").split()
            assert math.isclose(got[zlib.crc32(str(t).encode())], sum(map(want, ["<begin>", *ws], ws)), rel_tol=1e-9, abs_tol=1e-9), (sent, t)


def test_all_ways_give_the_same_and_salad_is_rejected(spark):
    """A salad of trusted words has their letters, but not their neighbours."""
    rng = random.Random(6)
    words = ["".join(rng.choices(["ta", "re", "mi", "so", "lan", "de"], k=3)) for _ in range(120)]
    after = {w: rng.sample(words, 3) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 120:
            out.append(rng.choice([w for w in after[out[-1]] if w != out[-1]] or words))
        return out

    good = [" ".join(text()) for _ in range(250)]
    salad = [" ".join(rng.sample(text(), 120)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + salad)] + [(3, good[3], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    plain = lambda **more: sorted((r["doc_id"], round(r["perplexity"], 7), round(r["threshold"], 7), r["keep"]) for r in kneser.classify(docs, labels, **more).collect())
    got = plain()
    assert len(got) == len(good) + len(salad) + 1
    assert plain(pairs_sent=20) == got and plain(pairs_sent=0, most_sent=10) == got
    assert all(keep == (i < 250) for i, _, _, keep in got)


def test_pairs_begin_with_each_text():
    found = W.split(pa.array(["a b", None, "", "b"]), W.SPACED)
    known = np.sort(found.hash[:1])
    assert kneser.pairs(found, known).tolist() == [1 << 20 | 2, 2 << 20, 1 << 20]
