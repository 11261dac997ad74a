"""Collocations against plain Python with whole integers."""

import random
import re
from collections import Counter

from tarnlake.llm import phrases

_UPPER = {c: c + 32 for c in range(65, 91)}


def _expected(rows, least, longest=5, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    covered = set()
    for (lang, p), f in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner = (lang, p[i : i + k])
                if 100 * f >= 100 * often[inner]:
                    covered.add(inner)
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or (lang, p) in covered:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1))


def _found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "times", "a", "ünï", "x\x1cy", "o'neil", "日本", "(new"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; "]
    return [(rng.choice(["en", "de", None, ""]), "".join(rng.choices(words, weights=range(1, 13))[0] + rng.choice(ends) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


def test_counts_scores_and_ranks(spark):
    rows = _corpus(150)
    rows += [("en", None), ("en", ""), ("en", "a a a a a a a"), ("fr", "long " * 4000), rows[3], rows[3], ("en", "w" * 100_000)]
    want = _expected(rows, 5)
    assert len(want) > 100
    assert _found(spark, rows, least=5) == want
    assert _found(spark, rows, least=5, block=300, first=7) == _expected(rows, 5, first=7)
    assert _found(spark, rows, least=3, longest=3) == _expected(rows, 3, 3)


def test_no_rows_no_phrases(spark):
    assert _found(spark, []) == []
    assert _found(spark, [("en", None), (None, "only once")]) == []


def test_collisions_only_add_candidates(spark):
    rows = _corpus(60, 2)
    assert _found(spark, rows, least=4, map_bits=6, shard_bits=10, held=50) == _expected(rows, 4)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 6 * 10**12), ("en", "a", 7 * 10**12), ("en", "b", 6 * 10**12 + 1)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 5 * 10**15)], "lang string, n long")
    score = 1000 * 6 * 10**12 * 5 * 10**15 // (7 * 10**12 * (6 * 10**12 + 1))
    assert [tuple(r) for r in phrases.ranked(counts, totals, 10).select("a", "l", "r", "n", "score").collect()] == [(6 * 10**12, 7 * 10**12, 6 * 10**12 + 1, 5 * 10**15, score)]


def test_texts_are_read_as_often_whatever_the_candidates(spark):
    """More candidates than one automaton takes cost no further reading."""
    rows = _corpus(60, 3)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "lang string, text string").mapInArrow(count, "lang string, text string")
    read = []
    for block in (phrases.BLOCK, 300, 40):
        before = seen.value
        found = phrases.collocations(docs, least=4, block=block).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        read.append(seen.value - before)
        assert sorted(map(tuple, found)) == _expected(rows, 4)
    assert read[0] > 0 and read == [read[0]] * 3


def test_counts_of_many_small_holdings(spark):
    """Texts whose automata are built row by row, with counts beyond a byte in one holding."""
    rows = [("en", "a b " * 700), (None, "a b. " * 300), ("en", None), *_corpus(20, 4)]
    for more in ({"read": 1}, {"block": 1}, {}):
        assert _found(spark, rows, least=3, **more) == _expected(rows, 3)
