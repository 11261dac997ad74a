import random
import struct
import zlib
from collections import Counter, defaultdict

from tarnlake.llm import packing
from tarnlake.llm.queries import tokenizer_path
from tokenizers import Tokenizer

TEXTS = ["", None, "Hello, World. It's the 3rd <|endoftext|> of Ça\u0301fé!!", "a\xa0b\u2003c\x1cd\r\n\te", "x" * 300, "don't  CAN'T .. ,, a.b.,", "DŽungla ΣΑΣ. İstanbul I.", "word " * 5000, "<|STARTOFTEXT|>."]


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, length int, share string")
    rows = packing.pack(docs, tokenizer_path(), 64).collect()
    check(rows, TEXTS, 64)
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    waste = sum(64 - n for n in lengths.values() if n & (n - 1))
    assert waste < 64


def test_any_other_tokenizer_encodes_whole_texts():
    import numpy as np
    import public_tokenizers
    from tarnlake.llm.queries import tokenizer_path

    for path, word_wise in ((tokenizer_path(), True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        ids, plain = packing._ids(open(path).read()), Tokenizer.from_file(path)
        assert ids.word_wise == word_wise
        rng = random.Random(3)
        odd = ["".join(rng.choices("ab'é.,!$%<|>sStTmMdDllveß1 \u0301ΣİÅ’-_\"ªµ", k=rng.randrange(1, 14))) for _ in range(3000)]
        for text in [*TEXTS, *odd]:
            assert np.frombuffer(packing.encode(ids, text), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_hot_length_is_ranked_in_shares(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(700)], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer_path(), 64).collect()
    check(rows, ["same text"] * 700, 64)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_fill_is_closest_to_capacity():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(100):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        anchor = rng.randrange(1, 40)
        used = packing.fill(counts, anchor, 48)
        total = anchor + sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())
        sums = {anchor + sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))}
        best = max(s for s in sums if s <= 48)
        assert total == best or total & (total - 1) == 0
