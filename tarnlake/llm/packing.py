"""Packing documents into training sequences by minimum bin slack.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches the driver.
There, for the longest length left, a subset-sum over bitsets finds the multiset of other lengths
that comes closest to the capacity; backtracking yields its counts, and the pattern is used as often
as the histogram allows. Workers then turn a piece's rank within its length into a place.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import Counter
from pathlib import Path
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import checkpoints

CAPACITY = 2048
END = 1
_READY: dict[str, object] = {}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_KEEP = 200_000
#: Runs of letters, single digits, runs of marks: the cut of tokenizers whose words can be encoded one by one. A fixed value.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Ids(dict):
    """The ids of a run of characters without white space, as bytes; a memo of two generations of bounded size, so that frequent words outlive rare ones."""

    def __init__(self, tokenizer, word_wise: bool):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.word_wise = tokenizer, tokenizer.model, word_wise
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        bare = word.rstrip(punctuation)
        if bare and len(bare) < len(word) and bare[-1].islower() and bare[-1] < "\u0250" and "<|" not in word:  # the marks behind a letter are a run of their own
            ids = self[bare] + self[word[len(bare) :]]
        elif word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250"):  # nothing to normalise or to cut
            told = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            known = [t.id for t in self.model.tokenize(told)]
            ids = _PACK[len(known)](*known) if len(known) < len(_PACK) else struct.pack(f"<{len(known)}I", *known)
        else:
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) > _KEEP:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids


def _ids(definition: str) -> _Ids:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _READY:
        from tokenizers import Tokenizer

        _READY.clear()
        _READY[key] = _Ids(Tokenizer.from_str(definition), _word_wise(definition))
    return _READY[key]


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _word_wise(definition: str) -> bool:
    """Whether a tokenizer folds case, drops white space and cuts at it, so that a text's ids are its words' ids."""
    told = json.loads(definition)
    kinds = lambda part, many: [x["type"] for x in (part or {}).get(many, [])]
    cut = next(iter((told.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    special = [t for t in told.get("added_tokens") or [] if "<|" not in t["content"] or t["normalized"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
    return (
        kinds(told.get("normalizer"), "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds(told.get("pre_tokenizer"), "pretokenizers") == ["Split", "ByteLevel"]
        and (cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ({"Regex": _RUNS}, "Removed", True)
        and not told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
        and not special
    )


def encode(ids: _Ids, text: str | None) -> bytes:
    """Little-endian 32-bit ids of a whole text."""
    if not ids.word_wise:
        return np.asarray(ids.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    plain = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" not in plain and _latin(plain):  # case folds alike, letter by letter, and no special token can come of it
        plain = plain.lower()
    return b"".join(map(ids.__getitem__, plain.split(" ")))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids and an end id, cut into whole windows and a rest.

    docs needs doc_id and text. Null or empty texts have the end id alone.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    tail = np.asarray([end], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches):
        ids = _ids(definition)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(ids, text.as_py()) + tail
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    part = raw[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def fill(counts: dict[int, int], anchor: int, capacity: int) -> dict[int, int]:
    """How many of each length to put beside the anchor to leave the least padding."""
    room = capacity - anchor
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 ... copies make every count up to the limit
            step = min(step, left)
            grown = (reach | reach << (length * step)) & mask
            if grown != reach:
                trail.append((length, step, reach))
                reach = grown
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room:  # a power of two needs no padding either
        exact = [p - anchor for k in range(capacity.bit_length()) if anchor <= (p := 1 << k) <= capacity and reach >> (p - anchor) & 1]
        total = max(exact, default=total)
    used: Counter[int] = Counter()
    for length, step, before in reversed(trail):
        if not before >> total & 1:
            total -= length * step
            used[length] += step
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, beyond the last rank, uses in a sequence, first sequence, offset)."""
    left = {k: v for k, v in histogram.items() if v > 0}
    given: Counter[int] = Counter()
    out, sequence = [], 0
    while left:
        anchor = max(left)
        left[anchor] -= 1
        used = Counter(fill({k: v for k, v in left.items() if v}, anchor, capacity))
        left[anchor] += 1
        used[anchor] += 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            out.append((length, given[length], given[length] + n * times, n, sequence, offset))
            given[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return out


def place(parts: DataFrame, capacity: int = CAPACITY, group: int = 1 << 16) -> DataFrame:
    """Give every piece a sequence_id and an offset. parts: stored rows of ``pieces``.

    Ranks within a length come from ranks within salted shares of it, so that a length that holds a
    third of all pieces is ranked by many tasks.
    """
    spark: SparkSession = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    salts = [(k, 1 if n <= 256 else max(32, -(-n // group))) for k, n in histogram.items()]
    shares = F.broadcast(spark.createDataFrame(salts, "length long, shares long"))  # at most a row for each length
    steps = F.broadcast(spark.createDataFrame(rows, "length long, low long, high long, uses long, first long, shift long"))
    salted = parts.join(shares, "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("shares"))).drop("shares")
    sums = salted.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")  # rows alike in all of these are the same piece
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.join(steps, (ranked["length"] == steps["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("shift") + F.pmod(F.col("rank") - F.col("low"), F.col("uses")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences; one row for each piece.

    Null ids stay null, repeated rows are packed each, an empty table gives no rows, and other
    columns are ignored. Sequences may end short at any power of two, which needs no padding.
    """
    checkpoints.ensure(docs.sparkSession)
    return place(pieces(docs, tokenizer, capacity, end).checkpoint(), capacity)
