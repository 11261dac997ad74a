"""Word pairs travel packed: what the join writes, and rows and shards of any size."""

import random

import numpy as np
import pyarrow as pa
from tarnlake.llm import kneser


def corpus(n, words, length, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(words)}" for _ in range(length))) for i in range(n)]


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_joined_word_takes_few_bytes(spark, tmp_path):
    """On 0.51 GB the rows of one pair and one document each took more than the disk that op9 has."""
    rows = corpus(2000, 3000, 150, 1)
    docs = spark.createDataFrame(rows, "key long, text string").repartition(4).withColumnRenamed("key", "doc_id").checkpoint()
    before = shuffled(spark)
    model = kneser.WordModel(docs, None, f"{tmp_path}/pairs", pairs_sent=0)
    found = kneser.measure(docs.withColumnRenamed("doc_id", "key"), np.zeros(kneser.SYMBOLS**kneser.ORDER, np.float32), model).collect()
    assert len(found) == 2000
    assert (shuffled(spark) - before) / (2000 * 150) < 12  # both sides of the join, counts and answers


def test_rows_and_shards_of_any_size_give_the_same(spark, tmp_path, monkeypatch):
    rows = [*corpus(60, 40, 30, 2), (60, ""), (61, None), (62, "w1"), (63, "never seen"), (64, "w1 w2 " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cost = np.linspace(1, 2, kneser.SYMBOLS**kneser.ORDER, dtype=np.float32)

    def run(name, sent):
        model = kneser.WordModel(docs.filter("doc_id < 40 OR doc_id = 64"), None, f"{tmp_path}/{name}", pairs_sent=sent)
        return {r["key"]: (round(r["nats"], 7), r["symbols"]) for r in kneser.measure(docs.withColumnRenamed("doc_id", "key"), cost, model).collect()}

    want = run("all", 1 << 19)
    assert len(want) == len(rows)
    assert run("none", 0) == want
    for k, (shards, words, pairs_, ids, at_once) in enumerate([(1, 1 << 22, 3, 2, 10), (7, 1 << 22, 1, 5, 1 << 20), (2, 100, 1 << 18, 1 << 12, 200)]):
        for name, value in (("SHARDS", shards), ("SHARD_WORDS", words), ("ROW_PAIRS", pairs_), ("ROW_WORDS", ids), ("COUNTED", at_once)):
            monkeypatch.setattr(kneser, name, value)
        assert run(f"patched-{k}", 5) == want


def test_packed_numbers_come_back():
    for values in ([0], [0, 0, 255], [256, 1], [2**40, 3, 2**39 + 5], list(range(1000))):
        blob = kneser.packed(np.array(values, np.int64))
        assert kneser.unpacked(pa.scalar(blob, pa.binary()), len(values)).tolist() == values
    assert len(kneser.packed(np.array([255, 1]))) == 2 and len(kneser.packed(np.array([256, 1]))) == 4


def test_a_frequent_word_is_in_all_shards():
    shards = kneser.Shards(1000, 32)
    for pair in (np.arange(1000) << kneser._SHIFT | 7, 7 << kneser._SHIFT | np.arange(1000)):
        order, places = shards.dealt(shards.codes(pair))
        assert len(places) == 32 and max(j - i for _, i, j in places) <= 33 and sorted(order.tolist()) == list(range(1000))
    v, w = shards.words(shards.codes(np.array([999 << kneser._SHIFT | 3])))
    assert (v.tolist(), w.tolist()) == ([999], [3])
