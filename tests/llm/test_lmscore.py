import random
from collections import Counter

import numpy as np
import pyarrow as pa
from tarnlake.llm import lmscore


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = lmscore.Network(30, 6)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    near, token = rng.integers(0, 30, (12, 4)), rng.integers(0, 30, 12)
    grad, places = net.gradients(near, token)
    dense = {k: {at: v[at] for at in np.ndindex(v.shape)} for k, v in grad.items()}
    dense["near"] = {(j, int(r), i): g[n, i] for j, (rows, g) in enumerate(places) for n, r in enumerate(rows) for i in range(lmscore.WIDTH)}
    for k, at in [("group", (0, 1)), ("group_bias", (3,)), ("bias", (2,)), ("near", (1, near[0, 1], 3)), ("near", (3, near[5, 3], 0)), ("word", (token[0] // 6, 1, token[0] % 6)), ("word_bias", (token[0] // 6, token[0] % 6))]:
        at, out = tuple(map(int, at)), []
        for d in (1e-6, -1e-6):
            net.weights[k][at] += d
            out.append(-net.log_prob(near, token).mean())
            net.weights[k][at] -= d
        assert np.isclose((out[0] - out[1]) / 2e-6, dense[k][at], atol=1e-8)


def test_every_token_is_a_target(spark, monkeypatch, tmp_path):
    """The rounds take turns: over all of them each token is predicted ``passes`` times."""
    rng = np.random.default_rng(1)
    for rounds, passes in ((2, 1), (3, 2), (4, 4)):
        n = 1000
        told = sum(((rng2.permutation(n) - turn) % rounds < passes).astype(int) for turn in range(rounds) for rng2 in [np.random.default_rng([n, 5])])
        assert (told == passes).all()
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 9, 30))) for i in range(40)], "doc_id long, text string").coalesce(1)
    vocab = lmscore.vocabulary(docs, 12)
    before = lmscore.Network(vocab.size, vocab.side)
    score = lambda flat: lmscore.score(docs, vocab, flat).agg({"log_likelihood": "sum"}).first()[0]
    assert score(lmscore.train(docs, vocab)) > score(before.pack())


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(2)
    most = 2**64 - 1
    for keys in ([], [0], [most], [0, most], list(range(50)), [most - i for i in range(50)], rng.integers(0, 1 << 63, 1000).tolist()):
        keys = np.unique(np.array(keys, np.uint64))
        asked = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, 1, most, 1 << 63], np.uint64), rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)])
        at, there = lmscore.Lookup(keys).find(asked)
        assert there.tolist() == np.isin(asked, keys).tolist()
        assert (keys[at[there]] == asked[there]).all()


def test_large_weights_and_single_tokens():
    """Against one window at a time in double precision, also where exp of what comes out is beyond single precision."""
    rng = np.random.default_rng(3)
    for scale in (1, 300):
        net = lmscore.Network(40, 7)
        net.weights = {k: (scale * v).astype(np.float32) for k, v in net.weights.items()}
        near, token = rng.integers(0, 40, (50, 4)), rng.integers(0, 40, 50)
        got = net.log_prob(near, token)
        w = {k: v.astype(float) for k, v in net.weights.items()}
        for i, (places, t) in enumerate(zip(near, token, strict=True)):
            h = np.tanh(sum(w["near"][j, places[j]] for j in range(4)) + w["bias"])
            g, t = divmod(int(t), net.side)
            a, b = h @ w["group"] + w["group_bias"], h @ w["word"][g] + w["word_bias"][g]
            want = a[g] - np.logaddexp.reduce(a) + b[t] - np.logaddexp.reduce(b)
            assert np.isclose(got[i], want, rtol=1e-3, atol=1e-3 * scale)
        grad, _ = net.gradients(near, token)
        assert all(np.isfinite(g).all() for g in grad.values())


def test_probabilities_sum_to_one():
    net = lmscore.Network(36, 6)
    near = np.tile([1, 2, 3, 4], (36, 1))
    assert np.isclose(np.exp(net.log_prob(near, np.arange(36))).sum(), 1)


def test_scores_follow_the_corpus(spark):
    rng = random.Random(1)
    chain = {c: [f"{c}{i}" for i in range(3)] for c in "abcd"}

    def text(n):
        return " ".join(rng.choice(chain["abcd"[i % 4]]) for i in range(n))

    rows = [(i, text(rng.randrange(20, 200))) for i in range(400)]
    shuffled = text(100).split()
    rng.shuffle(shuffled)
    rows += [(1000, text(100)), (1001, " ".join(shuffled)), (1002, None), (1003, ""), (1003, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, tokens int").repartition(3)
    vocab = lmscore.vocabulary(docs, 12)
    assert len(vocab.key) == 12
    flat = lmscore.train(docs, vocab, rounds=3, passes=2)
    got = {r["doc_id"]: r for r in lmscore.score(docs, vocab, flat).collect()}
    assert got[1000]["mean_log_likelihood"] > got[1001]["mean_log_likelihood"] + 0.3
    assert (got[1002]["tokens"], got[1002]["log_likelihood"], got[1002]["mean_log_likelihood"]) == (0, 0.0, None)
    # against one window at a time
    net = lmscore.Network(vocab.size, vocab.side).unpack(flat)
    line, at, _ = lmscore.windows(pa.array([dict(rows)[1001]]), vocab)
    slow = sum(net.log_prob(lmscore._near(line, np.array([i])), line[[i]])[0] for i in at)
    assert np.isclose(got[1001]["log_likelihood"], slow, rtol=1e-4)


def test_held_out_texts_beat_a_unigram_model(spark):
    """At the query's own values: what the neighbours tell is worth more than word frequencies, on texts that were not trained on."""
    rng = random.Random(9)
    after = {i: rng.sample(range(120), 3) for i in range(120)}

    def text(n):
        words = [rng.randrange(120)]
        while len(words) < n:
            words.append(rng.choice(after[words[-1]]))
        return words

    name = lambda words: " ".join(f"w{i}" for i in words)
    train, held = [text(150) for _ in range(600)], [text(100) for _ in range(30)]
    docs = spark.createDataFrame([(i, name(t)) for i, t in enumerate(train)], "doc_id long, text string").repartition(2)
    vocab = lmscore.vocabulary(docs)
    flat = lmscore.train(docs, vocab)
    mixed = [rng.sample(t, len(t)) for t in held]
    rows = [(i, name(t)) for i, t in enumerate(held)] + [(100 + i, name(t)) for i, t in enumerate(mixed)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), vocab, flat).collect()}
    counts = Counter(w for t in train for w in t)
    total = sum(counts.values())
    unigram = [sum(np.log(counts[w] / total) for w in t) / len(t) for t in held]
    gain = [got[i] - u for i, u in enumerate(unigram)]
    assert np.mean(gain) > 0.5 and min(gain) > 0, (np.mean(gain), min(gain))
    assert all(got[i] > got[100 + i] for i in range(30))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.lm_scores(docs).collect() == []
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lmscore.lm_scores(only).first()["tokens"] == 0


def test_mean_of_many_copies(spark):
    rows = [(n, np.full(4, n, np.float32).tobytes()) for n in range(1, 101)]
    copies = spark.createDataFrame(rows, "seen long, weights binary")
    mean = lmscore._mean(copies, np.zeros(4, np.float32), fan=8)
    assert np.allclose(mean, sum(n * n for n in range(1, 101)) / 5050, rtol=1e-5)


def test_every_word_has_a_probability_of_its_own(spark):
    # the n-th word occurs in n texts; 10 words have ids, 20 more counts are sent, the rest are joined
    names = [f"w{i}" for i in range(1, 101)]
    rows = [(k, " ".join(w for i, w in enumerate(names, 1) if i > k)) for k in range(100)]
    rows += [(1000, "w3 w3 w40"), (1001, "w3 w3 w40"), (1002, "w99"), (1003, None), (1004, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(w for _, t in rows for w in (t or "").split())
    flat = None
    for sent in (20, 1000):
        vocab = lmscore.vocabulary(docs, 10, sent)
        assert (vocab.rare is not None) == (sent == 20)
        flat = lmscore.Network(vocab.size, vocab.side).pack() if flat is None else flat
        net = lmscore.Network(vocab.size, vocab.side).unpack(flat)
        got = {r["doc_id"]: r["log_likelihood"] for r in lmscore.score(docs, vocab, flat).collect()}
        assert len(got) == len(rows)
        hashes = dict(zip(names, lmscore.W.split(pa.array(names), lmscore.W.ALNUM).hash.tolist(), strict=True))
        kept, by_id = set(vocab.key.tolist()), {}
        for w, h in hashes.items():
            if h not in kept:
                by_id.setdefault(h % lmscore.OTHERS, []).append(counts[w])

        def within(w):
            own = by_id.get(hashes[w] % lmscore.OTHERS, [])
            return 0.0 if hashes[w] in kept else np.log(counts[w] / (sum(own) + own.count(1) + 1))

        for i, text in rows:
            line, at, _ = lmscore.windows(pa.array([text]), vocab)
            ids = float(net.log_prob(lmscore._near(line, at), line[at]).sum()) if len(at) else 0.0
            assert np.isclose(got[i], ids + sum(within(w) for w in (text or "").split()), rtol=1e-5), i
    # words that no text has share what is left, and less than the rarest word has
    new = {r["text"]: r["log_likelihood"] for r in lmscore.score(spark.createDataFrame([("qzxv",), ("w1",)], "text string"), vocab, flat).collect()}
    assert new["qzxv"] < new["w1"]
