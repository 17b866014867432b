"""The network against loops and numerical gradients, scores against the formula, gain on held-out texts."""

import collections
import random

import numpy as np
import pytest
import xxhash

from driftline.llm import pseudolikelihood as pl

from .test_llm import SF, documents, odd_texts


def word(w):
    return xxhash.xxh32_intdigest(w.encode()) or 1


def some_network(counts, seed=1):
    net = pl.Network.start(counts)
    net.flat += np.random.default_rng(seed).normal(0, 0.3, net.flat.shape).astype(np.float32)
    net.flat[pl.INPUTS] = 0
    return net


def by_loops(net, counts, buckets):
    """Log P of each bucket of one text, digit by digit."""
    out, n = [], counts + 0.01
    around = [None, None, *buckets, None, None]
    for i in range(2, len(around) - 2):
        h = np.tanh(sum(net.flat[pl.SCALES_AT + k] * net.flat[around[i + p] % pl.INPUTS] for k, p in enumerate(pl.PLACES) if around[i + p] is not None) + np.zeros(pl.HIDDEN))
        total = 0.0
        for level in range(4):
            prefix, width = around[i] >> 4 * (4 - level), 16 ** (3 - level)
            logits = [np.log(n[(prefix * 16 + v) * width : (prefix * 16 + v + 1) * width].sum()) + net.flat[pl.Network.OUT + level * 16 + v] @ h for v in range(16)]
            total += logits[around[i] >> 4 * (3 - level) & 15] - np.log(np.exp(logits).sum())
        out.append(total)
    return out


pl.SCALES_AT = pl.Network.SCALES


def test_network_against_loops():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9, pl.BUCKETS)
    net = some_network(counts)
    words = [r.integers(1, 2**32, n, dtype=np.uint32) for n in (5, 0, 1, 9)]
    line, owner = pl.laid_out(np.concatenate(words), np.array([5, 0, 1, 9]))
    want = [x for t in words for x in by_loops(net, counts, [int(w) % pl.BUCKETS for w in t])]
    assert np.allclose(net.log_probs(line), want, atol=1e-4) and np.bincount(owner).tolist() == [5, 0, 1, 9]
    assert len(pl.Network.start(counts).log_probs(pl.laid_out(np.empty(0, np.uint32), np.array([0, 0]))[0])) == 0


def test_buckets_sum_to_one():
    counts = np.random.default_rng(0).integers(0, 9, pl.BUCKETS)
    net = some_network(counts)
    line = np.empty((pl.BUCKETS, 5), np.int32)
    line[:] = [3, 70, 0, 9, -1]
    line[:, 2] = np.arange(pl.BUCKETS)
    total = sum(np.exp(net.log_probs(x)[2]) if len(x) else 0 for x in np.concatenate([np.full((64, 2), -1), line[::1024], np.full((64, 2), -1)], axis=1).astype(np.int32))
    assert 0 < total < 1
    z = np.array([net._forward(np.array([3, 70, b, 9, -1], np.int32))[4][0] for b in range(0, pl.BUCKETS, 16)])
    share = np.exp(z).reshape(-1, 4, 16)
    share /= share.sum(axis=2, keepdims=True)
    prefix = np.arange(0, pl.BUCKETS, 16) >> 4
    upper = share[np.arange(4096), 0, prefix >> 8] * share[np.arange(4096), 1, prefix >> 4 & 15] * share[np.arange(4096), 2, prefix & 15]
    assert abs((upper[:, None] * share[:, 3]).sum() - 1) < 1e-4


def test_gradient_and_step():
    r = np.random.default_rng(2)
    counts = r.integers(0, 9, pl.BUCKETS)
    net = some_network(counts)
    line = pl.laid_out(r.integers(1, 40, 30, dtype=np.uint32), np.array([12, 18]))[0]
    loss = lambda: -net.log_probs(line).sum()
    checked = 0
    for rows, g in net.gradient(line):
        for k in range(0, len(rows), max(1, len(rows) // 7)):
            if rows[k] == pl.INPUTS:
                continue
            for d in (0, 5):
                old = net.flat[rows[k], d]
                net.flat[rows[k], d] = old + 1e-2
                more = loss()
                net.flat[rows[k], d] = old - 1e-2
                less = loss()
                net.flat[rows[k], d] = old
                assert abs((more - less) / 2e-2 - g[k, d]) < 2e-2 + 0.02 * abs(g[k, d])
                checked += 1
    before = loss()
    for _ in range(20):
        net.step(line, 0.05)
    assert checked > 30 and loss() < before - 5 and not net.flat[pl.INPUTS].any()


def test_train_averages_the_tasks_changes(spark):
    """Two tasks, one round: each row moves by the mean of the tasks' changes, weighted by how often they met it."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(40)) for _ in range(20)]
    docs = documents(spark, texts)
    made = pl.materialize(pl.chunks(docs.coalesce(1)).unionByName(pl.chunks(docs.where("doc_id < 5").coalesce(1))), "chunks").repartition(2, "chunk").cache()
    counts = pl.bucket_counts(made)
    assert counts.sum() == 25 * 40
    got = pl.train(made, counts, rounds=1)
    start = pl.Network.start(counts)
    change, met = np.zeros(start.flat.shape), np.zeros(len(start.flat))
    tasks = collections.defaultdict(list)
    for row in made.selectExpr("spark_partition_id() as task", "lengths", "words").collect():
        tasks[row["task"]].append(row)
    for rows in tasks.values():
        own = pl.Network.start(counts)
        for row in rows:
            own.step(pl.laid_out(np.frombuffer(row["words"], np.uint32), np.frombuffer(row["lengths"], np.int64))[0], pl.RATE)
        change += (own.flat - start.flat) * own.met[:, None]
        met += own.met
    assert np.allclose(got.flat, start.flat + change / np.maximum(met, 1)[:, None], atol=1e-5)
    made.unpersist()


def test_each_word_is_a_target_once(spark, monkeypatch):
    """Rounds divide the chunks; within one, steps go over every word."""
    monkeypatch.setattr(pl, "CHUNK_WORDS", 500)
    made = pl.chunks(spark.read.parquet(f"{SF}/documents.parquet").limit(50))
    n = made.count()
    of = [made.where(f"pmod(xxhash64(chunk), {pl.ROUNDS}) = {turn}").count() for turn in range(pl.ROUNDS)]
    assert n > 5 and sum(of) == n
    line = pl.laid_out(np.arange(1, 10001, dtype=np.uint32), np.array([10000]))[0]
    assert sum((line[i : i + pl.BATCH + 4][2:-2] >= 0).sum() for i in range(0, len(line) - 4, pl.BATCH)) == 10000


def test_gain_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    made = pl.materialize(pl.chunks(docs.where("doc_id % 10 <> 3").coalesce(1)), "chunks")
    counts = pl.bucket_counts(made)
    trained = pl.train(made, counts)
    texts = [pl.hashed((r["text"] or "").encode()) for r in docs.where("doc_id % 10 = 3").collect()]
    line = pl.laid_out(np.concatenate(texts), np.array([len(t) for t in texts]))[0]
    assert trained.log_probs(line).mean() > pl.Network.start(counts).log_probs(line).mean() + 0.1


def test_scores_are_the_formula(spark, monkeypatch):
    """By loops, over many chunks and parts; and a text with its words exchanged is less likely."""
    monkeypatch.setattr(pl, "CHUNK_WORDS", 400)
    monkeypatch.setattr(pl, "PART_KEYS", 1500)
    r = random.Random(3)
    follows = {f"w{i}": f"w{(i * 7 + 1) % 300}" for i in range(300)}
    texts = [[f"w{r.randrange(300)}"] for _ in range(150)]
    for t in texts:
        while len(t) < 30:
            t.append(follows[t[-1]])
    texts.append(r.sample(texts[0], 30))
    made = pl.materialize(pl.chunks(documents(spark, [*(" ".join(t) for t in texts), None, ""])), "chunks")
    assert made.count() > 8
    counts = pl.bucket_counts(made)
    bucket = lambda w: word(w) % pl.BUCKETS
    want = collections.Counter(bucket(w) for t in texts for w in t)
    assert counts.sum() == 151 * 30 and all(counts[b] == n for b, n in want.items())
    net = some_network(counts)
    got = {row["doc_id"]: row for row in pl.score(made, net, counts).collect()}
    single = collections.Counter(w for t in texts for w in [*t, None])
    double = collections.Counter(p for t in texts for p in zip([None, *t], [*t, None], strict=True))
    for i, t in enumerate(texts):
        total = 0.0
        for k, (w, log) in enumerate(zip(t, by_loops(net, counts, [bucket(w) for w in t]) if i % 30 == 0 else net.log_probs(pl.laid_out(np.array([word(w) for w in t], np.uint32), np.array([30]))[0]), strict=True)):
            share = np.exp(log) * single[w] / counts[bucket(w)]
            sides = [((t[k - 1] if k else None), w), (w, (t[k + 1] if k + 1 < len(t) else None))]
            beside = [single[sides[0][0]], single[sides[1][1]]]
            total += np.log(sum((double[p] - 1 + (4 + 2 * (n - 1) ** 0.5) * share) / (n - 1 + 4 + 2 * (n - 1) ** 0.5) for p, n in zip(sides, beside, strict=True)) / 2)
        assert abs(got[i]["log_prob"] - total) < 2e-3 and got[i]["n_tokens"] == 30
    assert got[150]["mean_log_prob"] < got[0]["mean_log_prob"] - 1 and got[151]["n_tokens"] == got[152]["log_prob"] == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packed_keys(parts):
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 1000, dtype=np.uint64))
    begin = pl.parts_of(keys, parts)
    assert np.concatenate([pl.unpacked(pl.packed(keys[a:z])) for a, z in zip(begin[:-1], begin[1:], strict=True)]).tolist() == keys.tolist()
    assert len(begin) == parts + 1 and begin[0] == 0


def test_short_counts():
    counts = np.array([0, 1, 254, 255, 256, 7, 2**40], np.int64)
    assert pl.long(pl.short(counts), 7).tolist() == counts.tolist() and pl.long(pl.short(counts[:3]), 3).tolist() == [0, 1, 254]


def test_odd_texts(spark):
    rows = [*odd_texts(), "aa bb", "aa bb", "x" * 100_000, "long " * 50_000]
    odd = pl.score_documents(documents(spark, rows)).collect()
    assert len(odd) == len(rows) and all((r["n_tokens"] == 0) == (r["mean_log_prob"] is None) and r["log_prob"] <= 0 for r in odd)
    by_id = {r["doc_id"]: r for r in odd}
    assert by_id[len(rows) - 4]["log_prob"] == pytest.approx(by_id[len(rows) - 3]["log_prob"]) and by_id[len(rows) - 1]["n_tokens"] == 50_000
    assert pl.score_documents(documents(spark, ["a"]).where("false")).count() == 0
    assert pl.score_documents(documents(spark, [None, ""])).count() == 2
