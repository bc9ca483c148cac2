"""Language model scores: counts by brute force, a proper distribution, gradients, carried states, held-out gain."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.llm import language_model as M
from crateflow.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def brute(rows):
    lower = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts, ends = collections.Counter(), 0
    for (_, text), out in zip(rows, held):
        if not out:
            counts.update(lower(text))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for (i, text), h in zip(rows, held):
        c = [counts[w] for w in lower(text)] + [ends]
        out.append((i, h, len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)))
    return out


def tiny(class_words=4, short=10):
    v = M.Vocabulary([30, *range(40, 40 - short + 1, -1)], {1: 12, 2: 10, 4: 9}, {0: 12, 2: 19}, class_words)
    return v, M.new_network(v, 5, 6)


def test_events_sum_to_one():
    v, net = tiny()
    states = np.random.Generator(np.random.PCG64(1)).normal(size=(3, 5)).astype(np.float32)
    listed = np.arange(v.short)
    p = np.zeros(3)
    for i in listed:
        cls, place = v.split(np.full(3, i))
        p += np.exp(M.log_likelihood(net, states, cls, place))
    # words told apart by counts: twelve of count 1, five of 2, one of 9; and the unknown one
    for count, n in ((1, 12), (2, 5), (9, 1), (0, 1)):
        count, rank = np.full(3, count), np.full(3, -1)
        cls, place = v.split(v.of_words(count, rank))
        p += n * np.exp(M.log_likelihood(net, states, cls, place) + v.share(count, rank))
    assert np.allclose(p, 1, atol=1e-4)


def test_gradients_match_differences():
    v, net = tiny()
    net = {k: x.astype(np.float64) for k, x in net.items()}
    rng = np.random.Generator(np.random.PCG64(2))
    seen, target = rng.integers(0, v.ids, (5, 3)), rng.integers(0, v.ids, (5, 3))
    h = rng.normal(size=(3, 5))

    def loss():
        cls, place = v.split(target.ravel())
        states, own = [], h
        for t in range(5):
            own = own * (seen[t] != 0)[:, None]
            x = net["emb"][seen[t]] @ net["win"] + net["bias"]
            g = own @ net["rec"]
            r, z = (1 / (1 + np.exp(-(x + g)[:, i * 5:(i + 1) * 5])) for i in (0, 1))
            n = np.tanh(x[:, 10:] + r * g[:, 10:])
            own = n + z * (own - n)
            states.append(own)
        return -M.log_likelihood(net, np.concatenate(states), cls, place).mean()

    grads, _ = M._gradients({k: x.astype(np.float32) for k, x in net.items()}, v, seen, target, h.astype(np.float32))
    for k, g in grads.items():
        for at in rng.integers(0, net[k].size, 8):
            at = np.unravel_index(at, net[k].shape)
            if net[k][at] < -1e8:
                continue
            old = net[k][at]
            net[k][at] = old + 1e-5
            up = loss()
            net[k][at] = old - 1e-5
            down = loss()
            net[k][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=3e-4), k


def test_lanes_and_windows_do_not_matter():
    v, net = tiny()
    rng = np.random.Generator(np.random.PCG64(3))
    sizes = [1, 90, 3, 1, 40, 7, 200]
    ids = np.concatenate([np.append(rng.integers(1, v.ids, n - 1), 0) for n in sizes])
    ends = np.cumsum(sizes)
    alone = np.concatenate([M.score_documents(net, v, ids[e - n:e], np.array([n]), lanes=1, window=1000) for e, n in zip(ends, sizes)])
    for lanes, window in ((1, 7), (3, 4), (50, 64)):
        assert np.allclose(M.score_documents(net, v, ids, ends, lanes, window), alone, atol=1e-5)
    assert len(M.score_documents(net, v, ids[:0], ends[:0])) == 0


def test_a_long_document_takes_long_windows(monkeypatch):
    v, net = tiny()
    sizes = [6000, *[20] * 400]
    ids = np.concatenate([np.append(np.random.default_rng(n).integers(1, v.ids, n - 1), 0) for n in sizes])
    ends, told, likelihood = np.cumsum(sizes), [], M.log_likelihood
    monkeypatch.setattr(M, "log_likelihood", lambda net, states, *rest: told.append(len(states)) or likelihood(net, states, *rest))
    got = M.score_documents(net, v, ids, ends, lanes=16, window=32)
    assert sum(told) == len(ids) and max(told) <= 16 * 32 and len(told) < 60
    assert np.allclose(got, M.score_documents(net, v, ids, ends, lanes=1, window=5), atol=1e-5)


def test_one_pass_learns_every_token(monkeypatch):
    v = M.Vocabulary([50, *range(40, 9, -1)], {3: 9}, {2: 9}, 8)
    rng = np.random.default_rng(5)
    for n in (2, 31, 64, 999, 5000):
        stream, seen = rng.integers(0, 30, n), []
        gradients = M._gradients
        with monkeypatch.context() as m:
            marks = np.arange(n)
            m.setattr(M, "_gradients", lambda net, v, a, b, h: seen.append(b) or ({k: np.zeros_like(x) for k, x in net.items()}, h))
            assert M.train(M.new_network(v, 4, 4), v, marks, None, 0.01) == n - 1
        assert set(np.concatenate([x.ravel() for x in seen]).tolist()) == set(range(1, n))
        assert M._gradients is gradients and M.train(M.new_network(v, 4, 4), v, stream, None, 0.01) == n - 1


def test_classes_are_learned_in_few_batches():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2048):
        cls = np.minimum((rng.pareto(0.7, n) * 2).astype(np.int64), 31)
        place = np.where(rng.random(n) < 0.8, rng.integers(0, 64, n), -1)
        met, size, batches = [], 0, 0
        for c, rows, used in M._padded(cls, place):
            assert (cls[rows] == c[:, None]).all() and used[:, 0].all()
            met += rows[used].tolist()
            size, batches = size + rows.size, batches + 1
        assert sorted(met) == np.flatnonzero(place >= 0).tolist()
        assert size <= 2 * len(met) and batches <= 12


def test_softmax_of_large_and_small_numbers():
    x = np.array([[1e4, 0, -1e9], [-1e4, -1e4, -1e9], [0, 1, 2]], np.float32)
    p = M._softmax(x.copy())
    assert np.allclose(p[:2], [[1, 0, 0], [0.5, 0.5, 0]]) and np.allclose(p.sum(axis=1), 1)
    assert np.allclose(M._log_of(x, np.array([1, 0, 2])), [-1e4, math.log(0.5), math.log(p[2, 2])], rtol=1e-5)
    assert np.allclose(M._softmax(x[2:].copy()), p[2:]) and M._softmax(x[:0].copy()).shape == (0, 3)


def test_training_is_adam_on_the_clipped_gradients(monkeypatch):
    v, net = tiny()
    start = {k: x.copy() for k, x in net.items()}
    seen, gradients = [], M._gradients

    def kept(net, *rest):
        grads, h = gradients(net, *rest)
        seen.append({k: g.copy() for k, g in grads.items()})
        return grads, h

    monkeypatch.setattr(M, "_gradients", kept)
    M.train(net, v, np.random.default_rng(4).integers(0, v.ids, 400), None, 0.02, lanes=4, window=16)
    moment = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in start.items()}
    for i, grads in enumerate(seen):
        norm = math.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        for k, x in start.items():
            g, m = grads[k] * min(1.0, 5.0 / norm), moment[k]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            now = 0.02 * min(1.0, 2 * (1 - i / len(seen)))
            x -= (now / (1 - 0.9 ** (i + 1)) * m[0] / (np.sqrt(m[1] / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
    assert len(seen) > 3 and all(np.allclose(net[k], start[k], atol=1e-4) for k in net)


def test_mean_over_groups(spark):
    rows = [(i, float(1 + i % 4), np.full(3, i, "<f4").tobytes()) for i in range(70)] + [(99, 0.0, np.zeros(3, "<f4").tobytes())]
    got = np.frombuffer(M._mean(spark.createDataFrame(rows, "number bigint, weight double, net binary"), fan_in=4), "<f4")
    assert np.allclose(got, sum(w * i for i, w, _ in rows[:70]) / sum(w for _, w, _ in rows[:70]), atol=1e-3)


def test_scores_of_odd_rows(spark):
    rows = [(0, "The the THE cat"), (1, None), (2, ""), (3, " \t\n"), (None, "a null id"), (4, "cat\x0bdog\x1cdog É é"), (5, "the cat"),
            (5, "the cat"), (6, "x" * 200_000), (7, "long " * 30_000), (8, "dog cat the a")]
    rows += [(i, f"the cat w{i % 3} sat") for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, held_out string, n int").repartition(2)
    out = M.score(docs, held_out(), slice_bytes=500, start_steps=5).collect()
    key = lambda r: (*r[:5], round(r[5], 6))
    assert collections.Counter(key(r) for r in out) == collections.Counter(key(r) for r in brute(rows))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert M.score(docs.limit(0), held_out()).count() == 0
    none = M.score(docs, F.lit(True)).collect()
    assert {r.n_known for r in none} == {0} and {r.base_score for r in none} == {0.0}


def test_op11_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op11_language_model(spark, sf).collect()}
    for i, held, n, known, total, base in brute(rows):
        assert tuple(got[i])[1:5] == (held, n, known, total) and got[i].base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9
