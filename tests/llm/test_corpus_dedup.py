"""Substring, SimHash and embedding dedup, components, decontamination and WARC against plain versions."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crateflow.llm import decontaminate, embedding_dedup, simhash, substring_dedup, warc
from crateflow.operators import components

SF = "/root/testdata/sf0.001"


def _parts(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "random", "star", "empty"])
def test_components(spark, kind):
    rnd = random.Random(4)
    pairs = {"path": [(i, i + 1) for i in range(1500)], "random": [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)],
             "star": [(0, i) for i in range(1, 2000)], "empty": []}[kind]
    edges = spark.createDataFrame(pairs + pairs[:5], "u bigint, v bigint")
    want = _parts({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in components.connected(edges).collect()}
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)


def _removed(docs, length):
    """Plain version: docs is a list of distinct (id, version, words), in order."""
    first, out = {}, {}
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    for i, v, words in docs:
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            key = tuple(words[at:at + length])
            if first.setdefault(key, (i, v, at)) != (i, v, at):
                gone[at:at + length] = [True] * length
        out[i, v] = gone
    return out


def test_substring_dedup(spark):
    rnd = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for n in range(60):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 40)
            at = rnd.randint(0, len(words))
            words[at:at] = shared[a:a + rnd.randint(2, 20)]
        rows.append((n, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(3, " ".join(shared)), rows[7], rows[7], (None, " ".join(shared[5:30])), (90, None), (91, ""), (92, "a b"),
             (93, "ab " * 3000), (94, "é日 " * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("starts", F.lit(1))
    import zlib

    plain = {(i, zlib.crc32(t.encode()) if t is not None else -1): (t or "").encode().split() for i, t in rows}
    want = _removed([(i, v, w) for (i, v), w in plain.items()], 6)
    for options in ({}, {"slice_bytes": 500, "chars_per_bucket": 200}):
        got = substring_dedup.remove_repeats(docs, length=6, **options).collect()
        assert len(got) == len(rows)
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got)
        exp = []
        for i, t in rows:
            key = (i, zlib.crc32(t.encode()) if t is not None else -1)
            gone, words = want[key], plain[key]
            exp.append((i is None, i or 0, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
        assert kept == sorted(exp)
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def _plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    grams = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprint_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == _plain_fingerprint(texts[r.doc_id]) for r in rows[:60])
    own = spark.createDataFrame([("one two three",)], "t string").select(F.hex(F.xxhash64("t"))).first()[0]
    assert simhash.fingerprint(b"one two three") == int(own, 16)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = _parts(fp, near)
    assert {r.doc_id: r.component_id for r in rows} == want and near


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_simhash_links_close_fingerprints(spark, radius):
    rnd = random.Random(6)
    values = {rnd.getrandbits(64) for _ in range(150)}
    for v in list(values)[:80]:
        for _ in range(3):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits bigint"), radius)
    got = {r.node: r.component for r in components.connected(edges).collect()}
    want = _parts(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius])
    assert {v: got.get(v, v) for v in signed} == want


def test_bk_tree_of_a_crowded_shard():
    rnd = random.Random(7)
    values = np.unique(np.array([rnd.getrandbits(12) | 1 << 60 for _ in range(600)], dtype=np.uint64))
    got = {int(a): int(b) for a, b in simhash.tree_forest(values, 2)}
    pairs = [(a, b) for a, b in itertools.combinations(values.tolist(), 2) if (a ^ b).bit_count() <= 2]
    assert _parts(values.tolist(), list(got.items())) == _parts(values.tolist(), pairs)


def test_simhash_cases(spark):
    rows = [(5, None), (2, ""), (9, "  "), (7, "x y z w"), (7, "x y z w"), (8, "X Y z W"), (None, "lone words here"), (None, "lone words here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("bits", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert [g[2] for g in got if g[0] in (2, 5, 9)] == [2, 2, 2] and all(g[1] == "0" * 16 for g in got if g[0] in (2, 5, 9))
    assert [g[2] for g in got if g[0] in (7, 8)] == [7, 7, 7] and [g[2] for g in got if g[0] == 0] == [0, 0]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _plain_links(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= t
    np.fill_diagonal(s, False)
    return s


def test_embedding_dedup_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = embedding_dedup.near_duplicates(table).collect()
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    ids = sorted(data)
    near = _plain_links(np.stack([data[i] for i in ids]), 0.9)
    got = {r.vec_id: r for r in rows}
    assert sum(r.n_links for r in rows) >= 0.9 * near.sum()  # recall
    assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(axis=1)))
    want = _parts(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    assert np.mean([got[i].component_id == want[i] for i in ids]) > 0.9


@pytest.mark.parametrize("blocks", [{}, {"block_members": 7, "block_queries": 11}])
def test_embedding_links_are_counted_once(spark, blocks):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 12))
    x = np.concatenate([base, np.repeat(base[:6], 12, axis=0) + rng.normal(size=(72, 12)) * 0.12, base[:3] * 2.0])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, [0.0] * 12), (902, [float("nan")] * 12),
                                                        (903, [None] + [1.0] * 11), (904, []), (905, [1.0, 2.0]), (None, x[40].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1))
    good = [(i, v) for i, v in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    near = _plain_links(np.array([v for _, v in good]), 0.9)
    got = embedding_dedup.near_duplicates(table, probes=64, **blocks).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, int(n)) for (i, _), n in zip(good, near.sum(axis=1)))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links) for r in got if r.vec_id is None or r.vec_id < 900) == want
    part = _parts(range(len(good)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    least = {}
    for k, (i, _) in enumerate(good):
        if i is not None:
            least[part[k]] = min(least.get(part[k], i), i)
    assert {r.vec_id: r.component_id for r in got if r.vec_id is not None and r.vec_id < 900} == {
        i: least[part[k]] for k, (i, _) in enumerate(good) if i is not None}
    assert all(r.component_id == r.vec_id and r.n_links == 0 and r.kept for r in got if (r.vec_id or 0) >= 900)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def _plain_tiling(text, item, k):
    """Greedy string tiling by direct comparison."""
    a_marked, b_marked, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best, found = k - 1, None
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while (i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n]
                       and not a_marked[i + n] and not b_marked[j + n]):
                    n += 1
                if n > best:
                    best, found = n, (i, j)
        if found is None:
            return covered
        i, j = found
        a_marked[i:i + best], b_marked[j:j + best] = [True] * best, [True] * best
        covered += best


def test_tiling_equals_the_plain_version(spark):
    rnd = random.Random(9)
    items = [(n, " ".join(rnd.choice("abcd") + str(rnd.randint(0, 2)) for _ in range(rnd.randint(1, 25)))) for n in range(12)] + [(50, None), (51, "")]
    docs = []
    for n in range(40):
        words = [rnd.choice("abcd") + str(rnd.randint(0, 2)) for _ in range(rnd.randint(0, 60))]
        item = rnd.choice(items[:12])[1].split()
        cut = rnd.randint(0, len(item))
        docs.append((n, " ".join(words + item[cut:] + words[:3] + item[:cut]).upper() if n % 3 else ", ".join(words)))
    docs += [(100, None), (101, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for options in ({}, {"block_bytes": 100}):
        got = {(r.doc_id, r.item_id): r.matched for r in
               decontaminate.contaminated_pairs(d, b, min_match=3, threshold=0.5, **options).collect()}
        want = {}
        for i, t in docs:
            for j, u in items:
                words = (u or "").split()
                if words:
                    n = _plain_tiling((t or "").lower().replace(",", "").split(), words, min(3, len(words)))
                    if n >= 0.5 * len(words):
                        want[i, j] = n
        assert got == want
    assert decontaminate.contaminated_pairs(d.limit(0), b).count() == 0 and decontaminate.contaminated_pairs(d, b.limit(0)).count() == 0


def test_repeated_benchmark_rows_are_sent_once_and_all_reported(spark):
    text = "one two three four five six seven"
    items = [(1, text)] * 500 + [(2, text), (None, text), (None, text), (3, "another text that no document holds at all")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame([(7, "x " + text + " y"), (7, "x " + text + " y"), (8, "nothing here")], "doc_id bigint, text string")
    for options in ({}, {"block_bytes": 40}):
        got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(d, b, **options).collect())
        assert got == {(7, 1): 1000, (7, 2): 2, (7, None): 4}
        assert [r.doc_id for r in decontaminate.remove_contaminated(d, b, **options).collect()] == [8]


def test_decontamination_of_batches_without_a_word(spark):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "x"), (3, ""), (4, None)], "item_id bigint, text string")
    for rows in ([(1, ""), (2, None), (None, " \n "), (2, None)], [(1, "..."), (1, "...")]):
        d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        assert decontaminate.contaminated_pairs(d, b).count() == 0
        assert sorted(map(str, decontaminate.remove_contaminated(d, b).collect())) == sorted(map(str, d.collect()))


def test_decontamination_finds_planted_passages_and_leaves_the_rest(spark):
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, b).collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in b.collect()}
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in docs.collect()}
    want = {(i, j) for i, t in texts.items() for j, u in items.items() if u in t}
    assert want and want <= found and len(found) <= 1.2 * len(want)
    kept = decontaminate.remove_contaminated(docs, b)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({i for i, _ in found})


def test_warc_round_trip(spark, tmp_path):
    big = "é日" * 30000 + "\r\n\r\nWARC/1.1\r\nend"
    rows = [(1, "http://a/ b\r\nX: y", "x" * 1500), (2, None, "x" * 1500), (3, "u", "x" * 1500), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
            (7, "u", ""), (8, "u", big), (8, "u", big), (9, "u", big), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    warc.write_archives(pages, f"{tmp_path}/w", segment_bytes=1000, chunk_bytes=300, records_per_file=50)
    records = warc.read_records(spark, f"{tmp_path}/w")
    logical = warc.reassemble(records)
    got = sorted(((r.page_id or 0, r.warc_type, bytes(r.payload) if r.payload is not None else None, r.payload_sha1, r.copies)
                  for r in warc.payloads(logical).collect()), key=str)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g)
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert by[3][0][1:4] == ("response", b"x" * 1500, sha("x" * 1500)) and [by[i][0][1] for i in (1, 2)] == ["revisit"] * 2
    assert by[1][0][3] == sha("x" * 1500) and by[1][0][2] is None
    assert by[6][0][2] == b"" and by[4][0][1] == by[5][0][1] == "response"
    assert by[9][0][2] == big.encode() and sum(g[4] for g in by[8]) == 2 and by[8][0][1] == "revisit"
    assert sum(g[4] for g in got) == len(rows)
    assert all(r.digest_agrees is not False for r in warc.payloads(logical).collect())
    # a lost segment and a wrong length are told
    lost = warc.reassemble(records.where("not (segment = 3)"))
    assert {r.complete for r in lost.where("page_id = 9").collect()} == {False}
    assert warc.reassemble(records.limit(0)).count() == 0
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.payloads(warc.reassemble(warc.read_records(spark, f"{tmp_path}/none"))).count() == 0


def test_chunked_framing_and_damage():
    body = bytes(range(256)) * 5
    assert warc.unchunked(warc.chunked(body, 100)) == body and warc.unchunked(warc.chunked(b"", 9)) == b""
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhel") is None and warc.unchunked(b"zz\r\n") is None
    one = list(warc.records_of(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, 50, 10, "d"))
    damaged = b"noise" + one[0] + b"\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\nxx\r\n" + b"\r\n\r\n".join(one[1:])
    assert len(list(warc.parse(damaged))) == len(one)


@pytest.mark.parametrize("size", [3000, 12000])
def test_embedding_recall_of_planted_pairs_with_default_parameters(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, size)] * 0.6 + rng.normal(size=(size, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # the last tenth are vectors at a known cosine from as many others
    n = size // 10
    u, cosine = x[:n], rng.uniform(0.901, 0.95, (n, 1))
    w = rng.normal(size=(n, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    x[-n:] = cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    links = np.concatenate([(x[a:a + 1000] @ x.T >= 0.9).sum(axis=1) - 1 for a in range(0, size, 1000)])
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, min_cosine=0.9).collect()}
    assert links.sum() >= 2 * n and all(got[i] <= links[i] for i in range(size))
    print("recall", size, sum(got.values()), int(links.sum()))
    assert sum(got.values()) >= 0.95 * links.sum()


def test_substring_dedup_of_invalid_bytes(spark):
    """A text that is no UTF-8 neither fails nor hides its repeats."""
    words = "".join(f" w{i}" for i in range(30)).encode()
    rows = [(i, (b"a\xff\xfe" + bytes([65 + i]) + words).hex()) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, h string").select("doc_id", F.expr("cast(unhex(h) as string)").alias("text"))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, length=20).collect()}
    assert [got[i].n_removed for i in range(3)] == [0, 30, 30] and got[1].kept == "a\ufffd\ufffdB"


def test_gzip_archives_of_many_members():
    import gzip
    import time

    parts = [bytes([i % 251]) * (i % 3000) + str(i).encode() for i in range(4000)]
    raw = b"".join(map(gzip.compress, parts))
    began = time.process_time()
    assert warc.unzipped(raw) == b"".join(parts)
    assert time.process_time() - began < 5
    big = gzip.compress(random.Random(1).randbytes(3 << 20))
    assert len(warc.unzipped(big + raw)) == (3 << 20) + sum(map(len, parts))
    assert warc.unzipped(raw[:-5])[: len(parts[0])] == parts[0] and warc.unzipped(b"plain") == b"plain"
    assert warc.unzipped(gzip.compress(b"x") + b"\x1f\x8bnoise") == b"x"
