"""Embedding near-dedup: product quantisation over coarse inverted lists, with exact cosine rerank.

Equal vectors are one class. Coarse cells and residual codebooks are learned
on the driver from a bounded sample; every class is then assigned to its
nearest cell (its inverted list), its residual is coded subspace by subspace,
and it probes the lists of its nearest cells. In a list, distances of a query
to all members come from lookup tables (the query stays exact, the members
are codes); a member whose distance, less its own known coding error, can
still be within the radius is compared exactly in double precision. Lists are
cut into blocks of members by blocks of queries, so a crowded cell is many
tasks. What leaves a block are link counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import written
from crateflow.operators.components import connected


# ---- the quantiser (numpy, on a bounded sample) -----------------------------------------------

def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first; a tie goes to the lower index."""
    out = np.empty((len(x), k), dtype=np.int32)
    norms = (centres ** 2).sum(axis=1)
    for a in range(0, len(x), 2048):
        d = norms - 2 * (x[a: a + 2048] @ centres.T)
        out[a: a + 2048] = d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centres; starts from different rows, an empty centre stays where it is."""
    k = min(k, len(x))
    centres = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centres and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = 8, codes: int = 256, rounds: int = 8):
        self.coarse = _means(sample, cells, rounds, 1)
        residual = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [_means(residual[:, c], codes, rounds, 2 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells to probe, home first; codes; length of the coding error) of unit vectors."""
        near = _nearest(x, self.coarse, min(probes, len(self.coarse)))
        residual = x - self.coarse[near[:, 0]]
        codes = np.stack([_nearest(residual[:, c], b)[:, 0] for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        return near, codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray, block: int = 128):
        """Blocks (first query, squared distances of the queries to the coded members of a cell), by table lookup."""
        shifted = queries - self.coarse[cell]
        for a in range(0, len(queries), block):
            here = shifted[a: a + block]
            total = np.zeros((len(here), len(codes)), dtype=np.float32)
            for i, (c, b) in enumerate(zip(self.cuts, self.books)):
                table = ((here[:, c, None] - b.T[None]) ** 2).sum(axis=1).astype(np.float32)
                total += table[:, codes[:, i]]
            yield a, total


def learn(classes: DataFrame, dim: int, cells: int, sample_rows: int = 16384, sample_bytes: int = 32 << 20) -> Quantiser:
    """A quantiser from at most ``sample_rows`` vectors of at most ``sample_bytes``, those with the least hash."""
    most = max(1, min(sample_rows, sample_bytes // (8 * dim)))
    rows = classes.where(F.size("vector") == dim).orderBy(F.xxhash64("vector"), "cid").limit(most).select("vector").toArrow()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    return Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), cells)


# ---- tasks ------------------------------------------------------------------------------------------

_ASSIGNED = "cid bigint, n bigint, dim int, cell int, probes array<int>, codes binary, err double, vector array<double>"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assigner(sent, probes: int):
    """(cid, n, vector) -> the vector's cell, cells to probe, codes and coding error."""

    def run(batches):
        models = sent.value
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("vector")))
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                vector = part.column("vector")
                x = _vectors(vector, int(dim))
                near, codes, err = models[int(dim)].encode(x / np.linalg.norm(x, axis=1, keepdims=True), probes)
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("n"), pa.array(np.full(rows, dim, np.int32)), pa.array(near[:, 0]),
                     pa.array(list(near), pa.list_(pa.int32())),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), vector],
                    names=["cid", "n", "dim", "cell", "probes", "codes", "err", "vector"])

    return run


def _comparer(sent, min_cosine: float):
    """The members and queries of one block of one list -> link counts (v null) and forest edges (links 0)."""
    radius = np.sqrt(max(0.0, 2 - 2 * min_cosine)) + 1e-6
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        member = np.asarray(table.column("member").to_numpy(), dtype=bool)
        if member.all() or not member.any():
            return schema.empty_table()
        dim, cell = table.column("dim")[0].as_py(), table.column("list")[0].as_py()
        model = sent.value[dim]
        cid, n = (table.column(c).to_numpy() for c in ("cid", "n"))
        home = table.column("cell").to_numpy()
        vectors = _vectors(table.column("vector").combine_chunks(), dim)
        norm = np.linalg.norm(vectors, axis=1)
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        codes = np.frombuffer(b"".join(table.column("codes").filter(pa.array(member)).to_pylist()), np.uint8).reshape(len(m), -1)
        probed = np.asarray(table.column("probes").filter(pa.array(member)).combine_chunks().flatten()).reshape(len(m), -1)
        slack = table.column("err").to_numpy()[m] + radius
        limit = np.square(slack).astype(np.float32) * np.float32(1.0001)
        credit, label = np.zeros(len(member), dtype=np.int64), np.arange(len(member))
        for a, far in model.distances(vectors[q] / norm[q, None], cell, codes):
            i, j = np.nonzero(far <= limit)
            i, j = q[a + i], m[j]
            other = cid[i] != cid[j]
            i, j = i[other], j[other]
            for s in range(0, len(i), 1 << 16):
                qi, mj = i[s: s + (1 << 16)], j[s: s + (1 << 16)]
                exact = np.einsum("ij,ij->i", vectors[qi], vectors[mj]) / (norm[qi] * norm[mj])
                near = exact >= min_cosine
                qi, mj = qi[near], mj[near]
                np.add.at(credit, qi, n[mj])
                # the member finds the query by itself if it probes the query's cell; else both count here
                back = (probed[np.searchsorted(m, mj)] == home[qi, None]).any(axis=1)
                np.add.at(credit, mj[~back], n[qi[~back]])
                _join(label, qi, mj)
        root = label[label]
        linked, counted = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(credit)
        return pa.table([pa.array(np.concatenate([cid[linked], cid[counted]])),
                         pa.array(np.concatenate([cid[root[linked]], np.zeros(len(counted), np.int64)]),
                                  mask=np.arange(len(linked) + len(counted)) >= len(linked)),
                         pa.array(np.concatenate([np.zeros(len(linked), np.int64), credit[counted]]))], schema=schema)

    return compare


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the parts of a[k] and b[k] in ``label`` (each entry names its part's least entry)."""
    pairs = np.unique(np.sort(np.stack([label[a], label[b]], axis=1), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    parent: dict[int, int] = {}

    def find(x):
        while x in parent:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    if parent:
        moved = np.arange(len(label))
        for x in list(parent):
            moved[x] = find(x)
        label[:] = moved[label]


# ---- the operator -----------------------------------------------------------------------------------

def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.9,
                    probes: int = 16, cells_per_root: float = 1.0, max_cells: int = 4096, block_members: int = 4096,
                    block_queries: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors are linked if their cosine is ``min_cosine`` or more and one
    of them is in a list that the other probes (measure recall; with
    ``probes`` of at least the number of cells it is exact). There are
    ``cells_per_root`` times the root of the number of classes lists, up to
    ``max_cells``. ``n_links`` counts other rows, equal vectors among them.

    Defined cases: a vector that is null, empty, zero, or holds a null or a
    non-finite component links with nothing (its component is its own id);
    vectors of different lengths never link; equal vectors always do; repeated rows
    are vectors of their own; a null id never is a component's least, and a
    component of null ids alone has component_id null; kept is true where
    id and component_id are equal or both null; other columns are ignored; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    largest = F.array_max(F.transform("vector", F.abs))
    good = F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & (largest > 0), F.lit(False))
    # the direction does not change by scaling, and squares of the largest component then stay in range
    scaled = F.when(good, F.transform("vector", lambda x: x / largest))
    rows = written(rows.select("vec_id", scaled.alias("vector")), "vectors")
    classes = (rows.where("vector is not null").groupBy("vector")
               .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
               .select(F.monotonically_increasing_id().alias("cid"), "vector", "least", "n"))
    classes = written(classes, "vector-classes")
    models = {}
    for dim, n in classes.groupBy(F.size("vector")).count().collect():  # one row for each vector length
        models[dim] = learn(classes, dim, int(max(1, min(max_cells, round(cells_per_root * n ** 0.5)))))
    sent = spark.sparkContext.broadcast(models)
    assigned = written(classes.select("cid", "n", "vector").mapInArrow(_assigner(sent, probes), _ASSIGNED), "vector-codes")

    # how many blocks of members and of queries each list is cut into
    probed = assigned.select("*", F.explode("probes").alias("list"))
    sizes = (probed.groupBy("dim", "list")
             .agg(F.ceil(F.count(F.when(F.col("cell") == F.col("list"), 1)) / block_members).alias("a"),
                  F.ceil(F.count(F.lit(1)) / block_queries).alias("b")).where("a > 0"))
    sizes = written(sizes, "vector-lists").withColumnRenamed("dim", "dim_")
    part = lambda k: F.pmod(F.xxhash64("cid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k).cast("int") - 1))
    on = lambda c: (F.col("dim") == F.col("dim_")) & (F.col(c) == F.col("list_"))
    sizes = sizes.withColumnRenamed("list", "list_")
    shape = ["dim", "list", "i", "j", "member", "cid", "n", "cell", "vector", "codes", "probes", "err"]
    members = (assigned.join(F.broadcast(sizes), on("cell")).withColumn("list", F.col("cell")).withColumn("member", F.lit(True))
               .withColumn("i", part("a")).withColumn("j", every("b")).select(shape))
    queries = (probed.join(F.broadcast(sizes), on("list")).withColumn("member", F.lit(False))
               .withColumn("j", part("b")).withColumn("i", every("a"))
               .withColumn("codes", F.lit(None).cast("binary")).withColumn("probes", F.lit(None).cast("array<int>")).select(shape))
    found = (members.unionByName(queries).groupBy("dim", "list", "i", "j")
             .applyInArrow(_comparer(sent, min_cosine), "u bigint, v bigint, links bigint"))
    found = written(found, "vector-links")
    counts = found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    nodes = connected(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "cid")
    members = classes.join(nodes, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    members = written(members.join(counts, "cid", "left").select(
        "vector", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-parts")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(least, "component").select("vector", "n_links", "component_id")
    linked = rows.where("vector is not null").join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
