"""Artist graph on DataFrames.

A graph is three DataFrames:

* ``vertices`` (id, in_collection, ...)
* ``edges``    (src, dst) explicit relations, both directions, no loops
* ``hubs``     (hub, id) co-appearance: every two members of a hub (a
  release) are neighbours. The clique a release induces is never
  materialised; a search expands a hub at most once, so a release with a
  third of all artists costs one pass over its members, not its pairs.

Iterative jobs run one DataFrame job per round and cut lineage every round
with a reliable checkpoint in the shared folder; loops stop on a scalar
count (the only value brought to the driver).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from crateflow.operators import derive as D
from crateflow.operators import group_tasks as T
from crateflow.operators.components import connected
from crateflow.session import cut_lineage, drop_scratch, scratch_path

#: rows (vertices, edges, hub memberships) up to which a group is worked on inside one task, where a vertex
#: counts as several, for the directions of its centrality (128 numbers a vertex, 16 to 20 bytes for another row)
TASK_ROWS, VERTEX_ROWS = 1 << 21, 8


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    hubs: DataFrame

    @property
    def spark(self):
        return self.vertices.sparkSession

    def materialized(self) -> "Graph":
        """Checkpoint the three tables once; iterative jobs then start from
        stored data instead of re-running the derivation every round."""
        return Graph(_ckpt(self.vertices), _ckpt(self.edges), _ckpt(self.hubs))


def _ckpt(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def _empty_ids(spark) -> DataFrame:
    return spark.createDataFrame([], "id bigint")


# ---- building the graphs -----------------------------------------------------------

def artist_vertex(m) -> DataFrame:
    """G1: every artist id that occurs anywhere, ``in_collection`` = max flag.

    Flag: known artist with collected items, or artist of a release that is
    in the collection.
    """
    known = D.artist_item_counts(m).select(
        "id_artist", F.when(F.col("qty_collection_items") > 0, 1).otherwise(0).alias("in_collection"))
    zero = F.lit(0).alias("in_collection")
    masters = m.t("artist_masters").filter(F.col("role").isin(*D.MASTER_ROLES)).select("id_artist", zero)
    rel_flag = (m.t("release_artists").select("id_release", "id_artist")
                .join(m.t("release").select("id_release"), "id_release")
                .join(m.t("collection_items").select("id_release").distinct().withColumn("__c", F.lit(1)),
                      "id_release", "left")
                .groupBy("id_artist").agg(F.max(F.coalesce("__c", F.lit(0))).alias("in_collection")))
    allv = (known
            .unionByName(m.t("artist_aliases").select(F.col("id_alias").alias("id_artist"), zero))
            .unionByName(m.t("artist_members").select(F.col("id_member").alias("id_artist"), zero))
            .unionByName(m.t("artist_groups").select(F.col("id_group").alias("id_artist"), zero))
            .unionByName(masters).unionByName(rel_flag))
    return allv.groupBy("id_artist").agg(F.max("in_collection").cast("int").alias("in_collection"))


def artist_edge(m) -> DataFrame:
    """Member, group and alias relations (no known-artist filter).

    The co-appearance branch is the hub table (``co_appearance_hubs(m, False)``).
    """
    return (D.rel_group_member(m).unionByName(D.rel_member_of_group(m)).unionByName(D.rel_alias(m))
            .distinct())


def undirected(edges: DataFrame, src: str = "id_artist_from", dst: str = "id_artist_to") -> DataFrame:
    """Drop loops, merge multi-edges, emit both directions."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b"))
    canon = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return canon.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        canon.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def _restrict(vertices: DataFrame, edges: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = vertices.select("id")
    e = (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
         .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    h = hubs.join(ids, "id", "left_semi").repartition("hub").distinct()  # dealt once for counting and joining
    multi = h.groupBy("hub").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= 2).select("hub")
    return e.select("src", "dst"), h.join(multi, "hub", "left_semi").select("hub", "id")


def _memberships(m) -> DataFrame:
    """(hub, id): releases and their artists; ``_restrict`` leaves those of D5d between its vertices."""
    return m.t("release_artists").select(F.col("id_release").alias("hub"), F.col("id_artist").alias("id"))


def network_plan(m) -> Graph:
    """Graph of the load frontier: G1 vertices, G2 edges, all co-appearance hubs; only the vertices are written."""
    v = _ckpt(artist_vertex(m).withColumnRenamed("id_artist", "id"))
    return Graph(v, *_restrict(v, undirected(artist_edge(m)), _memberships(m)))


def network_graph(m) -> Graph:
    """``network_plan``, written."""
    return network_plan(m).materialized()


def relation_graph(m) -> Graph:
    """Graph of the known artists: D5 relations (loops dropped) and known
    co-appearance hubs; ``in_collection`` from the item counts (the input of
    the community jobs)."""
    v = D.derive_artist(m).select(
        F.col("id_artist").alias("id"), "name_artist", "qty_collection_items",
        F.when(F.col("qty_collection_items") > 0, 1).otherwise(0).cast("int").alias("in_collection"))
    e, h = _restrict(v, undirected(D.artist_relations(m)), _memberships(m))
    return Graph(v, e, h).materialized()


def clustered_plan(m) -> Graph:
    """G7 of the relation graph: the graph that components and communities are found on; not written yet."""
    g = relation_graph(m)
    return pruned(g, _ckpt(relevant_vertices(g)))


def clustered_graph(m) -> Graph:
    """``clustered_plan``, written."""
    return clustered_plan(m).materialized()


def stored_graph(m, name: str, build) -> Graph:
    """A graph whose three tables are stored once for each dataset, as the derivations are."""
    made: list[Graph] = []

    def part(of):
        def run():
            if not made:
                made.append(build(m))
            return getattr(made[0], of)
        return run

    return Graph(*(m.stored(f"graph_{name}_{of}", part(of)) for of in ("vertices", "edges", "hubs")))


# ---- traversal ------------------------------------------------------------------------

def _neighbours(g: Graph, frontier: DataFrame, key: list[str]) -> DataFrame:
    """One hop from ``frontier`` (key + id): direct neighbours and members of its hubs.

    Hubs are made distinct before their members are joined, so a hub is
    expanded once, however many of its members the frontier holds.
    """
    direct = frontier.join(g.edges.withColumnRenamed("src", "id"), "id").select(*key, F.col("dst").alias("id"))
    hubs = frontier.join(g.hubs, "id").select(*key, "hub").distinct()
    return direct.unionByName(hubs.join(g.hubs, "hub").select(*key, "id")).distinct()


def neighbourhood(g: Graph, seeds: DataFrame, k: int = 2) -> DataFrame:
    """Vertices within ``k`` hops of any seed, with the hop distance.

    One lazy plan: every hop starts from all vertices of the hop before, and
    the least distance of a vertex is taken at the end.
    """
    hop = seeds.select("id").distinct()
    reached = hop.withColumn("dist", F.lit(0))
    for d in range(1, k + 1):
        hop = _neighbours(g, hop, [])
        reached = reached.unionByName(hop.withColumn("dist", F.lit(d)))
    return reached.groupBy("id").agg(F.min("dist").alias("dist"))


class _Layers:
    """The layers of a search, each written once under its distance; all are read back as one table."""

    def __init__(self, spark, name: str, schema: str):
        self.spark, self.path, self.schema = spark, scratch_path(spark, name), schema

    def put(self, df: DataFrame, dist: int) -> DataFrame:
        at = f"{self.path}/dist={dist}"
        df.write.parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, dist int").parquet(self.path)


def seed_distances(g: Graph, sources: DataFrame) -> DataFrame:
    """(seed, id, dist): breadth-first search from every source separately, until nothing new is reached.

    The state has a row for each source and vertex, so ``sources`` is a
    bounded set given by the caller. A neighbour of a layer lies in it, in the
    one before or in the next one, so a round looks at two layers only.
    """
    layers = _Layers(g.spark, "search", "seed bigint, id bigint")
    last = layers.put(sources.select(F.col("id").alias("seed"), "id").distinct(), 0)
    before, d = last.limit(0), 0
    while not last.isEmpty():
        d += 1
        known = last.unionByName(before)
        before, last = last, layers.put(_neighbours(g, last, ["seed"]).join(known, ["seed", "id"], "left_anti"), d)
    return layers.all()


def shortest_path_connectors(g: Graph, sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """G5 from given sources: every vertex on some shortest path from a source to a seed (both ends included).

    All shortest paths are taken (a superset of the single, tie-dependent
    path a sequential library returns). ``sources`` is a bounded set, as for
    the similarity of given artists: the search state has a row for each
    source and vertex. The path vertices come from a walk back from the
    seeds, one layer nearer to the source each round; a hub is expanded once
    for each (source, distance), so its cost is linear in its members.
    """
    states = seed_distances(g, sources)
    goals = seeds.select("id").distinct()
    far = states.join(goals, "id", "left_semi").agg(F.max("dist")).first()[0]
    found = _Layers(g.spark, "paths", "seed bigint, id bigint")
    farther = None
    for d in range(-1 if far is None else far, -1, -1):
        layer = states.where(F.col("dist") == d).select("seed", "id")
        now = layer.join(goals, "id", "left_semi").select("seed", "id")
        if farther is not None:
            now = now.unionByName(layer.join(_neighbours(g, farther, ["seed"]), ["seed", "id"], "left_semi")).distinct()
        farther = found.put(now, d)
    ends = sources.select("id")
    return ends.distinct() if far is None else found.all().select("id").unionByName(ends).distinct()


def nearest_seeds(g: Graph, seeds: DataFrame) -> DataFrame:
    """(id, lo, hi, dist): each reached vertex's distance to the nearest seed, and the least and largest id of its nearest seeds.

    One search from all seeds at once: every vertex is reached once, every
    edge and membership is passed once, whatever the number of seeds.
    """
    layers = _Layers(g.spark, "regions", "id bigint, lo bigint, hi bigint")
    last = layers.put(seeds.select("id").distinct().select("id", F.col("id").alias("lo"), F.col("id").alias("hi")), 0)
    before, d = last.limit(0), 0
    while not last.isEmpty():
        d += 1
        known = last.select("id").unionByName(before.select("id"))
        before, last = last, layers.put(_spread(g, last).join(known, "id", "left_anti"), d)
    return layers.all()


def _span(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _spread(g: Graph, frontier: DataFrame) -> DataFrame:
    """(id, lo, hi) one hop on: the span of the labels that reach each vertex; a hub passes on the span of its members."""
    direct = frontier.join(g.edges.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), "lo", "hi")
    hubs = _span(frontier.join(g.hubs, "id").select("hub", "lo", "hi"), "hub")
    return _span(direct.unionByName(hubs.join(g.hubs, "hub").select("id", "lo", "hi")), "id")


def region_connectors(g: Graph, seeds: DataFrame) -> DataFrame:
    """The vertices that connect the seeds with each other, the seeds included: (id).

    Every vertex belongs to the region of its nearest seeds. Where two
    regions meet (an edge or a hub with vertices of different nearest seeds,
    or a vertex with several), all shortest ways from there back to the
    nearest seeds are kept. So whatever seeds are connected stay connected,
    every shortest path between the seeds of neighbouring regions stays, and
    with it a shortest network over all seeds. One search and one walk back,
    linear in edges and memberships, with no bound on the number of seeds.
    """
    seeds = _ckpt(seeds.select("id").distinct())
    region = nearest_seeds(g, seeds)
    span = region.select("id", "lo", "hi")
    # a vertex meets another region if the labels at one of its edges or hubs, its own included, are not all the same
    at_edges = _span(g.edges.join(span, g.edges.src == F.col("id")).select(F.col("dst").alias("id"), "lo", "hi")
                     .unionByName(span), "id").where("lo <> hi").select("id")
    members = g.hubs.join(span, "id")
    mixed = _span(members, "hub").where("lo <> hi").select("hub")
    meets = _ckpt(at_edges.unionByName(members.join(mixed, "hub", "left_semi").select("id")).distinct())
    far = region.join(meets, "id", "left_semi").agg(F.max("dist")).first()[0]
    found, farther = _Layers(g.spark, "connectors", "id bigint"), None
    for d in range(-1 if far is None else far, -1, -1):
        layer = region.where(F.col("dist") == d).select("id")
        now = layer.join(meets, "id", "left_semi")
        if farther is not None:
            now = now.unionByName(layer.join(_neighbours(g, farther, []), "id", "left_semi")).distinct()
        farther = found.put(now, d)
    return seeds if far is None else found.all().select("id").unionByName(seeds).distinct()


def top_sources(g: Graph, k: int = 10) -> DataFrame:
    """The ``k`` collected vertices with the largest degree (ties by id): given sources for a page of paths."""
    collected = g.vertices.filter(F.col("in_collection") == 1).select("id")
    return _ckpt(vertex_degree(g).join(collected, "id", "left_semi").orderBy(F.col("degree").desc(), "id").limit(k).select("id"))


def relevant_vertices(g: Graph, k: int = 2) -> DataFrame:
    """G4 of all collected vertices, and G5 between all of them."""
    seeds = g.vertices.filter(F.col("in_collection") == 1).select("id")
    return neighbourhood(g, seeds, k).select("id").unionByName(region_connectors(g, seeds)).distinct()


def artist_ignore(g: Graph, k: int = 2) -> DataFrame:
    """Vertices neither near a collected vertex nor connecting collected ones."""
    keep = _ckpt(relevant_vertices(g, k))
    return g.vertices.select(F.col("id").alias("id_artist")).join(
        keep.withColumnRenamed("id", "id_artist"), "id_artist", "left_anti")


def pruned(g: Graph, keep: DataFrame) -> Graph:
    """Induced subgraph on ``keep`` (hubs keep members in ``keep``)."""
    v = g.vertices.join(keep.select("id"), "id", "left_semi")
    e, h = _restrict(v, g.edges, g.hubs)
    return Graph(v, e, h)


# ---- components ---------------------------------------------------------------------------

def connected_components(g: Graph) -> DataFrame:
    """(id, component) with component = smallest vertex id in it.

    A hub becomes edges from its members to its least member, which keeps
    the components and is linear; see ``components.connected``.
    """
    hubs = g.hubs.repartition("hub")  # dealt once for the least members and the join
    least = hubs.groupBy("hub").agg(F.min("id").alias("v"))
    edges = (g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
             .unionByName(hubs.join(least, "hub").select(F.col("id").alias("u"), "v")))
    found = connected(edges).withColumnRenamed("node", "id")
    return g.vertices.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def vertex_degree(g: Graph) -> DataFrame:
    """Explicit neighbours plus hub memberships (a linear degree)."""
    de = g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("__e"))
    dh = g.hubs.groupBy("id").agg(F.count(F.lit(1)).alias("__h"))
    return (g.vertices.select("id").join(de, "id", "left").join(dh, "id", "left")
            .select("id", (F.coalesce("__e", F.lit(0)) + F.coalesce("__h", F.lit(0))).alias("degree")))


# ---- centrality -----------------------------------------------------------------------------

def within_groups(g: Graph, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, grp) and hub memberships (grp, hub, id) inside the groups of (id, grp); a vertex may be in several.

    A hub is restricted to each group it reaches; one member of a hub alone
    has no neighbour there and is left out.
    """
    a = groups.select(F.col("id").alias("src"), "grp")
    b = groups.select(F.col("id").alias("dst"), "grp")
    edges = g.edges.join(a, "src").join(b, ["dst", "grp"]).select("src", "dst", "grp")
    members = g.hubs.join(groups.select("id", "grp"), "id").select("grp", "hub", "id")
    several = members.groupBy("grp", "hub").agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2").drop("__n")
    return edges, members.join(several, ["grp", "hub"], "left_semi")


def group_rows(g: Graph, groups: DataFrame) -> DataFrame:
    """(grp, kind, a, b): vertices with their collection flag, edges and memberships inside the groups of (id, grp), as ``group_tasks`` takes them."""
    edges, members = within_groups(g, groups)
    row = lambda kind, a, b: ("grp", F.lit(kind).alias("kind"), F.col(a).cast("bigint").alias("a"),
                              F.col(b).cast("bigint").alias("b"))
    flags = groups.select("id", "grp").join(g.vertices.select("id", F.coalesce("in_collection", F.lit(0)).alias("flag")), "id")
    return (flags.select(*row(T.VERTEX, "id", "flag")).unionByName(edges.select(*row(T.EDGE, "src", "dst")))
            .unionByName(members.select(*row(T.MEMBER, "hub", "id"))))


def by_size(rows: DataFrame, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that fit a task, and (grp) of the larger ones."""
    share = F.when(F.col("kind") == T.VERTEX, VERTEX_ROWS).otherwise(1)
    large = _ckpt(rows.groupBy("grp").agg(F.sum(share).alias("n")).where(F.col("n") > task_rows).select("grp"))
    return rows.join(large, "grp", "left_anti"), large


def in_tasks(rows: DataFrame, run, more: str, of_rows=T.Group.of_rows, columns: tuple = ("kind", "a", "b")) -> DataFrame:
    """(id, grp, ``more``) of ``run(group, key)`` for each group of ``rows``; it yields arrays of ids and of the further columns."""
    schema = StructType([StructField("id", LongType()), rows.schema["grp"], *StructType.fromDDL(more)])
    arrow = to_arrow_schema(schema)

    def task(key, table):
        group = of_rows(*(table[c].to_numpy() for c in columns))
        parts = list(run(group, key[0].as_py()))
        found = [np.concatenate([np.broadcast_to(p[i], len(p[0])) for p in parts]) for i in range(len(arrow) - 1)]
        found.insert(1, [key[0].as_py()] * len(found[0]))
        return pa.table([pa.array(c, t) for c, t in zip(found, arrow.types)], schema=arrow)

    return rows.groupBy("grp").applyInArrow(task, schema)


def eigenvector_centrality(g: Graph, groups: DataFrame | None = None, tol: float = 1e-6,
                           task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, grp, eigenvalue) for each group of (id, grp); without groups all vertices are group 0.

    Defined score: the leading eigenvector, scaled to maximum 1 in a group,
    of the weighted graph where two vertices are joined with weight 1 for an
    explicit edge and 1 for each hub they share; the hub part of A x is the
    sum of a hub less the vertex's own value, so no pair of members is formed.
    Found by Lanczos iteration until the residual of each group is small
    against its eigenvalue and the gap to the next one (see
    ``group_tasks.leading_vector``): groups of up to ``task_rows`` rows inside
    one task each, larger ones by one job for each step.
    """
    groups = g.vertices.select("id", F.lit(0).alias("grp")) if groups is None else groups.select("id", "grp")
    rows = _ckpt(group_rows(g, groups))
    small, large = by_size(rows, task_rows)
    out = in_tasks(small, lambda group, key: [(group.ids, T.leading_vector(group.times, group.n, tol))], "eigenvalue double")
    if large.isEmpty():
        return out
    return out.unionByName(_lanczos(rows.join(large, "grp", "left_semi"), tol))


def _times(edges: DataFrame, members: DataFrame, x: DataFrame) -> DataFrame:
    """(id, grp, add): adjacency times x; vertices without a neighbour are missing."""
    own = members.join(x, ["id", "grp"])
    total = own.groupBy("grp", "hub").agg(F.sum("x").alias("total"))
    via_hub = own.join(total, ["grp", "hub"]).select("id", "grp", (F.col("total") - F.col("x")).alias("add"))
    via_edge = (edges.join(x.withColumnRenamed("id", "src"), ["src", "grp"])
                .select(F.col("dst").alias("id"), "grp", F.col("x").alias("add")))
    return via_hub.unionByName(via_edge).groupBy("id", "grp").agg(F.sum("add").alias("add"))


def _ritz(tol: float, floor: float = 1e-10):
    """For a group's projected matrix: the leading vector's coefficients and whether its residual is small enough."""
    def task(key, table):
        steps = sorted(table.to_pylist(), key=lambda r: r["k"])
        h = np.zeros((len(steps), len(steps)))
        used = len(steps)
        for r in steps:
            h[: r["k"] + 1, r["k"]] = r["c"]
            if r["norm"] == 0:
                used = min(used, r["k"] + 1)  # the directions so far span all that can be reached
        h = h[:used, :used]
        h = np.triu(h) + np.triu(h, 1).T
        values, y = np.linalg.eigh(h)
        top, best = values[-1], y[:, -1]
        residual = steps[used - 1]["norm"] * abs(best[-1])
        gap = top - values[-2] if used > 1 else 0.0
        done = residual == 0 or (residual <= tol * top and residual <= max(tol * gap, floor * top))
        y = np.zeros(len(steps))
        y[:used] = best
        return pa.table({"grp": [key[0].as_py()], "y": [y.tolist()], "done": [bool(done)]},
                        schema=pa.schema([("grp", table.schema.field("grp").type), ("y", pa.list_(pa.float64())), ("done", pa.bool_())]))

    return task


def _lanczos(rows: DataFrame, tol: float, steps: int = 16) -> DataFrame:
    """Leading vectors of all groups of ``rows`` at once, one job for each step; groups that are done leave.

    A row holds a vertex's entries of the directions so far; restarted with the
    best vector after ``steps`` directions. One row for each group and step holds the projected matrix.
    """
    edges = rows.where(F.col("kind") == T.EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst"), "grp")
    members = rows.where(F.col("kind") == T.MEMBER).select("grp", F.col("a").alias("hub"), F.col("b").alias("id"))
    vertices = rows.where(F.col("kind") == T.VERTEX).select(F.col("a").alias("id"), "grp")
    n = vertices.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    state = _ckpt(vertices.join(n, "grp").select("id", "grp", F.array(1 / F.sqrt("n")).alias("v")))
    done_parts = []
    while not state.isEmpty():
        columns = []
        for k in range(steps):
            x = state.select("id", "grp", F.col("v")[k].alias("x"))
            w = state.join(_times(edges, members, x), ["id", "grp"], "left").withColumn("w", F.coalesce("add", F.lit(0.0)))
            w = _ckpt(w.select("id", "grp", "v", "w"))
            dots = _ckpt(w.groupBy("grp").agg(F.array(*(F.sum(F.col("v")[j] * F.col("w")) for j in range(k + 1))).alias("c"),
                                              F.sum(F.col("w") * F.col("w")).alias("ww")))
            rest = w.join(dots, "grp").withColumn("r", F.aggregate(
                F.zip_with("v", "c", lambda a, b: a * b), F.col("w"), lambda s, p: s - p))
            norms = rest.groupBy("grp").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.first("ww").alias("ww"), F.first("c").alias("c"))
            norms = _ckpt(norms.select("grp", "c", F.when(F.col("rr") > 1e-26 * F.col("ww"), F.sqrt("rr")).otherwise(0.0).alias("norm")))
            columns.append(norms.withColumn("k", F.lit(k)))
            old = state
            if k + 1 < steps:
                new = F.when(F.col("norm") > 0, F.col("r") / F.col("norm")).otherwise(0.0)
                state = rest.drop("c", "ww").join(norms.select("grp", "norm"), "grp").select("id", "grp", F.array_append("v", new).alias("v"))
                state = _ckpt(state)
            for df in (dots, w, *((old,) if old is not state else ())):
                drop_scratch(df)
        projected = columns[0]
        for c in columns[1:]:
            projected = projected.unionByName(c)
        schema = StructType([rows.schema["grp"], *StructType.fromDDL("y array<double>, done boolean")])
        best = _ckpt(projected.groupBy("grp").applyInArrow(_ritz(tol), schema))
        dot = F.aggregate(F.zip_with("v", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
        x = _ckpt(state.join(best, "grp").select("id", "grp", "done", dot.alias("x")))
        ready = x.where("done")
        most = ready.groupBy("grp").agg(F.max(F.abs("x")).alias("most"))
        done_parts.append(ready.join(most, "grp").select("id", "grp", (F.abs("x") / F.col("most")).alias("eigenvalue")))
        left = x.where(~F.col("done"))
        size = left.groupBy("grp").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
        state = _ckpt(left.join(size, "grp").select("id", "grp", F.array(F.col("x") / F.col("size")).alias("v")))
    out = done_parts[0]
    for part in done_parts[1:]:
        out = out.unionByName(part)
    return out
