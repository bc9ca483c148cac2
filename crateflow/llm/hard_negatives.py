"""Hard-negative mining: Fagin's threshold algorithm over per-dimension sorted lists, with integer scores.

Candidates are hashed into shards of bounded size, anchors into blocks; a
task holds one shard and one block. It sorts the shard once for each
dimension. For an anchor every list is read from the end that its component's
sign makes best, some depths at a time (a row's places in the lists say at
which depth it is first met); each row met is scored at once
(random access) by the integer inner product. No row that was not met can
score more than the threshold, the score of an imagined row with the current
entry of every list. A search ends when the threshold is strictly below the
kth score of what it looks for (rows that tie with the kth may have a smaller
id, hence strictly). Positives are searched first, over all shards; their
scores give the windows in which negatives are searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.common import written

_LONG = np.iinfo(np.int64)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), width)


class SortedLists:
    """One shard: its rows, each dimension's components in ascending order, and each row's place in every list."""

    def __init__(self, rows: np.ndarray):
        self.n, self.width = rows.shape
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, axis=0)
        self.place = np.empty((self.width, self.n), dtype=np.int32)
        for place, own in zip(self.place, order.T):
            place[own] = np.arange(self.n)
        self.most = max((abs(int(x)) for x in (rows.max(initial=0), rows.min(initial=0))), default=0)
        self._rows = {np.dtype(np.int64): rows}

    def depths(self, anchor: np.ndarray) -> np.ndarray:
        """The depth at which sorted access, every list from its better end, first meets each row."""
        first = np.full(self.n, self.n if anchor.any() else 0, dtype=np.int32)
        for place, a in zip(self.place, anchor.tolist()):
            if a:
                np.minimum(first, place if a < 0 else self.n - 1 - place, out=first)
        return first

    def threshold(self, anchor: list[int], depth: int) -> int:
        """No row that the first ``depth`` entries of the lists do not hold scores more."""
        low, high = self.values[depth - 1].tolist(), self.values[self.n - depth].tolist()
        edge = sum(a * (low[i] if a < 0 else high[i]) for i, a in enumerate(anchor))
        return min(max(edge, _LONG.min), _LONG.max)

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact integer scores of ``rows`` (as a full table, only these rows filled); beyond a long: the nearest long."""
        bound = self.most * max(sum(map(abs, a)) for a in anchors.tolist())
        kind = np.dtype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object)
        if kind not in self._rows:
            self._rows[kind] = self._rows[np.dtype(np.int64)].astype(kind)
        table, exact = self._rows[kind], anchors.T.astype(kind)
        if 4 * len(rows) > self.n:  # reading the shard in order is cheaper than fetching so many rows
            return table @ exact
        out = np.zeros((self.n, len(anchors)), dtype=kind)
        out[rows] = table[rows] @ exact
        return out


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), _LONG.min), _LONG.max) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


class _Best:
    """The k best of what was met, by score and then by smaller id; ``low`` and ``high`` bound the scores."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None, of: int = 0):
        self.k, self.low, self.high, self.of = k, low, high, of
        self.scores = self.ids = np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(self.scores) == self.k:
            able = scores >= self.scores[-1]
            scores, ids = scores[able], ids[able]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            best = np.lexsort((ids, ~scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]

    def settled(self, threshold: int) -> bool:
        """No row that was not met can enter."""
        if self.low is not None and threshold < self.low:
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]


class _Search:
    """What one anchor looks for, among the rows that ``allowed()`` marks."""

    def __init__(self, allowed, wanted: list[_Best]):
        self.mask, self.wanted = allowed, wanted

    def begin(self, lists: SortedLists, anchor: np.ndarray) -> "_Search":
        self.anchor, self.allowed = anchor.tolist(), self.mask()
        self.left = int(self.allowed.sum()) if self.wanted else 0
        self.met = lists.depths(anchor) if self.left else None
        return self

    def end(self) -> None:
        self.allowed = self.met = None


def _searches(lists: SortedLists, ids: np.ndarray, anchors: np.ndarray, found: list[_Search], first_depth: int = 64,
              batch: int = 16) -> None:
    """Sorted access some depths at a time, ``batch`` anchors side by side, until each search is settled."""
    for at in range(0, len(found), batch):
        active = [(i, s) for i, s in enumerate(found[at: at + batch], at) if s.begin(lists, anchors[i]).left]
        depth, stop = 0, min(first_depth, lists.n)
        while active:
            fresh = [(s.met >= depth) & (s.met < stop) for _, s in active]
            scores = lists.scores(np.flatnonzero(np.logical_or.reduce(fresh)), anchors[[i for i, _ in active]])
            still = []
            for column, ((i, s), new) in enumerate(zip(active, fresh)):
                new = np.flatnonzero(new & s.allowed)
                s.left -= len(new)
                own = _longs(scores[new, column])
                for w in s.wanted:
                    w.add(own, ids[new])
                if s.left and stop < lists.n:
                    edge = lists.threshold(s.anchor, stop)
                    if not all(w.settled(edge) for w in s.wanted):
                        still.append((i, s))
            active, depth, stop = still, stop, min(4 * stop, lists.n)
        for s in found[at: at + batch]:
            s.end()


_POSITIVES = "anchor_id bigint, positive_id bigint, positive_score bigint"
_NEGATIVES = "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _task(found_schema: list[str], search):
    def run(key, shard: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if shard.num_rows and anchors.num_rows:
            width = key[1].as_py()
            lists = SortedLists(_matrix(shard["q"], width))
            ids, labels = (shard[c].to_numpy() for c in ("id", "label"))
            out.extend(search(lists, ids, labels, _matrix(anchors["q"], width), anchors.drop_columns(["q"]).to_pylist()))
        table = np.concatenate(out) if out else np.zeros((0, len(found_schema)), dtype=np.int64)
        return pa.table([pa.array(table[:, i]) for i in range(len(found_schema))], names=found_schema)

    return run


def _rows(*columns) -> np.ndarray:
    return np.stack(np.broadcast_arrays(*(np.asarray(c, dtype=np.int64) for c in columns)), axis=1)


def _positive_search(k: int):
    def search(lists, ids, labels, anchors, rows):
        found = [_Search(lambda r=r: (labels == r["label"]) & (ids != r["id"]), [_Best(k)]) for r in rows]
        _searches(lists, ids, anchors, found)
        for r, s in zip(rows, found):
            yield _rows(r["id"], s.wanted[0].ids, s.wanted[0].scores)

    return search


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negative_search(k: int, low: int, high: int):
    def search(lists, ids, labels, anchors, rows):
        found = []
        for r in rows:
            windows = [window(s, low, high) for s in r["scores"]]
            found.append(_Search(lambda r=r: labels != r["label"], [_Best(k, *w, s) for w, s in zip(windows, r["scores"]) if w[0] <= w[1]]))
        _searches(lists, ids, anchors, found)
        for r, s in zip(rows, found):
            for best in s.wanted:
                yield _rows(r["id"], best.of, best.ids, best.scores)

    return search


def _first(df: DataFrame, by: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         shard_rows: int = 1 << 15, block_rows: int = 1 << 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows of ``vectors`` for which ``anchors`` holds. A row's
    score is its integer inner product with the anchor, after every component
    became floor(``scale`` * x). An anchor's positives are its ``positives``
    best other rows of its label; each brings the ``negatives`` best rows of
    other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score. Higher scores come first, ties by smaller id.

    Each task holds ``shard_rows`` candidates and ``block_rows`` anchors (on
    average of a hash), whatever one label or one group of copies holds.

    Defined cases: rows with a null id, label or vector, or with a null, NaN
    or infinite component take no part; rows that share an id are one, the
    one with the least (label, quantised vector); vectors of another length
    than the anchor's do not meet it; empty vectors have score 0; a positive
    with a negative score has an empty window; of ties any number may meet
    the kth score, the smaller id is taken; components and scores beyond a
    long become the nearest long; other columns, whatever their names, are
    ignored; an empty table, or no anchor, gives no rows.
    """
    vec = F.col(vec_col)
    usable = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    own = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        quantised(vec, scale).alias("q"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), usable.alias("usable"))
    own = own.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND usable").drop("usable")
    own = own.groupBy("id").agg(F.min(F.struct("label", "q", "is_anchor")).alias("r")).select("id", "r.*")
    base = written(own.withColumn("width", F.size("q")), "negatives-rows")
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a")).first()
    shards, blocks = max(1, -(-sizes.n // shard_rows)), max(1, -(-sizes.a // block_rows))
    key = ["shard", "width", "block"]
    number = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = base.select("id", "label", "q", "width", number(shards, 1).alias("shard"), each(blocks).alias("block"))

    def searched(asked: DataFrame, names: str, search) -> DataFrame:
        sent = asked.withColumn("block", number(blocks, 2)).withColumn("shard", each(shards))
        sent = sent.toDF(*sent.columns)  # columns of its own beside those of ``rows``
        columns = [c.split()[0] for c in names.split(", ")]
        return rows.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_task(columns, search), names)

    asked = base.where("is_anchor").select("id", "label", "q", "width").toDF("id", "label", "q", "width")
    near = searched(asked, _POSITIVES, _positive_search(positives))
    pairs = written(_first(near, ["anchor_id"], "positive_score", "positive_id", positives, "nth").drop("nth"), "negatives-positives")
    windows = pairs.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # ``positives`` entries at most
    asked = asked.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    hard = searched(asked, _NEGATIVES, _negative_search(negatives, low, high))
    ranked = _first(hard, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives, "rank")
    return pairs.join(ranked, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
