"""Scores of whole documents under a gated recurrent language model, beside an add-one unigram score.

Words are counted over all training documents by Spark. The most frequent
ones, the shortlist, are split by rank into equal classes; every other word
belongs to the class of words with about its count (powers of two), unknown
words to a class of their own. The network (numpy) predicts the class from its
state, and the word from state and class: softmax over the class for shortlist
words, the share in the class's count for others. All unknown words are one
event, as they are in the unigram score, so both distribute over the
same V + 1 events. While learning, a word outside the shortlist counts once
less: a word seen only once stands for what was never seen.

Learning is truncated backpropagation over windows whose state is carried on.
A bounded sample starts the network; then every slice of the corpus goes on
from there on all of its training tokens, and the parameters are
averaged by a tree of groups, weighted by tokens. Scoring runs documents side
by side in lanes, window by window; a document's state is carried from its
first word to its end, however long it is.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import raw_texts, slices, written
from crateflow.llm.slice_table import Numbers, figures_back, keys_of_slices, pack, slice_numbers, unpack
from crateflow.session import drop_scratch

_SLICES = ("slice bigint, doc_id array<bigint>, held_out array<boolean>, n_words array<int>, stream binary, "
           "word array<binary>, n array<bigint>")
_RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
           "score double")


# ---- the network -------------------------------------------------------------------------

class Vocabulary:
    """Output ids: 0 the end, then shortlist words by rank, then one id for each class of other words."""

    def __init__(self, counts: list[int], rare: dict[int, int], spare: dict[int, int], class_words: int):
        self.short = len(counts)  # the end included
        self.classes = -(-self.short // class_words)
        self.class_words = class_words
        self.buckets = 1 + max([0, *rare])
        self.rare_total = np.array([rare.get(b, 0) for b in range(self.buckets)], dtype=np.float64)
        # a class without words is never used: its counts go to the next one below
        self.used = np.maximum.accumulate(np.where(self.rare_total > 0, np.arange(self.buckets), 0))
        self.ids = self.short + self.buckets
        # counts that set the first biases
        self.word_mass = np.zeros(self.classes * class_words)
        self.word_mass[: self.short] = counts
        mass = np.zeros(self.buckets)
        for b, n in spare.items():
            mass[self.used[min(b, self.buckets - 1)]] += n
        self.class_mass = np.concatenate([self.word_mass.reshape(self.classes, class_words).sum(axis=1), mass])
        self.empty = np.append(np.zeros(self.classes + 1, dtype=bool), self.rare_total[1:] == 0)

    def of_words(self, count: np.ndarray, rank: np.ndarray, less: int = 0) -> np.ndarray:
        """Output id of each word by its count and its rank in the shortlist (-1: not there)."""
        return np.where(rank >= 0, rank, self.short + self.used[np.minimum(bucket(count - less), self.buckets - 1)])

    def split(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in the class; -1 for words that the class's counts tell apart)."""
        listed = ids < self.short
        return (np.where(listed, ids // self.class_words, ids - self.short + self.classes),
                np.where(listed, ids % self.class_words, -1))

    def share(self, count: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Log of a word's share in its class, 0 where the softmax tells it or the word is unknown."""
        total = self.rare_total[np.minimum(bucket(count), self.buckets - 1)]
        rare = (rank < 0) & (count > 0)
        return np.where(rare, np.log(np.maximum(count, 1) / np.maximum(total, 1)), 0.0)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for no count, else the number of bits of the count."""
    return np.where(count > 0, np.frexp(np.maximum(count, 0).astype(np.float64))[1], 0).astype(np.int64)


def new_network(v: Vocabulary, hidden: int, embedding: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    words = np.log(v.word_mass + 0.5).reshape(v.classes, v.class_words)
    words[(np.arange(words.size) >= v.short).reshape(words.shape)] = -1e9  # places without a word
    classes = np.where(v.empty, -1e9, np.log(v.class_mass + 0.5))
    return {"emb": (0.3 * rng.normal(size=(v.ids, embedding))).astype(np.float32), "win": draw(embedding, 3 * hidden),
            "rec": draw(hidden, 3 * hidden), "bias": np.zeros(3 * hidden, np.float32),
            "cls": 0.1 * draw(hidden, v.classes + v.buckets), "cls_bias": classes.astype(np.float32),
            "word": 0.1 * draw(v.classes, hidden, v.class_words), "word_bias": words.astype(np.float32)}


def to_bytes(net: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([net[k].ravel() for k in sorted(net)]).astype("<f4").tobytes()


def from_bytes(blob: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(blob, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at: at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _exp_sums(x: np.ndarray) -> np.ndarray | None:
    """Turns ``x`` into its exponentials and gives each row's sum; None where a sum has no finite log."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], x.dtype)
    return total if np.isfinite(total).all() and total.all() else None


def _softmax(x: np.ndarray) -> np.ndarray:
    before = x.copy()
    total = _exp_sums(x)
    if total is None:  # rare: take the largest out first
        np.exp(before - before.max(axis=1, keepdims=True), out=x)
        total = x.sum(axis=1)
    x *= np.reciprocal(total)[:, None]
    return x


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row's entry ``at``."""
    own = x[np.arange(len(x)), at]
    total = _exp_sums(x.copy())
    if total is None:
        top = x.max(axis=1)
        return own - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
    return own - np.log(total)


def _by_class(cls: np.ndarray, place: np.ndarray):
    """(class, rows) of the rows whose place in the class is told by its softmax."""
    rows = np.flatnonzero(place >= 0)
    rows = rows[np.argsort(cls[rows], kind="stable")]
    found, begin = np.unique(cls[rows], return_index=True)
    yield from zip(found.tolist(), np.split(rows, begin[1:]))


def log_likelihood(net: dict, states: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural log probability of each token (but for the share of words that counts tell apart)."""
    x = states @ net["cls"]
    x += net["cls_bias"]
    out = _log_of(x, cls).astype(np.float64)
    for c, rows in _by_class(cls, place):
        x = states[rows] @ net["word"][c]
        x += net["word_bias"][c]
        out[rows] += _log_of(x, place[rows])
    return out


def train(net: dict, v: Vocabulary, stream: np.ndarray, steps: int | None, rate: float, lanes: int = 64, window: int = 32) -> int:
    """Adam on truncated backpropagation; returns the tokens used.

    ``stream``: output ids, documents one after another, each closed by the
    end. It is cut into lanes; each lane runs over its tokens again and again
    for ``steps`` windows (None: once over every token of the stream), and its
    state is carried from window to window and cleared after an end.
    """
    total, once = len(stream) - 1, steps is None
    if total < 1:
        return 0
    lanes = min(lanes, max(1, total // window))
    span = -(-total // lanes) if once else total // lanes
    window = min(window, span)
    steps = -(-span // window) if once else steps
    # in one pass the last lane ends with the stream; lanes may share a token
    begin = np.arange(lanes) * (total - span) // max(1, lanes - 1) if once else np.arange(lanes) * span
    # all parameters lie in one vector, so that Adam is a dozen passes over it
    flat = np.concatenate([x.ravel() for x in net.values()])
    places = np.cumsum([0, *(x.size for x in net.values())]).tolist()
    own = {k: flat[i:j].reshape(x.shape) for (k, x), i, j in zip(net.items(), places, places[1:])}
    grad, mean, square, work = (np.zeros_like(flat) for _ in range(4))
    h = np.zeros((lanes, net["rec"].shape[0]), np.float32)
    at = 0
    for step in range(1, steps + 1):
        if at + window > span and not once:
            at = 0
            h[:] = 0
        wide = min(window, span - at)
        where = begin + at + np.arange(wide)[:, None]
        at += wide
        grads, h = _gradients(own, v, stream[where], stream[where + 1], h)
        np.concatenate([grads[k].ravel() for k in own], out=grad)
        grad *= min(1.0, 5.0 / (float(np.sqrt(grad @ grad)) + 1e-9))
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        np.subtract(grad, mean, out=work)
        work *= 0.1
        mean += work
        grad *= grad
        grad -= square
        grad *= 0.01
        square += grad
        np.divide(square, 1 - 0.99**step, out=work)
        np.sqrt(work, out=work)
        work += 1e-8
        np.divide(mean, work, out=work)
        work *= now / (1 - 0.9**step)
        flat -= work
    for k, x in own.items():
        net[k][...] = x
    return total if once else steps * window * lanes


def _inputs(net: dict, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, what they give to gates and candidate) of tokens time x lanes, as time x feature x lanes.

    With lanes last a gate of one step is one block of memory.
    """
    emb = np.ascontiguousarray(net["emb"][seen].transpose(0, 2, 1))
    x = np.matmul(net["win"].T, emb)
    x += net["bias"][:, None]
    return emb, x


def _steps(net: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray, kept: bool = True):
    """The unit's run over a window from state ``h`` (feature x lanes): what it saw and gave at each time.

    ``x`` as ``_inputs`` gives it; ``keep`` (time x lanes) is 0 where a state is cleared first. Unless
    ``kept``, only the states are of every time, the rest is of the last one.
    """
    size = h.shape[0]
    rec = np.ascontiguousarray(net["rec"].T)
    rec[: 2 * size] *= -1  # a gate is 1 / (1 + exp(-x))
    minus = -x[:, : 2 * size]
    n, width = len(x) if kept else 1, x.shape[2]
    g, gates, before, cand = (np.empty((n, w, width), np.float32) for w in (3 * size, 2 * size, size, size))
    states = np.empty((len(x), size, width), np.float32)
    with np.errstate(over="ignore"):  # beyond the range of exp a gate is 0
        for t in range(len(x)):
            at, s = t if kept else 0, states[t]
            b, a, c, own = before[at], gates[at], cand[at], g[at]
            np.multiply(h, keep[t], out=b)
            np.matmul(rec, b, out=own)
            np.add(minus[t], own[: 2 * size], out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            np.multiply(a[:size], own[2 * size:], out=c)
            c += x[t, 2 * size:]
            np.tanh(c, out=c)
            np.subtract(b, c, out=s)
            s *= a[size:]
            s += c
            h = s
    return before, gates, g[:, 2 * size:], cand, states


def _gradients(net: dict, v: Vocabulary, seen: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss of one window (time x lanes), and the state after it."""
    n_steps, lanes = seen.shape
    size = h.shape[1]
    keep = (seen != 0).astype(np.float32)  # after an end a new document begins
    emb, x = _inputs(net, seen)
    before, gates, inner, cand, states = _steps(net, x, keep, h.T)
    cls, place = v.split(target.ravel())
    s = states.transpose(0, 2, 1).reshape(-1, size)
    scale = np.float32(1 / len(s))
    grads = {k: np.zeros_like(net[k]) for k in ("word", "word_bias")}
    d = _softmax(s @ net["cls"] + net["cls_bias"])
    d[np.arange(len(s)), cls] -= 1
    d *= scale
    grads["cls"], grads["cls_bias"] = s.T @ d, d.sum(axis=0)
    ds = d @ net["cls"].T
    for c, rows, used in _padded(cls, place):
        own = s[rows]  # class x row x feature
        d = np.matmul(own, net["word"][c])
        d += net["word_bias"][c][:, None]
        d = d.reshape(-1, d.shape[-1])
        _softmax(d)
        d[np.arange(len(d)), place[rows].ravel()] -= 1
        d *= (scale * used).reshape(-1, 1)
        d = d.reshape(*rows.shape, -1)
        grads["word"][c], grads["word_bias"][c] = np.matmul(own.transpose(0, 2, 1), d), d.sum(axis=1)
        ds[rows[used]] += np.matmul(d, net["word"][c].transpose(0, 2, 1))[used]
    ds = np.ascontiguousarray(ds.reshape(n_steps, lanes, size).transpose(0, 2, 1))
    r, z = gates[:, :size], gates[:, size:]
    # what a state's gradient is multiplied by, for all times at once
    to_cand = (1 - z) * (1 - cand * cand)
    to_reset, to_update = inner * r * (1 - r), (before - cand) * z * (1 - z)
    dg, dn = np.empty_like(x), np.empty_like(cand)
    dh = np.zeros((size, lanes), np.float32)
    for t in range(n_steps - 1, -1, -1):
        dh += ds[t]
        out, own = dg[t], dn[t]
        np.multiply(dh, to_cand[t], out=own)
        np.multiply(own, to_reset[t], out=out[:size])
        np.multiply(dh, to_update[t], out=out[size: 2 * size])
        np.multiply(own, r[t], out=out[2 * size:])
        dh *= z[t]
        dh += net["rec"] @ out
        dh *= keep[t]
    rows = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)  # noqa: E731  feature x token
    dx = rows(dg)
    grads["rec"] = rows(before) @ dx.T
    dx[2 * size:] = rows(dn)
    grads["win"], grads["bias"] = rows(emb) @ dx.T, dx.sum(axis=1)
    flat = seen.ravel()
    order = np.argsort(flat.astype(np.min_scalar_type(len(net["emb"]))), kind="stable")
    flat = flat[order]
    begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    grads["emb"] = np.zeros_like(net["emb"])
    grads["emb"][flat[begin]] = np.add.reduceat((dx.T @ net["win"].T)[order], begin, axis=0)
    return grads, np.ascontiguousarray(states[-1].T)


def _padded(cls: np.ndarray, place: np.ndarray):
    """(classes, rows as class x row, which of them are not padding): as ``_by_class``, classes of about as many rows together."""
    rows = np.flatnonzero(place >= 0)
    rows = rows[np.argsort(cls[rows], kind="stable")]
    found, begin, n = np.unique(cls[rows], return_index=True, return_counts=True)
    size = bucket(n - 1)
    for b in np.unique(size).tolist():
        mine = np.flatnonzero(size == b)
        at = np.arange(int(n[mine].max()))
        used = at < n[mine][:, None]
        yield found[mine], rows[np.where(used, begin[mine][:, None] + at, begin[mine][:, None])], used


def score_documents(net: dict, v: Vocabulary, ids: np.ndarray, ends: np.ndarray, lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of every token of ``ids``; documents end before each of ``ends``.

    Documents are dealt to lanes, the longest first, and follow each other
    there; ``lanes`` x ``window`` tokens are scored at a time, so memory does
    not depend on a document's length.
    """
    out = np.zeros(len(ids))
    if not len(ids):
        return out
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    lanes = min(lanes, len(ends))
    heap, dealt = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for doc in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        dealt[lane].append(doc)
        heapq.heappush(heap, (load + int(sizes[doc]), lane))
    dealt.sort(key=lambda docs: -int(sizes[docs].sum()))
    flat = np.concatenate([np.arange(begins[d], ends[d]) for docs in dealt for d in docs])
    length = np.array([sizes[docs].sum() for docs in dealt])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    seen = np.concatenate([[0], ids[:-1]])
    first = np.zeros(len(ids), dtype=bool)
    first[begins] = True
    seen[first] = 0  # a document begins as after an end
    cls, place = v.split(ids)
    h = np.zeros((net["rec"].shape[0], lanes), np.float32)
    t0 = 0
    while t0 < length[0]:
        k = int(np.searchsorted(-length, -t0, side="left"))  # lanes that are not over; they are sorted
        # the fewer lanes a long document has beside it, the longer the window: as many tokens at a time
        time = t0 + np.arange(min(max(window, lanes * window // k), int(length[0]) - t0))[:, None]
        valid = time < length[:k]
        at = flat[np.where(valid, start[:k] + time, 0)]
        _, x = _inputs(net, seen[at])
        states = _steps(net, x, (~first[at]).astype(np.float32), h[:, :k], kept=False)[-1]
        h = states[-1]
        told = at[valid]
        out[told] = log_likelihood(net, states.transpose(0, 2, 1)[valid], cls[told], place[told])
        t0 += len(time)
    return out


# ---- Spark ---------------------------------------------------------------------------------

def _sliced(slice_bytes: int):
    def run(batches):
        numbers = slice_numbers()
        for part in slices(batches, "text", slice_bytes):
            local = Numbers()
            texts = [(raw or b"").lower().split() for raw in raw_texts(part.column("text"))]
            docs = [np.fromiter(map(local.__getitem__, words), np.int64, len(words)) for words in texts]
            held = part.column("held_out").to_pylist()
            stream = np.concatenate([np.zeros(0, np.int64), *docs])
            learned = np.concatenate([np.zeros(0, np.int64), *(d for d, out in zip(docs, held) if not out)])
            # frequent words get small numbers: the stream packs better
            order = np.argsort(-np.bincount(stream, minlength=len(local)), kind="stable")
            number = np.empty(len(local), dtype=np.int64)
            number[order] = np.arange(len(local))
            words = list(local)
            yield pa.RecordBatch.from_pylist([{
                "slice": next(numbers), "doc_id": part.column("doc_id"), "held_out": held, "n_words": [len(d) for d in docs],
                "stream": pack(number[stream]), "word": list(map(words.__getitem__, order.tolist())),
                "n": np.bincount(learned, minlength=len(local))[order],
            }], schema=_ARROW)

    return run


_ARROW = pa.schema([("slice", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                    ("n_words", pa.list_(pa.int32())), ("stream", pa.binary()), ("word", pa.list_(pa.binary())),
                    ("n", pa.list_(pa.int64()))])


class _Slice:
    """One stored slice: its documents' tokens (the end is one), with each token's count and rank."""

    def __init__(self, row: dict, end_count: int):
        flat = lambda c: row[c].values.to_numpy() if row[c].is_valid else np.zeros(0, np.int64)
        stream, sizes = unpack(row["stream"].as_py()), flat("n_words").astype(np.int64)
        count, rank = (np.append(flat(c).astype(np.int64), x) for c, x in (("count", end_count), ("rank", 0)))
        self.ends = np.cumsum(sizes + 1)
        local = np.full(int(self.ends[-1]) if len(sizes) else 0, len(count) - 1, dtype=np.int64)
        words = np.ones(len(local), dtype=bool)
        words[self.ends - 1] = False
        local[words] = stream
        # what depends on the word alone is reckoned once a word, then dealt to the tokens
        self.count, self.rank, self.local = count, rank, local
        self.held_out = row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool)
        self.sizes = sizes + 1

    def training_ids(self, v: Vocabulary) -> np.ndarray:
        return v.of_words(self.count, self.rank, less=1)[self.local[np.repeat(~self.held_out, self.sizes)]]


def _each_slice(batches, end_count: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield row, _Slice(row, end_count)


def _mean(df: DataFrame, fan_in: int = 32) -> bytes | None:
    """Weighted mean of the rows (number, weight, net), by groups of ``fan_in`` rows at a time."""
    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        weight = sum(r["weight"] for r in rows)
        total = sum(np.frombuffer(r["net"], "<f4").astype(np.float64) * r["weight"] for r in rows) / weight
        return pa.table([pa.array([rows[0]["number"]], pa.int64()), pa.array([weight], pa.float64()),
                         pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["number", "weight", "net"])

    df = written(df.where("weight > 0"), "lm-learners")
    n = df.count()
    while n > 1:
        groups = -(-n // fan_in)
        df = df.groupBy(F.pmod(F.xxhash64("number"), F.lit(groups))).applyInArrow(lambda t: add(t), df.schema)
        df = written(df, "lm-mean")
        n = df.count() if groups > 1 else 1
    row = df.first()
    return None if row is None else bytes(row.net)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = 32,
          class_words: int = 64, hidden: int = 24, embedding: int = 24, start_steps: int = 240, start_slices: int = 4,
          rate: float = 0.015, slice_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learned from the rows for which ``held_out`` is false: counts from all of
    them; the network from ``start_steps`` windows of 64 x 32 tokens of
    ``start_slices`` slices, then from every training token of every slice.
    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one
    end. ``n_known`` counts tokens with a training count, ``train_tokens`` is
    their number N in the corpus; ``base_score`` sums log10((c + 1) / (N + V + 1)),
    ``score`` the network's log10 probabilities.

    Defined cases: a null or empty text is its end alone; a null id is an id
    like any other, a null ``held_out`` is false; invalid UTF-8 is taken
    by bytes; repeated rows are documents of their own, also in the counts;
    of words with equal counts the smaller bytes come first in the shortlist;
    without training rows every count is 0 and the network is as it began;
    other columns are ignored; an empty table gives no rows. A text of
    any length is one row of one slice, scored word after word in one lane.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                      F.col(text_col).cast("string").cast("binary").alias("text"))
    table = written(own.mapInArrow(_sliced(slice_bytes), _SLICES), "lm-slices")
    ends = table.select(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    keys = keys_of_slices(table, "word", "n")
    counts = written(keys.groupBy("key").agg(F.sum("n").alias("count")), "lm-counts")
    size = counts.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    total, distinct = (size.n or 0) + ends, size.v + (1 if ends else 0)
    listed = counts.where("count > 1").orderBy(F.desc("count"), "key").limit(classes * class_words - 1).collect()
    ranks = spark.createDataFrame([(r.key, i + 1) for i, r in enumerate(listed)], "key binary, rank int")
    figures = counts.join(F.broadcast(ranks), "key", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    bits = lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0)
    rare = figures.where("rank < 0 AND count > 0")
    masses = (rare.groupBy(bits(F.col("count")).alias("b"), bits(F.col("count") - 1).alias("less"))
              .agg(F.sum("count").alias("n")).collect())  # at most two rows for each bit of a long
    sums = [{}, {}]
    for r in masses:
        for own_sum, b in zip(sums, (r.b, r.less)):
            own_sum[b] = own_sum.get(b, 0) + r.n
    v = Vocabulary([ends, *(r["count"] for r in listed)], *sums, class_words)
    back = figures_back(table.drop("word", "n"), keys, figures, ["count", "rank"])
    prepared = written(back, "lm-prepared")
    for done in (table, counts):
        drop_scratch(done)
    first = new_network(v, hidden, embedding)

    def started(table: pa.Table) -> pa.Table:
        rows = sorted(_each_slice(table.to_batches(), ends), key=lambda x: x[0]["slice"].as_py())
        stream = np.concatenate([np.zeros(0, np.int64), *(s.training_ids(v) for _, s in rows)])
        net = {k: x.copy() for k, x in first.items()}
        train(net, v, stream, start_steps, rate)
        return pa.table([pa.array([to_bytes(net)], pa.binary())], names=["net"])

    chosen = prepared.select("slice").orderBy(F.xxhash64("slice"), "slice").limit(start_slices).collect()
    sample = prepared.where(F.col("slice").isin([r.slice for r in chosen]))
    begun = sample.groupBy(F.pmod("slice", F.lit(1))).applyInArrow(lambda t: started(t), "net binary").first()
    sent = spark.sparkContext.broadcast(bytes(begun.net) if begun else to_bytes(first))  # some hundred KB

    def learn(batches):
        for row, s in _each_slice(batches, ends):
            net, ids = from_bytes(sent.value, first), s.training_ids(v)
            used = train(net, v, ids, None, rate / 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["slice"].as_py()], pa.int64()), pa.array([float(used)], pa.float64()),
                 pa.array([to_bytes(net)], pa.binary())], names=["number", "weight", "net"])

    learned = _mean(prepared.mapInArrow(learn, "number bigint, weight double, net binary"))
    final = spark.sparkContext.broadcast(learned or sent.value)
    base = np.log10(total + distinct + 1)

    def run(batches):
        net = from_bytes(final.value, first)
        for row, s in _each_slice(batches, ends):
            logs = score_documents(net, v, v.of_words(s.count, s.rank)[s.local], s.ends)
            logs += v.share(s.count, s.rank)[s.local]
            logs /= np.log(10)
            of_docs = lambda x: np.add.reduceat(x, s.ends - s.sizes) if len(x) else x
            yield pa.RecordBatch.from_arrays(
                [row["doc_id"].values, row["held_out"].values, pa.array(s.sizes), pa.array(of_docs((s.count > 0).astype(np.int64)[s.local])),
                 pa.array(np.full(len(s.sizes), total, np.int64)), pa.array(of_docs((np.log10(s.count + 1.0) - base)[s.local])),
                 pa.array(of_docs(logs))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return prepared.mapInArrow(run, _RESULT)
