"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it.

A document's pre-tokens are kept in leaves of consecutive ones; a leaf knows
its characters and its tokens, and the tree above holds the sums. A leaf
begins with a space after a character other than white space, where
a pre-token begins whatever comes before or after. An edit therefore re-encodes
the leaves it touches and those whose border character it touches, and all
other counts stand; the sums above the changed leaves are then updated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.bpe import ByteBpe, shared_model
from crateflow.llm.common import extended, raw_texts, slices, utf8_buffers, with_text

EDITS = "array<struct<start:int,stop:int,insert:string>>"


class SumTree:
    """Sums of (characters, tokens) over leaves; leaf i is node ``width + i``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        self.sums = []
        for values in (chars, tokens):
            level = np.zeros(self.width, dtype=np.int64)
            level[: len(values)] = values
            levels = [level]
            while len(level) > 1:
                level = level[0::2] + level[1::2]
                levels.append(level)
            self.sums.append([0, *np.concatenate(levels[::-1]).tolist()])
        self.chars, self.tokens = self.sums

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, where it begins): the leaf that holds character ``at``; the last one with characters for the end."""
        node, before = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more = (chars - self.chars[node], tokens - self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2


class EditedDocument:
    """A text with its tree; edits change the text at once, counts when ``settle`` gets those of the changed leaves."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text = text
        self.tree = SumTree(chars, tokens)
        self.dirty: set[int] = set()
        self.split: dict[int, tuple[list[int], list[int]]] = {}  # changed leaf -> the leaves that replace it

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace characters [start, stop) of the text as it is now; the range is clipped to it."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if start == stop and not insert:
            return
        tree = self.tree
        # the first leaf that begins before the edit, the last one whose end is untouched with the character before it
        first, begin = tree.find(max(start - 1, 0))
        last, last_begin = tree.find(min(stop, size)) if size else (0, 0)
        if last_begin >= stop and last > first and last_begin - 1 >= stop:
            last, last_begin = tree.find(last_begin - 1)
        total = 0
        for leaf in range(first, last + 1):
            total += tree.chars[leaf + tree.width]
            tree.put(leaf, 0, 0)
            self.dirty.discard(leaf)
        self.text = self.text[:start] + insert + self.text[stop:]
        tree.put(first, total + len(insert) - (stop - start), 0)
        self.dirty.add(first)

    def changed(self) -> list[tuple[int, str]]:
        """(leaf, text) of the leaves to encode again."""
        out, width = [], self.tree.width
        if not self.dirty:
            return out
        begin = 0
        for leaf in sorted(self.dirty):
            begin = self._begin(leaf)
            out.append((leaf, self.text[begin: begin + self.tree.chars[leaf + width]]))
        return out

    def _begin(self, leaf: int) -> int:
        node, before = leaf + self.tree.width, 0
        while node > 1:
            if node & 1:
                before += self.tree.chars[node - 1]
            node //= 2
        return before

    def settle(self, counts: dict[int, tuple[list[int], list[int]]]) -> None:
        """Take the leaves (characters, tokens) into which each changed leaf was cut."""
        for leaf, (chars, tokens) in counts.items():
            self.tree.put(leaf, self.tree.chars[leaf + self.tree.width], sum(tokens))
            self.split[leaf] = (chars, tokens)
        self.dirty.clear()

    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold any; a changed leaf as the leaves it was cut into."""
        w, chars, tokens = self.tree.width, [], []
        for leaf, (c, t) in enumerate(zip(self.tree.chars[w:], self.tree.tokens[w:])):
            if leaf in self.split:
                chars += self.split[leaf][0]
                tokens += self.split[leaf][1]
            elif c:
                chars.append(c)
                tokens.append(t)
        return chars, tokens


def _leaves(bpe: ByteBpe, column: pa.Array, per_leaf: int):
    """Leaf sizes of whole texts: (leaves of each row, characters of each leaf, tokens of each leaf)."""
    data, offsets = utf8_buffers(column)
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = bpe._cuts(data)
    starts = np.flatnonzero(begins)
    heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts = np.union1d(starts, heads)
    # every per_leaf-th unit of a row begins a leaf
    row = np.searchsorted(heads, starts, side="right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, heads)[row]
    starts = starts[nth % per_leaf == 0]
    bounds = np.append(starts, len(data))
    _, tokens = bpe.encode_buffer(data, bounds)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return np.bincount(owner, minlength=len(offsets) - 1), np.diff(chars[bounds]), tokens


def _valid(column: pa.Array) -> pa.Array:
    """Texts as valid UTF-8, nulls as empty ones."""
    return pa.array([(t or b"").decode("utf-8", "replace") for t in raw_texts(column)], pa.large_string())


def index(docs: DataFrame, path: str, text_col: str = "text", per_leaf: int = 16) -> DataFrame:
    """``docs`` with its state: ``leaf_chars``, ``leaf_tokens`` and their total ``n_tokens``.

    Texts are encoded as ordinary text: strings of special tokens too.
    Null and empty texts have no leaves and no tokens.
    """
    model = shared_model(docs.sparkSession, path)
    new = ("leaf_chars", "leaf_tokens", "n_tokens")
    kept = [c for c in docs.columns if c not in new]
    carried, name = with_text(docs, kept, text_col)

    def run(batches):
        bpe = model()
        for part in slices(batches, name, 1 << 20):
            n, chars, tokens = _leaves(bpe, _valid(part.column(name)), per_leaf)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            total = np.concatenate([[0], np.cumsum(tokens)])
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *lists,
                                              pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=[*kept, *new])

    schema = extended(docs, kept, "leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint")
    return carried.mapInArrow(run, schema)


def with_edits(state: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """``state`` with each document's edits (doc_id, seq, start, stop, insert), in the order of ``seq``."""
    own = edits.groupBy(F.col(id_col).alias("__id")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "insert"))).alias("__edits"))
    out = state.join(own, F.col(id_col) == F.col("__id"), "left")
    slim = F.transform("__edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"),
                                                     e["insert"].cast("string").alias("insert")))
    return out.withColumn(edits_col, slim).drop("__id", "__edits")


def apply_edits(state: DataFrame, path: str, text_col: str = "text", edits_col: str = "edits", per_leaf: int = 16) -> DataFrame:
    """``state`` (see ``index``) after the edits in ``edits_col``: text, leaves and ``n_tokens`` are the new ones.

    Each edit replaces characters [start, stop) of the text as the edits
    before it left it. ``reencoded_chars`` is how many characters were
    encoded again. Defined cases: a null text is edited as an empty one (and
    stays null without an effective edit); null edits, or none, change nothing; ranges are clipped to the text, a
    null bound is 0 for start and the start for stop, a null insert is empty; repeated rows are edited
    alike; other columns pass through; an empty table gives no rows.
    """
    model = shared_model(state.sparkSession, path)
    mine = (text_col, edits_col, "leaf_chars", "leaf_tokens", "n_tokens", "reencoded_chars")
    kept = [c for c in state.columns if c not in mine]

    def run(batches):
        bpe = model()
        for part in slices(batches, "__own_text", 1 << 20):
            docs, where, regions = [], [], []
            columns = (part.column(c).to_pylist() for c in ("__own_text", "leaf_chars", "leaf_tokens", edits_col))
            for text, chars, tokens, edits in zip(*columns):
                doc = EditedDocument((text or b"").decode("utf-8", "replace"), np.array(chars or [], np.int64),
                                     np.array(tokens or [], np.int64))
                for e in edits or []:
                    if e is not None:
                        start = e["start"] or 0
                        doc.edit(start, start if e["stop"] is None else e["stop"], e["insert"] or "")
                for leaf, region in doc.changed():
                    where.append((len(docs), leaf))
                    regions.append(region)
                docs.append(doc)
            n, chars, tokens = _leaves(bpe, pa.array(regions, pa.large_string()), per_leaf)
            ends = np.cumsum(n).tolist()
            chars, tokens = chars.tolist(), tokens.tolist()
            counts: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
            for (row, leaf), a, b in zip(where, [0, *ends], ends):
                counts.setdefault(row, {})[leaf] = (chars[a:b], tokens[a:b])
            again = np.zeros(len(docs), dtype=np.int64)
            for (row, _), region in zip(where, regions):
                again[row] += len(region)
            for row, own in counts.items():
                docs[row].settle(own)
            states = [d.state() for d in docs]
            was_null = part.column("__own_text").is_null().to_pylist()
            texts = [None if null and not d.text else d.text for d, null in zip(docs, was_null)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(texts, pa.string()),
                 pa.array([s[0] for s in states], pa.list_(pa.int32())), pa.array([s[1] for s in states], pa.list_(pa.int32())),
                 pa.array([d.tree.tokens[1] for d in docs], pa.int64()), pa.array(again)],
                names=[*kept, text_col, "leaf_chars", "leaf_tokens", "n_tokens", "reencoded_chars"])

    schema = extended(state, kept, f"`{text_col}` string, leaf_chars array<int>, leaf_tokens array<int>, "
                                   "n_tokens bigint, reencoded_chars bigint")
    return (state.select(*kept, F.col(text_col).cast("string").cast("binary").alias("__own_text"), "leaf_chars", "leaf_tokens",
                         F.col(edits_col).cast(EDITS).alias(edits_col)).mapInArrow(run, schema))
