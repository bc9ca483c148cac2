"""Byte-level BPE: speculate with greedy longest matches, verify pairs, merge exactly what fails.

A word's merge result is the one token sequence in which every adjacent
pair is compatible: re-merging the bytes of the two tokens gives the same two
tokens. So each distinct word is first cut greedily into longest matches,
all adjacent pairs of all new words are tested together in numpy, and only
words with an incompatible pair run the exact merge loop.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from crateflow.llm.common import extended, give_back, slices, utf8_buffers, with_text, word_hashes

#: Fixed value: the published pre-token pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << 62


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Cache:
    """Encoded units: sorted hashes (a second hash checks them) and the range of each unit's ids."""

    def __init__(self):
        self.h = self.check = np.zeros(0, dtype=np.uint64)
        self.begin = self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of each unit; begin -1 where it is not here."""
        if not len(self.h):
            return np.full(len(h), -1), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        here = (self.h[at] == h) & (self.check[at] == check)
        return np.where(here, self.begin[at], -1), np.where(here, self.size[at], 0)

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        begin = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(h := np.concatenate([self.h, h]), kind="stable")
        self.h, self.check = h[order], np.concatenate([self.check, check])[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON form."""

    CACHED_UNITS = 100_000  # entries in each of the two generations of the cache
    LONG = 48  # bytes; a longer word goes through the loops that have no lockstep

    def __init__(self, source: bytes):
        spec = json.loads(source)
        chars = _byte_of_char()
        as_bytes = lambda s: bytes(map(chars.__getitem__, s))
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = 1 + max(*vocab.values(), *self.special.values(), 0)
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.ids = {t: i for t, i in vocab.items() if t}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)])
        # a token's order is the rank of the merge that makes it; single bytes come before all merges
        self.order = np.zeros(size, dtype=np.int64)
        self.order[self.byte_id] = np.arange(256)
        self.left, self.right = np.arange(size), np.arange(size)
        merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"], 256):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            a, b, c = self.ids[a], self.ids[b], self.ids[a + b]
            if merge.setdefault((a, b), (rank, c))[0] == rank and self.left[c] == c:
                self.left[c], self.right[c], self.order[c] = a, b, rank
        pairs = np.array([a << 32 | b for a, b in merge], dtype=np.int64)
        made = np.array(list(merge.values()), dtype=np.int64)
        at = np.argsort(pairs)
        self.pairs, self.rank, self.result = pairs[at], made[at, 0], made[at, 1]
        del spec, vocab, merge, pairs, made  # a worker that loads the file stands next to the executor's heap
        self._index_prefixes()
        self.token_bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.token_size = np.fromiter(map(len, self.token), dtype=np.int64, count=size)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.pattern = regex.compile(PATTERN)
        self.special_bytes = (re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True)))
                              if self.special else None)
        self.cache = self.older = _Cache()
        self.checked = self.merged_exactly = 0  # words speculated on, and those that failed the check
        give_back()

    def __getstate__(self) -> dict:
        """What encoding and decoding read, a few MB of arrays: no dictionary or list of tokens, no cached units."""
        left_out = ("token", "ids", "merge", "cache", "older")
        return {k: v for k, v in self.__dict__.items() if k not in left_out}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.cache = self.older = _Cache()

    @functools.cached_property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, result) of each pair of ids that merges: for long words, made when the first one comes."""
        pairs = zip((self.pairs >> 32).tolist(), (self.pairs & 0xFFFFFFFF).tolist())
        return dict(zip(pairs, zip(self.rank.tolist(), self.result.tolist())))

    def _index_prefixes(self) -> None:
        """The tree of token prefixes as a sorted edge list (node, byte) -> node, and the token each node completes."""
        edges, children, completes = array("q"), array("q"), array("q", [-1])
        last, path = b"", [0]  # the token before, and the nodes of its prefixes
        for t in sorted(self.ids):
            # in this order a prefix that is known is one of the token before
            n = next((i for i, (a, b) in enumerate(zip(t, last)) if a != b), min(len(t), len(last)))
            del path[n + 1:]
            for byte in t[n:]:
                edges.append(path[-1] << 8 | byte)
                path.append(len(completes))
                children.append(path[-1])
                completes.append(-1)
            completes[path[-1]] = self.ids[t]
            last = t
        edges, children = np.array(edges, dtype=np.int64), np.array(children, dtype=np.int64)
        order = np.argsort(edges)
        self.edge, self.child, self.completes = edges[order], children[order], np.array(completes, dtype=np.int64)

    # -- words ------------------------------------------------------------------

    def speculate(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Greedy longest matches of all words in lockstep: for each byte the token that begins there, or -1."""
        begins = np.full(len(data), -1, dtype=np.int64)
        first, stop, at = starts.copy(), stops.copy(), starts.copy()
        node, best, best_stop = (np.zeros(len(starts), dtype=np.int64) for _ in range(3))
        while len(first):
            key = node << 8 | data[np.minimum(at, len(data) - 1)]
            where = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            grows = (self.edge[where] == key) & (at < stop)
            node = np.where(grows, self.child[where], 0)
            at = at + grows
            whole = grows & (self.completes[node] >= 0)
            best, best_stop = np.where(whole, self.completes[node], best), np.where(whole, at, best_stop)
            ended = ~grows
            begins[first[ended]] = best[ended]
            first, at = np.where(ended, best_stop, first), np.where(ended, best_stop, at)
            on = first < stop
            if not on.all():
                first, stop, at, node, best, best_stop = (x[on] for x in (first, stop, at, node, best, best_stop))
        return begins

    def _across(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of merging x and y; rank _NONE where no merge joins them."""
        key = x << 32 | y
        where = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[where] == key, self.rank[where], _NONE), self.result[where]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are merged.

        From the finished tokens, merges are undone from the latest to the
        earliest, on the side that was made later; a merge across the border
        that would have come before the one just undone shows a conflict.
        """
        ok = np.ones(len(a), dtype=bool)
        x, y, at = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(at):
            bad = self._across(x, y)[0] < limit
            ok[at[bad]] = False
            on_x = self.order[x] > self.order[y]
            can_x, can_y = self.right[x] != x, self.left[y] != y
            undo_x = can_x & (on_x | ~can_y)
            undo_y = can_y & ~undo_x
            limit = np.where(undo_x, self.order[x], self.order[y] + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            on = ~bad & (undo_x | undo_y)
            x, y, at, limit = x[on], y[on], at[on], limit[on]
        return ok

    def merge_exactly(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, owner) of words by the merges in their order: in each round the least, leftmost pair of every word."""
        ids = self.byte_id[data[ragged(starts, stops - starts)]]
        owner = np.repeat(np.arange(len(starts)), stops - starts)
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rank = np.full(len(ids), _NONE)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._across(ids[inner], ids[inner + 1])[0]
        while len(ids):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(heads, append=len(ids))
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done.append((ids[over], owner[over]))
                keep = ~over
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                least, sizes = least[least != _NONE], sizes[least != _NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]  # the leftmost of each word
            ids[hit] = self._across(ids[hit], ids[hit + 1])[1]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            after = moved + 1 < len(ids)
            same = np.zeros(len(moved), dtype=bool)
            same[after] = owner[moved[after] + 1] == owner[moved[after]]
            rank[moved] = _NONE
            rank[moved[same]] = self._across(ids[moved[same]], ids[moved[same] + 1])[0]
            left = moved[moved > 0]
            left = left[owner[left - 1] == owner[left]]
            rank[left - 1] = self._across(ids[left - 1], ids[left])[0]
        ids, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one word of any length, with a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := self.merge.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word): speculate, verify all adjacent pairs at once, merge exactly what failed."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        stops = np.cumsum(sizes)
        starts = stops - sizes
        short = np.flatnonzero(sizes <= self.LONG)
        begins = self.speculate(data, starts[short], stops[short])
        places = np.flatnonzero(begins >= 0)
        flat, owner = begins[places], np.searchsorted(starts, places, side="right") - 1
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        failed = np.unique(owner[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]])
        good = np.ones(len(raw), dtype=bool)
        good[failed] = False
        keep = good[owner]
        exact, whose = self.merge_exactly(data, starts[failed], stops[failed])
        flat, owner = [flat[keep], exact], [owner[keep], failed[whose]]
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            own = np.array(self.merge_long(raw[i]), dtype=np.int64)
            flat.append(own)
            owner.append(np.full(len(own), i))
        flat, owner = np.concatenate(flat), np.concatenate(owner)
        self.checked += len(short)
        self.merged_exactly += len(failed)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(raw))

    # -- texts ------------------------------------------------------------------

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are a space after a character other than white space: a pre-token always begins there.

        Where the character before cannot be told from white space by its
        last bytes, there is no cut; longer units are as right as short ones.
        """
        cut = data == 32
        cut[0] = False
        at = np.flatnonzero(cut)
        last = data[at - 1]
        plain = (last > 32) & (last < 128)
        second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        other = (last >= 128) & ~((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) & ~((third >= 0xE1) & (third <= 0xE3))
        cut[at] = plain | other
        return cut

    def _pieces(self, unit: str) -> list[str]:
        """The pre-tokens of a unit."""
        if unit[:1] == " ":
            if unit[1:].isalpha():
                return [unit]
            if unit[-1] in ",." and unit[1:-1].isalpha():
                return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def _encode_cut(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each entry) of lists of pre-tokens."""
        flat = list(itertools.chain.from_iterable(cut))
        index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids, sizes = self.encode_words(index)
        which = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        total = np.concatenate([[0], np.cumsum(sizes[which])])
        ends = np.cumsum(n)
        return ids[ragged((np.cumsum(sizes) - sizes)[which], sizes[which])], total[ends] - total[ends - n]

    def _units(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each unit) by the cache; new units are encoded first."""
        h = word_hashes(data, starts, stops)
        check = word_hashes(data, starts, stops, salt=1)
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        check, starts, stops = check[first], starts[first], stops[first]
        begin, size = self.cache.find(h, check)
        if (missing := np.flatnonzero(begin < 0)).size:
            if len(self.cache.h) > self.CACHED_UNITS:
                self.cache, self.older = _Cache(), self.cache
                missing = np.arange(len(h))
            begin, size = self.older.find(h[missing], check[missing])
            old = begin >= 0
            self.cache.add(h[missing[old]], check[missing[old]], self.older.ids[ragged(begin[old], size[old])], size[old])
            new = missing[~old]
            raw = data.tobytes()
            cut = [self._pieces(raw[i:j].decode("utf-8", "replace")) for i, j in zip(starts[new].tolist(), stops[new].tolist())]
            self.cache.add(h[new], check[new], *self._encode_cut(cut))
            begin, size = self.cache.find(h, check)
        begin, size = begin[back], size[back]
        return self.cache.ids[ragged(begin, size)], size

    def encode_buffer(self, data: np.ndarray, offsets: np.ndarray, window: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each row) of texts in one buffer, window by window."""
        ids, counts, a = [], np.zeros(len(offsets) - 1, dtype=np.int64), 0
        while a < len(data):
            size = window
            while True:
                b = min(len(data), a + size)
                here = data[a:b]
                begins = self._cuts(here)
                begins[offsets[(offsets >= a) & (offsets < b)] - a] = True
                begins[0] = True
                starts = np.flatnonzero(begins)
                if b == len(data) or len(starts) > 1:
                    break
                size *= 2  # one unit longer than the window
            if b < len(data):
                starts, b = starts[:-1], a + int(starts[-1])
            stops = np.append(starts[1:], b - a)
            flat, n = self._units(here, starts, stops)
            ids.append(flat)
            rows = np.searchsorted(offsets, starts + a, side="right") - 1
            counts += np.bincount(rows, weights=n, minlength=len(counts)).astype(np.int64)
            a = b
        return (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)), counts

    def encode_texts(self, column: pa.Array, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text) of a column of whole texts; a null is empty.

        ``special``: the strings of special tokens become their ids, and what
        is before and after them is encoded apart.
        """
        data, offsets = utf8_buffers(column)
        raw = data.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            mended = [raw[i:j].decode("utf-8", "replace") for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
            data, offsets = utf8_buffers(pa.array(mended, pa.large_string()))
            raw = data.tobytes()
        found = [m.span() for m in self.special_bytes.finditer(raw)] if special and self.special_bytes else []
        edges = set(offsets.tolist())
        found = [(i, j) for i, j in found if not any(k in edges for k in range(i + 1, j))]
        if not found:
            return self.encode_buffer(data, offsets)
        # special strings are parts of their own
        parts = np.unique(np.concatenate([offsets, np.array(found).ravel()]))
        ids, n = self.encode_buffer(data, parts)
        at = np.searchsorted(parts, [i for i, _ in found])
        begin = np.cumsum(n) - n
        replaced = np.zeros(len(n), dtype=bool)
        replaced[at] = True
        own = np.array([self.special[raw[i:j].decode()] for i, j in found], dtype=np.int32)
        pieces = [ids[i: i + k] for i, k in zip(begin.tolist(), n.tolist())]
        for i, token in zip(at.tolist(), own):
            pieces[i] = np.array([token], dtype=np.int32)
        sizes = np.where(replaced, 1, n)
        rows = np.searchsorted(offsets, parts[:-1], side="right") - 1
        return np.concatenate(pieces), np.bincount(rows, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        return self.encode_texts(pa.array([text]), special)[0]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.token_bytes[ragged(self.token_start[ids], self.token_size[ids])].tobytes().decode("utf-8", "replace")


def shared_model(spark, path: str, most: int = 64 << 20):
    """A function that gives the encoder inside a task: it is built once on the driver and its arrays are broadcast."""
    with open(path, "rb") as f:
        source = f.read()
    if len(source) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    sent = spark.sparkContext.broadcast(ByteBpe(source))
    return lambda: sent.value


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", special: bool = True,
                  ids_col: str = "token_ids", decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the token ids (array<int>) of each whole text and the text decoded from them.

    Defined cases: a null or empty text has no ids and decodes to an empty
    text; invalid UTF-8 is read with replacement characters; the new columns
    replace columns of the same names, all others pass through; repeated
    rows are encoded each; an empty table gives no rows.
    """
    model = shared_model(docs.sparkSession, path)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    carried, name = with_text(docs, kept, text_col)

    def run(batches):
        bpe = model()
        for part in slices(batches, name, 1 << 20):
            flat, counts = bpe.encode_texts(part.column(name), special)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = [bpe.decode(flat[i:j]) for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array(decoded, pa.string())], names=[*kept, ids_col, decoded_col])

    schema = extended(docs, kept, f"`{ids_col}` array<int>, `{decoded_col}` string")
    return carried.mapInArrow(run, schema)
