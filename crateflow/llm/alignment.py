"""Cross-tokenizer alignment: byte offsets where the tokens of two tokenizers both end cut them into groups.

A text's cumulative token ends are keys of two dictionaries, end to index;
the intersection of their key sets, sorted, slices both id lists into groups,
and every common end links the tokens that end there. Neither tokenizer has a
token that reaches over a space after a character other than white space (the
pre-token pattern of the one and the pieces of the other see to that; the
pieces are tested when the model is loaded). So a text is cut there, and each
distinct unit of a slice is encoded and aligned once. How often an id pair is
linked in the corpus is counted by Spark over the slices' distinct pairs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.bpe import PATTERN, _byte_of_char
from crateflow.llm.common import raw_texts, slices, written
from crateflow.llm.slice_table import Numbers, figures_back, keys_of_slices, pack, pack_lines, slice_numbers, unpack, unpack_lines

SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")  # B encodes nothing as nothing, so a last space stays; \S of Python: no white space of either tokenizer matches it
_UNCUT = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]  # spaces after white space are no cuts
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_B_BITS = 32


class TokenizerPair:
    """A: byte-level BPE (JSON form of the tokenizers library), given space + text. B: a piece model that adds the space."""

    def __init__(self, source_a: bytes, source_b: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(source_a)
        chars = _byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(chars.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # in a file of this kind the ids follow the order of the merges, so they are the ranks
        for i, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if ranks[bytes(map(chars.__getitem__, left + right))] != 256 + i:
                raise ValueError("the ids of tokenizer A do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=source_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            if not byte and not self.b.is_control(i) and SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} of tokenizer B reaches over a space")
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.digits = np.array(list(map(len, names)), dtype=np.int64)
        self.names = {end: np.array([n + end for n in names], dtype=object) for end in ",|;"}

    def _encode_a(self, spaced: list[str], raw: list[bytes]) -> list[list[int]]:
        """Ids of A of each unit. Units that end in a sign other than white space are encoded in one go."""
        together = [i for i, u in enumerate(spaced) if not u[-1].isspace()]
        ids = self.a.encode_to_numpy("".join(map(spaced.__getitem__, together)), disallowed_special=()) if together else np.zeros(0, np.uint32)
        ends = np.cumsum(self.sizes_a[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(raw[i]) for i in together]), side="left") + 1
        flat, out = ids.tolist(), [None] * len(spaced)
        for i, a, b in zip(together, [0, *cuts.tolist()], cuts.tolist()):
            out[i] = flat[a:b]
        return [self.a.encode_ordinary(u) if o is None else o for u, o in zip(spaced, out)]

    def align(self, units: list[str], block: int = 1 << 16) -> "Aligned":
        """All units (without their leading spaces) encoded, and those that both tokenizers spell aligned; about ``block`` characters at a time."""
        cuts = np.flatnonzero(np.diff(np.cumsum([len(u) + 1 for u in units]) // block)) + 1
        cuts = [0, *cuts.tolist(), len(units)]
        return Aligned.joined([self._align(units[i:j]) for i, j in zip(cuts, cuts[1:])])

    def _align(self, units: list[str]) -> "Aligned":
        spaced = [" " + u for u in units]
        raw = [u.encode() for u in spaced]
        ids_a, ids_b = self._encode_a(spaced, raw), self.b.encode(units, num_threads=1) if units else []
        spelled = np.ones(len(raw), dtype=bool)
        for table, widths, ids in ((self.bytes_a, self.sizes_a, ids_a), (self.bytes_b, self.sizes_b, ids_b)):
            flat = list(chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(widths[flat])])[np.cumsum(list(map(len, ids)))] if units else np.zeros(0, np.int64)
            if b"".join(map(table.__getitem__, flat)) != b"".join(raw) or not np.array_equal(ends, np.cumsum(list(map(len, raw)))):
                spelled &= np.array([b"".join(map(table.__getitem__, x)) == t for x, t in zip(ids, raw)], dtype=bool)
        return Aligned(self, spelled, [len(t) for t in raw], ids_a, ids_b)


class Aligned:
    """Per unit: ``spelled``, ``n_a``, ``n_b``, ``n_links`` and ``texts`` (the groups as ``a1,a2|b1;a3|b2``); ``links`` of all as ``a << 32 | b``."""

    def __init__(self, pair: TokenizerPair, spelled: np.ndarray, sizes: list[int], ids_a: list[list[int]], ids_b: list[list[int]]):
        count = lambda ids: np.array(list(map(len, ids)), dtype=np.int64) * spelled
        self.spelled, self.n_a, self.n_b = spelled, count(ids_a), count(ids_b)
        sizes = np.array(sizes, dtype=np.int64) * spelled
        flat = lambda ids: np.fromiter(chain.from_iterable(x for x, ok in zip(ids, spelled) if ok), np.int64)
        a, b = flat(ids_a), flat(ids_b)
        # end of each token in the spelled units one after another -> its index; every unit's end is a common one
        index_a = dict(zip(np.cumsum(pair.sizes_a[a]).tolist(), range(len(a))))
        index_b = dict(zip(np.cumsum(pair.sizes_b[b]).tolist(), range(len(b))))
        common = sorted(index_a.keys() & index_b.keys())
        last_a, last_b = (np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (index_a, index_b))
        # tokens are never empty, so at a common end one of each ends: they are linked
        self.links = a[last_a] << _B_BITS | b[last_b]
        self.n_links = np.diff(np.searchsorted(np.array(common, dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)]), side="right"))
        del index_a, index_b, common
        self.texts = self._texts(pair, a, b, last_a, last_b)

    @classmethod
    def joined(cls, parts: list["Aligned"]) -> "Aligned":
        """Blocks of units one after another."""
        out = cls.__new__(cls)
        out.spelled, out.n_a, out.n_b, out.n_links, out.links = (
            np.concatenate([getattr(p, c) for p in parts]) for c in ("spelled", "n_a", "n_b", "n_links", "links"))
        out.texts = list(chain.from_iterable(p.texts for p in parts))
        return out

    def _texts(self, pair: TokenizerPair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """Both id lists sliced into groups and written out: a comma after an id, a bar after A's last, a semicolon after B's last."""
        per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        at_a = np.arange(len(a)) + np.repeat(np.cumsum(per_b) - per_b, per_a)
        at_b = np.arange(len(b)) + np.repeat(np.cumsum(per_a), per_b)
        words, sizes = np.empty(len(a) + len(b), dtype=object), np.empty(len(a) + len(b), dtype=np.int64)
        for ids, at, last, end in ((a, at_a, last_a, "|"), (b, at_b, last_b, ";")):
            words[at], sizes[at] = pair.names[","][ids], pair.digits[ids] + 1
            words[at[last]] = pair.names[end][ids[last]]
        text = "".join(words.tolist())
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [text[i: max(i, j - 1)] for i, j in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def _load(digest: str, source_a: bytes, source_b: bytes) -> TokenizerPair:
    return TokenizerPair(source_a, source_b)


def shared_pair(spark, path_a: str, path_b: str, most: int = 64 << 20):
    """A function that gives the pair inside a task; both files are read on the driver and broadcast."""
    sources = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            sources.append(f.read())
        if len(sources[-1]) > most:
            raise ValueError(f"{path} is larger than {most} bytes")
    digest, sent = hashlib.sha1(b"".join(sources)).hexdigest(), spark.sparkContext.broadcast(tuple(sources))
    return lambda: _load(digest, *sent.value)


def text_units(raw: bytes | None) -> list[str]:
    """Units of a text without their leading spaces; none where it is null, empty or not valid UTF-8."""
    try:
        text = raw.decode() if raw else ""
    except UnicodeDecodeError:
        return []
    if not text:
        return []
    plain = text[0] != " " and text[-1] != " " and not any(x in text for x in _UNCUT)
    return text.split(" ") if plain else _CUT.split(text)


_SLICES = ("slice bigint, doc_id array<bigint>, n_units array<int>, n_a array<bigint>, n_b array<bigint>, "
           "stream binary, unit_groups binary, unit_links binary, links binary, pair array<bigint>, n array<bigint>")


def _sliced(model, slice_bytes: int):
    def run(batches):
        pair, numbers = model(), slice_numbers()
        for part in slices(batches, "text", slice_bytes):
            yield _slice(pair, next(numbers), part)  # nothing of a slice outlives it here

    return run


def _slice(pair: TokenizerPair, number: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """One slice: its documents as streams of units, its units' groups and links, its id pairs and their numbers."""
    local = Numbers()
    streams = [np.array(list(map(local.__getitem__, text_units(raw))), dtype=np.int64) for raw in raw_texts(part.column("text"))]
    found = pair.align(list(local))
    streams = [d if found.spelled[d].all() else d[:0] for d in streams]  # one unit that is not spelled: no tokens at all
    stream = np.concatenate([*streams, np.zeros(0, np.int64)])
    times = np.bincount(stream, minlength=len(local))
    pairs, links = np.unique(found.links, return_inverse=True)
    counts = np.bincount(links, weights=np.repeat(times, found.n_links), minlength=len(pairs)).astype(np.int64)
    return pa.RecordBatch.from_pylist([{
        "slice": number, "doc_id": part.column("doc_id"), "n_units": [len(d) for d in streams],
        "n_a": [found.n_a[d].sum() for d in streams], "n_b": [found.n_b[d].sum() for d in streams], "stream": pack(stream),
        "unit_groups": pack_lines(found.texts), "unit_links": pack(found.n_links), "links": pack(links), "pair": pairs, "n": counts,
    }], schema=_ARROW)


_ARROW = pa.schema([
    ("slice", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_units", pa.list_(pa.int32())), ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())), ("stream", pa.binary()), ("unit_groups", pa.binary()),
    ("unit_links", pa.binary()), ("links", pa.binary()), ("pair", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

_RESULT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
           "groups string")


def _documents(batches):
    """Per document: its groups, and sums of the corpus-wide counts over its links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            flat = lambda c: row[c].values.to_numpy() if row[c].is_valid else np.zeros(0, np.int64)
            links, per_unit = unpack(row["links"].as_py()), unpack(row["unit_links"].as_py())
            offsets = np.concatenate([[0], np.cumsum(per_unit)])
            per_link = [flat("total"), flat("best").astype(np.int64)]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links] if len(links) else links)])[offsets]) for x in per_link]
            stream, texts = unpack(row["stream"].as_py()), unpack_lines(row["unit_groups"].as_py())
            ends = np.concatenate([[0], np.cumsum(flat("n_units").astype(np.int64))])
            docs = len(ends) - 1
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[stream])])[ends]) if docs else np.zeros(0, np.int64)
            n_links = total(per_unit)
            groups_of = [";".join(map(texts.__getitem__, stream[a:b].tolist())) if b > a else None
                         for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [row["doc_id"].values, *(row[c].values for c in ("n_a", "n_b")),
                 *(pa.array(x, pa.int64()) for x in (n_links, n_links, total(sums[1]), total(sums[0]))),
                 pa.array(groups_of, pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          slice_bytes: int = 3 << 19) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row of ``docs``.

    A encodes space + text, B the text (it adds the space); special tokens'
    strings are ordinary text. ``groups`` is ``a1,a2|b1;a3|b2``: decimal
    ids, A's before B's, a group for each byte offset where both end. The last
    tokens of a group end together: they are linked. An id pair's count is
    how many links of the corpus hold it; ``count_sum`` is its sum over a
    document's links, ``n_best`` counts the links whose count is the
    highest of any pair with the same B id, ties included.

    Defined cases: a text that is null, empty, not valid UTF-8, or not
    spelled by A's or B's tokens has zeros and a null ``groups``; repeated rows
    are documents of their own, also in the counts; other columns, whatever
    their names, are ignored; an empty table gives no rows. A long text is
    cut like any other; what one task holds is bounded by ``slice_bytes``, by one
    row, and by B's own needs for one unit without a space.
    """
    model = shared_pair(docs.sparkSession, path_a, path_b)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    table = written(own.mapInArrow(_sliced(model, slice_bytes), _SLICES), "alignment-slices")
    keys = keys_of_slices(table, "pair", "n")  # a pair that only texts without tokens hold has n = 0 and is in no sum
    totals = keys.groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key").bitwiseAND((1 << _B_BITS) - 1))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    figures = totals.join(highest, "b").select("key", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    back = figures_back(table.drop("pair", "n"), keys, figures, ["total", "best"])
    return back.mapInArrow(_documents, _RESULT)
