"""Language identification by compression: the language whose dictionary packs a text smallest.

Each language's dictionary is raw text of that language, given to zstandard
as raw content. A text is folded (ASCII letters lower-cased, everything
ASCII that is no letter one space), cut into blocks, and every block of it
is compressed with every dictionary; the smallest sum wins. A text that
fits two languages about equally well is compressed again at a higher level;
if the margin stays narrow, the answer is rejected.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import extended, raw_texts, slices, with_text

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def fold(raw: bytes) -> bytes:
    return b" " + b" ".join(raw.translate(_FOLD).split()) + b" "


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None,
          slots: int = 256, sample_chars: int = 4096, dictionary_bytes: int = 1 << 17,
          max_languages: int = 256) -> dict[str, bytes]:
    """{language: dictionary} from a bounded sample of the rows whose language is not null.

    The bound: for each language ``slots`` rows at most (the least hash of
    text in each slot, so the choice does not depend on order), of each
    ``sample_chars`` characters, of all ``dictionary_bytes``. More than
    ``max_languages`` languages raise an error. Equal texts count once.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"),
                       (F.lit(True) if where is None else where).alias("w"))
    rows = rows.where("w and l is not null and t rlike '\\\\p{L}'").select("l", "t", F.xxhash64("t").alias("h"))
    slot = F.pmod(F.col("h"), F.lit(slots))
    least = rows.groupBy("l", slot.alias("slot")).agg(F.min("h").alias("h"))
    chosen = least.limit(max_languages * slots + 1).collect()
    if len({r.l for r in chosen}) > max_languages or len(chosen) > max_languages * slots:
        raise ValueError(f"more than {max_languages} languages")
    if not chosen:
        return {}
    keys = docs.sparkSession.createDataFrame([(r.l, r.h) for r in chosen], "l string, h bigint")
    texts = (rows.join(F.broadcast(keys), ["l", "h"]).groupBy("l", "h")
             .agg(F.min(F.substring("t", 1, sample_chars)).alias("t")).collect())
    out: dict[str, bytes] = {}
    for r in sorted(texts, key=lambda r: (r.l, r.h)):
        if len(out.setdefault(r.l, b"")) < dictionary_bytes:
            out[r.l] += fold(r.t.encode("utf-8", "replace"))
    return {k: v[:dictionary_bytes] for k, v in out.items()}


class Scorer:
    """Compressors of all dictionaries at two levels."""

    def __init__(self, model: dict[str, bytes], block: int = 2048, levels: tuple[int, int] = (3, 12), again: float = 0.09):
        self.names, self.block, self.again = sorted(model), block, again
        self.sets = []
        for level in levels:
            row = []
            for name in self.names:
                d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                row.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False,
                                                    write_content_size=False, write_dict_id=False))
            self.sets.append(row)

    def _best(self, raw: bytes, compressors) -> tuple[str, float]:
        blocks = [raw[i: i + self.block] for i in range(0, len(raw), self.block)]
        sizes = [sum(map(len, map(c.compress, blocks))) for c in compressors]
        if len(sizes) == 1:
            return self.names[0], 1.0
        best = min(range(len(sizes)), key=sizes.__getitem__)  # a tie goes to the first name
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], 1 - sizes[best] / second

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        """(language, margin): the margin is how much smaller the best is than the second, 0 to 1."""
        if not raw or not self.names or not _LETTER.search(raw.decode("utf-8", "replace")):
            return UNKNOWN, 0.0
        raw = fold(raw)
        name, margin = self._best(raw, self.sets[0])
        return (name, margin) if margin >= self.again else self._best(raw, self.sets[1])


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", min_margin: float = 0.005,
             pred_col: str = "lang_pred", score_col: str = "score", accepted_col: str = "accepted") -> DataFrame:
    """``docs`` with the predicted language, its margin as score, and whether the answer is accepted.

    Only the text is looked at. Defined cases: null, empty or letterless
    texts (numerals and signs such as ½ or Ⅷ are no letters), and all texts under an empty model, give ``und``, 0 and not
    accepted; a tie goes to the first language by name, with score 0 (so not
    accepted); with one language every text with a letter gets it with score
    1; the new columns replace columns of the same names, others pass
    through; repeated rows are answered alike; an empty table gives no rows.
    """
    new = (pred_col, score_col, accepted_col)
    kept = [c for c in docs.columns if c not in new]
    carried, text = with_text(docs, kept, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x dictionary bytes

    def run(batches):
        scorer = Scorer(sent.value)
        for part in slices(batches, text, 1 << 20):
            found = [scorer.predict(raw) for raw in raw_texts(part.column(text))]
            names, scores = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([n != UNKNOWN and s >= min_margin for n, s in found], pa.bool_())], names=[*kept, *new])

    schema = extended(docs, kept, f"`{pred_col}` string, `{score_col}` double, `{accepted_col}` boolean")
    return carried.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: CRC-32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
