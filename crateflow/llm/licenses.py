"""Licence scan by canonical digests: texts that are a known licence up to harmless differences.

A text is made canonical (case, comment marks, copyright lines, reservations,
punctuation and white space, equivalent spellings), its SHA-256 is joined with
the digests of the known licences: ``KNOWN`` and the files of ``license_texts``,
each with and without its title lines. Whole texts are looked up, and every line as a text of its
own, which finds licence notices inside documents. All of it is DataFrame
functions: the texts are not shuffled, only digests meet the known table.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same word (left: variant, right: canonical).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "holder": "owner", "holders": "owners", "http": "https", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: Known licence texts and notices (id, text); the whole texts are in ``license_texts`` too, with titles.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
]


#: What may stand before the words of a line in a comment.
_MARKS = r"[ \t#/*;%!<>|\"'-]*(?:(?:dnl|@?rem)[ \t]+)?"
#: What follows these words where a licence speaks of them, and no name or year: such a line is part of the text,
#: wherever its lines are broken.
_BODY = (r"[ \t]*$|[ \t]+(?:(?:if|in|of|on|the)[ \t]*$|(?:and|are|disclaimer|doctrines|each contributor|holders?|if you|in it|including"
         r"|interests?|laws?|licen[cs]e|notices?|of this|on the|or|owners?|ownership|permission|resulting|statements?"
         r"|the (?:library|software)|treaty)\b)")
_ITEM = r"[ \t]*$|[ \t]+(?:the[ \t]*$|(?:representations|the licen[cs]es|under|you)\b)"
_NOTICE_LINE = (rf"(?m)^{_MARKS}(?:(?:(?:portions|parts)[ \t]+)?copyright\b(?![\"\-,.;)][^\w\n]*(?:[^\W\d]|$)|{_BODY})"
                rf"|\(c\)(?!{_ITEM})|\x{{a9}})[^\n]*$|^{_MARKS}all rights reserved\b[^\p{{L}}\p{{N}}\n]*$|^[ \t]*(?:dnl|@?rem)[ \t]")


def known_texts() -> list[tuple[str, str]]:
    """(id, text) of all known licences: ``KNOWN``, and each file of ``license_texts`` in its forms.

    A file ``ID.txt`` or ``ID@wording.txt`` has title lines, a line ``%%``,
    and the text. Its forms are the text without a title and after each one,
    whole, and cut before and after the line that ends the terms.
    """
    out = list(KNOWN)
    for file in resources.files(__package__).joinpath("license_texts").iterdir():
        titles, _, body = file.read_text(encoding="utf-8").partition("\n%%\n")
        terms, end, _ = body.partition("END OF TERMS AND CONDITIONS")
        bodies = [body, terms + end, terms] if end else [body]
        out += [(file.name.removesuffix(".txt").split("@")[0], f"{t}\n{b}") for t in ["", *titles.split("\n")] for b in bodies]
    return out


def _word_lines(text: Column) -> Column:
    """Lower case, without comment marks, copyright lines and reservations, words apart by one space; the line ends stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), _NOTICE_LINE, " "), "[^\\p{L}\\p{N}\\n]+", " ")


def _one_line(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _spelled(words: Column) -> Column:
    """Words apart by one space, equivalent spellings as one."""
    spell = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(spell, w), w)), " ")


def _n_words(words: Column) -> Column:
    return F.length(words) - F.length(F.translate(words, " ", "")) + 1


def canonical(text: Column) -> Column:
    """Lower case, without comment marks, copyright lines and reservations, words only, equivalent spellings as one."""
    return _spelled(_one_line(F.transform(F.split(_word_lines(text), "\n", -1), lambda x: F.trim(x))))


def known_table(spark: SparkSession, known=None) -> DataFrame:
    """(digest, n_words, license_id), n_words of the canonical text; of equal canonical texts the least id stands."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    forms = rows.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return (forms.groupBy(F.sha2(F.col("form").cast("binary"), 256).alias("digest"), _n_words(F.col("form")).alias("n_words"))
            .agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_license, notices, n_notices) for every row of ``docs``.

    ``text_license``: the licence that the entire text is, or null;
    ``notices``: ids of the licences that single lines are, sorted, each
    once; ``n_notices``: how many such lines there are. ``known`` has
    digest, n_words and license_id (see ``known_table``). Units with as many
    words as some known licence are digested; ``known`` is broadcast to them
    only if Spark finds it small enough, and joined by a shuffle of digests
    otherwise.

    Defined cases: a null text, or one with nothing left in canonical form,
    is no licence; rows that share an id are told apart by the CRC-32 of
    their texts, equal rows get equal answers; a null id is an id like any
    other; other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"),
                      F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("version"))
    # the text is made words once; its lines, and all of them in one, are the units
    lines = F.transform(F.split(_word_lines(F.col("text")), "\n", -1), lambda x: F.trim(x))
    unit = lambda whole, words: F.struct(F.lit(whole).alias("whole"), words.alias("words"))
    units = F.transform(F.array(lines), lambda x: F.concat(F.array(unit(True, _one_line(x))),
                                                           F.transform(x, lambda w: unit(False, w))))[0]
    units = own.select("doc_id", "version", F.explode(units).alias("u")).select("doc_id", "version", "u.whole", "u.words")
    # a spelling is one word for one word: only a unit with as many words as a known licence can be one;
    # there are no more such numbers than the longest known licence has words
    sizes = F.broadcast(known.select("n_words").distinct())
    hits = (units.where("words <> ''").withColumn("n_words", _n_words(F.col("words"))).join(sizes, "n_words", "left_semi")
            .select("doc_id", "version", "whole", "n_words", F.sha2(_spelled(F.col("words")).cast("binary"), 256).alias("digest"))
            .join(known, ["digest", "n_words"]).groupBy("doc_id", "version", "whole", "license_id")
            .agg(F.count(F.lit(1)).alias("n")))
    copies = own.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("copies"))
    found = hits.groupBy("doc_id", "version").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("notices"),
        F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("n"))
    out = copies.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                                 & (F.col("d.version") == F.col("f.version")), "left")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"), "d.doc_id", "f.text_license",
                      F.coalesce("f.notices", F.array().cast("array<string>")).alias("notices"),
                      # repeated rows were counted together
                      F.coalesce((F.col("f.n") / F.col("copies")).cast("bigint"), F.lit(0)).alias("n_notices")).drop("__copy")
