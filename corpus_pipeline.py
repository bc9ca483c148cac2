"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written
as Parquet and read again as the next one's ``docs``. All but the last keep
the columns of ``docs`` as they are, extra ones too. Cases that hold for all
stages: an empty table stays empty; a null id is an id like any other; rows
that share an id are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import bpe, decontaminate, langid, line_dedup, simhash
from crateflow.llm.common import written
from crateflow.llm.queries import tokenizer_path

#: No SQL: compression, XXH64 fingerprints, tiling and BPE cannot be said in it; tests compare with plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; the others go (null, empty and letterless texts too).

    Learned from the texts and non-null ``lang`` of ``docs`` that are not held out.
    """
    model = langid.learn(docs, where=~langid.held_out())
    names = {"pred_col": "__lang_pred", "score_col": "__score", "accepted_col": "__accepted"}
    return langid.identify(docs, model, **names).where("__accepted").select(docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source carry; ``n_chars`` follows the text."""
    names = {"kept_col": "__kept", "lines_col": "__lines", "dropped_col": "__dropped"}
    out = line_dedup.drop_boilerplate(docs, host_col="source", **names)
    changed = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = (F.when(F.col("__dropped") > 0, F.length("__kept")).otherwise(F.col("n_chars"))
                              .cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id.

    Of rows that share this id the text with the smaller CRC-32 stays, of
    equal rows one. In a group of null ids alone one row stays by the same rule.
    """
    groups = simhash.near_duplicates(docs)
    chosen = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component")
              .agg(F.min("doc_id").alias("id"), F.min("version").alias("__version")))
    chosen = chosen.select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__null"), "__version")
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__null": F.col("doc_id").isNull(),
                            "__version": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1))})
    on = ["__id", "__null", "__version"]
    return own.join(chosen, on, "left_semi").dropDuplicates(on).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or with its parts reordered."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, benchmark)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    out = bpe.encode_decode(docs, tokenizer_path(), keep=["doc_id"])
    return out.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_site_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
