"""The pipeline, stage by stage, against plain versions on the smallest table."""

import zlib

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from crateflow.llm import langid, simhash
from crateflow.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_work_on_what_came_before(spark, docs):
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        now = out.cache()
        assert now.count() > 0
    last = {r.doc_id: r.n_tokens for r in pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert {r.doc_id: r.n_tokens for r in pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()} == last
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    assert all(last[r.doc_id] == len(library.encode(r.text, add_special_tokens=False).ids) for r in now.collect())


def test_near_duplicate_stage_keeps_the_least_of_each_group(spark, docs):
    groups = simhash.near_duplicates(docs).collect()
    want = {r.component_id for r in groups}
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()) == sorted(want)


def test_line_stage_updates_length(spark):
    rows = [(n, f"own line {n}\nshared menu", "s", 99) for n in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    assert {(r.text, r.n_chars) for r in pipeline.drop_site_lines(spark, d, SF).collect()} == {
        (f"own line {n}", len(f"own line {n}")) for n in range(30)}


def test_stages_with_odd_rows(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "le chat est sur la table avec les enfants", None, None, 5),
                                 (0, "", "en", "src0", 0), (0, "", "en", "src0", 0), (1, "123 456", "fr", "src0", 7)], docs.schema)
    every = docs.unionByName(odd).unionByName(docs.limit(3))
    every = every.select("*", *[F.lit("x").alias(c) for c in ("score", "kept_text", "version", "bits", "component", "token_ids", "item_id", "host")])
    now, plain = every, None
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, SF)
        plain = out.collect()
        if name != "bpe":
            assert out.columns == every.columns
            now = spark.createDataFrame(plain, out.schema)
        empty = stage(spark, every.limit(0), SF)
        assert empty.count() == 0
    groups = {}
    for r in simhash.near_duplicates(every).collect():
        groups.setdefault(r.component, []).append((r.doc_id is None, r.doc_id or 0, r.version))
    left = [(r.doc_id is None, r.doc_id or 0, zlib.crc32(r.text.encode()) if r.text is not None else -1)
            for r in pipeline.drop_near_duplicates(spark, every, SF).collect()]
    assert sorted(left) == sorted(min(g) for g in groups.values())


def test_language_stage_judges_by_its_model(spark, docs):
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, SF).collect()}
    scorer = langid.Scorer(langid.learn(docs, where=~langid.held_out()))
    want = {r.doc_id for r in docs.collect() if scorer.predict((r.text or "").encode())[1] >= 0.005}
    assert kept == want and len(kept) > 0.95 * docs.count()


def test_every_operator_has_one_query(spark):
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(names)
