"""Landed documents: what is shuffled to build and to load them, and rows with odd keys."""

import json

from pyspark.sql import functions as F

from crateflow.operators import flatten as FL
from crateflow.operators import load as L
from crateflow.plans import load_plans as LP
from crateflow.sources import payloads as PL
from crateflow.sources.bindings import Model, TableSet

_SCHEMAS = {
    "release": "id_release bigint, id_master bigint, title string, year int, country int, url_thumbnail string, url_cover string, url_release string",
    "release_artists": "id_release bigint, id_artist bigint", "release_labels": "id_release bigint, id_label bigint, name_label string, catno string",
    "release_formats": "id_release bigint, name_format string, qty_format bigint",
    "release_credits": "id_release bigint, id_artist bigint, role string, name_artist string",
    "release_genres": "id_release bigint, name_genre string", "release_styles": "id_release bigint, name_style string",
    "release_videos": "id_release bigint, url_video string, title string, duration string",
    "release_tracks": "id_release bigint, position string, title string, duration string",
    "release_track_artists": "id_release bigint, name_artist string, role string, id_artist bigint, api_artist string, position string",
    "release_stats": "id_release bigint, qty_for_sale bigint, amt_price_lowest double, qty_has bigint, qty_want bigint, avg_rating double, qty_ratings bigint",
    "master_main": "id_master bigint, id_main_release bigint",
}


def _tables(spark, **rows):
    return TableSet(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in _SCHEMAS.items()})


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_release_documents_need_two_shuffles(spark):
    assert _shuffles(PL.release_payloads(_tables(spark))) <= 2


def test_release_documents_with_odd_keys(spark):
    head = lambda i, t: (i, 7, t, 2000, 1, None, None, None)
    m = _tables(spark, release=[head(1, "a"), head(1, "b"), head(2, "c"), head(None, "d")],
                release_genres=[(1, "rock"), (1, "jazz"), (3, "folk"), (None, "pop")], release_artists=[(2, None)],
                release_tracks=[(1, "1", "x", "3"), (1, None, "y", "4"), (2, "1", "z", "5")],
                release_track_artists=[(1, "n", "r", 5, "u", "1"), (1, "o", "r", 6, "u", None), (9, "p", "r", 7, "u", "1")],
                release_stats=[(1, 3, None, 1, 1, 0.5, 1)])
    got = sorted((json.loads(r.raw) for r in PL.release_payloads(m).collect()), key=lambda d: d["title"])
    assert [(d.get("id"), d["title"], sorted(d.get("genres", []))) for d in got] == [
        (1, "a", ["jazz", "rock"]), (1, "b", ["jazz", "rock"]), (2, "c", []), (None, "d", [])]
    assert "genres" not in got[2] and "tracklist" not in got[3] and got[2]["artists"] == [{}]
    assert {t["title"]: [x["id"] for x in t.get("extraartists", [])] for t in got[0]["tracklist"]} == {"x": [5], "y": []}
    assert got[0]["community"]["have"] == 1 and "lowest_price" not in got[0]


def test_master_documents(spark):
    head = lambda i, m: (i, m, "t", 2000, 1, None, None, None)
    m = _tables(spark, release=[head(1, 10), head(2, 10), head(3, 20)], master_main=[(10, 1), (20, 3)],
                release_genres=[(1, "rock"), (2, "rock"), (2, "jazz")], release_tracks=[(1, "1", "x", "3"), (2, "1", "no", "3")],
                release_track_artists=[(1, "n", "r", 5, "u", "1")], release_stats=[(1, 1, 1.0, 2, 3, 0.5, 1), (2, 1, 1.0, 20, 30, 0.5, 1)])
    got = {d["id"]: d for d in (json.loads(r.raw) for r in PL.master_payloads(m).collect())}
    assert sorted(got[10]["genres"]) == ["jazz", "rock"] and got[10]["stats"]["community"] == {"in_wantlist": 33, "in_collection": 22}
    assert [(t["title"], t["extraartists"][0]["id"]) for t in got[10]["tracklist"]] == [("x", 5)]
    assert set(got[20]) == {"id", "main_release"}


def test_documents_of_different_ids_are_loaded_without_a_shuffle_of_their_text(spark):
    raw = spark.range(6).select("id", F.to_json(F.struct("id", F.lit("n").alias("title"))).alias("raw"))
    loaded = spark.createDataFrame([(2,)], "id_release bigint")
    new = L.incremental_load(raw, loaded)["release"]
    assert sorted(r.id_release for r in new.collect()) == [0, 1, 3, 4, 5]
    assert _shuffles(FL.ENTITIES["release"].one_each(FL.ENTITIES["release"].parsed(raw))) == 0
    twice = raw.unionByName(raw.where("id = 4").withColumn("raw", F.lit('{"id": 4, "title": "m"}'))).unionByName(raw.where("id = 4"))
    assert sorted(r.id_release for r in L.incremental_load(twice, loaded)["release"].collect()) == [0, 1, 3, 4, 5]


def test_a_step_looks_into_the_target_once(spark, tmp_path, monkeypatch):
    looks, read = [], L.read_loaded
    monkeypatch.setattr(L, "read_loaded", lambda s, d, t: looks.append(t) or read(s, d, t))
    raw = spark.range(6).select("id", F.to_json(F.struct("id", F.array(F.lit("rock")).alias("genres"))).alias("raw"))
    L.load_batch(raw.where("id < 3"), str(tmp_path))
    L.load_batch(raw, str(tmp_path))
    L.load_batch(raw, str(tmp_path))
    assert looks == ["release"] * 2
    for table in ("release", "release_genres"):
        assert sorted(r.id_release for r in read(spark, str(tmp_path), table).collect()) == [0, 1, 2, 3, 4, 5]
    loaded = spark.read.parquet(f"{tmp_path}/release").where("id_release >= 0").groupBy("load").count().collect()
    assert sorted(r["count"] for r in loaded) == [3, 3]


def test_a_document_is_parsed_once_for_filters_and_columns(spark):
    raw = spark.createDataFrame([(1, '{"id": 1, "genres": ["rock", "jazz"]}'), (2, "no json"), (3, None), (4, '{"genres": ["pop"]}')],
                                "id bigint, raw string")
    parses = lambda df: df._jdf.queryExecution().executedPlan().toString().count("from_json")
    parsed = FL.parse(raw, FL.RELEASE_SCHEMA)
    genres = FL.flatten_genres(parsed)
    assert parses(genres) == 1 and sorted(map(tuple, genres.collect())) == [(1, "jazz"), (1, "rock")]
    bad = FL.quarantine(parsed)
    assert parses(bad) == 1 and sorted(r.payload_id for r in bad.collect()) == [2, 3, 4]
    pages = spark.createDataFrame([(1, 1, '[{"id": 5}, {"id": 6}]'), (1, 2, "{"), (2, 1, None)], "id_artist bigint, page bigint, raw string")
    masters = FL.flatten_artist_masters(pages)
    assert parses(masters) == 1 and sorted(r.id_master for r in masters.collect()) == [5, 6]
    assert sorted((r.id_artist, r.page) for r in FL.quarantine_pages(pages).collect()) == [(1, 2), (2, 1)]
    new = L.incremental_load(pages, spark.createDataFrame([], "id_artist bigint, page bigint"), "artist_page")  # parsed before it is flattened
    assert sorted(r.id_master for r in new["artist_masters"].collect()) == [5, 6]


def test_rows_of_release_stats_are_not_dealt_before_they_are_grouped(spark, tmp_path):
    cols = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame([(1, 7, 3, 1, 2.0, 9.5, 0.1), (1, 7, 4, 2, 3.0, 8.5, 0.1), (1, None, 4, 3, 1.0, 7.5, 0.1), (2, 5, 5, 1, 1.0, 4.0, 0.2),
                           (None, None, None, 1, None, None, None)], cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    stats = Model(spark, str(tmp_path), materialize=False).t("release_stats")
    # both shuffles of distinct counts combine rows first; dealing the rows by release before that saved neither
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert sorted(((tuple(r)) for r in stats.collect()), key=str) == [
        (1, 3, 7.5, 6, 1, 5.0, 2), (2, 1, None, 1, 1, 10.0, 1), (None, 1, None, None, 0, None, 0)]


def test_landed_files_hold_a_bounded_number_of_documents(spark, tmp_path, monkeypatch):
    documents = spark.range(0, 1000, 1, 40).select("id", F.lit("{}").alias("raw"))
    monkeypatch.setattr(LP, "LANDED_ROWS", 100)
    for name, df, files in (("few", documents, 10), ("least", documents.limit(50).repartition(20), 8)):
        LP._land(df, f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert len(back.inputFiles()) == files and back.count() == df.count()


def test_a_step_parses_its_documents_once(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(1, '{"id": 1, "title": "a", "genres": ["rock"]}'), (1, '{"id": 1, "title": "b", "genres": ["jazz"]}'),
                                 (2, '{"id": 2, "title": "c"}'), (3, "no json"), (1, '{"id": "x"}'), (5, None)], "id bigint, raw string")
    want = {(r.doc.id, r.doc.title) for r in FL.one_per_id(FL.parse(raw, FL.RELEASE_SCHEMA)).collect()}
    plans, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    L.load_batch(raw, str(tmp_path))
    assert sum(p.count("from_json") for p in plans) == 1
    read = lambda table: L.read_loaded(spark, str(tmp_path), table)
    assert {(r.id_release, r.title) for r in read("release").collect()} == want and len(want) == 2
    assert read("release_genres").count() == 1
    assert sorted((r.payload_id, r.n_chars) for r in read("_quarantine_release").collect() if r.n_chars) == [(1, 11), (3, 7)]
    assert read("_quarantine_release").count() == 3
