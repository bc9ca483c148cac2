"""Flatteners on hand-made payloads, incremental load, snapshots, table helpers."""

import json

import pytest
from pyspark.sql import functions as F

from crateflow.operators import flatten as FL
from crateflow.operators import load as L
from crateflow.operators.load import incremental_load, new_keys_only
from crateflow.session import scratch_path
from crateflow.sources import io


def _payloads(spark):
    docs = [
        {"id": 1, "title": "A", "genres": ["Rock", "Pop"], "styles": None,
         "tracklist": [{"position": "1", "title": "t1", "extraartists": [{"id": 9, "name": "x", "role": "Vocals"}]},
                       {"position": "2", "title": "t2"}],
         "community": {"have": 3, "want": 4, "rating": {"average": 4.5, "count": 2}}},
        {"id": 2, "title": "B", "artists": [{"id": 7}, {"id": 8}], "lowest_price": {"value": 9.5},
         "community": {"have": 1, "want": 0, "rating": {"average": 0.0, "count": 0}}},
    ]
    rows = [(d["id"], json.dumps(d)) for d in docs] + [(3, "{not json"), (4, '{"id": 4, "year": "x"}')]
    return spark.createDataFrame(rows, "id long, raw string")


def test_flatten_optional_and_nested(spark):
    p = FL.parse(_payloads(spark), FL.RELEASE_SCHEMA)
    assert sorted((r.id_release, r.name_genre) for r in FL.flatten_genres(p).collect()) == [(1, "Pop"), (1, "Rock")]
    assert FL.flatten_styles(p).count() == 0
    ta = FL.flatten_track_artists(p).collect()
    assert [(r.id_release, r.position, r.id_artist) for r in ta] == [(1, "1", 9)]
    st = {r.id_release: r.amt_price_lowest for r in FL.flatten_release_stats(p).collect()}
    assert st == {1: None, 2: 9.5}
    assert sorted(r.id_artist for r in FL.flatten_release_artists(p).collect()) == [7, 8]


def test_quarantine_counts_bad_rows(spark):
    p = FL.parse(_payloads(spark), FL.RELEASE_SCHEMA)
    bad = sorted(r.payload_id for r in FL.quarantine(p).collect())
    assert bad == [3, 4]
    assert FL.flatten_release(p).count() == 2  # bad rows never reach a sink


def test_incremental_load_skips_loaded(spark):
    payloads = _payloads(spark)
    loaded = spark.createDataFrame([(1,)], "id_release long")
    out = incremental_load(payloads, loaded)
    assert [r.id_release for r in out["release"].collect()] == [2]
    assert out["release_stats"].count() == 2  # stats are appended on every load
    dup = payloads.unionByName(payloads)
    assert new_keys_only(dup, loaded.withColumnRenamed("id_release", "id"), "id").count() == 3


def test_snapshots_and_helpers(spark):
    root = scratch_path(spark, "snap-test")
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string")
    assert io.publish_snapshot(a, root, "t") == 1
    assert io.publish_snapshot(b, root, "t") == 2
    assert io.read_snapshot_as_of(spark, root, "t").count() == 2
    assert io.read_snapshot_as_of(spark, root, "t", 1).first()["v"] == "x"
    assert io.snapshot_versions(spark, root, "t").count() == 2
    assert not io.table_exists(spark, f"{root}/missing")
    assert "w" in io.add_column_if_missing(a, "w", "int").columns
    assert io.add_column_if_missing(a, "v", "int").schema == a.schema
    a.createOrReplaceTempView("crateflow_tmp_view")
    assert io.table_exists(spark, "crateflow_tmp_view")
    assert io.drop_view(spark, "crateflow_tmp_view")
    io.create_view(a, "crateflow_tmp_view")
    assert io.view_exists(spark, "crateflow_tmp_view") and io.drop_view(spark, "crateflow_tmp_view")
    assert not io.view_exists(spark, "crateflow_tmp_view")
    io.execute_sql(spark, f"CREATE TABLE crateflow_tmp (k INT) USING parquet LOCATION '{root}/sql'")
    io.execute_sql(spark, "INSERT INTO crateflow_tmp VALUES (5)")
    assert spark.table("crateflow_tmp").collect()[0].k == 5
    io.drop_table(spark, "crateflow_tmp")
    io.drop_table(spark, "crateflow_tmp")
    assert not io.table_exists(spark, "crateflow_tmp")
    io.store_append(a, f"{root}/rows")
    io.store_append(b, f"{root}/rows")
    assert spark.read.parquet(f"{root}/rows").count() == 3
    io.store_replace(a, f"{root}/rows")
    assert spark.read.parquet(f"{root}/rows").count() == 1
    out = io.sql_query(spark, "SELECT k, v FROM {t} WHERE k = 2", t=b)
    assert out.collect()[0]["v"] == "z"


def test_script_statements():
    script = "SELECT ';' AS a; -- no; end\nSELECT \";\" , `;x`;\n;  SELECT 'it\\'s; me' - 1"
    assert io.statements(script) == ["SELECT ';' AS a", "SELECT \";\" , `;x`", "SELECT 'it\\'s; me' - 1"]
    assert io.statements("select 1 /* a; b /* c; */ ; */; select 'x''y;' -- z; ;") == ["select 1", "select 'x''y;'"]
    assert io.statements("a--b;c\nd;") == ["a\nd"] and io.statements(" ;; ") == [] and io.statements("a - b / c") == ["a - b / c"]
    for broken in ("select 'x", 'select "x', "select `x", "select 1 /* x"):
        with pytest.raises(ValueError):
            io.statements(broken)


def _mixed(spark):
    rows = [(1, '{"id": 1, "title": "A", "country": "Germany", "formats": [{"name": "Vinyl", "qty": "1"}], "artists": [{"id": 3}]}'),
            (1, "{bad copy"), (2, '{"id": 2, "title": "B", "country": 5, "artists": [{"id": 4}], "community": {"have": 1}}'),
            (5, "{}"), (6, '{"title": "no id"}'), (7, "nothing"), (8, None)]
    return spark.createDataFrame(rows, "id long, raw string")


def test_nothing_is_lost_between_good_and_quarantine(spark):
    p = FL.parse(_mixed(spark), FL.RELEASE_SCHEMA)
    assert FL.good(p).count() + FL.quarantine(p).count() == 7
    assert sorted(r.payload_id for r in FL.quarantine(p).collect()) == [1, 5, 6, 7, 8]
    head = {r.id_release: r.country for r in FL.flatten_release(FL.one_per_id(p)).collect()}
    assert head == {1: "Germany", 2: "5"}  # the bad copy does not displace the good one
    pages = spark.createDataFrame([(1, 0, '[{"id": 5}]'), (1, 1, "{oops"), (2, 0, None)], "id_artist long, page long, raw string")
    assert FL.flatten_artist_masters(pages).count() == 1
    assert sorted((r.id_artist, r.page) for r in FL.quarantine_pages(pages).collect()) == [(1, 1), (2, 0)]


def test_loads_are_idempotent(spark):
    target = scratch_path(spark, "ingest-test")
    first = {r.table: r.qty_rows for r in L.ingest_all({"release": _mixed(spark)}, target, 1).collect()}
    assert first["release"] == 2 and first["release_artists"] == 2 and first["_quarantine_release"] == 5
    again = {r.table: r.qty_rows for r in L.ingest_all({"release": _mixed(spark)}, target, 1).collect()}
    assert again == first  # the same step repeated replaces itself
    more = {r.table: r.qty_rows for r in L.ingest_all({"release": _mixed(spark)}, target, 2).collect()}
    stats = {"release_stats", "_quarantine_release"}
    assert {t: n for t, n in more.items() if t not in stats} == {t: n for t, n in first.items() if t not in stats}
    assert more["release_stats"] == 2 * first["release_stats"]


def test_a_stream_that_fails_half_way_goes_on_whole(spark, monkeypatch):
    from crateflow.streaming.ingest import stream_ingest

    base = scratch_path(spark, "stream-test")
    _mixed(spark).write.parquet(f"{base}/landing/drop=1")
    tracks, calls = FL.RELEASE_SINKS["release_labels"], []

    def broken(parsed, dt=None):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("disk full")
        return tracks(parsed, dt)

    monkeypatch.setitem(FL.RELEASE_SINKS, "release_labels", broken)
    args = (spark, f"{base}/landing", f"{base}/target", f"{base}/_checkpoint")
    with pytest.raises(Exception, match="disk full"):
        stream_ingest(*args)
    stream_ingest(*args)
    _mixed(spark).write.parquet(f"{base}/landing/drop=2")
    stream_ingest(*args)
    read = lambda t: L.read_loaded(spark, f"{base}/target", t)
    assert sorted(r.id_release for r in read("release").collect()) == [1, 2]
    assert sorted(r.id_artist for r in read("release_artists").collect()) == [3, 4]
