"""The commit log, snapshots and load steps: crashes, repeats, races, several runs into one target."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from crateflow.operators import flatten as FL
from crateflow.operators import load as L
from crateflow.session import scratch_path
from crateflow.sources import commits, io
from crateflow.streaming import ingest
from crateflow.streaming.ingest import stream_ingest


def _docs(spark, *ids, mark="x"):
    rows = [(i, json.dumps({"id": i, "title": f"{mark}{i}", "artists": [{"id": 10 + i}], "community": {"have": 1}})) for i in ids]
    return spark.createDataFrame(rows, "id long, raw string").repartition(2)


def _ids(spark, target, table="release", col="id_release"):
    return sorted(getattr(r, col) for r in L.read_loaded(spark, target, table).select(col).collect())


# ---- the log ---------------------------------------------------------------------

def test_put_if_absent_gives_a_name_once(spark):
    path = f"{scratch_path(spark, 'put')}/a/0001.json"
    won, barrier = [], threading.Barrier(8)

    def put(i):
        barrier.wait()
        if commits.put_if_absent(spark, path, str(i)):
            won.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and spark.read.text(path).first().value == str(won[0])
    assert not [n for n, _ in commits.children(spark, path.rpartition("/")[0]) if n.startswith(".")]


def test_log_gives_numbers_in_order(spark):
    log = commits.CommitLog(spark, scratch_path(spark, "log"), "what string")
    assert log.last() == 0 and log.entries().count() == 0
    assert log.put(1, {"what": "a"}) and not log.put(1, {"what": "b"})
    with pytest.raises(ValueError):
        log.put(3, {"what": "c"})
    assert log.put(2, {"what": "d"}) and log.last() == 2
    assert [(r.version, r.what) for r in log.entries().orderBy("version").collect()] == [(1, "a"), (2, "d")]
    assert log.entries().where("committed_at IS NULL").isEmpty()


# ---- snapshots -------------------------------------------------------------------

def test_publish_after_a_crash_and_two_at_once(spark, monkeypatch):
    root = scratch_path(spark, "snap")
    row = lambda v: spark.createDataFrame([(v,)], "v long")
    assert io.publish_snapshot(row(1), root, "t") == 1
    put = commits.CommitLog.put
    monkeypatch.setattr(commits.CommitLog, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        io.publish_snapshot(row(2), root, "t")
    monkeypatch.setattr(commits.CommitLog, "put", put)
    assert io.read_snapshot_as_of(spark, root, "t").first().v == 1
    assert io.publish_snapshot(row(3), root, "t") == 2 and io.read_snapshot_as_of(spark, root, "t").first().v == 3
    got, barrier = [], threading.Barrier(2)

    def publish(v):
        df = row(v)
        barrier.wait()
        got.append((io.publish_snapshot(df, root, "t"), v))

    threads = [threading.Thread(target=publish, args=(v,)) for v in (4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in got) == [3, 4]
    assert all(io.read_snapshot_as_of(spark, root, "t", version=n).first().v == v for n, v in got)
    with pytest.raises(commits.CommitConflict):
        io.publish_snapshot(row(6), root, "t", expected=2)
    assert io.publish_snapshot(row(7), root, "t", expected=4) == 5
    # the crashed writer's folder is the only one left over
    assert io.remove_orphans(spark, root, "t") == [] and len(io.remove_orphans(spark, root, "t", older_than=-5)) == 1
    assert io.read_snapshot_as_of(spark, root, "t", version=1).first().v == 1


def test_read_as_of_a_time(spark):
    root = scratch_path(spark, "snap")
    for v in (1, 2, 3):
        io.publish_snapshot(spark.createDataFrame([(v,)], "v long"), root, "t")
    at = [r.published_at for r in io.snapshot_versions(spark, root, "t").orderBy("version").collect()]
    assert [io.read_snapshot_as_of(spark, root, "t", as_of=x).first().v for x in at] == [1, 2, 3]
    assert io.read_snapshot_as_of(spark, root, "t", as_of="2999-01-01 00:00:00").first().v == 3
    for missing in ({"as_of": "1999-01-01 00:00:00"}, {"version": 9}):
        with pytest.raises(FileNotFoundError):
            io.read_snapshot_as_of(spark, root, "t", **missing)


# ---- load steps -------------------------------------------------------------------

def test_defaults_of_ingest_all_never_replace_rows(spark):
    target = scratch_path(spark, "ingest")
    L.ingest_all({"release": _docs(spark, 1, 2)}, target)
    out = {r.table: r.qty_rows for r in L.ingest_all({"release": _docs(spark, 3)}, target).collect()}
    assert _ids(spark, target) == [1, 2, 3] and out["release"] == 3 and out["release_stats"] == 3
    L.load_batch(_docs(spark, 2, 4), target)
    assert _ids(spark, target) == [1, 2, 3, 4]


def test_a_repeated_step_does_nothing_and_another_one_is_refused(spark):
    target = scratch_path(spark, "ingest")
    L.ingest_all({"release": _docs(spark, 1)}, target, "a")
    L.ingest_all({"release": _docs(spark, 1)}, target, "a")
    assert L.read_loaded(spark, target, "release_stats").count() == 1 and L.load_log(spark, target).last() == 1
    with pytest.raises(L.StepConflict):
        L.ingest_all({"release": _docs(spark, 1, 2)}, target, "a")
    assert _ids(spark, target) == [1]


def test_a_half_written_step_is_invisible_and_repeated_whole(spark, monkeypatch):
    target = scratch_path(spark, "ingest")
    L.ingest_all({"release": _docs(spark, 1)}, target)
    plain = FL.ARTIST_SINKS["artist_urls"]
    monkeypatch.setitem(FL.ARTIST_SINKS, "artist_urls", lambda *a: (_ for _ in ()).throw(RuntimeError("disk full")))
    landed = {"release": _docs(spark, 2), "artist": spark.createDataFrame([(5, '{"id": 5, "name": "n", "urls": ["u"]}')], "id long, raw string")}
    with pytest.raises(RuntimeError, match="disk full"):
        L.ingest_all(landed, target, "b")
    assert _ids(spark, target) == [1]  # release 2 was written, but not committed
    monkeypatch.setitem(FL.ARTIST_SINKS, "artist_urls", plain)
    L.ingest_all(landed, target, "b")
    assert _ids(spark, target) == [1, 2] and _ids(spark, target, "artist", "id_artist") == [5]
    assert L.remove_orphans(spark, target) == [] and L.remove_orphans(spark, target, older_than=-5)
    assert _ids(spark, target) == [1, 2] and _ids(spark, target, "artist_urls", "id_artist") == [5]


def test_two_loads_at_once_load_a_document_once(spark, monkeypatch):
    """The second load reads the target before the first one commits."""
    target, put, late = scratch_path(spark, "ingest"), commits.CommitLog.put, []

    def overtaken(log, version, entry):
        if not late:
            late.append(1)
            L.load_batch(_docs(spark, 2, 3, mark="other"), target)
        return put(log, version, entry)

    monkeypatch.setattr(commits.CommitLog, "put", overtaken)
    L.load_batch(_docs(spark, 1, 2), target)
    assert _ids(spark, target) == [1, 2, 3] and L.load_log(spark, target).last() == 2
    late.clear()

    def other_entity(log, version, entry):
        if not late:
            late.append(1)
            L.load_batch(spark.createDataFrame([(5, '{"id": 5}')], "id long, raw string"), target, entity="artist")
        return put(log, version, entry)

    monkeypatch.setattr(commits.CommitLog, "put", other_entity)
    L.load_batch(_docs(spark, 4), target)
    assert _ids(spark, target) == [1, 2, 3, 4] and _ids(spark, target, "artist", "id_artist") == [5]


def test_artist_pages_are_loaded_page_by_page(spark):
    target = scratch_path(spark, "ingest")
    page = lambda *ids: json.dumps([{"id": i, "role": "Main", "title": f"m{i}"} for i in ids])
    rows = [(1, 0, page(5, 6)), (1, 0, page(5, 6)), (1, 1, page(7)), (2, 0, "{bad"), (2, 0, page(8)), (3, 0, "{bad"), (None, 0, page(9)),
            (4, None, page(9)), (5, 0, "[]"), (6, 0, None)]
    pages = spark.createDataFrame(rows, "id_artist long, page long, raw string")
    out = {r.table: r.qty_rows for r in L.ingest_all({"artist_page": pages}, target).collect()}
    assert out == {"artist_pages": 4, "artist_masters": 4, "_quarantine_artist_page": 5}
    more = spark.createDataFrame([(1, 1, page(7)), (1, 2, page(10, 11))], "id_artist long, page long, raw string")
    L.ingest_all({"artist_page": more}, target)
    assert sorted((r.id_artist, r.id_master) for r in L.read_loaded(spark, target, "artist_masters").collect()) == [
        (1, 5), (1, 6), (1, 7), (1, 10), (1, 11), (2, 8)]
    skipped = L.ingest_all({"artist_page": pages, "release": _docs(spark, 1)}, target, process_masters=False).collect()
    assert not {"artist_masters", "artist_pages"} & {r.table for r in skipped}


# ---- streams -----------------------------------------------------------------------

def test_streams_and_batches_keep_each_others_rows(spark):
    base = scratch_path(spark, "stream")
    run = lambda n, drop, docs: (docs.write.parquet(f"{base}/landing{n}/drop={drop}"),
                                 stream_ingest(spark, f"{base}/landing{n}", f"{base}/target", f"{base}/ckpt{n}"))
    run(1, 1, _docs(spark, 1, 2))
    run(2, 1, _docs(spark, 3))  # another stream with a checkpoint of its own begins at epoch 0 again
    assert _ids(spark, f"{base}/target") == [1, 2, 3]
    L.load_batch(_docs(spark, 4), f"{base}/target")
    run(1, 2, _docs(spark, 5, 1))
    # the landing folder read again under a new checkpoint adds nothing but stats
    stream_ingest(spark, f"{base}/landing1", f"{base}/target", f"{base}/ckpt-new")
    assert _ids(spark, f"{base}/target") == [1, 2, 3, 4, 5]
    assert ingest.run_of(spark, f"{base}/ckpt1") == ingest.run_of(spark, f"{base}/ckpt1") != ingest.run_of(spark, f"{base}/ckpt2")


def _tagged(spark):
    rows = [("release", 1, None, '{"id": 1, "title": "A"}'), ("artist", 5, None, '{"id": 5, "name": "n", "urls": ["u"]}'),
            ("artist_page", 5, 0, '[{"id": 9, "role": "Main"}]'), ("master", 7, None, '{"id": 7, "genres": ["Rock"]}'),
            ("item", 3, None, '{"id": 1, "instance_id": 3}'), ("label", 4, None, "{}"), (None, 4, None, "{}"), ("release", 2, None, "{bad")]
    return spark.createDataFrame(rows, "entity string, id long, page long, raw string")


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_one_stream_for_all_entities_survives_a_failure_in_the_third(spark, monkeypatch, form):
    base = scratch_path(spark, "stream")
    getattr(_tagged(spark).write, form)(f"{base}/landing/drop=1")
    args = (spark, f"{base}/landing", f"{base}/target", f"{base}/ckpt", None, None, form)
    plain = FL.PAGE_SINKS["artist_masters"]
    monkeypatch.setitem(FL.PAGE_SINKS, "artist_masters", lambda *a: (_ for _ in ()).throw(RuntimeError("disk full")))
    with pytest.raises(Exception, match="disk full"):
        stream_ingest(*args)
    assert L.load_log(spark, f"{base}/target").last() == 0
    monkeypatch.setitem(FL.PAGE_SINKS, "artist_masters", plain)
    stream_ingest(*args)
    stream_ingest(*args)
    count = lambda t: L.read_loaded(spark, f"{base}/target", t).count()
    tables = ("release", "artist", "artist_urls", "artist_masters", "master_genres", "collection_items", "_quarantine_release", "_dead_letter")
    assert {t: count(t) for t in tables} == dict(zip(tables, (1, 1, 1, 1, 1, 1, 1, 2)))
    got = L.ingest_all(L.routed(_tagged(spark)), f"{base}/batch")
    assert {r.table: r.qty_rows for r in got.collect() if r.table in tables} == {t: count(t) for t in tables}


def test_unknown_landing_form(spark):
    with pytest.raises(ValueError):
        stream_ingest(spark, "a", "b", "c", form="csv")


def test_digest_does_not_depend_on_order(spark):
    a, b = _docs(spark, 1, 2, 3), _docs(spark, 3, 2, 1).repartition(3)
    assert L._digest({"release": a}) == L._digest({"release": b}) != L._digest({"release": a.limit(2)})
    assert L._digest({"release": a.where(F.lit(False))}) == "release:0:0"
