"""Registered load operators: flatteners, incremental load, quarantine,
ingest, table management (SURVEY E1-E27, T1-T15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.functions.nest import nest_by_key, nest_in_parts
from crateflow.operators import catalog as C
from crateflow.operators import derive as D
from crateflow.operators import flatten as FL
from crateflow.operators import load as L
from crateflow.plans import params as P
from crateflow.plans.registry import register
from crateflow.plans.sqlparts import canon
from crateflow.session import scratch_path
from crateflow.sources import io
from crateflow.operators.load import read_loaded
from crateflow.sources import payloads as PL

API = PL.API


def _payload(m, name, build):
    return m.stored(f"payload_{name}", lambda: build(m))


def release_parsed(m):
    return FL.parse(_payload(m, "release", PL.release_payloads), FL.RELEASE_SCHEMA)


def artist_parsed(m):
    return FL.parse(_payload(m, "artist", PL.artist_payloads), FL.ARTIST_SCHEMA)


def item_parsed(m):
    return FL.parse(_payload(m, "item", PL.item_payloads), FL.ITEM_SCHEMA)


def master_parsed(m):
    return FL.parse(_payload(m, "master", PL.master_payloads), FL.MASTER_SCHEMA)


@register("e1_collection_value", """
SELECT COUNT(*) AS qty_collection_items, round(SUM(p.hi), 2) AS amt_maximum,
       round(SUM(p.med), 2) AS amt_median, round(SUM(p.lo), 2) AS amt_minimum
FROM collection_items ci LEFT JOIN (
  SELECT id_release, min(amt_price) AS lo, max(amt_price) AS hi, median(amt_price) AS med
  FROM release_prices GROUP BY id_release) p ON p.id_release = ci.id_release""")
def e1(m):
    return L.collection_value(m)


@register("e3_flatten_collection_item", f"""
SELECT id_release, strftime(date_added, '%Y-%m-%dT%H:%M:%S') AS date_added, id_instance, title, id_master,
       concat('{API}/masters/', cast(id_master AS varchar)) AS api_master,
       concat('{API}/releases/', cast(id_release AS varchar)) AS api_release,
       url_thumbnail, url_cover, year_released, rating
FROM collection_items""")
def e3(m):
    return FL.flatten_collection_item(item_parsed(m))


# documents give country and format quantity as text
_REL = """SELECT id_release, id_master, title, url_thumbnail, url_cover, year, url_release,
CAST(country AS VARCHAR) AS country FROM release"""


@register("e4_flatten_release", _REL)
def e4(m):
    return FL.flatten_release(release_parsed(m))


@register("e5_flatten_release_artists", "SELECT id_artist, id_release FROM release_artists")
def e5(m):
    return FL.flatten_release_artists(release_parsed(m))


@register("e6_flatten_release_labels", "SELECT id_release, id_label, name_label, catno FROM release_labels")
def e6(m):
    return FL.flatten_release_labels(release_parsed(m))


@register("e7_flatten_release_formats", """SELECT id_release, name_format,
CAST(qty_format AS VARCHAR) AS qty_format FROM release_formats""")
def e7(m):
    return FL.flatten_release_formats(release_parsed(m))


@register("e8_flatten_release_credits", f"""SELECT id_release, name_artist, role, id_artist,
concat('{API}/artists/', cast(id_artist AS varchar)) AS api_artist FROM release_credits""")
def e8(m):
    return FL.flatten_release_credits(release_parsed(m))


@register("e9_flatten_release_stats", """SELECT id_release, qty_for_sale, amt_price_lowest, qty_has, qty_want,
avg_rating, qty_ratings FROM release_stats""")
def e9(m):
    return FL.flatten_release_stats(release_parsed(m))


@register("e10_flatten_genres", "SELECT id_release, name_genre FROM release_genres")
def e10(m):
    return FL.flatten_genres(release_parsed(m))


@register("e11_flatten_styles", "SELECT id_release, name_style FROM release_styles")
def e11(m):
    return FL.flatten_styles(release_parsed(m))


@register("e12_flatten_tracks", "SELECT id_release, position, title, duration FROM release_tracks")
def e12(m):
    return FL.flatten_tracks(release_parsed(m))


@register("e13_flatten_track_artists", """SELECT t.id_release, ta.name_artist, ta.role, ta.id_artist, ta.api_artist,
t.position FROM release_tracks t JOIN release_track_artists ta ON ta.id_release = t.id_release AND ta.position = t.position""")
def e13(m):
    return FL.flatten_track_artists(release_parsed(m))


@register("e14_flatten_videos", "SELECT id_release, url_video, title, duration FROM release_videos")
def e14(m):
    return FL.flatten_videos(release_parsed(m))


@register("e15_flatten_artist", "SELECT id_artist, name_artist, profile FROM artist")
def e15(m):
    return FL.flatten_artist(artist_parsed(m))


@register("e16_flatten_artist_masters", """
SELECT am.id_artist, am.id_master, r.title, CASE WHEN am.role = 'Main' THEN 'master' ELSE 'release' END AS type,
       am.id_master AS id_main_release, a.name_artist, am.role, r.year, r.url_thumbnail AS url_thumb
FROM artist_masters am JOIN artist a ON a.id_artist = am.id_artist
LEFT JOIN release r ON r.id_release = am.id_master""")
def e16(m):
    return FL.flatten_artist_masters(_payload(m, "artist_pages", PL.artist_release_pages))


@register("e17_flatten_artist_images", """SELECT id_artist, type, url_image, url_image_150, width_image, height_image
FROM artist_images WHERE id_artist IN (SELECT id_artist FROM artist)""")
def e17(m):
    return FL.flatten_artist_images(artist_parsed(m))


def _link_sql(table: str, what: str, active: bool) -> str:
    act = f"id_{what} % 2 = 0 AS is_active, " if active else ""
    return f"""SELECT id_{what}, concat('Artist ', cast(id_{what} AS varchar)) AS name_{what},
concat('{API}/artists/', cast(id_{what} AS varchar)) AS api_{what}, {act}url_thumbnail, id_artist
FROM {table} WHERE id_artist IN (SELECT id_artist FROM artist)"""


@register("e18_flatten_artist_groups", _link_sql("artist_groups", "group", True))
def e18(m):
    return FL.flatten_artist_groups(artist_parsed(m))


@register("e19_flatten_artist_aliases", _link_sql("artist_aliases", "alias", False))
def e19(m):
    return FL.flatten_artist_aliases(artist_parsed(m))


@register("e20_flatten_artist_members", _link_sql("artist_members", "member", True))
def e20(m):
    return FL.flatten_artist_members(artist_parsed(m))


@register("e21_flatten_artist_urls", "SELECT id_artist, url FROM artist_urls WHERE id_artist IN (SELECT id_artist FROM artist)")
def e21(m):
    return FL.flatten_artist_urls(artist_parsed(m))


@register("e22_flatten_master_stats", """
SELECT r.id_master, CAST(SUM(s.qty_want) AS BIGINT) AS qty_wants, CAST(SUM(s.qty_has) AS BIGINT) AS qty_has
FROM release r JOIN release_stats s ON s.id_release = r.id_release GROUP BY r.id_master""")
def e22(m):
    return FL.flatten_master_stats(master_parsed(m))


@register("e22b_flatten_master_genres", """SELECT DISTINCT r.id_master, g.name_genre FROM release r
JOIN release_genres g ON g.id_release = r.id_release""")
def e22b(m):
    return FL.flatten_master_genres(master_parsed(m))


@register("e22c_flatten_master_tracks", """SELECT mm.id_master, t.position, t.title, t.duration FROM master_main mm
JOIN release_tracks t ON t.id_release = mm.id_main_release""")
def e22c(m):
    return FL.flatten_master_tracks(master_parsed(m))


@register("e22f_flatten_master_track_artists", """SELECT mm.id_master, x.name_artist, x.role, x.id_artist, x.api_artist, x.position
FROM master_main mm JOIN release_track_artists x ON x.id_release = mm.id_main_release
JOIN release_tracks t ON t.id_release = x.id_release AND t.position = x.position""")
def e22f(m):
    return FL.flatten_master_track_artists(master_parsed(m))


@register("e23_incremental_load", f"{_REL} WHERE id_release NOT IN (SELECT id_release FROM collection_items)")
def e23(m):
    loaded = m.t("collection_items").select("id_release")
    return L.incremental_load(_payload(m, "release", PL.release_payloads), loaded)["release"]


@register("e23b_incremental_load_artist", """SELECT id_artist, name_artist, profile FROM artist
ANTI JOIN artist_images USING (id_artist)""")
def e23b(m):
    loaded = m.t("artist_images").select("id_artist")
    return L.incremental_load(_payload(m, "artist", PL.artist_payloads), loaded, "artist")["artist"]


@register("e23c_incremental_load_master", """SELECT DISTINCT r.id_master, g.name_genre FROM release r
JOIN release_genres g ON g.id_release = r.id_release WHERE r.id_master NOT IN (SELECT id_master FROM collection_items WHERE rating > 3)""")
def e23c(m):
    loaded = m.t("collection_items").filter("rating > 3").select("id_master")
    return L.incremental_load(_payload(m, "master", PL.master_payloads), loaded, "master")["master_genres"]


@register("e26_quarantine_bad_payloads", """SELECT page_id AS payload_id, length(html) AS n_chars FROM pages
WHERE NOT coalesce(json_valid(html), false)""")
def e26(m):
    landed = (_payload(m, "release", PL.release_payloads)
              .unionByName(m.t("pages").select(F.col("page_id").alias("id"), F.col("html").alias("raw"))))
    return FL.quarantine(FL.parse(landed, FL.RELEASE_SCHEMA))


def _counts_sql() -> str:
    known = "SEMI JOIN artist USING (id_artist)"
    main = "FROM master_main mm JOIN {0} x ON x.id_release = mm.id_main_release"
    mine = "FROM (SELECT DISTINCT r.id_master, x.{1} FROM release r JOIN {0} x ON x.id_release = r.id_release)"
    played = "FROM release_tracks t JOIN release_track_artists ta ON ta.id_release = t.id_release AND ta.position = t.position"
    counts = {t: f"FROM {t}" for t in (
        "collection_items", "release", "release_artists", "release_labels", "release_formats", "release_credits", "release_stats",
        "release_genres", "release_styles", "release_tracks", "release_videos", "artist")}
    counts |= {t: f"FROM {t} {known}" for t in ("artist_images", "artist_groups", "artist_aliases", "artist_members", "artist_urls",
                                                         "artist_masters")}
    counts["artist_pages"] = f"FROM (SELECT DISTINCT id_artist, floor(id_master / {PL.PAGE_SPAN}) FROM artist_masters {known})"
    counts |= {"release_track_artists": played, "master": "FROM master_main", "master_tracks": main.format("release_tracks"),
               "master_videos": main.format("release_videos"), "master_genres": mine.format("release_genres", "name_genre"),
               "master_styles": mine.format("release_styles", "name_style"),
               "master_stats": "FROM (SELECT DISTINCT r.id_master FROM release r SEMI JOIN release_stats s ON s.id_release = r.id_release)",
               "master_track_artists": f"{played} JOIN master_main mm ON mm.id_main_release = t.id_release"}
    sel = [f"SELECT '{t}' AS \"table\", COUNT(*) AS qty_rows {source}" for t, source in counts.items()]
    sel += [f"SELECT '_quarantine_{e}', 0" for e in FL.ENTITIES]
    return "\nUNION ALL ".join(sel)


_BUILDERS = {"item": ("item", PL.item_payloads), "release": ("release", PL.release_payloads), "artist": ("artist", PL.artist_payloads),
             "artist_page": ("artist_pages", PL.artist_release_pages), "master": ("master", PL.master_payloads)}


def _landed(m, entities=tuple(_BUILDERS)):
    return {e: _payload(m, *_BUILDERS[e]) for e in entities}


@register("e27_ingest_all", _counts_sql())
def e27(m):
    return L.ingest_all(_landed(m), scratch_path(m.spark, "ingest"))


@register("e25_ingest_without_masters", """SELECT 'artist' AS "table", COUNT(*) AS qty_rows FROM artist
UNION ALL SELECT 'artist_urls', COUNT(*) FROM artist_urls SEMI JOIN artist USING (id_artist)""")
def e25(m):
    landed = _landed(m, ("artist", "artist_page"))
    out = L.ingest_all(landed, scratch_path(m.spark, "ingest"), process_masters=False)
    return out.filter(F.col("table").isin("artist", "artist_urls", "artist_masters", "artist_pages"))


# ---- table management ---------------------------------------------------------------

@register("t1_scan_table", "SELECT * FROM collection_items")
def t1(m):
    return io.scan_table(m.spark, m.path("collection_items"))


_T2 = "SELECT name_format, COUNT(*) AS qty_rows FROM {release_formats} GROUP BY name_format"


@register("t2_sql_query", _T2.replace("{release_formats}", "release_formats"))
def t2(m):
    return io.sql_query(m.spark, _T2, release_formats=m.t("release_formats"))


@register("t11_add_column_if_missing", "SELECT *, CAST(NULL AS INTEGER) AS is_group FROM artist")
def t11(m):
    return io.add_column_if_missing(io.add_column_if_missing(m.t("artist"), "is_group", "int"), "is_group", "int")


@register("t12_new_keys_only", "SELECT * FROM release WHERE id_release NOT IN (SELECT id_release FROM collection_items)")
def t12(m):
    return L.new_keys_only(m.t("release"), m.t("collection_items"), "id_release")


def _snapshots(m):
    root = scratch_path(m.spark, "snapshots")
    io.publish_snapshot(m.t("artist"), root, "artist")
    io.publish_snapshot(D.derive_artist(m), root, "artist")
    return root


@register("t13_publish_snapshot", """SELECT a.id_artist, a.name_artist, a.profile,
  CASE WHEN EXISTS (SELECT 1 FROM artist_members mm WHERE mm.id_artist = a.id_artist) THEN 1 ELSE 0 END AS is_group,
  t.url_thumbnail, q.qty_collection_items
FROM artist a
LEFT JOIN (SELECT id_artist, min(url_thumbnail) AS url_thumbnail FROM (
   SELECT id_alias AS id_artist, url_thumbnail FROM artist_aliases UNION SELECT id_member, url_thumbnail FROM artist_members
   UNION SELECT id_group, url_thumbnail FROM artist_groups) x GROUP BY id_artist) t ON t.id_artist = a.id_artist
LEFT JOIN (SELECT ra.id_artist, COUNT(*) AS qty_collection_items FROM collection_items ci
   JOIN release_artists ra ON ra.id_release = ci.id_release GROUP BY ra.id_artist) q ON q.id_artist = a.id_artist""")
def t13(m):
    return io.read_snapshot_as_of(m.spark, _snapshots(m), "artist")


@register("t14_read_snapshot_as_of", "SELECT id_artist, name_artist, profile FROM artist")
def t14(m):
    return io.read_snapshot_as_of(m.spark, _snapshots(m), "artist", version=1)


@register("t14b_read_snapshot_as_of_time", "SELECT id_artist, name_artist, profile FROM artist")
def t14b(m):
    """The backup as of the time of the first version."""
    root = _snapshots(m)
    first = io.snapshot_versions(m.spark, root, "artist").orderBy("version").first().published_at
    return io.read_snapshot_as_of(m.spark, root, "artist", as_of=first)


@register("t15_nest_by_key", f"""SELECT id_release, {canon(['position', 'title', 'duration'])} AS tracks
FROM release_tracks GROUP BY id_release""")
def t15(m):
    nested = nest_by_key(m.t("release_tracks"), "id_release", "tracks")
    return C.nested_to_text(nested, "tracks", ["position", "title", "duration"])


@register("t15b_nest_in_parts", f"""SELECT id_release, CAST((nth - 1) // 2 AS INTEGER) AS part, {canon(['position', 'title', 'duration'])} AS tracks
FROM (SELECT *, row_number() OVER (PARTITION BY id_release ORDER BY position NULLS FIRST, title NULLS FIRST, duration NULLS FIRST) AS nth
      FROM release_tracks) GROUP BY id_release, (nth - 1) // 2""")
def t15b(m):
    nested = nest_in_parts(m.t("release_tracks"), "id_release", "tracks", 2, ["position", "title", "duration"])
    return C.nested_to_text(nested, "tracks", ["position", "title", "duration"])


#: documents that a landed file holds, and in how many files a drop lands at least
LANDED_ROWS, LANDED_FILES = 250_000, 8


def _land(documents, path):
    """Write documents as files of bounded size, however many tasks made them; a file is read in several pieces."""
    files = max(LANDED_FILES, -(-documents.count() // LANDED_ROWS))
    documents.coalesce(files).write.option("parquet.block.size", 8 << 20).parquet(path)


@register("s1_stream_ingest", _REL)
def s1(m):
    """Land the release payloads as files (two drops), stream them in, land all of
    them once more (the replay must add nothing) and read the release table back."""
    from crateflow.streaming.ingest import stream_ingest

    base = scratch_path(m.spark, "stream")
    payloads = _payload(m, "release", PL.release_payloads)
    landing, target, ckpt = f"{base}/landing", f"{base}/target", f"{base}/_checkpoint"
    _land(payloads.filter(F.pmod("id", F.lit(2)) == 0), f"{landing}/drop=1")
    stream_ingest(m.spark, landing, target, ckpt, max_files_per_trigger=4)
    _land(payloads.filter(F.pmod("id", F.lit(2)) == 1), f"{landing}/drop=2")
    _land(payloads, f"{landing}/drop=3")
    stream_ingest(m.spark, landing, target, ckpt, max_files_per_trigger=4)
    return read_loaded(m.spark, target, "release").drop("dt_loaded")


@register("s2_stream_all_entities", _counts_sql().replace("SELECT '_quarantine_item'", "SELECT '_dead_letter', 0 UNION ALL SELECT '_quarantine_item'"))
def s2(m):
    """Documents of all entities land as JSON lines in two drops, one stream loads them, then all land once more."""
    from crateflow.streaming.ingest import stream_ingest

    base = scratch_path(m.spark, "stream")
    landing, target, ckpt = f"{base}/landing", f"{base}/target", f"{base}/_checkpoint"
    tagged = None
    for entity, df in _landed(m).items():
        key, page = ("id_artist", F.col("page")) if entity == "artist_page" else ("id", F.lit(None).cast("bigint"))
        part = df.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), page.alias("page"), "raw")
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged.filter(F.pmod("id", F.lit(2)) == 0).write.json(f"{landing}/drop=1", compression="gzip")
    stream_ingest(m.spark, landing, target, ckpt, entity=None, form="json")
    tagged.filter(F.pmod("id", F.lit(2)) == 1).write.json(f"{landing}/drop=2", compression="gzip")
    stream_ingest(m.spark, landing, target, ckpt, entity=None, form="json")
    out = None
    for name in sorted({t for r in L.load_log(m.spark, target).entries().select("tables").collect() for t in r.tables}):
        part = read_loaded(m.spark, target, name).agg(F.count(F.lit(1)).alias("qty_rows")).select(F.lit(name).alias("table"), "qty_rows")
        out = part if out is None else out.unionByName(part)
    return out


@register("e22d_flatten_master_styles", """SELECT DISTINCT r.id_master, s.name_style FROM release r
JOIN release_styles s ON s.id_release = r.id_release""")
def e22d(m):
    return FL.flatten_master_styles(master_parsed(m))


@register("e22e_flatten_master_videos", """SELECT mm.id_master, v.url_video, v.title, v.duration FROM master_main mm
JOIN release_videos v ON v.id_release = mm.id_main_release""")
def e22e(m):
    return FL.flatten_master_videos(master_parsed(m))


@register("e2_refresh_collection_items", f"""
SELECT id_release, strftime(date_added, '%Y-%m-%dT%H:%M:%S') AS date_added, id_instance, title, id_master,
       concat('{API}/masters/', cast(id_master AS varchar)) AS api_master,
       concat('{API}/releases/', cast(id_release AS varchar)) AS api_release,
       url_thumbnail, url_cover, year_released, rating
FROM collection_items""")
def e2(m):
    """Full refresh: a first load, then a second complete load replaces it."""
    path = f"{scratch_path(m.spark, 'collection')}/collection_items"
    items = FL.flatten_collection_item(item_parsed(m))
    L.refresh_table(items.withColumn("rating", F.col("rating") + 1), path)
    L.refresh_table(items, path)
    return m.spark.read.parquet(path)
