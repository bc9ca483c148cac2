"""Landed API payloads, built by Spark from the logical tables.

The source pulls nested JSON documents from a catalogue API. Here the
"landed" documents are produced from the bindings with ``to_json`` — one
row (id, raw JSON string) per entity, or per page for paged resources —
so flattening them back must reproduce the flat tables. Optional fields are
left out (``to_json`` omits NULL fields) to exercise missing keys.

Every builder is linear and partitioned by the entity id; the rows of a
release go through one shuffle, among so many tasks that a task's share does
not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API = "https://api.example"
PAGE_SPAN = 1000  # artist release pages: masters with ids in [k*span, (k+1)*span)


#: rows of the largest child table that one task nests
TASK_ROWS = 100_000


def _nest(df: DataFrame, key: str, name: str, *fields) -> DataFrame:
    return df.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias(name))


def _tasks(df: DataFrame) -> int:
    """Among how many tasks documents with these child rows are dealt, so that a task's share is the same at any size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // TASK_ROWS))


def _listed(name: str) -> Column:
    """A collected list, null where it is empty (an optional field that is left out)."""
    return F.when(F.size(name) > 0, F.col(name)).alias(name)


def _in_one(head: DataFrame, lists: dict[str, DataFrame], tasks: int) -> DataFrame:
    """``head`` (id, ...) with a list for each name of ``lists`` (id and the column of that name).

    Rows of all kinds go through one shuffle and one aggregation. An id
    with several heads gives a row for each; rows without a head or an id
    give none, heads without an id neither.
    """
    kinds = {n: df.schema[n].dataType for n, df in lists.items()}
    fields = [c for c in head.columns if c != "id"]
    own = F.struct(*fields)
    kinds["__head"] = head.select(own.alias("h")).schema["h"].dataType
    every = None
    for name, df in {"__head": head.select("id", own.alias("__head")), **lists}.items():
        part = df.where("id IS NOT NULL").select(
            "id", *(F.col(n).cast(t).alias(n) if n == name else F.lit(None).cast(t).alias(n) for n, t in kinds.items()))
        every = part if every is None else every.unionByName(part)
    grouped = every.repartition(tasks, "id").groupBy("id").agg(*(F.collect_list(n).alias(n) for n in kinds))
    one = grouped.select("id", F.explode("__head").alias("__head"), *(_listed(n) for n in lists))
    return one.select("id", *(F.col(f"__head.{c}").alias(c) for c in fields), *lists)


def _tracks(tracks: DataFrame, extra: DataFrame, tasks: int, key: str = "id_release") -> DataFrame:
    """(id, tracklist): the tracks of each ``key``, each with its further artists (rows of the same key and position)."""
    track = F.struct("position", "title", "duration")
    artist = F.struct(F.col("id_artist").alias("id"), F.col("name_artist").alias("name"), "role",
                      F.col("api_artist").alias("resource_url"))
    kinds = {"track": tracks.select(track.alias("x")).schema["x"].dataType, "extra": extra.select(artist.alias("x")).schema["x"].dataType}
    none = {n: F.lit(None).cast(t).alias(n) for n, t in kinds.items()}
    id_ = F.col(key).alias("id")
    rows = (tracks.where(F.col(key).isNotNull()).select(id_, "position", track.alias("track"), none["extra"])
            .unionByName(extra.where(F.col(key).isNotNull() & F.col("position").isNotNull())
                         .select(id_, "position", none["track"], artist.alias("extra"))))
    at = rows.repartition(tasks, "id").groupBy("id", "position").agg(F.collect_list("track").alias("track"), F.collect_list("extra").alias("extra"))
    each = at.select("id", F.explode("track").alias("t"), F.when(F.size("extra") > 0, F.col("extra")).alias("extraartists"))
    return each.groupBy("id").agg(F.collect_list(F.struct("t.position", "t.title", "t.duration", "extraartists")).alias("tracklist"))


def release_payloads(m) -> DataFrame:
    """(id, raw) — one release document per release."""
    id_ = F.col("id_release").alias("id")
    head = m.t("release").select(
        id_, F.col("id_master").alias("master_id"), "title", "year",
        F.col("url_release").alias("uri"), "country", F.col("url_thumbnail").alias("thumb"),
        F.col("url_cover").alias("cover_image"))

    def rows(table, name, *fields):
        return m.t(table).select(id_, F.struct(*fields).alias(name))

    stats = m.t("release_stats").select(
        id_, F.struct(F.col("qty_for_sale").alias("num_for_sale"),
                      F.struct(F.col("qty_has").alias("have"), F.col("qty_want").alias("want"),
                               F.struct(F.col("avg_rating").alias("average"), F.col("qty_ratings").alias("count"))
                               .alias("rating")).alias("community"),
                      F.when(F.col("amt_price_lowest").isNotNull(),
                             F.struct(F.col("amt_price_lowest").alias("value"))).alias("lowest_price")).alias("stats"))
    lists = {
        "artists": rows("release_artists", "artists", F.col("id_artist").alias("id")),
        "labels": rows("release_labels", "labels", F.col("id_label").alias("id"), F.col("name_label").alias("name"), "catno"),
        "formats": rows("release_formats", "formats", F.col("name_format").alias("name"), F.col("qty_format").alias("qty")),
        "credits": rows("release_credits", "credits", F.col("id_artist").alias("id"), F.col("name_artist").alias("name"), "role"),
        "genres": m.t("release_genres").select(id_, F.col("name_genre").alias("genres")),
        "styles": m.t("release_styles").select(id_, F.col("name_style").alias("styles")),
        "videos": rows("release_videos", "videos", F.col("url_video").alias("uri"), "title", "duration"),
        "stats": stats,
    }
    tasks = _tasks(m.t("release_tracks"))
    doc = _in_one(head, lists, tasks).join(_tracks(m.t("release_tracks"), m.t("release_track_artists"), tasks), "id", "left")
    # several rows of stats give a document each
    doc = doc.withColumn("stats", F.explode_outer("stats")).withColumn("credits", F.transform("credits", lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), c["role"].alias("role"),
        F.concat(F.lit(f"{API}/artists/"), c["id"].cast("string")).alias("resource_url"))))
    cols = [F.col(c) for c in (*head.columns, "artists", "labels", "formats", "credits", "genres", "styles", "videos", "tracklist")]
    doc = doc.select("id", F.to_json(F.struct(*cols, "stats.num_for_sale", "stats.community", "stats.lowest_price")).alias("raw"))
    return doc.unionByName(head.where("id IS NULL").select("id", F.to_json(F.struct(*head.columns)).alias("raw")))


def artist_payloads(m) -> DataFrame:
    """(id, raw) — one artist document per known artist."""
    a = m.t("artist").select(F.col("id_artist").alias("id"), F.col("name_artist").alias("name"), "profile")
    k = "id_artist"

    def api(c):
        return F.concat(F.lit(f"{API}/artists/"), F.col(c).cast("string"))

    def name(c):
        return F.concat(F.lit("Artist "), F.col(c).cast("string"))

    images = _nest(m.t("artist_images"), k, "images", "type", F.col("url_image").alias("uri"),
                   F.col("url_image_150").alias("uri150"), F.col("width_image").alias("width"),
                   F.col("height_image").alias("height"))
    groups = _nest(m.t("artist_groups"), k, "groups", F.col("id_group").alias("id"), name("id_group").alias("name"),
                   api("id_group").alias("resource_url"), (F.col("id_group") % 2 == 0).alias("active"),
                   F.col("url_thumbnail").alias("thumbnail_url"))
    members = _nest(m.t("artist_members"), k, "members", F.col("id_member").alias("id"),
                    name("id_member").alias("name"), api("id_member").alias("resource_url"),
                    (F.col("id_member") % 2 == 0).alias("active"), F.col("url_thumbnail").alias("thumbnail_url"))
    aliases = _nest(m.t("artist_aliases"), k, "aliases", F.col("id_alias").alias("id"),
                    name("id_alias").alias("name"), api("id_alias").alias("resource_url"),
                    F.col("url_thumbnail").alias("thumbnail_url"))
    urls = m.t("artist_urls").groupBy(k).agg(F.collect_list("url").alias("urls"))
    doc = a
    for part in (images, groups, members, aliases, urls):
        doc = doc.join(part.withColumnRenamed(k, "id"), "id", "left")
    return doc.select("id", F.to_json(F.struct(*doc.columns)).alias("raw"))


SECOND_HOP = 1_000_000  # a referenced artist x has one member, SECOND_HOP + x


def referenced_artist_payloads(m, ids: DataFrame) -> DataFrame:
    """(id, raw) of artists that are referenced but not loaded, over two hops.

    ``ids`` (id_artist): the artists referenced by what is loaded. Each of them has a member that only its
    document names. Every third id has landed no document, so it stays missing.
    """
    first = ids.select(F.col("id_artist").alias("id")).distinct()
    member = F.array(F.struct((F.col("id") + SECOND_HOP).alias("id"), F.lit("member").alias("name"), F.lit(True).alias("active")))
    second = first.select((F.col("id") + SECOND_HOP).alias("id"))
    docs = first.withColumn("members", member).unionByName(second.withColumn("members", F.lit(None).cast(
        "array<struct<id:bigint,name:string,active:boolean>>")))
    docs = docs.filter(F.pmod("id", F.lit(3)) != 0).withColumn("name", F.concat(F.lit("Artist "), F.col("id").cast("string")))
    urls = F.array(F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))
    return docs.select("id", F.to_json(F.struct("id", "name", "members", urls.alias("urls"))).alias("raw"))


def referenced_artist_pages(m, ids: DataFrame) -> DataFrame:
    """(id_artist, page, raw) of referenced artists: id modulo 4 masters each, one a page; some have pages but no document."""
    own = ids.select("id_artist").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(3))))
    own = own.where(F.col("page") <= F.pmod("id_artist", F.lit(4)))
    master = F.struct((F.col("id_artist") * 10 + F.col("page")).alias("id"), F.lit("master").alias("type"), F.lit("Main").alias("role"))
    return own.select("id_artist", F.col("page").cast("bigint").alias("page"), F.to_json(F.array(master)).alias("raw"))


def artist_release_pages(m) -> DataFrame:
    """(id_artist, page, raw) — paged artist releases, known artists only.

    Each page is one landed document (a JSON array), so no document grows
    with an artist's catalogue.
    """
    am = m.t("artist_masters").join(m.t("artist").select("id_artist", "name_artist"), "id_artist")
    r = m.t("release").select(F.col("id_release").alias("id_master"), "title", "year",
                              F.col("url_thumbnail").alias("thumb"))
    rows = am.join(r, "id_master", "left").select(
        "id_artist", F.floor(F.col("id_master") / PAGE_SPAN).cast("bigint").alias("page"),
        F.struct(F.col("id_master").alias("id"), "title",
                 F.when(F.col("role") == "Main", F.lit("master")).otherwise(F.lit("release")).alias("type"),
                 F.col("id_master").alias("main_release"), F.col("name_artist").alias("artist"), "role",
                 "year", "thumb").alias("item"))
    pages = rows.groupBy("id_artist", "page").agg(F.collect_list("item").alias("items"))
    return pages.select("id_artist", "page", F.to_json("items").alias("raw"))


def item_payloads(m) -> DataFrame:
    """(id, raw) — one collection item (instance) per row."""
    ci = m.t("collection_items")
    doc = ci.select(
        F.col("id_release").alias("id"), F.col("id_instance").alias("instance_id"),
        F.date_format("date_added", "yyyy-MM-dd'T'HH:mm:ss").alias("date_added"), "rating",
        F.struct("title", F.col("id_master").alias("master_id"),
                 F.concat(F.lit(f"{API}/masters/"), F.col("id_master").cast("string")).alias("master_url"),
                 F.concat(F.lit(f"{API}/releases/"), F.col("id_release").cast("string")).alias("resource_url"),
                 F.col("url_thumbnail").alias("thumb"), F.col("url_cover").alias("cover_image"),
                 F.col("year_released").alias("year")).alias("basic_information"))
    return doc.select(F.col("instance_id").alias("id"), F.to_json(F.struct(*doc.columns)).alias("raw"))


def master_payloads(m) -> DataFrame:
    """(id, raw) — one master document: stats, genres, styles, tracks and
    videos of its main release."""
    rel = m.t("release").select("id_release", "id_master")
    main = m.t("master_main")
    none = F.lit(None).cast("bigint")

    def named(table, name, kind):
        return m.t(table).select("id_release", F.lit(kind).alias("kind"), F.col(name).alias("name"), none.alias("want"), none.alias("has"))

    # the master of each genre, style and stats row is looked up once; what is left is a row for each of a master's names
    own = (named("release_genres", "name_genre", "genre").unionByName(named("release_styles", "name_style", "style"))
           .unionByName(m.t("release_stats").select("id_release", F.lit("stats").alias("kind"), F.lit(None).cast("string").alias("name"),
                                                    F.col("qty_want").alias("want"), F.col("qty_has").alias("has"))))
    own = (rel.join(own, "id_release").groupBy("id_master", "kind", "name")
           .agg(F.sum("want").alias("want"), F.sum("has").alias("has")))
    named_as = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("name")))
    stats = F.struct(F.struct(F.col("want").alias("in_wantlist"), F.col("has").alias("in_collection")).alias("community"))
    own = own.groupBy("id_master").agg(named_as("genre").alias("genres"), named_as("style").alias("styles"),
                                       F.first(F.when(F.col("kind") == "stats", stats), ignorenulls=True).alias("stats"))
    own = own.select("id_master", _listed("genres"), _listed("styles"), "stats")
    mine = main.where("id_master IS NOT NULL").select("id_master", F.col("id_main_release").alias("id_release"))
    tracks, extra = (mine.join(m.t(t), "id_release") for t in ("release_tracks", "release_track_artists"))
    tracks = _tracks(tracks, extra, int(main.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id_master")
    videos = _nest(mine.join(m.t("release_videos"), "id_release"), "id_master", "videos", F.col("url_video").alias("uri"), "title", "duration")
    doc = main.select(F.col("id_master").alias("id"), F.col("id_main_release").alias("main_release"))
    for part in (own, videos):
        doc = doc.join(part.withColumnRenamed("id_master", "id"), "id", "left")
    doc = doc.join(tracks, "id", "left")
    return doc.select("id", F.to_json(F.struct("id", "main_release", "stats", "genres", "styles", "tracklist", "videos")).alias("raw"))
