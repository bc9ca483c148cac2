"""Catalogue queries (browse, search, sample, top-k, nested documents).

Every function takes a table handle ``m`` (``m.t(name)`` -> DataFrame) and
returns a DataFrame; pages for one artist or release are filters on the
same plans, so Catalyst pushes the key filter below the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.functions.text import canonical_list, contains_ci, fmt_fields, sort_key_a, sort_key_b
from crateflow.operators.keys import pin_rows
from crateflow.operators.ordering import sample_n, top_k, with_position

IMAGE_COLS = ["url_image", "url_image_150", "width_image"]
CATALOG_COLS = ["id_artist", "name_artist", "profile", *IMAGE_COLS, "qty_collection_items"]
ITEM_COLS = ["id_release", "title", "url_thumbnail", "url_cover", "year_released", "id_master"]


def primary_image(m, artists: DataFrame, key: str = "id_artist") -> DataFrame:
    """``artists`` LEFT JOIN images, keeping primary or image-less rows.

    An artist whose images are all non-primary drops out (the filter sits
    after the outer join, as in the source queries).
    """
    img = m.t("artist_images").select(F.col("id_artist").alias("__img_id"), "type", *IMAGE_COLS)
    j = artists.join(img, artists[key] == img["__img_id"], "left")
    return j.filter((F.col("type") == "primary") | F.col("type").isNull()).drop("__img_id", "type")


def collected_releases(m) -> DataFrame:
    """Distinct ids of releases in the collection."""
    return m.t("collection_items").select("id_release").distinct()


def artist_releases(m, artist_ids: DataFrame) -> DataFrame:
    """(id_release, id_artist) rows of the given artists, evaluated once.

    For a page or a short listing these are few beside the tables that meet
    them, and once written Spark knows it: the tables are filtered where they
    are scanned instead of being shuffled whole.
    """
    ra = m.t("release_artists").select("id_release", "id_artist")
    return pin_rows(ra.join(artist_ids.select("id_artist").distinct(), "id_artist", "left_semi").select("id_release", "id_artist"))


def artist_catalog(m, fmt: str | None = "Vinyl", artist_ids: DataFrame | None = None,
                   releases: DataFrame | None = None) -> DataFrame:
    """Q1: artists with a collected release, their primary image and the
    number of distinct collected releases in format ``fmt``.

    Releases whose format rows exist but none is ``fmt`` are dropped; a
    release without format rows keeps the artist with count 0. ``fmt=None``
    is the search variant (no format filter). Both sides are reduced to one
    row per artist before the final join. ``releases``: the rows of
    ``artist_releases`` for ``artist_ids``, where they are few.
    """
    rel, formats = collected_releases(m), m.t("release_formats")
    ra = m.t("release_artists").select("id_release", "id_artist")
    if releases is not None:
        ra = releases
        rel = m.t("collection_items").select("id_release").join(ra, "id_release", "left_semi").distinct()
        formats = formats.join(ra, "id_release", "left_semi")
    elif artist_ids is not None:
        ra = ra.join(artist_ids.select("id_artist").distinct(), "id_artist", "left_semi")
    if fmt is None:
        rf = formats.select("id_release").distinct()
        per_rel = rel.join(rf.withColumn("__fid", F.col("id_release")), "id_release", "left")
    else:
        rf = (formats.groupBy("id_release")
              .agg(F.max((F.col("name_format") == F.lit(fmt)).cast("int")).alias("__has_fmt")))
        per_rel = (rel.join(rf, "id_release", "left")
                   .filter(F.col("__has_fmt").isNull() | (F.col("__has_fmt") == 1))
                   .withColumn("__fid", F.when(F.col("__has_fmt") == 1, F.col("id_release"))))
    counts = (ra.join(per_rel.select("id_release", "__fid"), "id_release")
              .groupBy("id_artist")
              .agg(F.count_distinct("__fid").alias("qty_collection_items")))
    artists = m.t("artist").select("id_artist", "name_artist", "profile")
    if artist_ids is not None:
        artists = artists.join(artist_ids.select("id_artist").distinct(), "id_artist", "left_semi")
    return primary_image(m, artists).join(counts, "id_artist").select(*CATALOG_COLS)


def _artist_order():
    return [sort_key_a("name_artist").asc_nulls_last(), F.col("id_artist").asc_nulls_last(),
            F.col("url_image").asc_nulls_last()]


def artists_all(m) -> DataFrame:
    """Q3: Q1 in sort-key-A order, with ``pos``."""
    return with_position(artist_catalog(m), _artist_order())


def artists_top10(m, k: int = 10) -> DataFrame:
    """Q4: first ``k`` of Q3 (landing list)."""
    return top_k(artist_catalog(m), _artist_order(), k)


def artists_top_collected(m) -> DataFrame:
    """Q5: Q1 by collected count, most first."""
    order = [F.col("qty_collection_items").desc_nulls_last(), *_artist_order()]
    return with_position(artist_catalog(m), order)


def artists_random(m, n: int = 5, seed: int | None = None) -> DataFrame:
    """Q6: ``n`` random artists of Q1."""
    return sample_n(artist_catalog(m), n, seed, ["id_artist", "url_image"])


def artists_search(m, text: str, wildcards: bool = False) -> DataFrame:
    """Q7: name substring (case-insensitive), any format, sort key A."""
    ids = m.t("artist").filter(contains_ci("name_artist", text, wildcards)).select("id_artist")
    return with_position(artist_catalog(m, fmt=None, artist_ids=ids), _artist_order())


def artists_search_or_all(m, text: str) -> DataFrame:
    """Q27: empty text lists everything (Q3), otherwise searches (Q7)."""
    return artists_all(m) if not text else artists_search(m, text)


def _artist_item_rows(m) -> DataFrame:
    """(id_artist, id_release) for every collection row (instances repeat)."""
    ci = m.t("collection_items").select("id_release")
    return ci.join(m.t("release_artists").select("id_release", "id_artist"), "id_release")


def artist_items(m, artist_ids: DataFrame) -> DataFrame:
    """(id_artist, id_release, number of items) of the given artists, evaluated once."""
    rows = m.t("collection_items").select("id_release").join(artist_releases(m, artist_ids), "id_release")
    return pin_rows(_items_by_release(rows))


def _items_by_release(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id_artist", "id_release").agg(F.count(F.lit(1)).alias("__n_items"))


def artist_attribute_counts(m, table: str, attr: str, artist_ids: DataFrame | None = None,
                            items: DataFrame | None = None) -> DataFrame:
    """Q10: per artist, collected items by ``attr`` of ``table``.

    The attribute rows are counted per release first, so the join multiplies
    per-release counts instead of rows. ``items``: the rows of
    ``artist_items`` for ``artist_ids``, where several attributes are counted.
    """
    attr_rows = m.t(table).select("id_release", attr)
    if artist_ids is not None:
        # a bounded listing: only its releases' attribute rows are aggregated
        per_rel_item = items if items is not None else artist_items(m, artist_ids)
        attr_rows = attr_rows.join(per_rel_item.select("id_release"), "id_release", "left_semi")
    else:
        per_rel_item = _items_by_release(_artist_item_rows(m))
    per_rel_attr = attr_rows.groupBy("id_release", attr).agg(F.count(F.lit(1)).alias("__n_attr"))
    return (per_rel_item.join(per_rel_attr, "id_release")
            .groupBy("id_artist", attr)
            .agg(F.sum(F.col("__n_items") * F.col("__n_attr")).alias("qty_collection_items")))


def artist_formats(m, artist_ids=None, items=None):
    return artist_attribute_counts(m, "release_formats", "name_format", artist_ids, items)


def artist_genres(m, artist_ids=None, items=None):
    return artist_attribute_counts(m, "release_genres", "name_genre", artist_ids, items)


def artist_styles(m, artist_ids=None, items=None):
    return artist_attribute_counts(m, "release_styles", "name_style", artist_ids, items)


def artist_urls(m, id_artist: int) -> DataFrame:
    """Q13: urls of one artist."""
    return m.t("artist_urls").filter(F.col("id_artist") == F.lit(id_artist)).select("id_artist", "url")


def collection_base(m) -> DataFrame:
    """Q14: the six columns of the collection list."""
    return m.t("collection_items").select(*ITEM_COLS)


def _item_order_a():
    return [sort_key_a("title").asc_nulls_last(), F.col("id_release").asc_nulls_last()]


def _item_order_b():
    return [sort_key_b("title").asc_nulls_last(), F.col("id_release").asc_nulls_last()]


def collection_all(m) -> DataFrame:
    """Q15: items in sort-key-A order."""
    return with_position(collection_base(m), _item_order_a())


def collection_top10(m, k: int = 10) -> DataFrame:
    """Q16: first ``k`` items in sort-key-B order."""
    return top_k(collection_base(m), _item_order_b(), k)


def collection_random(m, n: int = 5, seed: int | None = None) -> DataFrame:
    """Q17."""
    return sample_n(collection_base(m), n, seed, ["id_release"])


def collection_search(m, text: str, wildcards: bool = False) -> DataFrame:
    """Q18: title substring, sort key B."""
    return with_position(collection_base(m).filter(contains_ci("title", text, wildcards)), _item_order_b())


def collection_search_or_all(m, text: str) -> DataFrame:
    """Q27 for items."""
    return collection_all(m) if not text else collection_search(m, text)


def collection_by_artist(m, id_artist: int) -> DataFrame:
    """Q19: an artist's items by year, each with its track list.

    ``tracks`` is an array of (position, title); empty when the release has
    no track rows.
    """
    ra = m.t("release_artists").filter(F.col("id_artist") == F.lit(id_artist)).select("id_release")
    items = collection_base(m).join(ra, "id_release")
    tracks = (m.t("release_tracks").join(items.select("id_release").distinct(), "id_release", "left_semi")
              .groupBy("id_release")
              .agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("tracks")))
    out = items.join(tracks, "id_release", "left").withColumn(
        "tracks", F.coalesce(F.col("tracks"), F.array().cast("array<struct<position:string,title:string>>")))
    return with_position(out, [F.col("year_released").asc_nulls_last(), F.col("id_release").asc_nulls_last()])


def collection_formats(m) -> DataFrame:
    """Q20: items per format, most first."""
    per_rel = m.t("collection_items").groupBy("id_release").agg(F.count(F.lit(1)).alias("__n"))
    agg = (m.t("release_formats").select("id_release", "name_format").join(per_rel, "id_release")
           .groupBy("name_format").agg(F.sum("__n").alias("qty_collection_items")))
    return with_position(agg, [F.col("qty_collection_items").desc_nulls_last(),
                               F.col("name_format").asc_nulls_last()])


def item_artists(m, release_ids: DataFrame | None = None) -> DataFrame:
    """Artists of the given (default: collected) releases, names by left join."""
    ids = release_ids if release_ids is not None else collected_releases(m)
    ra = m.t("release_artists").join(ids.select("id_release").distinct(), "id_release", "left_semi")
    return ra.join(m.t("artist").select("id_artist", "name_artist"), "id_artist", "left").select(
        "id_release", "id_artist", "name_artist")


def item_formats(m, release_ids: DataFrame | None = None) -> DataFrame:
    """Format rows of the releases (read from the format table)."""
    ids = release_ids if release_ids is not None else collected_releases(m)
    return m.t("release_formats").join(ids.select("id_release").distinct(), "id_release", "left_semi").select(
        "id_release", "name_format")


def _item_attr(m, table: str, attr: str, release_ids: DataFrame | None) -> DataFrame:
    ci = m.t("collection_items").select("id_release")
    if release_ids is not None:
        ci = ci.join(release_ids.select("id_release").distinct(), "id_release", "left_semi")
    return ci.join(m.t(table).select("id_release", attr), "id_release")


def item_genres(m, release_ids=None) -> DataFrame:
    """Genres through the items (a twice-owned release repeats)."""
    return _item_attr(m, "release_genres", "name_genre", release_ids)


def item_styles(m, release_ids=None) -> DataFrame:
    """Q21d."""
    return _item_attr(m, "release_styles", "name_style", release_ids)


def collection_documents(m) -> DataFrame:
    """Q22: items with nested artists / formats / genres / styles.

    Each list is aggregated per release (one shuffle on id_release each);
    the joins then reuse that partitioning.
    """
    base = collection_base(m)
    arts = item_artists(m).groupBy("id_release").agg(
        F.array_sort(F.collect_list(F.struct("id_artist", "name_artist"))).alias("artists"))
    fmts = item_formats(m).groupBy("id_release").agg(
        F.array_sort(F.collect_list("name_format")).alias("formats"))
    gens = item_genres(m).groupBy("id_release").agg(F.array_sort(F.collect_list("name_genre")).alias("genres"))
    stys = item_styles(m).groupBy("id_release").agg(F.array_sort(F.collect_list("name_style")).alias("styles"))
    out = base
    for part in (arts, fmts, gens, stys):
        out = out.join(part, "id_release", "left")
    return out


def release_head(m, id_release: int | None = None) -> DataFrame:
    """Q23: release head (one id, or all)."""
    r = m.t("release")
    if id_release is not None:
        r = r.filter(F.col("id_release") == F.lit(id_release))
    return r.select("id_release", "title", "url_thumbnail", "url_cover", "year", "country")


def _by_release(df: DataFrame, id_release: int | None) -> DataFrame:
    return df if id_release is None else df.filter(F.col("id_release") == F.lit(id_release))


def release_artists_page(m, id_release: int | None = None) -> DataFrame:
    """Artists of a release with profile and primary-or-none image."""
    ra = _by_release(m.t("release_artists").select("id_release", "id_artist"), id_release)
    a = m.t("artist").select(F.col("id_artist").alias("__aid"), "name_artist", "profile")
    j = ra.join(a, ra["id_artist"] == a["__aid"], "left").drop("__aid")
    return primary_image(m, j).select("id_release", "id_artist", "name_artist", "profile", *IMAGE_COLS)


def release_videos(m, id_release=None):
    return _by_release(m.t("release_videos"), id_release).select("id_release", "url_video", "title")


def release_tracks(m, id_release=None):
    return _by_release(m.t("release_tracks"), id_release).select("id_release", "position", "title", "duration")


def release_formats(m, id_release=None):
    return _by_release(m.t("release_formats"), id_release).select("id_release", "name_format", "qty_format")


def release_genres(m, id_release=None):
    return _by_release(m.t("release_genres"), id_release).select("id_release", "name_genre")


def release_styles(m, id_release=None):
    return _by_release(m.t("release_styles"), id_release).select("id_release", "name_style")


def release_labels(m, id_release=None):
    return _by_release(m.t("release_labels"), id_release).select("id_release", "name_label")


def release_document(m, id_release: int | None = None) -> DataFrame:
    """Q25: release head with its seven nested lists."""
    parts = {
        "artists": (release_artists_page(m, id_release),
                    ["id_artist", "name_artist", "profile", *IMAGE_COLS]),
        "videos": (release_videos(m, id_release), ["url_video", "title"]),
        "tracks": (release_tracks(m, id_release), ["position", "title", "duration"]),
        "formats": (release_formats(m, id_release), ["name_format", "qty_format"]),
        "labels": (release_labels(m, id_release), ["name_label"]),
        "genres": (release_genres(m, id_release), ["name_genre"]),
        "styles": (release_styles(m, id_release), ["name_style"]),
    }
    out = release_head(m, id_release)
    for name, (df, fields) in parts.items():
        nested = df.groupBy("id_release").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(nested, "id_release", "left")
    return out


def genre_style_matrix(m) -> DataFrame:
    """Q26: per (genre, style) — NULL kept as a group — distinct collected
    releases and distinct collected artists.

    Each collected release becomes one row with its sets of genres, styles and
    artists (bounded by the release). A row per release and artist, with the
    two sets, goes to the artist; the combinations are formed there, so only
    the per-combination sums of a task are shuffled again. A release
    is counted with the first of its artists.
    """
    rel = collected_releases(m)

    def sets(table: str, column: str, name: str) -> DataFrame:
        own = m.t(table).select("id_release", column).join(rel, "id_release", "left_semi")
        return own.groupBy("id_release").agg(F.collect_set(F.struct(column)).alias(name))

    # inner join with the artists: a release without artists drops out
    rows = (rel.join(sets("release_artists", "id_artist", "artists"), "id_release")
            .join(sets("release_genres", "name_genre", "genres"), "id_release", "left")
            .join(sets("release_styles", "name_style", "styles"), "id_release", "left"))
    rows = rows.select(F.posexplode("artists").alias("nth", "a"), "genres", "styles")
    # as many tasks as the session has for a shuffle: the combinations are many times what is sent
    parts = int(rel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("a.id_artist", (F.col("nth") == 0).cast("bigint").alias("n"), "genres", "styles").repartition(
        parts, "id_artist")
    rows = rows.select("id_artist", "n", F.explode_outer("genres").alias("g"), "styles")
    rows = rows.select("id_artist", "n", F.col("g.name_genre"), F.explode_outer("styles").alias("s"))
    per_artist = rows.groupBy("id_artist", "name_genre", F.col("s.name_style").alias("name_style")).agg(F.sum("n").alias("n"))
    return per_artist.groupBy("name_genre", "name_style").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("qty_collection_items"),
        F.count(F.lit(1)).alias("qty_collected_artists"))


def nested_to_text(df: DataFrame, col: str, fields: list[str]) -> DataFrame:
    """Replace array<struct> ``col`` by its canonical text (sorted, '|'-joined)."""
    return df.withColumn(col, canonical_list(F.transform(F.col(col), lambda x: fmt_fields(*[x[f] for f in fields]))))
