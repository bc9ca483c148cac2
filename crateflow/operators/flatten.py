"""Flatten landed JSON payloads into the relational model.

Payloads are parsed once with ``from_json`` against an explicit schema
(PERMISSIVE, with a corrupt-record column), then each target table is a
projection or an ``explode`` of the parsed struct — no Python, no per-row
parsing outside the JVM. Missing optional keys come back as NULL; a NULL
or empty list yields no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.session import cut_lineage

CORRUPT = "_corrupt_record"

_PERSON = "struct<id:bigint,name:string,role:string,resource_url:string>"
RELEASE_SCHEMA = (
    "id bigint, master_id bigint, title string, year int, uri string, country string, thumb string, "
    "cover_image string, num_for_sale bigint, "
    "artists array<struct<id:bigint>>, "
    "labels array<struct<id:bigint,name:string,catno:string>>, "
    "formats array<struct<name:string,qty:string>>, "
    f"credits array<{_PERSON}>, "
    "genres array<string>, styles array<string>, "
    "videos array<struct<uri:string,title:string,duration:string>>, "
    f"tracklist array<struct<position:string,title:string,duration:string,extraartists:array<{_PERSON}>>>, "
    "community struct<have:bigint,want:bigint,rating:struct<average:double,count:bigint>>, "
    "lowest_price struct<value:double>, "
    f"{CORRUPT} string")

_LINK = "struct<id:bigint,name:string,resource_url:string,active:boolean,thumbnail_url:string>"
ARTIST_SCHEMA = (
    "id bigint, name string, profile string, "
    "images array<struct<type:string,uri:string,uri150:string,width:int,height:int>>, "
    f"groups array<{_LINK}>, members array<{_LINK}>, "
    "aliases array<struct<id:bigint,name:string,resource_url:string,thumbnail_url:string>>, "
    f"urls array<string>, {CORRUPT} string")

ARTIST_PAGE_SCHEMA = ("array<struct<id:bigint,title:string,type:string,main_release:bigint,artist:string,"
                      "role:string,year:int,thumb:string>>")

ITEM_SCHEMA = (
    "id bigint, instance_id bigint, date_added string, rating bigint, "
    "basic_information struct<title:string,master_id:bigint,master_url:string,resource_url:string,"
    "thumb:string,cover_image:string,year:int>, "
    f"{CORRUPT} string")

MASTER_SCHEMA = (
    "id bigint, main_release bigint, "
    "stats struct<community:struct<in_wantlist:bigint,in_collection:bigint>>, "
    "genres array<string>, styles array<string>, "
    f"tracklist array<struct<position:string,title:string,duration:string,extraartists:array<{_PERSON}>>>, "
    "videos array<struct<uri:string,title:string,duration:string>>, "
    f"{CORRUPT} string")


def _with_parsed(raw: DataFrame, name: str, parsed: Column) -> DataFrame:
    """``raw`` with a parsed column that is evaluated once a row.

    As a plain column, every later filter on one of its fields would be moved
    below it and parse the text again; filters stay above a generated row.
    """
    return raw.drop(name).select("*", F.explode(F.array(parsed)).alias(name))


def parse(raw: DataFrame, schema: str, col: str = "raw") -> DataFrame:
    """Parse a text column into ``doc`` (PERMISSIVE: bad rows keep the text
    in ``doc._corrupt_record`` and NULL fields)."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return _with_parsed(raw, "doc", F.from_json(F.col(col), schema, opts))


def _is_good():
    return F.col(f"doc.{CORRUPT}").isNull() & F.col("doc.id").isNotNull()


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(_is_good())


def quarantine(parsed: DataFrame, id_col: str = "id", col: str = "raw") -> DataFrame:
    """Exactly the rows that ``good`` leaves out (no JSON, wrong types, no id), with their landing id and size."""
    bad = parsed.filter(~F.coalesce(_is_good(), F.lit(False)))
    return bad.select(F.col(id_col).alias("payload_id"), (F.col("__n_chars") if "__n_chars" in parsed.columns else F.length(col)).alias("n_chars"))


def without_text(parsed: DataFrame, col: str = "raw") -> DataFrame:
    """Parsed documents with the size and the hash of their text in place of it, as much as ``quarantine`` and ``one_per_id`` need."""
    return parsed.select("id", "doc", F.length(col).alias("__n_chars"), F.xxhash64(col).alias("__hash"))


def _one_per(rows: DataFrame, keys: tuple[str, ...], col: str = "raw") -> DataFrame:
    """One row for each key, ``rows`` itself where no key comes twice. Only rows of keys that occur several times meet in a shuffle; the others stay where they are."""
    names = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    counts = rows.select(*names).groupBy(*(f"__key{i}" for i in range(len(keys)))).agg(F.count(F.lit(1)).alias("__n"))
    several = cut_lineage(counts.where("__n > 1").drop("__n"))  # written, so that its size is known
    if several.isEmpty():
        return rows
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    order = F.struct("__hash", "doc") if "__hash" in rows.columns else F.struct(F.xxhash64(col), F.col(col))
    first = F.min_by(F.struct(*rows.columns), order)
    chosen = rows.join(several, same, "left_semi").groupBy(*names).agg(first.alias("__row")).select("__row.*")
    return rows.join(several, same, "left_anti").unionByName(chosen)


def one_per_id(parsed: DataFrame, key: str = "doc.id", col: str = "raw") -> DataFrame:
    """One good document for each value of ``key``: of several, the one whose text has the least hash (then the least text).

    Bad copies are taken out first, so they never displace a good one.
    """
    return _one_per(good(parsed), (key,), col)


def parse_pages(pages: DataFrame, col: str = "raw") -> DataFrame:
    """Pages of an artist's releases with ``items``, null where a page is not a list of releases."""
    return _with_parsed(pages, "items", F.from_json(col, ARTIST_PAGE_SCHEMA))


def _page_is_good() -> Column:
    return F.col("items").isNotNull() & F.col("id_artist").isNotNull() & F.col("page").isNotNull()


def _good_pages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(_page_is_good())


def _bad_pages(parsed: DataFrame, col: str = "raw") -> DataFrame:
    return parsed.filter(~_page_is_good()).select("id_artist", "page", F.length(col).alias("n_chars"))


def quarantine_pages(pages: DataFrame, col: str = "raw") -> DataFrame:
    """E26 for pages: those without an artist or number, or whose text is not a list of releases, with their size."""
    return _bad_pages(parse_pages(pages, col), col)


def _stamp(df: DataFrame, dt_loaded: Column | None) -> DataFrame:
    return df if dt_loaded is None else df.withColumn("dt_loaded", dt_loaded)


def _explode(parsed: DataFrame, key: str, arr: str, alias: str = "x") -> DataFrame:
    return good(parsed).select(F.col("doc.id").alias(key), F.explode(f"doc.{arr}").alias(alias))


# ---- release -------------------------------------------------------------------

def flatten_release(parsed: DataFrame, dt_loaded: Column | None = None) -> DataFrame:
    """Release head with renamed columns."""
    d = good(parsed)
    return _stamp(d.select(
        F.col("doc.id").alias("id_release"), F.col("doc.master_id").alias("id_master"),
        F.col("doc.title").alias("title"), F.col("doc.thumb").alias("url_thumbnail"),
        F.col("doc.cover_image").alias("url_cover"), F.col("doc.year").alias("year"),
        F.col("doc.uri").alias("url_release"), F.col("doc.country").alias("country")), dt_loaded)


def flatten_release_artists(parsed, dt_loaded=None, key="id_release"):
    """E5."""
    return _stamp(_explode(parsed, key, "artists").select(F.col("x.id").alias("id_artist"), key), dt_loaded)


def flatten_release_labels(parsed, dt_loaded=None, key="id_release"):
    """E6."""
    return _stamp(_explode(parsed, key, "labels").select(
        key, F.col("x.id").alias("id_label"), F.col("x.name").alias("name_label"), F.col("x.catno").alias("catno")),
        dt_loaded)


def flatten_release_formats(parsed, dt_loaded=None, key="id_release"):
    """E7."""
    return _stamp(_explode(parsed, key, "formats").select(
        key, F.col("x.name").alias("name_format"), F.col("x.qty").alias("qty_format")), dt_loaded)


def flatten_release_credits(parsed, dt_loaded=None, key="id_release"):
    """E8."""
    return _stamp(_explode(parsed, key, "credits").select(
        key, F.col("x.name").alias("name_artist"), F.col("x.role").alias("role"),
        F.col("x.id").alias("id_artist"), F.col("x.resource_url").alias("api_artist")), dt_loaded)


def flatten_release_stats(parsed, dt_loaded=None):
    """NULL-safe paths (a missing ``lowest_price`` gives NULL)."""
    d = good(parsed).filter(F.col("doc.community").isNotNull())
    return _stamp(d.select(
        F.col("doc.id").alias("id_release"), F.col("doc.num_for_sale").alias("qty_for_sale"),
        F.col("doc.lowest_price.value").alias("amt_price_lowest"),
        F.col("doc.community.have").alias("qty_has"), F.col("doc.community.want").alias("qty_want"),
        F.col("doc.community.rating.average").alias("avg_rating"),
        F.col("doc.community.rating.count").alias("qty_ratings")), dt_loaded)


def flatten_genres(parsed, dt_loaded=None, key="id_release"):
    """E10 (NULL list -> no rows)."""
    return _stamp(_explode(parsed, key, "genres").select(key, F.col("x").alias("name_genre")), dt_loaded)


def flatten_styles(parsed, dt_loaded=None, key="id_release"):
    """E11."""
    return _stamp(_explode(parsed, key, "styles").select(key, F.col("x").alias("name_style")), dt_loaded)


def flatten_tracks(parsed, dt_loaded=None, key="id_release"):
    """E12."""
    return _stamp(_explode(parsed, key, "tracklist").select(
        key, F.col("x.position").alias("position"), F.col("x.title").alias("title"),
        F.col("x.duration").alias("duration")), dt_loaded)


def flatten_track_artists(parsed, dt_loaded=None, key="id_release"):
    """Two-level explode; ``extraartists`` may be absent."""
    t = _explode(parsed, key, "tracklist", "t")
    return _stamp(t.select(key, F.col("t.position").alias("position"), F.explode("t.extraartists").alias("x"))
                  .select(key, F.col("x.name").alias("name_artist"), F.col("x.role").alias("role"),
                          F.col("x.id").alias("id_artist"), F.col("x.resource_url").alias("api_artist"),
                          "position"), dt_loaded)


def flatten_videos(parsed, dt_loaded=None, key="id_release"):
    """E14."""
    return _stamp(_explode(parsed, key, "videos").select(
        key, F.col("x.uri").alias("url_video"), F.col("x.title").alias("title"),
        F.col("x.duration").alias("duration")), dt_loaded)


# ---- artist ---------------------------------------------------------------------

def flatten_artist(parsed, dt_loaded=None):
    """E15."""
    return _stamp(good(parsed).select(F.col("doc.id").alias("id_artist"), F.col("doc.name").alias("name_artist"),
                                      F.col("doc.profile").alias("profile")), dt_loaded)


def flatten_artist_masters(pages: DataFrame, dt_loaded=None):
    """Every page of an artist's releases (all pages, the last included); bad pages are in ``quarantine_pages``."""
    x = _good_pages(parse_pages(pages)).select("id_artist", F.explode("items").alias("x"))
    return _stamp(x.select(
        "id_artist", F.col("x.id").alias("id_master"), F.col("x.title").alias("title"),
        F.col("x.type").alias("type"), F.col("x.main_release").alias("id_main_release"),
        F.col("x.artist").alias("name_artist"), F.col("x.role").alias("role"), F.col("x.year").alias("year"),
        F.col("x.thumb").alias("url_thumb")), dt_loaded)


def flatten_artist_pages(pages: DataFrame, dt_loaded=None):
    """Which pages of which artists were loaded."""
    return _stamp(_good_pages(parse_pages(pages)).select("id_artist", "page"), dt_loaded)


def flatten_artist_images(parsed, dt_loaded=None):
    """E17 (NULL list allowed)."""
    return _stamp(_explode(parsed, "id_artist", "images").select(
        "id_artist", F.col("x.type").alias("type"), F.col("x.uri").alias("url_image"),
        F.col("x.uri150").alias("url_image_150"), F.col("x.width").alias("width_image"),
        F.col("x.height").alias("height_image")), dt_loaded)


def _links(parsed, arr: str, what: str, with_active: bool, dt_loaded):
    x = _explode(parsed, "id_artist", arr)
    cols = [F.col("x.id").alias(f"id_{what}"), F.col("x.name").alias(f"name_{what}"),
            F.col("x.resource_url").alias(f"api_{what}")]
    if with_active:
        cols.append(F.col("x.active").alias("is_active"))
    cols += [F.col("x.thumbnail_url").alias("url_thumbnail"), "id_artist"]
    return _stamp(x.select(*cols), dt_loaded)


def flatten_artist_groups(parsed, dt_loaded=None):
    """E18."""
    return _links(parsed, "groups", "group", True, dt_loaded)


def flatten_artist_aliases(parsed, dt_loaded=None):
    """E19."""
    return _links(parsed, "aliases", "alias", False, dt_loaded)


def flatten_artist_members(parsed, dt_loaded=None):
    """E20."""
    return _links(parsed, "members", "member", True, dt_loaded)


def flatten_artist_urls(parsed, dt_loaded=None):
    """E21 (NULL list allowed)."""
    return _stamp(_explode(parsed, "id_artist", "urls").select("id_artist", F.col("x").alias("url")), dt_loaded)


# ---- collection, master ------------------------------------------------------------

def flatten_collection_item(parsed, dt_loaded=None):
    """Eleven fields from the top level and ``basic_information``."""
    d = good(parsed)
    b = "doc.basic_information"
    return _stamp(d.select(
        F.col("doc.id").alias("id_release"), F.col("doc.date_added").alias("date_added"),
        F.col("doc.instance_id").alias("id_instance"), F.col(f"{b}.title").alias("title"),
        F.col(f"{b}.master_id").alias("id_master"), F.col(f"{b}.master_url").alias("api_master"),
        F.col(f"{b}.resource_url").alias("api_release"), F.col(f"{b}.thumb").alias("url_thumbnail"),
        F.col(f"{b}.cover_image").alias("url_cover"), F.col(f"{b}.year").alias("year_released"),
        F.col("doc.rating").alias("rating")), dt_loaded)


def flatten_master_stats(parsed, dt_loaded=None):
    """Master stats (wants, has)."""
    d = good(parsed).filter(F.col("doc.stats").isNotNull())
    return _stamp(d.select(F.col("doc.id").alias("id_master"),
                           F.col("doc.stats.community.in_wantlist").alias("qty_wants"),
                           F.col("doc.stats.community.in_collection").alias("qty_has")), dt_loaded)


# the master genre / style / track / video tables reuse the release flatteners
def flatten_master_genres(parsed, dt_loaded=None):
    return flatten_genres(parsed, dt_loaded, key="id_master")


def flatten_master_styles(parsed, dt_loaded=None):
    return flatten_styles(parsed, dt_loaded, key="id_master")


def flatten_master_tracks(parsed, dt_loaded=None):
    return flatten_tracks(parsed, dt_loaded, key="id_master")


def flatten_master_track_artists(parsed, dt_loaded=None):
    return flatten_track_artists(parsed, dt_loaded, key="id_master")


def flatten_master_videos(parsed, dt_loaded=None):
    return flatten_videos(parsed, dt_loaded, key="id_master")


# the first table of each entity says which ids are loaded; it is written last
RELEASE_SINKS = {
    "release": flatten_release, "release_artists": flatten_release_artists,
    "release_labels": flatten_release_labels, "release_formats": flatten_release_formats,
    "release_credits": flatten_release_credits, "release_stats": flatten_release_stats,
    "release_genres": flatten_genres, "release_styles": flatten_styles, "release_tracks": flatten_tracks,
    "release_track_artists": flatten_track_artists, "release_videos": flatten_videos,
}
ARTIST_SINKS = {
    "artist": flatten_artist, "artist_images": flatten_artist_images, "artist_groups": flatten_artist_groups,
    "artist_aliases": flatten_artist_aliases, "artist_members": flatten_artist_members,
    "artist_urls": flatten_artist_urls,
}
MASTER_SINKS = {
    "master": lambda parsed, dt=None: _stamp(good(parsed).select(F.col("doc.id").alias("id_master"),
                                                                 F.col("doc.main_release").alias("id_main_release")), dt),
    "master_genres": flatten_master_genres, "master_styles": flatten_master_styles, "master_stats": flatten_master_stats,
    "master_tracks": flatten_master_tracks, "master_track_artists": flatten_master_track_artists,
    "master_videos": flatten_master_videos,
}
ITEM_SINKS = {"collection_items": flatten_collection_item}
PAGE_SINKS = {"artist_pages": flatten_artist_pages, "artist_masters": flatten_artist_masters}


@dataclass(frozen=True)
class Entity:
    """A kind of landed document: how it is parsed, what names it, and the tables it fills."""

    schema: str
    keys: tuple[str, ...]  # key columns of its first table
    doc_keys: tuple[str, ...]  # the same in a parsed document
    sinks: dict  # table -> flattener; the first table says which documents are loaded
    always: frozenset = frozenset()  # tables that every load appends to
    paged: bool = False  # several documents (pages) for one id

    def landed(self, raw: DataFrame) -> DataFrame:
        """Payload rows as landing columns: id, raw, and page where documents are pages."""
        if not self.paged:
            return raw.select("id", "raw")
        return raw.select(F.col("id_artist" if "id_artist" in raw.columns else "id").alias("id_artist"), "page", "raw")

    def parsed(self, raw: DataFrame) -> DataFrame:
        rows = self.landed(raw)
        return parse_pages(rows).withColumn("doc", F.struct("id_artist", "page")) if self.paged else parse(rows, self.schema)

    def good(self, parsed: DataFrame) -> DataFrame:
        return _good_pages(parsed) if self.paged else good(parsed)

    def one_each(self, parsed: DataFrame) -> DataFrame:
        """One good document for each key: see ``one_per_id``."""
        return _one_per(self.good(parsed), self.doc_keys)

    def one_of_good(self, rows: DataFrame) -> DataFrame:
        """``one_each`` of documents that are good; the same frame where no key comes twice."""
        return _one_per(rows, self.doc_keys)

    def bad(self, parsed: DataFrame) -> DataFrame:
        return _bad_pages(parsed) if self.paged else quarantine(parsed)


ENTITIES = {
    "release": Entity(RELEASE_SCHEMA, ("id_release",), ("doc.id",), RELEASE_SINKS, frozenset({"release_stats"})),
    "artist": Entity(ARTIST_SCHEMA, ("id_artist",), ("doc.id",), ARTIST_SINKS),
    "artist_page": Entity(ARTIST_PAGE_SCHEMA, ("id_artist", "page"), ("doc.id_artist", "doc.page"), PAGE_SINKS, paged=True),
    "master": Entity(MASTER_SCHEMA, ("id_master",), ("doc.id",), MASTER_SINKS, frozenset({"master_stats"})),
    "item": Entity(ITEM_SCHEMA, ("id_instance",), ("doc.instance_id",), ITEM_SINKS),
}
