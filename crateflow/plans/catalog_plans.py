"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.operators import catalog as C
from crateflow.operators import search as SE
from crateflow.plans import params as P
from crateflow.plans.registry import register
from crateflow.plans.sqlparts import (ARTIST_ORDER, KEY_A_TITLE, KEY_B_TITLE, PICTURES, canon, catalog_sql)

Q1 = catalog_sql()


@register("q1_artist_catalog", Q1)
def q1(m):
    return C.artist_catalog(m, P.FORMAT)


@register("q3_artists_all", f"SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos FROM ({Q1}) q")
def q3(m):
    return C.artists_all(m)


@register("q4_artists_top10", f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos
FROM ({Q1}) q) WHERE pos <= {P.TOP_K}""")
def q4(m):
    return C.artists_top10(m, P.TOP_K)


@register("q5_artists_top_collected", f"""SELECT *, row_number() OVER (ORDER BY qty_collection_items DESC NULLS LAST,
{ARTIST_ORDER}) AS pos FROM ({Q1}) q""")
def q5(m):
    return C.artists_top_collected(m)


@register("q6_artists_random", f"""SELECT * FROM ({Q1}) q ORDER BY md5(concat('{P.SEED}:', cast(id_artist AS varchar), ':',
coalesce(url_image, ''))) LIMIT {P.RANDOM_N}""")
def q6(m):
    return C.artists_random(m, P.RANDOM_N, P.SEED)


_Q7 = catalog_sql(False, P.ARTIST_SEARCH)


@register("q7_artists_search", f"SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos FROM ({_Q7}) q")
def q7(m):
    return C.artists_search(m, P.ARTIST_SEARCH)


@register("q7b_artists_search_indexed", f"SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos FROM ({_Q7}) q")
def q7b(m):
    return SE.artists_search(m, P.ARTIST_SEARCH)


def _attr_sql(table: str, attr: str) -> str:
    return f"""SELECT ra.id_artist, t.{attr}, COUNT(*) AS qty_collection_items
FROM collection_items ci JOIN release_artists ra ON ra.id_release = ci.id_release
JOIN {table} t ON t.id_release = ci.id_release GROUP BY ra.id_artist, t.{attr}"""


@register("q10a_artist_formats", _attr_sql("release_formats", "name_format"))
def q10a(m):
    return C.artist_formats(m)


@register("q10b_artist_genres", _attr_sql("release_genres", "name_genre"))
def q10b(m):
    return C.artist_genres(m)


@register("q10c_artist_styles", _attr_sql("release_styles", "name_style"))
def q10c(m):
    return C.artist_styles(m)


@register("q13_artist_urls", f"SELECT id_artist, url FROM artist_urls WHERE id_artist = {P.ARTIST_ID}")
def q13(m):
    return C.artist_urls(m, P.ARTIST_ID)


_ITEMS = "SELECT id_release, title, url_thumbnail, url_cover, year_released, id_master FROM collection_items"


@register("q14_collection_base", _ITEMS)
def q14(m):
    return C.collection_base(m)


@register("q15_collection_all", f"""SELECT *, row_number() OVER (ORDER BY {KEY_A_TITLE} ASC NULLS LAST,
id_release ASC NULLS LAST) AS pos FROM ({_ITEMS}) q""")
def q15(m):
    return C.collection_all(m)


@register("q16_collection_top10", f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {KEY_B_TITLE} ASC NULLS LAST,
id_release ASC NULLS LAST) AS pos FROM ({_ITEMS}) q) WHERE pos <= {P.TOP_K}""")
def q16(m):
    return C.collection_top10(m, P.TOP_K)


@register("q17_collection_random", f"""SELECT * FROM ({_ITEMS}) q
ORDER BY md5(concat('{P.SEED}:', cast(id_release AS varchar))) LIMIT {P.RANDOM_N}""")
def q17(m):
    return C.collection_random(m, P.RANDOM_N, P.SEED)


_Q18 = f"""SELECT *, row_number() OVER (ORDER BY {KEY_B_TITLE} ASC NULLS LAST, id_release ASC NULLS LAST) AS pos
FROM ({_ITEMS} WHERE title ILIKE '%{P.TITLE_SEARCH}%') q"""


@register("q18_collection_search", _Q18)
def q18(m):
    return C.collection_search(m, P.TITLE_SEARCH)


@register("q18b_collection_search_indexed", _Q18)
def q18b(m):
    return SE.collection_search(m, P.TITLE_SEARCH)


@register("q19_collection_by_artist", f"""
SELECT ci.id_release, ci.title, ci.url_thumbnail, ci.url_cover, ci.year_released, ci.id_master,
       coalesce(t.tracks, '') AS tracks,
       row_number() OVER (ORDER BY ci.year_released ASC NULLS LAST, ci.id_release ASC NULLS LAST) AS pos
FROM collection_items ci JOIN release_artists ra ON ci.id_release = ra.id_release
LEFT JOIN (SELECT id_release, {canon(['position', 'title'])} AS tracks FROM release_tracks GROUP BY id_release) t
  ON t.id_release = ci.id_release
WHERE ra.id_artist = {P.ARTIST_ID}""")
def q19(m):
    return C.nested_to_text(C.collection_by_artist(m, P.ARTIST_ID), "tracks", ["position", "title"])


@register("q20_collection_formats", """
SELECT name_format, qty_collection_items,
       row_number() OVER (ORDER BY qty_collection_items DESC NULLS LAST, name_format ASC NULLS LAST) AS pos
FROM (SELECT name_format, CAST(SUM(copies) AS BIGINT) AS qty_collection_items
      FROM (SELECT id_release, COUNT(*) AS copies FROM collection_items GROUP BY id_release) owned
      JOIN release_formats USING (id_release) GROUP BY name_format) q""")
def q20(m):
    return C.collection_formats(m)


@register("q21a_item_artists", """
SELECT ra.id_release, ra.id_artist, a.name_artist FROM release_artists ra
LEFT JOIN artist a ON a.id_artist = ra.id_artist
WHERE ra.id_release IN (SELECT id_release FROM collection_items)""")
def q21a(m):
    return C.item_artists(m)


@register("q21b_item_formats", """
SELECT id_release, name_format FROM release_formats WHERE id_release IN (SELECT id_release FROM collection_items)""")
def q21b(m):
    return C.item_formats(m)


@register("q21c_item_genres", """
SELECT ci.id_release, rg.name_genre FROM collection_items ci JOIN release_genres rg ON rg.id_release = ci.id_release""")
def q21c(m):
    return C.item_genres(m)


@register("q21d_item_styles", """
SELECT ci.id_release, rs.name_style FROM collection_items ci JOIN release_styles rs ON rs.id_release = ci.id_release""")
def q21d(m):
    return C.item_styles(m)


@register("q22_collection_documents", f"""
SELECT ci.id_release, ci.title, ci.url_thumbnail, ci.url_cover, ci.year_released, ci.id_master,
       a.artists, f.formats, g.genres, s.styles
FROM collection_items ci
LEFT JOIN (SELECT ra.id_release, {canon(['ra.id_artist', 'a.name_artist'])} AS artists
           FROM release_artists ra LEFT JOIN artist a ON a.id_artist = ra.id_artist
           WHERE ra.id_release IN (SELECT id_release FROM collection_items) GROUP BY ra.id_release) a
  ON a.id_release = ci.id_release
LEFT JOIN (SELECT id_release, {canon(['name_format'])} AS formats FROM release_formats
           WHERE id_release IN (SELECT id_release FROM collection_items) GROUP BY id_release) f
  ON f.id_release = ci.id_release
LEFT JOIN (SELECT c.id_release, {canon(['rg.name_genre'])} AS genres FROM collection_items c
           JOIN release_genres rg ON rg.id_release = c.id_release GROUP BY c.id_release) g
  ON g.id_release = ci.id_release
LEFT JOIN (SELECT c.id_release, {canon(['rs.name_style'])} AS styles FROM collection_items c
           JOIN release_styles rs ON rs.id_release = c.id_release GROUP BY c.id_release) s
  ON s.id_release = ci.id_release""")
def q22(m):
    d = C.collection_documents(m)
    d = C.nested_to_text(d, "artists", ["id_artist", "name_artist"])
    for c in ("formats", "genres", "styles"):
        d = d.withColumn(c, F.array_join(F.array_sort(F.col(c)), "|"))
    return d


@register("q23_release_head", f"""SELECT id_release, title, url_thumbnail, url_cover, year, country
FROM release WHERE id_release = {P.RELEASE_ID}""")
def q23(m):
    return C.release_head(m, P.RELEASE_ID)


# an artist that is not loaded is listed with empty columns
_Q24A = f"""SELECT w.id_release, w.id_artist, shown.name_artist, shown.profile, shown.url_image, shown.url_image_150,
       shown.width_image
FROM (SELECT * FROM artist JOIN ({PICTURES}) pic USING (id_artist)) shown JOIN release_artists w USING (id_artist)
UNION ALL SELECT id_release, id_artist, NULL, NULL, NULL, NULL, NULL FROM release_artists ANTI JOIN artist USING (id_artist)"""


@register("q24a_release_artists", _Q24A)
def q24a(m):
    return C.release_artists_page(m)


@register("q24b_release_videos", "SELECT id_release, url_video, title FROM release_videos")
def q24b(m):
    return C.release_videos(m)


@register("q24c_release_tracks", "SELECT id_release, position, title, duration FROM release_tracks")
def q24c(m):
    return C.release_tracks(m)


@register("q24d_release_formats", "SELECT id_release, name_format, qty_format FROM release_formats")
def q24d(m):
    return C.release_formats(m)


@register("q24e_release_genres", "SELECT id_release, name_genre FROM release_genres")
def q24e(m):
    return C.release_genres(m)


@register("q24f_release_styles", "SELECT id_release, name_style FROM release_styles")
def q24f(m):
    return C.release_styles(m)


@register("q24g_release_labels", "SELECT id_release, name_label FROM release_labels")
def q24g(m):
    return C.release_labels(m)


_DOC_FIELDS = {
    "artists": ["id_artist", "name_artist", "profile", "url_image", "url_image_150", "width_image"],
    "videos": ["url_video", "title"],
    "tracks": ["position", "title", "duration"],
    "formats": ["name_format", "qty_format"],
    "labels": ["name_label"],
    "genres": ["name_genre"],
    "styles": ["name_style"],
}
_DOC_SRC = {
    "artists": f"({_Q24A})", "videos": "release_videos", "tracks": "release_tracks",
    "formats": "release_formats", "labels": "release_labels", "genres": "release_genres",
    "styles": "release_styles",
}


def _q25_sql() -> str:
    joins = "\n".join(
        f"LEFT JOIN (SELECT id_release, {canon(fs)} AS {n} FROM {_DOC_SRC[n]} x GROUP BY id_release) {n}_t "
        f"ON {n}_t.id_release = r.id_release" for n, fs in _DOC_FIELDS.items())
    cols = ", ".join(f"{n}_t.{n}" for n in _DOC_FIELDS)
    return f"""SELECT r.id_release, r.title, r.url_thumbnail, r.url_cover, r.year, r.country, {cols}
FROM release r
{joins}"""


@register("q25_release_document", _q25_sql())
def q25(m):
    d = C.release_document(m)
    for n, fs in _DOC_FIELDS.items():
        d = C.nested_to_text(d, n, fs)
    return d


@register("q26_genre_style_matrix", """
WITH combo AS (
  SELECT DISTINCT owned.id_release, g.name_genre, s.name_style
  FROM (SELECT DISTINCT id_release FROM collection_items SEMI JOIN release_artists USING (id_release)) owned
  LEFT JOIN release_genres g USING (id_release) LEFT JOIN release_styles s USING (id_release)
), items AS (
  SELECT name_genre, name_style, COUNT(*) AS n FROM combo GROUP BY ALL
), people AS (
  SELECT name_genre, name_style, COUNT(DISTINCT id_artist) AS n FROM combo JOIN release_artists USING (id_release) GROUP BY ALL
)
SELECT items.name_genre, items.name_style, items.n AS qty_collection_items, people.n AS qty_collected_artists
FROM items JOIN people ON people.name_genre IS NOT DISTINCT FROM items.name_genre
  AND people.name_style IS NOT DISTINCT FROM items.name_style""")
def q26(m):
    return C.genre_style_matrix(m)


def _found(name: str, listing: str) -> str:
    return f"SELECT '{name}' AS branch, pos, id_artist FROM ({listing}) {name}_listing"


_ALL = f"SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos FROM ({Q1}) q"
_SOME = f"SELECT *, row_number() OVER (ORDER BY {ARTIST_ORDER}) AS pos FROM ({_Q7}) q"


@register("q27_artists_search_or_all", f"{_found('all', _ALL)} UNION ALL {_found('search', _SOME)}")
def q27(m):
    both = [C.artists_search_or_all(m, text).select(F.lit(name).alias("branch"), "pos", "id_artist")
            for name, text in (("all", ""), ("search", P.ARTIST_SEARCH))]
    return both[0].unionByName(both[1])


@register("q27b_collection_search_or_all", f"""SELECT 'all' AS branch, pos, id_release FROM (
SELECT id_release, row_number() OVER (ORDER BY {KEY_A_TITLE} ASC NULLS LAST, id_release ASC NULLS LAST) AS pos FROM ({_ITEMS}) q) x
UNION ALL SELECT 'search', pos, id_release FROM ({_Q18}) y""")
def q27b(m):
    both = [C.collection_search_or_all(m, text).select(F.lit(name).alias("branch"), "pos", "id_release")
            for name, text in (("all", ""), ("search", P.TITLE_SEARCH))]
    return both[0].unionByName(both[1])
