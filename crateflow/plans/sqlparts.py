"""Shared SQL fragments of the oracle texts (DuckDB dialect)."""

# sort key A: leading dots, then apostrophes, then quotes are skipped, once each
_LEAD = """'^[.]*['']*["]*'"""
KEY_A_ARTIST = f"regexp_replace(upper(name_artist), {_LEAD}, '')"
KEY_A_TITLE = f"regexp_replace(upper(title), {_LEAD}, '')"
# sort key B: the first dot, apostrophe or quote is taken out
KEY_B_TITLE = """regexp_replace(upper(title), '^([^.''"]*)[.''"]', '\\1')"""

ARTIST_ORDER = f"{KEY_A_ARTIST} ASC NULLS LAST, id_artist ASC NULLS LAST, url_image ASC NULLS LAST"

# the pictures an artist is shown with: primary (or untyped) ones, or one empty row without any image
PICTURES = """SELECT DISTINCT id_artist, url_image, url_image_150, width_image FROM artist_images
WHERE coalesce(type, 'primary') = 'primary'
UNION ALL SELECT id_artist, NULL, NULL, NULL FROM artist ANTI JOIN artist_images USING (id_artist)"""


def catalog_sql(one_format: bool = True, name_part: str | None = None) -> str:
    """Artists with collected items; counts are taken per artist before names and pictures are joined."""
    fmt = "WHERE coalesce(f.name_format, 'Vinyl') = 'Vinyl'" if one_format else ""
    like = f"WHERE contains(lower(a.name_artist), lower('{name_part}'))" if name_part else ""
    return f"""
SELECT a.id_artist, a.name_artist, a.profile, pic.url_image, pic.url_image_150, pic.width_image, own.qty_collection_items
FROM (SELECT credit.id_artist, COUNT(DISTINCT item.with_format) AS qty_collection_items
      FROM (SELECT c.id_release, f.id_release AS with_format
            FROM (SELECT DISTINCT id_release FROM collection_items) c
            LEFT JOIN release_formats f USING (id_release) {fmt}) item
      JOIN release_artists credit USING (id_release) GROUP BY credit.id_artist) own
JOIN artist a USING (id_artist) JOIN ({PICTURES}) pic USING (id_artist) {like}"""


def canon(expr_fields: list[str], order_free: bool = True) -> str:
    """DuckDB text of a nested list: fields joined by ':', rows sorted, '|'."""
    item = "concat_ws(':', " + ", ".join(f"coalesce(cast({f} AS varchar), '')" for f in expr_fields) + ")"
    return f"string_agg({item}, '|' ORDER BY {item})"
