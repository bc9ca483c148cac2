"""Logical tables of the collection model, bound to the driver's parquet tables.

The driver ships TPC-H-like tables, not catalogue data. Each logical table
(artist, release, collection_items, ...) is therefore a *binding*: one SQL
text over the driver tables, written so it runs unchanged in Spark SQL and in
DuckDB. Spark builds it with ``spark.sql(text, **dataframes)`` (no global
views, no string rewriting); the oracle inlines the same text as a CTE.

Placeholders ``{name}`` refer to driver tables or to other bindings.
All bindings read whole tables; ``%`` shapes attribute values (which name
gets a leading quote) and says which entities have rows in some child tables
(images, urls, videos; the rules are in FIXTURES.md), so that none, one and
several occur.
"""

from __future__ import annotations

import hashlib
import re
import threading

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

BINDINGS: dict[str, str] = {
    "artist": """
SELECT s_suppkey AS id_artist,
       CASE s_suppkey % 4 WHEN 0 THEN '...' || s_name WHEN 1 THEN chr(39) || s_name
            WHEN 2 THEN chr(34) || lower(s_name) ELSE s_name END AS name_artist,
       n_name AS profile
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "artist_images": """
SELECT s_suppkey AS id_artist,
       CASE WHEN s_suppkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS type,
       concat('img/', cast(s_suppkey AS string)) AS url_image,
       concat('img150/', cast(s_suppkey AS string)) AS url_image_150,
       600 AS width_image, 400 AS height_image
FROM {supplier} WHERE s_suppkey % 3 <> 0""",
    "artist_urls": """
SELECT s_suppkey AS id_artist, concat('https://example.org/', s_name) AS url
FROM {supplier} WHERE s_suppkey % 2 = 0""",
    "artist_members": """
SELECT s_suppkey AS id_artist, s_suppkey + 1 AS id_member, concat('m/', cast(s_suppkey AS string)) AS url_thumbnail
FROM {supplier} WHERE s_suppkey % 10 = 0
UNION ALL SELECT s_suppkey, s_suppkey + 2, NULL FROM {supplier} WHERE s_suppkey % 10 = 0
UNION ALL SELECT s_suppkey, s_suppkey + 100000, NULL FROM {supplier} WHERE s_suppkey % 20 = 0""",
    "artist_groups": """
SELECT s_suppkey AS id_artist, s_suppkey - 1 AS id_group, concat('g/', cast(s_suppkey AS string)) AS url_thumbnail
FROM {supplier} WHERE s_suppkey % 10 = 1
UNION ALL SELECT s_suppkey, s_suppkey + 200000, NULL FROM {supplier} WHERE s_suppkey % 10 = 5""",
    "artist_aliases": """
SELECT s_suppkey AS id_artist, s_suppkey + 3 AS id_alias, concat('a/', cast(s_suppkey AS string)) AS url_thumbnail
FROM {supplier} WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey + 3, s_suppkey, NULL FROM {supplier} WHERE s_suppkey % 14 = 0""",
    "artist_masters": """
SELECT DISTINCT l_suppkey + CASE WHEN l_linenumber = 7 THEN 300000 ELSE 0 END AS id_artist,
       l_orderkey AS id_master,
       CASE l_linenumber % 4 WHEN 0 THEN 'Producer' WHEN 1 THEN 'Main' WHEN 2 THEN 'Appearance' ELSE 'TrackAppearance' END AS role
FROM {lineitem}""",
    "artist_ignore": """
SELECT s_suppkey + 300000 AS id_artist FROM {supplier} WHERE s_suppkey % 5 = 0""",
    "artist_write_attempts": """
SELECT s_suppkey + 300000 AS id_artist, s_suppkey % 3 AS qty_attempts FROM {supplier} WHERE s_suppkey % 4 = 0""",
    "release": """
SELECT o_orderkey AS id_release, o_orderkey % 500 AS id_master,
       CASE o_orderkey % 4 WHEN 0 THEN '.' || o_orderpriority || '.' WHEN 1 THEN chr(39) || o_orderpriority
            WHEN 2 THEN lower(o_orderpriority) ELSE o_orderpriority END || ' ' || cast(o_orderkey AS string) AS title,
       year(o_orderdate) AS year, c_nationkey AS country,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('thumb/', cast(o_orderkey AS string)) END AS url_thumbnail,
       concat('cover/', cast(o_orderkey AS string)) AS url_cover,
       concat('https://catalog.example/release/', cast(o_orderkey AS string)) AS url_release
FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey""",
    "collection_items": """
SELECT o_orderkey AS id_release, o_orderkey * 10 + 1 AS id_instance, o_orderdate AS date_added,
       r.title, r.id_master, r.year AS year_released, o_orderkey % 6 AS rating,
       r.url_thumbnail, r.url_cover
FROM {orders} JOIN {release} r ON r.id_release = o_orderkey WHERE o_orderstatus = 'F'""",
    "release_artists": """
SELECT DISTINCT l_orderkey AS id_release, l_suppkey AS id_artist FROM {lineitem}""",
    "release_formats": """
SELECT l_orderkey AS id_release,
       CASE l_returnflag WHEN 'R' THEN 'Vinyl' WHEN 'A' THEN 'CD' ELSE 'Cassette' END AS name_format, count(*) AS qty_format
FROM {lineitem} WHERE l_linenumber <> 2 GROUP BY 1, 2""",
    "release_genres": """
SELECT DISTINCT l_orderkey AS id_release, p_brand AS name_genre
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_type <> 'STANDARD'""",
    "release_styles": """
SELECT DISTINCT l_orderkey AS id_release, p_name AS name_style
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_type <> 'PROMO'""",
    "release_labels": """
SELECT DISTINCT l_orderkey AS id_release, l_partkey % 50 AS id_label,
       concat('Label ', cast(l_partkey % 50 AS string)) AS name_label, l_linestatus AS catno
FROM {lineitem}""",
    "release_tracks": """
SELECT l_orderkey AS id_release, cast(l_linenumber AS string) AS position, p_name AS title,
       cast(l_quantity AS string) AS duration
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "release_videos": """
SELECT l_orderkey AS id_release, concat('https://video.example/', cast(l_partkey AS string)) AS url_video, p_name AS title,
       cast(p_size AS string) AS duration
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber = 1""",
    "release_credits": """
SELECT l_orderkey AS id_release, l_suppkey AS id_artist,
       CASE p_size % 8 WHEN 0 THEN 'Electric Guitar' WHEN 1 THEN 'Written-By' WHEN 2 THEN 'Mixed By' WHEN 3 THEN 'MC'
            WHEN 4 THEN 'Design' WHEN 5 THEN 'Photography By' WHEN 6 THEN 'Mastered By' ELSE 'Liner Notes' END AS role,
       s_name AS name_artist
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey""",
    "release_stats": """
SELECT l_orderkey AS id_release, count(*) AS qty_for_sale,
       CASE WHEN min(l_linenumber) = max(l_linenumber) THEN NULL ELSE min(l_extendedprice) END AS amt_price_lowest,
       cast(sum(l_quantity) AS bigint) AS qty_has, count(DISTINCT l_partkey) AS qty_want,
       round(avg(l_discount) * 50, 2) AS avg_rating, count(DISTINCT l_suppkey) AS qty_ratings
FROM {lineitem} GROUP BY l_orderkey""",
    "release_prices": """
SELECT l_orderkey AS id_release, l_extendedprice AS amt_price
FROM {lineitem}""",
    "release_track_artists": """
SELECT DISTINCT l_orderkey AS id_release, s_name AS name_artist,
       CASE p_size % 3 WHEN 0 THEN 'Featuring' WHEN 1 THEN 'Remix' ELSE 'Vocals' END AS role,
       l_suppkey AS id_artist, concat('https://api.example/artists/', cast(l_suppkey AS string)) AS api_artist,
       cast(l_linenumber AS string) AS position
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
WHERE l_linenumber % 2 = 1""",
    "master_main": """
SELECT id_master, min(id_release) AS id_main_release FROM {release} GROUP BY id_master""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def deps(name: str) -> list[str]:
    """Direct dependencies (driver tables or bindings) of a binding."""
    return sorted(set(_PLACEHOLDER.findall(BINDINGS[name])))


def binding_order(names) -> list[str]:
    """Bindings needed for ``names`` (transitively), dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n not in BINDINGS:
            return
        for d in deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql_text(name: str) -> str:
    """Binding text with placeholders resolved to plain names (DuckDB / views)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), BINDINGS[name]).strip()


# (application id, dataset dir, binding) -> parquet path of the stored table
_STORED: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()


class Model:
    """Per-dataset handle: driver tables and logical tables as DataFrames.

    ``Model(spark, sf_dir).t('collection_items')`` returns the logical table.
    With ``materialize=True`` (default) each binding is computed once per
    application and stored as parquet in the shared checkpoint folder — the
    role the flattened tables of the load step play in a deployment — so
    queries scan stored tables (filters and column pruning reach those
    scans) instead of re-deriving the binding in every branch of a plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._cache: dict[str, DataFrame] = {}

    def derived(self, name: str) -> DataFrame:
        """The binding as a lazy plan over the driver tables."""
        args = {d: self.t(d) for d in deps(name)}
        return self.spark.sql(BINDINGS[name], **args)

    def _stored(self, name: str) -> DataFrame:
        return self.stored(name, lambda: self.derived(name))

    def stored(self, name: str, build) -> DataFrame:
        """``build()`` written once per application to the shared folder, then read."""
        from crateflow.session import shared_dir

        app = self.spark.sparkContext.applicationId
        key = (app, self.sf_dir, name)
        with _LOCK:
            path = _STORED.get(key)
            if path is None:
                tag = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:10]
                path = f"{shared_dir(self.spark)}/crateflow-tables/{app}/{tag}/{name}"
                # as the last step left the rows: no shuffle only for the sizes of the files
                build().write.mode("overwrite").option("compression", "zstd").parquet(path)
                _STORED[key] = path
        return self.spark.read.parquet(path)

    def t(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in DRIVER_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in BINDINGS:
                df = self._stored(name) if self.materialize else self.derived(name)
            else:
                raise KeyError(f"unknown table {name!r}")
            self._cache[name] = df
        return self._cache[name]

    def path(self, name: str) -> str:
        """Where the stored table of a binding lies."""
        self.t(name)
        return _STORED[self.spark.sparkContext.applicationId, self.sf_dir, name]

    def forget(self, *names: str) -> None:
        """After a load: stored tables of these names (all without names) are built anew when next used."""
        with _LOCK:
            for key in list(_STORED):
                if key[1] == self.sf_dir and (not names or key[2] in names):
                    del _STORED[key]
        for name in names or list(self._cache):
            self._cache.pop(name, None)

    def store_all(self) -> None:
        """Compute and store every binding (the load step)."""
        for n in BINDINGS:
            self.t(n)

    __getitem__ = t


class TableSet:
    """Tables given directly as DataFrames (tests, or tables already loaded)."""

    def __init__(self, **tables: DataFrame):
        self._tables = dict(tables)

    def t(self, name: str) -> DataFrame:
        return self._tables[name]

    __getitem__ = t

    def with_table(self, name: str, df: DataFrame) -> "TableSet":
        out = TableSet(**self._tables)
        out._tables[name] = df
        return out
