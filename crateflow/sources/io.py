"""Table management: scans, SQL, appends, overwrites, snapshots.

Storage is parquet directories (or catalog tables); versioned snapshots are
plain directories plus a log that says which one each version is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from crateflow.sources.commits import CommitConflict, CommitLog, delete_path, fresh_name, remove_unnamed


def scan_table(spark: SparkSession, path_or_name: str) -> DataFrame:
    """Full scan of a parquet path or a catalog table / view."""
    if "/" in path_or_name:
        return spark.read.parquet(path_or_name)
    return spark.table(path_or_name)


def sql_query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL over DataFrames passed by name (``{name}`` in the text)."""
    return spark.sql(text, **tables)


def execute_sql(spark: SparkSession, statement: str) -> None:
    """One DDL or DML statement, run at once."""
    spark.sql(statement)


# what opens a part of a script in which ';' means nothing, and what closes it
_CLOSING = {"'": "'", '"': '"', "`": "`", "--": "\n", "/*": "*/"}


def _skip(script: str, at: int, opening: str) -> int:
    """The place after the part that ``opening`` begins at ``at``."""
    close, i = _CLOSING[opening], at + len(opening)
    depth = 1
    while i < len(script):
        if opening in "'\"" and script[i] == "\\":  # the next sign is escaped
            i += 2
        elif opening == "/*" and script.startswith("/*", i):  # comments nest
            depth, i = depth + 1, i + 2
        elif script.startswith(close, i):
            depth, i = depth - 1, i + len(close)
            if not depth:
                return i
        else:
            i += 1
    if opening == "--":
        return len(script)
    raise ValueError(f"{opening} at sign {at + 1} of the script is never closed")


def statements(script: str) -> list[str]:
    """The statements of a script, comments taken out; a ';' in a literal, a quoted name or a comment ends none.

    Literals may hold escaped or doubled quotes, block comments may nest; a
    quote or block comment that is never closed raises ``ValueError``.
    """
    found, own, i = [], "", 0
    while i < len(script):
        opening = next((o for o in _CLOSING if script.startswith(o, i)), None)
        if opening:
            end = _skip(script, i, opening)
            own += script[i:end] if len(opening) == 1 else "\n" if opening == "--" else " "
            i = end
        elif script[i] == ";":
            found.append(own.strip())
            own, i = "", i + 1
        else:
            own, i = own + script[i], i + 1
    return [s for s in [*found, own.strip()] if s]


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """T4: run a SQL script statement by statement."""
    return [spark.sql(s) for s in statements(script)]


def store_append(df: DataFrame, path: str) -> None:
    """T5: append (schema fixed by the first write)."""
    df.write.mode("append").parquet(path)


def store_replace(df: DataFrame, path: str) -> None:
    """Replace the table with ``df``."""
    df.write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path_or_name: str) -> bool:
    """A real existence check (path readable or catalog entry)."""
    if "/" not in path_or_name:
        return spark.catalog.tableExists(path_or_name)
    try:
        spark.read.parquet(path_or_name).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a catalog table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_view(df: DataFrame, name: str) -> None:
    """A temporary view, replaced if it exists."""
    df.createOrReplaceTempView(name)


def view_exists(spark: SparkSession, name: str) -> bool:
    """T10."""
    return spark.catalog.tableExists(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    """T10."""
    return spark.catalog.dropTempView(name)


def add_column_if_missing(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """Idempotent add of a NULL column."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


# ---- snapshots (T13, T14) --------------------------------------------------------

def _versions(spark: SparkSession, root: str, name: str) -> CommitLog:
    return CommitLog(spark, f"{root}/{name}/_log", "data string")


def snapshot_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(version, published_at, data) of every published snapshot."""
    return _versions(spark, root, name).entries().withColumnRenamed("committed_at", "published_at")


def publish_snapshot(df: DataFrame, root: str, name: str, expected: int | None = None) -> int:
    """Write ``df`` as a new immutable version and return its number.

    The data goes to a folder of its own, then one log entry makes it the
    current version: readers see the old version or the new one. A writer
    that fails before its entry leaves nothing but that folder. Of two
    writers at once both succeed, one after the other, unless ``expected``
    names the version the data was made from: then the later one gets
    ``CommitConflict`` and its data is removed.
    """
    spark, log = df.sparkSession, _versions(df.sparkSession, root, name)
    data = fresh_name("data")
    df.write.mode("errorifexists").parquet(f"{root}/{name}/{data}")
    version = 1 + (log.last() if expected is None else expected)
    while not log.put(version, {"data": data}):
        if expected is not None:
            delete_path(spark, f"{root}/{name}/{data}")
            raise CommitConflict(f"{name} has a version {version} already")
        version += 1
    return version


def read_snapshot_as_of(spark: SparkSession, root: str, name: str, version: int | None = None,
                        as_of: datetime | str | None = None) -> DataFrame:
    """The current snapshot, that of a given version, or the last one published at or before a time (a backup)."""
    known = snapshot_versions(spark, root, name)
    if version is not None:
        known = known.where(F.col("version") == int(version))
    if as_of is not None:
        known = known.where(F.col("published_at") <= F.lit(as_of).cast("timestamp"))
    row = known.orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"no such snapshot of {name} under {root}")
    return spark.read.parquet(f"{root}/{name}/{row.data}")


def remove_orphans(spark: SparkSession, root: str, name: str, older_than: float = 86400.0) -> list[str]:
    """Delete data folders of writers that never published, if they are older than so many seconds."""
    named = {r.data for r in snapshot_versions(spark, root, name).select("data").toLocalIterator()}
    return remove_unnamed(spark, f"{root}/{name}", named, "data-", older_than)
