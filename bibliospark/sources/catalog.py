"""File listing, catalogue deltas and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliospark.functions import text as tx
from bibliospark.operators.filters import file_stem
from bibliospark.partitioning import first_per_key, top_per_key

# Folders and file types of the library scan.
IGNORED_FOLDERS = ["_Admin", "gemini", ".gemini", ".git", ".venv", "notes_output", "archive", "lost+found",
                   "__pycache__", "compiled_notes", "exports"]
BOOK_SUFFIXES = ["pdf", "djvu", "epub"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) below ``root``; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"),
        F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def title_author(stem: Column) -> tuple[Column, Column]:
    """'Author - Title' file stems; anything else is a title by Unknown."""
    parts = F.split(stem, " - ")
    named = F.size(parts) >= 2
    return (
        F.when(named, tx.strip(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " - "))).otherwise(stem),
        F.when(named, tx.strip(F.get(parts, F.lit(0)))).otherwise("Unknown"),
    )


def catalog_scan(files: DataFrame, own_folders: Sequence[str] = ()) -> DataFrame:
    """Book files of a listing (path, mtime, size) with directory, title and author from the name.

    Hidden folders, the fixed list above and the application's ``own_folders`` are skipped.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin([*IGNORED_FOLDERS, *own_folders]) | d.startswith("."))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    title, author = title_author(file_stem(F.col("path")))
    return files.filter(suffix.isin(BOOK_SUFFIXES) & ~skipped).select(
        "*", F.array_join(folders, "/").alias("directory"), title.alias("title"), author.alias("author"))


def catalog_delta(current: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """(path, change): new, changed or unchanged against known(path, last_modified, index_version).

    Times are doubles, so a difference of one second may come out a little above 1; differences count to the microsecond.
    """
    stored = known.select("path", "last_modified", "index_version", F.lit(True).alias("_known"))
    stale = (
        F.lit(force) | F.col("last_modified").isNull() | (F.round(F.abs(F.col("mtime") - F.col("last_modified")), 6) > 1.0)
        | F.col("index_version").isNull() | (F.col("index_version") < 1))
    return current.join(stored, "path", "left").select(
        "path", F.when(F.col("_known").isNull(), "new").when(stale, "changed").otherwise("unchanged").alias("change"))


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert-or-update: the highest version of every key, updates winning ties. An aggregate, not a group sort."""
    columns = target.columns
    both = target.withColumn("_src", F.lit(0)).unionByName(updates.select(*columns).withColumn("_src", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_src")).alias("_row"))
    return best.select(*keys, "_row.*").select(*columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key the target lacks, one per key."""
    fresh = rows.join(target.select(*keys), list(keys), "left_anti")
    if not order:
        return fresh.dropDuplicates(list(keys))
    return first_per_key(fresh, list(keys), *order)


def write_upsert(merged: DataFrame, path: str, partition: str) -> None:
    """Write only the partitions present in ``merged``; a retried task or job rewrites the same files."""
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def nullify_references(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children keep their rows but lose references to deleted parents."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    joined = children.join(gone, key, "left")
    return joined.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns])


def stratified_samples(terms: DataFrame, seed: str, overall: int = 20, per_type: int = 5) -> DataFrame:
    """Seeded samples over all terms and per type: order by a hash of the id, so reruns pick the same rows."""
    mixed = terms.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))))
    across = mixed.orderBy("_h", "id").limit(overall).withColumn("sample", F.lit("overall"))
    typed = top_per_key(mixed, ["kind"], per_type, "_h", "id").drop("rank").withColumn("sample", F.lit("type"))
    return across.unionByName(typed).drop("_h")
