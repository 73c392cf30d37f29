"""Incremental sync: what a scan changes in the catalog, and the catalog after it. Joins of snapshots; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import page_path
from siltstone.session import cut

SCANNED = ("kind", "size", "mtime_ns")
EXTRACTED = ("status", "extractor", "error", "sha256")
UNREADABLE = ("unsupported", "error")


def diff(scan: DataFrame, entries: DataFrame, retry: tuple[str, ...] = ()) -> DataFrame:
    """(relative_path, change) of every path of the scan or the catalog: added, updated, unchanged, removed, or retry.

    A path is unchanged if kind, size and mtime_ns are equal (null equals null); retry is such a path whose status is in the retry
    set. Each side should hold a path once; null paths are left out.
    """
    new = scan.where("relative_path is not null").select("relative_path", F.struct(*SCANNED).alias("_new"))
    old = entries.where("relative_path is not null").select("relative_path", F.struct(*SCANNED).alias("_old"), F.col("status").alias("_status"))
    same = F.col("_new").eqNullSafe(F.col("_old"))
    change = (
        F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(~same, "updated").when(F.col("_status").isin(*retry) if retry else F.lit(False), "retry").otherwise("unchanged")
    )
    return new.join(old, "relative_path", "full_outer").select("relative_path", change.alias("change"))


def spared(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """(relative_path, change) with nothing removed that a scan couldn't see: failed(relative_path) are the files and folders that it couldn't read; what is there or below stays unchanged."""
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    gone = changes.where("change = 'removed'").select("relative_path", F.explode(above).alias("_above"))
    unseen = gone.join(failed.select(F.col("relative_path").alias("_above")), "_above", "left_semi").select("relative_path").distinct()
    marked = changes.join(unseen.withColumn("_unseen", F.lit(True)), "relative_path", "left")
    return marked.select("relative_path", F.when(F.col("_unseen"), "unchanged").otherwise(F.col("change")).alias("change"))


def settled(changes: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """(relative_path, change) with each retry settled: unchanged if extraction gave the same again, updated if not. results(relative_path, status, extractor, error, sha256) are the extractions of changed and retried files."""
    new = results.select("relative_path", F.struct(*EXTRACTED).alias("_new"))
    old = entries.select("relative_path", F.struct(*EXTRACTED).alias("_old"))
    joined = changes.join(new, "relative_path", "left").join(old, "relative_path", "left")
    outcome = F.when(F.col("change") == "retry", F.when(F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")).otherwise(F.col("change"))
    return joined.select("relative_path", outcome.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    """One row (added, updated, unchanged, removed); zeros for an empty table."""
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return changes.agg(*map(count, ("added", "updated", "unchanged", "removed")))


def removed_pages(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """(relative_path, wiki_path) of the pages of files that vanished."""
    gone = changes.where("change = 'removed'").join(entries.where("kind = 'file'"), "relative_path", "left_semi")
    return gone.select("relative_path", page_path(F.col("relative_path")).alias("wiki_path"))


def numbered(df: DataFrame, order: str, start: int) -> DataFrame:
    """df with id start+1, start+2 ... in the given order, without passing all rows through one task: ranges are numbered side by side and shifted by the sizes of those before."""
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").count().withColumn("_shift", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return within.join(F.broadcast(before.select("_part", "_shift")), "_part").withColumn("id", F.lit(start) + F.coalesce("_shift", F.lit(0)) + F.col("_k")).drop("_part", "_shift", "_k")


def upserted(entries: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The entries after a sync: fresh rows for added and updated paths, the others as they were, removed ones gone.

    A path keeps its id; added paths get ids above the highest so far, in order of path. fresh has the columns of entries but id.
    """
    columns = [c for c in entries.columns if c != "id"]
    written = fresh.select(*columns).join(changes.where("change in ('added', 'updated')"), "relative_path", "left_semi")
    kept = entries.join(changes.where("change in ('added', 'updated', 'removed')"), "relative_path", "left_anti")
    ids = entries.select("relative_path", "id")
    updated = written.join(ids, "relative_path")
    added = numbered(written.join(ids, "relative_path", "left_anti").select(*columns), "relative_path", entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    order = entries.columns
    return kept.select(order).unionByName(updated.select(order)).unionByName(added.select(order))


def current_chunks(chunks: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks after a sync: those of changed or removed entries gone, fresh ones added. gone has entry_id."""
    return chunks.join(gone.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(fresh)
