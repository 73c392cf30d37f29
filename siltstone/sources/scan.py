"""Listing of a file tree, and the rules of what is left out."""

from __future__ import annotations

import fnmatch
import os
import stat
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import folded, suffix
from siltstone.sources.settings import Settings

SCHEMA = "absolute_path string, relative_path string, kind string, size bigint, mtime_ns bigint, error string"


def kept(path: Column, directories: tuple[str, ...], globs: tuple[str, ...], suffixes: tuple[str, ...], is_directory: Column | None = None) -> Column:
    """Whether a relative path stays: no folder on the way is excluded by name or pattern, and a file's suffix isn't excluded."""
    parts = F.split(F.lower(path), "/")
    folder = F.lit(False) if is_directory is None else is_directory
    folders = F.when(folder, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    patterns = "|".join("^" + fnmatch.translate(g.lower()).replace(r"\z", r"\Z") for g in globs)
    excluded = F.exists(folders, lambda f: f.isin([d.lower() for d in directories]) | (f.rlike(patterns) if patterns else F.lit(False)))
    return ~excluded & (folder | ~suffix(path).isin([s.lower() for s in suffixes]))


def _list(root: str, folder: str, settings: Settings) -> Iterator[tuple]:
    """Entries of one folder: links are passed over, excluded folders and the home folder pruned, errors recorded."""
    names = {d.casefold() for d in settings.excluded_directories}
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name.casefold())
    except OSError as e:
        yield folder, os.path.relpath(folder, root).replace(os.sep, "/"), "error", None, None, str(e)
        return
    for entry in found:
        try:
            status = entry.stat(follow_symlinks=False)
        except OSError as e:
            yield entry.path, os.path.relpath(entry.path, root).replace(os.sep, "/"), "error", None, None, str(e)
            continue
        relative, folded = os.path.relpath(entry.path, root).replace(os.sep, "/"), entry.name.casefold()
        if stat.S_ISDIR(status.st_mode):
            if folded in names or any(fnmatch.fnmatchcase(folded, g.casefold()) for g in settings.excluded_globs) or Path(entry.path) == Path(settings.home):
                continue
            yield entry.path, relative, "directory", 0, status.st_mtime_ns, None
        elif stat.S_ISREG(status.st_mode) and Path(entry.name).suffix.casefold() not in settings.excluded_suffixes:
            yield entry.path, relative, "file", status.st_size, status.st_mtime_ns, None


def scan_tree(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) below the root: level by level, the folders of a level listed side by side by the executors, which must see the tree.

    entries has absolute_path, relative_path, kind, size, mtime_ns; errors has absolute_path, relative_path ('.' for the root) and
    error. Links are never followed. Neither has an order; in_scan_order() gives it.
    """
    from siltstone.session import cut

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for folder in batch["absolute_path"] for row in _list(settings.root, folder, settings)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"size": "Int64", "mtime_ns": "Int64"})

    level = spark.createDataFrame([(settings.root,)], "absolute_path string")
    found = None
    while True:
        listed = cut(level.repartition("absolute_path").mapInPandas(task, SCHEMA))
        found = listed if found is None else found.unionByName(listed)
        level = listed.where("kind = 'directory'").select("absolute_path")
        if level.isEmpty():
            break
    return found.where("kind <> 'error'").drop("error"), found.where("kind = 'error'").select("absolute_path", "relative_path", "error")


def in_scan_order(entries: DataFrame) -> DataFrame:
    """entries by path without regard to case."""
    return entries.orderBy(folded(F.col("relative_path")), "relative_path")
