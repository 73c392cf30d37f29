"""Markdown pages of the catalog: their text as a column, the files that a task writes, and checks of what is there."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import fence, file_name, json_string, page_path

REQUIRED = ("index.md", "overview.md", "log.md")


def page_text() -> Column:
    """The page of a record, from its columns; null fields are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # fixed values: the labels, headings and sentences of a page are its format
    head = [
        F.lit("---"),
        *[F.concat(F.lit(f"{label}: "), json_string(text(c))) for label, c in (("source_path", "absolute_path"), ("relative_path", "relative_path"), ("status", "status"), ("extractor", "extractor"), ("sha256", "sha256"))],
        F.concat(F.lit("size_bytes: "), text("size")),
        F.concat(F.lit("modified_ns: "), text("mtime_ns")),
        F.concat(F.lit("indexed_at: "), json_string(text("indexed_at"))),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("# "), file_name(F.col("relative_path"))),
        F.lit(""),
        F.lit("## Provenance"),
        F.lit(""),
        F.concat(F.lit("- Original file: `"), text("absolute_path"), F.lit("`")),
        F.concat(F.lit("- Relative path: `"), text("relative_path"), F.lit("`")),
        F.concat(F.lit("- Extraction status: `"), text("status"), F.lit("`")),
    ]
    note = F.when(text("error") != "", F.concat(F.lit("- Extraction note: "), text("error")))
    marks = fence(text("content"))
    body = F.when(text("content") != "", F.concat(marks, F.lit("text\n"), text("content"), F.lit("\n"), marks, F.lit("\n"))).otherwise("No readable text was extracted. The file remains indexed by path and metadata.\n")
    return F.concat_ws("\n", *head, note, F.lit(""), F.lit("## Extracted content"), F.lit(""), body)


def pages(records: DataFrame) -> DataFrame:
    """(relative_path, wiki_path, page) of file records."""
    return records.where("kind = 'file'").select("relative_path", page_path(F.col("relative_path")).alias("wiki_path"), page_text().alias("page"))


def to_compile(entries: DataFrame, changed: DataFrame, present: DataFrame) -> DataFrame:
    """(relative_path, wiki_path) of pages to write: files that changed, and files whose page isn't among present(wiki_path)."""
    expected = entries.where("kind = 'file'").select("relative_path", page_path(F.col("relative_path")).alias("wiki_path"))
    touched = expected.join(changed.select("relative_path"), "relative_path", "left_semi")
    return touched.unionByName(expected.join(present.select("wiki_path"), "wiki_path", "left_anti")).distinct()


def lint(entries: DataFrame, present: DataFrame) -> DataFrame:
    """(issue_type, subject, message): pages that are missing, and present pages of no file."""
    expected = entries.where("kind = 'file'").select(page_path(F.col("relative_path")).alias("wiki_path")).distinct()
    there = present.select("wiki_path").where("wiki_path is not null and wiki_path <> ''").distinct()
    missing = expected.join(there, "wiki_path", "left_anti").select(F.lit("missing").alias("issue_type"), F.col("wiki_path").alias("subject"), F.concat(F.lit("Missing source page: "), "wiki_path").alias("message"))
    orphan = there.join(expected, "wiki_path", "left_anti").select(F.lit("orphan").alias("issue_type"), F.col("wiki_path").alias("subject"), F.concat(F.lit("Orphan source page: "), file_name(F.col("wiki_path"))).alias("message"))
    return missing.unionByName(orphan)


def navigation(entries: DataFrame) -> DataFrame:
    """(section, relative_path, line) of the index page: files, then directories."""
    target = F.regexp_replace(page_path(F.col("relative_path")), "^wiki/", "")
    line = F.when(F.col("kind") == "file", F.concat(F.lit("- ["), "relative_path", F.lit("]("), target, F.lit(") — "), "status", F.lit(", "), F.col("size").cast("string"), F.lit(" bytes"))).otherwise(F.concat(F.lit("- `"), "relative_path", F.lit("/`")))
    return entries.select(F.when(F.col("kind") == "file", 0).otherwise(1).alias("section"), "relative_path", line.alias("line"))


def status_counts(entries: DataFrame) -> DataFrame:
    """(kind, status, entries)."""
    return entries.groupBy("kind", "status").agg(F.count("*").alias("entries"))


def write_whole(to: Path, text: str) -> None:
    """Writes a file aside and renames it, so a lost task leaves no half file."""
    to.parent.mkdir(parents=True, exist_ok=True)
    aside = to.with_name(f".{to.name}.{os.getpid()}")
    aside.write_text(text, encoding="utf-8", newline="\n")
    aside.replace(to)


def write_pages(written: DataFrame, home: str) -> int:
    """Writes pages(wiki_path, page) below a folder that all executors share; returns their number."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, page in zip(batch["wiki_path"], batch["page"]):
                write_whole(Path(home, path), page)
            yield pd.DataFrame({"n": [len(batch)]})

    return written.select("wiki_path", "page").mapInPandas(task, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove_page(home: str, wiki_path: str) -> bool:
    """Deletes a generated page; anything outside the pages' folder is left alone."""
    page, root = Path(home, wiki_path).resolve(), Path(home, "wiki/sources").resolve()
    if root in page.parents and page.is_file():
        page.unlink()
        return True
    return False


def remove_pages(gone: DataFrame, home: str) -> int:
    """Deletes the pages of gone(wiki_path), by the tasks; returns how many there were."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [sum(remove_page(home, p) for p in batch["wiki_path"])]})

    return gone.select("wiki_path").mapInPandas(task, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def present_pages(spark: SparkSession, home: str, batch: int = 10_000) -> DataFrame:
    """(wiki_path) of the pages that are there, listed by a task a batch at a time."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for folders in batches:
            for folder in folders["folder"]:
                names = (e.name for e in os.scandir(Path(home, folder)) if e.name.endswith(".md") and not e.name.startswith(".")) if Path(home, folder).is_dir() else iter(())
                while some := list(islice(names, batch)):
                    yield pd.DataFrame({"wiki_path": [f"{folder}/{name}" for name in some]})

    return spark.createDataFrame([("wiki/sources",)], "folder string").mapInPandas(task, "wiki_path string")


def write_contract(home: str) -> None:
    """A file in the home folder that says how its pages are to be used, written once."""
    to = Path(home, "AGENTS.md")
    if not to.exists():
        write_whole(to, "# How to use these pages\n\n- Never change the source tree.\n- Start from `wiki/index.md` and open the pages that matter only.\n- Keep source paths, and say where a text could not be read.\n- Only add to `wiki/log.md`.\n")


def write_navigation(entries: DataFrame, home: str, root: str) -> None:
    """index.md and overview.md. Tasks write the sorted lines as parts; the driver only strings the parts together, byte by byte."""
    wiki, parts = Path(home, "wiki"), Path(home, "wiki", f".index-{uuid.uuid4().hex}")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sections: dict[int, int] = {}
        number = TaskContext.get().partitionId()
        parts.mkdir(parents=True, exist_ok=True)
        aside = {k: parts / f".{k}-{number:06d}.{os.getpid()}" for k in (0, 1)}
        for k in (0, 1):
            aside[k].write_text("")
        for batch in batches:
            for section, lines in batch.groupby("section", sort=True)["line"]:
                with aside[section].open("a", encoding="utf-8", newline="\n") as f:
                    f.writelines(line + "\n" for line in lines)
                sections[section] = sections.get(section, 0) + len(lines)
        for k in (0, 1):
            aside[k].replace(parts / f"{k}-{number:06d}")
        yield pd.DataFrame({"n": [sum(sections.values())]})

    written = navigation(entries).orderBy("section", "relative_path").mapInPandas(task, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    with (wiki / ".index.new").open("wb") as f:
        f.write(f"# Catalog\n\nSource root: `{root}`\n\n## Source pages\n\n".encode())
        for section, heading in ((0, b""), (1, b"\n## Directories\n\n")):
            f.write(heading)
            for part in sorted(parts.glob(f"{section}-*")) if written else ():
                with part.open("rb") as lines:
                    shutil.copyfileobj(lines, f)
    (wiki / ".index.new").replace(wiki / "index.md")
    shutil.rmtree(parts, ignore_errors=True)
    counts = {(r.kind, r.status): r.entries for r in status_counts(entries).collect()}
    files, folders = (sum(n for (k, _), n in counts.items() if k == kind) for kind in ("file", "directory"))
    by_status = "".join(f"- {s}: {n}\n" for (k, s), n in sorted(counts.items()) if k == "file")
    write_whole(wiki / "overview.md", f"# Overview\n\n- Source root: `{root}`\n- Indexed files: {files}\n- Indexed directories: {folders}\n\n## Extraction status\n\n{by_status}")


def append_log(home: str, title: str, facts: dict[str, object]) -> None:
    log = Path(home, "wiki/log.md")
    log.parent.mkdir(parents=True, exist_ok=True)
    if not log.exists():
        log.write_text("# Log\n", encoding="utf-8")
    with log.open("a", encoding="utf-8", newline="\n") as f:
        f.write(f"\n## {datetime.now(UTC).isoformat(timespec='seconds')} — {title}\n\n" + "".join(f"- {k}: {v}\n" for k, v in facts.items()))


def missing_required(home: str) -> list[str]:
    return [f"Missing required file: {name}" for name in REQUIRED if not Path(home, "wiki", name).is_file()]
