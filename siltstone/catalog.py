"""A catalog kept as Parquet snapshots: entries, chunks and postings of the last commit, named by a manifest that is swapped in one step."""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import page_path
from siltstone.operators import chunks as chunking
from siltstone.operators import index, sync
from siltstone.plans.search import clauses, search
from siltstone.session import cut
from siltstone.sinks import wiki
from siltstone.sources.extract import read_files
from siltstone.sources.scan import scan_tree
from siltstone.sources.settings import Settings

VERSION, UPGRADABLE = 4, (2, 3)
ENTRIES = "id bigint, relative_path string, absolute_path string, kind string, size bigint, mtime_ns bigint, status string, extractor string, error string, sha256 string, wiki_path string, indexed_at string"
POSTINGS = "chunk_id bigint, entry_id bigint, field string, term string, pos int"
STATS = "chunk_id bigint, n_tokens int"
CHUNKS = "id bigint, entry_id bigint, chunk_index int, relative_path string, content string, ngrams string"


class CatalogError(RuntimeError):
    pass


class Catalog:
    """Entries and chunks of a home folder that driver and executors share."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.manifest = Path(settings.home, "catalog.json")
        state = json.loads(self.manifest.read_text()) if self.manifest.exists() else None
        if state is not None and state.get("version") not in (VERSION, *UPGRADABLE):
            raise CatalogError("the catalog has no known version; it was left as it is")
        self.state = state

    def _table(self, name: str, schema: str) -> DataFrame:
        if self.state is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(str(Path(self.settings.home, "snapshots", self.state["snapshot"], name)))

    @property
    def entries(self) -> DataFrame:
        return self._table("entries", ENTRIES)

    @property
    def chunks(self) -> DataFrame:
        """Chunks with their bigrams; those of old catalogs are filled in, and files without chunks get their path-only one."""
        stored = self._table("chunks", CHUNKS)
        if self.state is None or self.state["version"] == VERSION:
            return stored
        if "ngrams" not in stored.columns:
            stored = stored.withColumn("ngrams", F.lit(None).cast("string"))
        bare = chunking.missing_path_chunks(self.entries, stored).withColumn("id", F.xxhash64("entry_id", "chunk_index"))
        return chunking.with_ngrams(stored).unionByName(bare.select(stored.columns))

    @property
    def postings(self) -> DataFrame:
        """The positional index, stored in order of term; catalogs of before have none, so it is made from their chunks."""
        return self._table("postings", POSTINGS) if self._indexed else index.postings(self.chunks)

    @property
    def stats(self) -> DataFrame:
        return self._table("stats", STATS) if self._indexed else index.chunk_stats(self.chunks)

    @property
    def _indexed(self) -> bool:
        return self.state is None or bool(self.state.get("indexed"))

    def listed(self) -> DataFrame:
        """All entries in order of path."""
        return self.entries.orderBy("relative_path")

    def commit(self, entries: DataFrame, chunks: DataFrame, postings: DataFrame, stats: DataFrame) -> None:
        """Writes a new snapshot beside the last one, then names it in the manifest; a failure before that leaves the catalog as it was."""
        name = uuid.uuid4().hex
        folder = Path(self.settings.home, "snapshots", name)
        entries.write.parquet(str(folder / "entries"))
        chunks.write.parquet(str(folder / "chunks"))
        postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(str(folder / "postings"))
        stats.write.parquet(str(folder / "stats"))
        aside = self.manifest.with_suffix(".new")
        self.state = {"version": VERSION, "snapshot": name, "indexed": True}
        aside.write_text(json.dumps(self.state))
        os.replace(aside, self.manifest)

    def sync(self, retry_unreadable: bool = False) -> dict:
        """Scans the root, extracts what is new, changed or to be tried again, and commits. Returns the counts and the changed and removed paths as DataFrames.

        A root that can't be listed changes nothing; entries below a folder that can't be listed stay as they are.
        """
        scan, errors = scan_tree(self.spark, self.settings)
        if not errors.where("relative_path = '.'").isEmpty():
            raise CatalogError(f"the root can't be listed; the catalog was left as it is: {self.settings.root}")
        before = self.entries
        changes = cut(sync.spared(sync.diff(scan, before, sync.UNREADABLE if retry_unreadable else ()), errors))
        read = cut(read_files(scan.join(changes.where("change in ('added', 'updated', 'retry')"), "relative_path", "left_semi"), self.settings.max_file_bytes))
        changes = cut(sync.settled(changes, read, before))
        now = datetime.now(UTC).isoformat(timespec="seconds")
        fresh = read.drop("content").withColumn("wiki_path", page_path(F.col("relative_path"))).withColumn("indexed_at", F.lit(now))
        after = cut(sync.upserted(before, fresh, changes))
        touched = after.join(changes.where("change in ('added', 'updated')"), "relative_path", "left_semi").where("kind = 'file'").select("id", "relative_path")
        texts = read.join(touched, "relative_path").select("id", "relative_path", F.when(F.col("status") == "extracted", F.col("content")).otherwise("").alias("content"))
        cut_texts = chunking.chunked(texts, "id", "content", self.settings.chunk_bytes).join(touched.select(F.col("id").alias("entry_id"), F.col("relative_path").alias("_path")), "entry_id")
        path = F.when(F.col("chunk_index") == 0, F.col("_path")).otherwise("")
        new_chunks = cut_texts.select(F.xxhash64("entry_id", "chunk_index").alias("id"), "entry_id", "chunk_index", path.alias("relative_path"), "content", chunking.chunk_ngrams(F.col("content"), path).alias("ngrams"))
        gone = before.join(changes.where("change in ('updated', 'removed')"), "relative_path", "left_semi").select(F.col("id").alias("entry_id"))
        removed = cut(sync.removed_pages(changes, before))
        new_chunks, chunks = cut(new_chunks), self.chunks
        stay = chunks.join(gone.distinct(), "entry_id", "left_anti")
        self.commit(after, sync.current_chunks(chunks, new_chunks, gone), index.current_postings(self.postings, new_chunks, gone), index.current_stats(self.stats, stay, new_chunks))
        counts = sync.summary(changes).first().asDict()
        counts |= {"extraction_errors": read.where("status = 'error'").count(), "scan_errors": errors.count()}
        return {"counts": counts, "changed": changes.where("change in ('added', 'updated')"), "removed": removed}

    def records(self) -> DataFrame:
        """Entries with their text put together."""
        return self.entries.join(chunking.reassembled(self.chunks).withColumnRenamed("entry_id", "id"), "id", "left")

    def get(self, relative_path: str) -> DataFrame:
        one = self.entries.where(F.col("relative_path") == relative_path)
        return one.join(chunking.reassembled(self.chunks.join(one.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")).withColumnRenamed("entry_id", "id"), "id", "left")

    def search(self, question: str, limit: int = 5) -> DataFrame:
        """The answers to one question; of the postings only those of its terms are read."""
        asked = self.spark.createDataFrame([(0, question)], "query_id bigint, query_text string")
        terms = [r.term for r in clauses(asked).select(F.explode("terms").alias("term")).distinct().collect()]
        return search(asked, self.chunks, self.entries, limit, self.postings.where(F.col("term").isin(terms)), self.stats).drop("query_id").orderBy("rank")

    def compile(self, synced: dict) -> dict:
        """Writes the pages of changed files and of files without one, removes those of vanished files, rewrites the index."""
        home = self.settings.home
        wiki.write_contract(home)
        removed = wiki.remove_pages(synced["removed"], home)
        wanted = cut(wiki.to_compile(self.entries, synced["changed"], wiki.present_pages(self.spark, home)))
        written = wiki.write_pages(wiki.pages(self.records().join(wanted.select("relative_path"), "relative_path", "left_semi")), home)
        wiki.write_navigation(self.entries, home, self.settings.root)
        wiki.append_log(home, "Ingest", synced["counts"])
        return {"source_pages": written, "removed_pages": removed, "index_path": str(Path(home, "wiki/index.md"))}

    def lint(self) -> DataFrame:
        """(message) of what is missing or left over among the pages, in order."""
        home = self.settings.home
        required = self.spark.createDataFrame([(0, m) for m in wiki.missing_required(home)], "_order int, message string")
        found = wiki.lint(self.entries, wiki.present_pages(self.spark, home)).select(F.when(F.col("issue_type") == "missing", 1).otherwise(2).alias("_order"), "message")
        return required.unionByName(found).orderBy("_order", "message").select("message")
