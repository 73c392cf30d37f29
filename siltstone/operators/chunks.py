"""Texts cut into chunks of a byte budget that put together give the text again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import cjk_bigrams

DEFAULT_BYTES = 32 * 1024
_UNIT = re.compile(r"\S+\s*|\s+")


def pieces(text: str, budget: int) -> list[str]:
    """Chunks of text: whole lines as long as they fit, longer lines at white space, a longer word alone and uncut. A long line never shares a chunk with other lines."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            chunks.append("".join(held))
            held.clear()
        size = 0

    def pack(unit: str) -> None:
        nonlocal size
        n = len(unit.encode())
        if held and size + n > budget:
            close()
        held.append(unit)
        size += n

    for line in text.splitlines(keepends=True):
        if len(line.encode()) <= budget:
            pack(line)
            continue
        close()
        for unit in _UNIT.findall(line):
            pack(unit)
        close()
    close()
    return chunks


def _cut_task(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, out = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                parts = pieces(text or "", budget) or [""]
                rows += [k] * len(parts)
                at += range(len(parts))
                out += parts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(out, pa.string())], ["entry_id", "chunk_index", "content"])

    return run


def chunked(df: DataFrame, key: str, text: str, budget: int = DEFAULT_BYTES) -> DataFrame:
    """(entry_id, chunk_index, content) of df[key], df[text]; a null or empty text is one empty chunk, so every entry has one."""
    if budget < 1:
        raise ValueError("the budget must be at least one byte")
    return df.select(F.col(key).cast("bigint").alias("entry_id"), F.col(text).alias("content")).mapInArrow(_cut_task(budget), "entry_id bigint, chunk_index int, content string")


def reassembled(chunks: DataFrame) -> DataFrame:
    """(entry_id, content): chunks put together in order; repeated rows count once. A group holds one text."""
    parts = F.array_sort(F.collect_set(F.struct("chunk_index", "id", "content")))
    return chunks.groupBy("entry_id").agg(F.array_join(F.transform(parts, lambda c: c["content"]), "").alias("content"))


def chunk_ngrams(content: Column, path: Column) -> Column:
    """The bigram field of a chunk: those of its content, then those of the path, which only an entry's first chunk carries."""
    return F.array_join(F.concat(cjk_bigrams(F.coalesce(content, F.lit(""))), cjk_bigrams(F.coalesce(path, F.lit("")))), " ")


def with_ngrams(chunks: DataFrame) -> DataFrame:
    """Chunks of any catalog with the bigram field filled where it is null (catalogs before it was introduced)."""
    return chunks.withColumn("ngrams", F.coalesce("ngrams", chunk_ngrams(F.col("content"), F.col("relative_path"))))


def missing_path_chunks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, chunk_index, relative_path, content, ngrams): the path-only chunk of each file entry that has no chunk at all."""
    bare = entries.where("kind = 'file'").select(F.col("id").alias("entry_id"), "relative_path").join(chunks.select("entry_id").distinct(), "entry_id", "left_anti")
    return bare.select("entry_id", F.lit(0).alias("chunk_index"), "relative_path", F.lit("").alias("content"), chunk_ngrams(F.lit(""), F.col("relative_path")).alias("ngrams"))
