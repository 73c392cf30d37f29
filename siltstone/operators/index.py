"""Positional inverted index of chunks, and the statistics that scores need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import index_tokens

FIELDS = ("relative_path", "content", "ngrams")


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entry_id, fields, n_tokens) of chunks(id, entry_id, relative_path, content, ngrams): the terms of each field in order; null fields have none."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), index_tokens(F.coalesce(f, F.lit(""))).alias("terms")) for f in FIELDS])
    each = chunks.select(F.col("id").alias("chunk_id"), "entry_id", fields.alias("fields"))
    return each.withColumn("n_tokens", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["terms"])))


def postings_of(tokens: DataFrame) -> DataFrame:
    """(chunk_id, entry_id, field, term, pos) of tokenized chunks."""
    # there are always fields; the plain inline would filter on their number first and cut the text into terms twice for it
    each = tokens.select("chunk_id", "entry_id", F.inline_outer("fields"))
    return each.select("chunk_id", "entry_id", "field", F.posexplode("terms").alias("pos", "term")).select("chunk_id", "entry_id", "field", "term", "pos")


def postings(chunks: DataFrame) -> DataFrame:
    return postings_of(tokenized(chunks))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_tokens) over all fields; chunks without a term count too."""
    return tokenized(chunks).select("chunk_id", "n_tokens")


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row (n_chunks, n_tokens, avg_tokens)."""
    return stats.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn("avg_tokens", F.when(F.col("n_chunks") > 0, F.col("n_tokens") / F.col("n_chunks")))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, n_chunks, n_occurrences): occurrences add up before the shuffle, so frequent terms don't make large groups."""
    return posts.groupBy("term", "chunk_id").agg(F.count("*").alias("_n")).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("_n").alias("n_occurrences"))


def current_postings(posts: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The postings after a sync: those of changed or removed entries gone, those of fresh chunks added. gone has entry_id."""
    return posts.join(gone.select("entry_id").distinct(), "entry_id", "left_anti").select(posts.columns).unionByName(postings(fresh))


def current_stats(stats: DataFrame, chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lengths of the chunks that stay, and of fresh ones."""
    return stats.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").unionByName(chunk_stats(fresh))
