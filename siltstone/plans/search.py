"""Questions answered from the index: strict co-occurrence first, then files that hold all words across chunks, then smaller groups of words, at last any word.

All questions of a table are answered in one job. The group of words that wins is chosen from the masks of words that files
hold, so the ladder of groups costs one pass instead of a query for each group (groups.py).
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.chunks import with_ngrams
from siltstone.operators.index import corpus_stats, postings_of, tokenized
from siltstone.plans import groups, occurrences
from siltstone.session import BROADCAST_ROWS, cut, small

# Weights of the fields, constants of the score, statuses that rank last.
WEIGHTS = {"relative_path": 8.0, "content": 4.0, "ngrams": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEMOTED = ("unsupported", "error")
#: In place of a rank where a file has no entry.
UNKNOWN = 2
#: Asked terms that are looked for while chunks are cut into terms; of more, postings are made first.
MOST_TERMS = 20_000


def clauses(queries: DataFrame) -> DataFrame:
    """(query_id, n_clauses, clause, token, word, branch, branch_size, phrase, field, terms): the phrases that the words of questions ask for; word and phrase are hashes of what they ask for.

    A word is asked for literally in any field (branch 0), or, if it has two CJK pairs or more, by all its pairs in the bigram
    field (branch 1). A null question, or one of stop words only, has no rows; of repeated query_id rows the least question holds.
    """
    one = queries.groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    tokens = one.select("query_id", text.candidate_tokens(text.query_tokens(F.col("query_text"))).alias("tokens")).where(F.size("tokens") > 0)
    each = tokens.select("query_id", F.size("tokens").alias("n_clauses"), F.posexplode("tokens").alias("clause", "token"))
    pairs = text.cjk_query_bigrams(F.col("token"))
    phrase = lambda branch, size, field, terms: F.struct(F.lit(branch).alias("branch"), size.alias("branch_size"), F.lit(field).alias("field"), terms.alias("terms"))
    literal = F.array(phrase(0, F.lit(1), "", text.index_tokens(F.col("token"))))
    by_pairs = F.transform(pairs, lambda g: phrase(1, F.size(pairs), "ngrams", text.index_tokens(g)))
    asked = each.select("query_id", "n_clauses", "clause", "token", F.xxhash64("token").alias("word"), F.inline(F.when(F.size(pairs) >= 2, F.concat(literal, by_pairs)).otherwise(literal)))
    # a pair that a word holds twice is asked for twice, as two phrases
    twice = F.row_number().over(Window.partitionBy("query_id", "clause", "branch", "field", "terms").orderBy("field"))
    return asked.withColumn("_copy", twice).withColumn("phrase", F.xxhash64("field", "terms")).select("query_id", "n_clauses", "clause", "token", "word", "branch", "branch_size", "_copy", "phrase", "field", "terms")


def phrase_hits(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """(phrase, chunk_id, entry_id, weighted, plain): how often each asked phrase stands in each chunk, its terms at neighbouring positions of one field; field '' means any.

    A phrase of several terms is looked up by its rarest one; the others are then checked at the places that it allows.
    """
    words = asked.select("phrase", F.col("field").alias("_field"), F.size("terms").alias("_n"), F.posexplode("terms").alias("_at", "term")).distinct()
    words = cut(words)
    met = cut(posts.join(small(words.select("term").distinct(), F.octet_length("term") + 32), "term", "left_semi"))
    # a frequent term would be one task's work in a join by term: what is asked goes to the postings instead
    counted = words.join(met.groupBy("term").agg(F.count("*").alias("_times")), "term", "left")
    first = counted.groupBy("phrase").agg(F.min(F.struct(F.coalesce("_times", F.lit(0)).alias("times"), F.col("_at").alias("at"), "term", "_field", F.col("_n").alias("n"))).alias("_r")).where("_r.times > 0")
    rarest = small(cut(first.select("phrase", "_r.term", F.col("_r._field").alias("_field"), F.col("_r.n").alias("_n"), F.col("_r.at").alias("_at"))), F.octet_length("term") + 64)
    place = met.join(rarest, "term").where("_field = '' or _field = field")
    starts = place.select("phrase", "_n", "chunk_id", "entry_id", "field", (F.col("pos") - F.col("_at")).alias("_start"))
    others = small(words.where("_n > 1").select("phrase", F.col("_at").alias("_j"), "term"), F.octet_length("term") + 48)
    longer = starts.where("_n > 1").join(others, "phrase").withColumn("pos", F.col("_start") + F.col("_j"))
    whole = longer.join(met, ["term", "chunk_id", "entry_id", "field", "pos"]).groupBy("phrase", "_n", "chunk_id", "entry_id", "field", "_start").agg(F.count("*").alias("_met")).where("_met = _n")
    columns = ["phrase", "chunk_id", "entry_id", "field"]
    weight = F.coalesce(*[F.when(F.col("field") == f, w) for f, w in WEIGHTS.items()])
    return starts.where("_n = 1").select(columns).unionByName(whole.select(columns)).groupBy("phrase", "chunk_id", "entry_id").agg(F.sum(weight).alias("weighted"), F.count("*").cast("double").alias("plain"))


def bm25(f: Column, rarity: Column, length: Column, average: Column) -> Column:
    return rarity * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, LEAST_IDF).otherwise(value)


def phrase_scores(asked: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(phrase, chunk_id, entry_id, weighted, plain): scores of the asked phrases in chunks with and without field weights."""
    total = corpus_stats(stats).first()
    hits = cut(phrase_hits(asked, posts))
    held = cut(hits.groupBy("phrase").agg(F.count("*").alias("_df")))
    scored = hits.join(small(held, 32), "phrase").join(stats.select("chunk_id", "n_tokens"), "chunk_id")
    rarity, average = idf(F.lit(total.n_chunks), F.col("_df")), F.lit(total.avg_tokens or 1.0)
    return scored.select("phrase", "chunk_id", "entry_id", *[bm25(F.col(c), rarity, F.col("n_tokens"), average).alias(c) for c in ("weighted", "plain")])


def word_scores(asked: DataFrame, chunks: DataFrame, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(word, chunk_id, chunk_index, entry_id, weighted, plain) of the asked words that a chunk satisfies; only satisfied branches score. A word counts once however many questions ask for it."""
    if posts is None or stats is None:
        chunks = cut(with_ngrams(chunks).distinct())
        tokens = cut(tokenized(chunks))
        posts, stats = postings_of(tokens), cut(tokens.select("chunk_id", "n_tokens"))
    phrases = cut(asked.select("word", "branch", "branch_size", "_copy", "phrase", "field", "terms").distinct())
    scores = phrase_scores(phrases.select("phrase", "field", "terms").where(F.size("terms") > 0).distinct(), posts, stats)
    branches = scores.join(small(phrases.drop("field", "terms"), 64), "phrase").groupBy("word", "branch", "branch_size", "chunk_id", "entry_id").agg(F.count("*").alias("_met"), F.sum("weighted").alias("weighted"), F.sum("plain").alias("plain"))
    words = branches.where("_met = branch_size").groupBy("word", "chunk_id", "entry_id").agg(F.sum("weighted").alias("weighted"), F.sum("plain").alias("plain"))
    return words.join(chunks.select(F.col("id").alias("chunk_id"), "chunk_index"), "chunk_id")


def chunk_scores(asked: DataFrame, chunks: DataFrame, status: DataFrame | None = None) -> DataFrame | None:
    """word_scores of chunks without stored postings, dealt, a row a chunk with lists of its words, and the entries' ranks of status(entry_id, demoted) if given; None where too many terms are asked for.

    Repeated rows of chunks count once. No term that isn't asked for, and no row for a place, is written.
    """
    rows = cut(asked.select("word", "branch", "branch_size", "_copy", "field", "terms").distinct())
    if rows.count() > BROADCAST_ROWS or rows.select(F.explode("terms")).distinct().count() > MOST_TERMS:
        return None
    rows = [(r.word, r.branch, r.branch_size, (r.field, tuple(r.terms))) for r in rows.collect()]
    phrases = {p: k for k, p in enumerate(sorted({r[3] for r in rows}))}
    wanted = occurrences.Phrases(list(phrases))
    if not wanted.terms:
        return None
    words = occurrences.Words([(*r[:3], phrases[r[3]]) for r in rows], len(phrases))
    every = cut(occurrences.counted(chunks, wanted, WEIGHTS))
    counts = lambda df: df.select(F.explode("phrase").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    parts = groups.parts(words.rows({r.phrase: r.n for r in counts(every).collect()}), asked.sparkSession)
    if status is not None:
        every = with_status(every, status)
    # repeated rows meet in the part of their file
    held = cut(every.repartition(parts, "entry_id").dropDuplicates(["chunk_id", "chunk_index", "entry_id", "digest"]))
    total = corpus_stats(held.select("n_tokens")).first()
    rarity = np.zeros(len(phrases))
    for r in counts(held).select("phrase", idf(F.lit(total.n_chunks), F.col("n")).alias("idf")).collect():
        rarity[r.phrase] = r.idf
    return cut(occurrences.scored(held.where("chunk_id is not null"), words, rarity, total.avg_tokens or 1.0, bm25))


def with_status(rows: DataFrame, status: DataFrame) -> DataFrame:
    """rows with the rank of their entry; those without an entry help to choose the group of words, but can't be shown."""
    return rows.join(small(status, 16), "entry_id", "left").withColumn("demoted", F.coalesce("demoted", F.lit(UNKNOWN).cast("byte")))


def groups_table(spark: SparkSession) -> DataFrame:
    """(n_clauses, ordinal, mask, size, first): the groups of words in the order in which they are tried, for questions of up to eight words; 467 rows."""
    rows = [(n, k, sum(1 << i for i in g), len(g), g[0]) for n in range(1, groups.MOST_WORDS + 1) for k, g in enumerate(groups.tried(n))]
    return spark.createDataFrame(rows, "n_clauses int, ordinal int, mask int, size int, first int")


def _bit(clause: str = "clause") -> Column:
    return F.pow(F.lit(2), F.col(clause)).cast("int")


def question_lists(asked: DataFrame) -> DataFrame:
    """(query_id, list, words): the words of each question in order; list is their hash."""
    words = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("clause", "word"))).alias("_w")).select("query_id", F.col("_w.word").alias("words"))
    return words.select("query_id", F.xxhash64("words").alias("list"), "words")


def chosen_groups(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, mask, size, first): the first group of words all of which some file holds; questions without any have no row. scores are dealt."""
    lists = cut(question_lists(asked))
    first = groups.first_groups(scores, lists.select("list", "words").distinct())
    per_list = lists.withColumn("n_clauses", F.size("words")).join(first, "list")
    return per_list.join(F.broadcast(groups_table(asked.sparkSession)), ["n_clauses", "ordinal"]).select("query_id", "mask", "size", "first")


def word_sets(asked: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, set) of the questions, and (set, words, whole) of each set: the words of a chosen group, all wanted, or of a question without one, any of them."""
    per = question_lists(asked).join(chosen.select("query_id", "mask"), "query_id", "left")
    per = per.select("query_id", groups.chosen_words(F.col("words"), F.col("mask")).alias("words"), F.col("mask").isNotNull().alias("whole"))
    per = cut(per.withColumn("set", F.xxhash64("words", "whole")))
    return per.select("query_id", "set"), per.select("set", "words", "whole").distinct()


def _found(asked: DataFrame, scores: DataFrame, chosen: DataFrame, find) -> DataFrame:
    """(query_id, stage, entry_id, chunk_id, score): what find gives for the words of each question; equal groups are looked for once."""
    per_question, sets = word_sets(asked, chosen)
    return groups.found(scores, sets, find).join(small(per_question, 16), "set").select("query_id", "stage", "entry_id", "chunk_id", "score")


def same_chunk(asked: DataFrame, scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, entry_id, chunk_id, score): files with a chunk that holds the whole chosen group; without a group, files with a chunk that holds any word. scores are dealt."""
    return _found(asked, scores, chosen, groups.Part.same_chunk).drop("stage")


def across_chunks(asked: DataFrame, scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, entry_id, chunk_id, score): files that hold the chosen group in any of their chunks. The score is the sum of the words' best chunks without field weights; the chunk is the first word's best. scores are dealt."""
    found = _found(asked, scores, chosen, groups.Part.across_chunks)
    return found.where("entry_id is not null").drop("stage")


def ranked(found: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """found with its entry's columns and rank, the first `limit` of each question: stage, then files that couldn't be read last, then score, then path."""
    # paths matter among equal scores only, so they are fetched for the few files that may be shown
    best = F.rank().over(Window.partitionBy("query_id").orderBy("stage", "demoted", F.desc(F.round("score", 9))))
    near = found.withColumn("_k", best).where(F.col("_k") <= limit).drop("_k")
    joined = near.join(entries.select(F.col("id").alias("entry_id"), "relative_path", "absolute_path", "status"), "entry_id")
    order = Window.partitionBy("query_id").orderBy("stage", "demoted", F.desc(F.round("score", 9)), text.folded(F.col("relative_path")), "relative_path")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def prepared(queries: DataFrame, chunks: DataFrame, posts: DataFrame | None = None, stats: DataFrame | None = None, status: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clauses of questions with all phrases, the same with one row a word, and the dealt scores of the words (a row a word, or a chunk with lists of words), with the rank of their entry if status(entry_id, demoted) is given; each written once.

    posts and stats are those of chunks where they are stored; without them chunks are cut into terms once, and their repeated rows count once.
    """
    phrases = cut(clauses(queries))
    asked = cut(phrases.select("query_id", "n_clauses", "clause", "word", "token").distinct())
    scores = chunk_scores(phrases, chunks, status) if posts is None or stats is None else None
    if scores is None:
        scores = cut(word_scores(phrases, chunks, posts, stats))
        scores = groups.dealt(scores if status is None else with_status(scores, status))
    # terms, postings and shuffles of the way here may go: their files stay until the driver happens to collect its garbage
    gc.collect()
    queries.sparkSession.sparkContext._jvm.System.gc()
    return phrases, asked, scores


def clause_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, clause, chunk_id, entry_id, weighted, plain): the satisfied words of each question in each chunk."""
    _, asked, scores = prepared(queries, chunks)
    return asked.join(groups.flat(scores), "word").select("query_id", "clause", "chunk_id", "entry_id", "weighted", "plain")


def distinct_questions(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, query_text) of one question for each text, and (query_id, asked_id) of all of them: equal questions are answered once."""
    one = queries.where("query_text is not null").groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    texts = cut(one.groupBy("query_text").agg(F.min("query_id").alias("asked_id")))
    return texts.select(F.col("asked_id").alias("query_id"), "query_text"), one.join(texts, "query_text").select("query_id", "asked_id")


def _hits(queries: DataFrame, chunks: DataFrame, entries: DataFrame, limit: int, posts: DataFrame | None, stats: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranked files of each question, the questions' words, and the chosen groups of these."""
    status = entries.select(F.col("id").alias("entry_id"), F.when(F.col("status").isin(*DEMOTED), 1).otherwise(0).cast("byte").alias("demoted"))
    _, asked, scores = prepared(queries, chunks, posts, stats, status)
    chosen = cut(chosen_groups(asked, scores))
    found = _found(asked, scores.where(F.col("demoted") < UNKNOWN), chosen, lambda part, lists, whole: part.best_of_both(lists, whole, limit))
    place = F.col("stage")
    return ranked(found.withColumns({"stage": F.shiftright(place, 1), "demoted": place.bitwiseAND(1)}), entries, limit), asked, chosen


def ranked_files(queries: DataFrame, chunks: DataFrame, entries: DataFrame, limit: int = 5, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, stage, relative_path, absolute_path, status, score) of search(), for which no text is read again."""
    texts, ids = distinct_questions(queries)
    hits, *_ = _hits(texts, chunks, entries, limit, posts, stats)
    return hits.withColumnRenamed("query_id", "asked_id").join(ids, "asked_id").select("query_id", "rank", "stage", "relative_path", "absolute_path", "status", "score")


def search(queries: DataFrame, chunks: DataFrame, entries: DataFrame, limit: int = 5, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, stage, relative_path, absolute_path, wiki_path, status, excerpt, score) for queries(query_id, query_text).

    chunks(id, entry_id, chunk_index, relative_path, content, ngrams) must hold each id once, repeated rows aside, entries each id once; without stored
    postings null ngrams are filled. stage is 0 for
    files that hold the words in one chunk, 1 across chunks; scores compare within a stage. Questions without tokens or hits
    have no rows, a limit below 1 gives none at all. A file without text is found by its path, which is its excerpt then.
    """
    texts, ids = distinct_questions(queries)
    hits, asked, chosen = _hits(texts, chunks, entries, limit, posts, stats)
    words = asked.join(chosen.select("query_id", "mask"), "query_id", "left").where(F.col("mask").isNull() | (F.col("mask").bitwiseAND(_bit()) > 0))
    tokens = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("clause", "token"))), lambda w: w["token"]).alias("_tokens"))
    shown = hits.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").dropDuplicates(["query_id", "rank"]).join(tokens, "query_id")
    excerpt = F.when(F.length("content") > 0, text.excerpt(F.col("content"), F.col("_tokens"))).otherwise(F.col("relative_path"))
    answers = shown.withColumnRenamed("query_id", "asked_id").join(ids, "asked_id")
    return answers.select("query_id", "rank", "stage", "relative_path", "absolute_path", text.page_path(F.col("relative_path")).alias("wiki_path"), "status", excerpt.alias("excerpt"), "score")
