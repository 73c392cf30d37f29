"""Queries over the core operators, by name, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import chunks, index, snapshots, sync
from siltstone.plans import groups, search
from siltstone.queries import sql
from siltstone.session import cut
from siltstone.sinks import wiki
from siltstone.sources import extract, scan
from siltstone.sources.settings import EXCLUDED_DIRECTORIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(check: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if check:
            SQL[f.__name__] = check
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SNAPSHOT_SQL = """
with held as (
  select snapshot_no, nfc_normalize(replace(relative_path, '\\', '/')) as relative_path, sha256, mtime_ns
  from catalog_entries where snapshot_no is not null and relative_path is not null
  qualify row_number() over (partition by snapshot_no, nfc_normalize(replace(relative_path, '\\', '/')) order by delivered_at desc nulls last, sha256 desc nulls last, mtime_ns desc nulls last) = 1),
numbers as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) as following, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from held)),
late as (select * from held join numbers using (snapshot_no) where before is not null),
early as (select following as snapshot_no, relative_path, sha256, mtime_ns from held join numbers using (snapshot_no) where following is not null),
both_sides as (
  select snapshot_no, relative_path, l.relative_path as is_late, e.relative_path as is_early,
    l.sha256 is distinct from e.sha256 as sha_differs, l.mtime_ns is distinct from e.mtime_ns as mtime_differs
  from late l full join early e using (snapshot_no, relative_path))
"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "catalog_entries")
    return snapshots.changes(entries, "snapshot_no", snapshots.canonical_path(F.col("relative_path")), "delivered_at", ["sha256", "mtime_ns"])


@query(SNAPSHOT_SQL + "select snapshot_no, relative_path, case when is_early is null then 'added' when is_late is null then 'removed' else 'changed' end as change_type from both_sides where is_early is null or is_late is null or sha_differs or mtime_differs")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("snapshot_no", F.col("key").alias("relative_path"), "change_type")


@query(
    SNAPSHOT_SQL
    + """select snapshot_no, case when is_early is null then 'added' when is_late is null then 'removed' else 'changed' end as change_type,
  case when is_early is null or is_late is null then '' else concat_ws(',', case when sha_differs then 'sha256' end, case when mtime_differs then 'mtime_ns' end) end as changed_fields, count(*) as entries
from both_sides where is_early is null or is_late is null or sha_differs or mtime_differs group by 1, 2, 3"""
)
def p4_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("snapshot_no", "change_type", F.array_join("changed_fields", ",").alias("changed_fields")).agg(F.count("*").alias("entries"))


# --- search -----------------------------------------------------------------------------------------------------------

ENTRIES = "entries as (select id, relative_path, absolute_path, {status} as status from catalog_records)"
#: Statuses of files that couldn't be read, for the check of their rank only; the given records were all read.
UNREAD = "case when id % 7 = 0 then 'error' when id % 11 = 0 then 'unsupported' else status end"
#: The questions most queries ask: every twentieth of the logged ones, against all chunks.
LOGGED = "select query_id, query_text from search_hits where query_text is not null and query_id % 20 = 0"
#: All logged questions.
ALL_LOGGED = "select query_id, query_text from search_hits where query_text is not null"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.with_ngrams(table(spark, sf_dir, "catalog_chunks").distinct())


def _searched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeated rows, which a search counts once, and null bigram fields, which it fills."""
    return table(spark, sf_dir, "catalog_chunks")


def _all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_hits").select("query_id", "query_text").where("query_text is not null")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_questions(spark, sf_dir).where("query_id % 20 = 0")


def _entries(spark: SparkSession, sf_dir: str, status: str = "status") -> DataFrame:
    return table(spark, sf_dir, "catalog_records").select("id", "relative_path", "absolute_path", F.expr(status).alias("status"))


def _asked(questions: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return search.prepared(questions, _searched_chunks(questions.sparkSession, sf_dir))[1:]


def _chosen(questions: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, scores = _asked(questions, sf_dir)
    return asked, scores, search.chosen_groups(asked, scores)


HIT_SQL = f"""select h.query_id, h.rank::int as rank, h.stage, h.relative_path, h.absolute_path, {sql.page_path("h.relative_path")} as wiki_path, h.status,
  case when coalesce(c.content, '') = '' then h.relative_path else {sql.excerpt("coalesce(c.content, '')", "g.tokens")} end as excerpt, round(h.score, 6) as score
from hits_ranked h join chunks c on c.id = h.chunk_id join group_tokens g on g.query_id = h.query_id"""


@query(f"with {ENTRIES.format(status='status')}, {sql.ladder(LOGGED)} {HIT_SQL}")
def search_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five files of each question."""
    return search.search(_questions(spark, sf_dir), _searched_chunks(spark, sf_dir), _entries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"with {ENTRIES.format(status=UNREAD)}, {sql.ladder(LOGGED, 50)} select query_id, rank::int as rank, stage, relative_path, status, round(score, 6) as score from hits_ranked")
def search_demoted_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 50 files a question and some files marked as unread: these come after all others of their stage."""
    found = search.ranked_files(_questions(spark, sf_dir), _searched_chunks(spark, sf_dir), _entries(spark, sf_dir, UNREAD), 50)
    return found.select("query_id", "rank", "stage", "relative_path", "status", F.round("score", 6).alias("score"))


@query(f"with {sql.scores(LOGGED)} select query_id, clause::int as clause, chunk_id, round(weighted, 6) as weighted, round(plain, 6) as plain from satisfied")
def bm25_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every satisfied word of the questions in every chunk, with and without field weights."""
    return search.clause_scores(_questions(spark, sf_dir), _searched_chunks(spark, sf_dir)).select("query_id", "clause", "chunk_id", F.round("weighted", 6).alias("weighted"), F.round("plain", 6).alias("plain"))


@query(f"with {ENTRIES.format(status='status')}, {sql.ladder(LOGGED)} select query_id, mask::int as mask, size::int as size, first::int as first from chosen")
def chosen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of words that each question is answered with."""
    return search.chosen_groups(*_asked(_questions(spark, sf_dir), sf_dir))


@query(f"with {ENTRIES.format(status='status')}, {sql.ladder(ALL_LOGGED)} select query_id, entry_id, chunk_id, round(score, 6) as score from same")
def best_chunk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold the chosen words in one chunk (any word where there is no group), with their best chunk."""
    return search.same_chunk(*_chosen(_all_questions(spark, sf_dir), sf_dir)).withColumn("score", F.round("score", 6))


@query(f"with {ENTRIES.format(status='status')}, {sql.ladder(ALL_LOGGED)} select query_id, entry_id, chunk_id, round(a.score, 6) as score from across_all a join first_chunk using (query_id, entry_id)")
def cross_chunk_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold all chosen words, in whichever of their chunks."""
    return search.across_chunks(*_chosen(_all_questions(spark, sf_dir), sf_dir)).withColumn("score", F.round("score", 6))


#: Hyphenated names of the catalog's own pages: phrases of neighbouring terms.
NAMES = f"select id as query_id, {sql.stem('relative_path')} as query_text from catalog_records where id % 20 = 0"


@query(f"with {sql.scores(NAMES)} select query_id, chunk_id, count(*) as words, round(sum(weighted), 6) as score from satisfied group by 1, 2")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every twentieth file as questions to all; hyphenated parts must stand next to each other."""
    names = table(spark, sf_dir, "catalog_records").where("id % 20 = 0").select(F.col("id").alias("query_id"), text.stem(F.col("relative_path")).alias("query_text"))
    return search.clause_scores(names, _searched_chunks(spark, sf_dir)).groupBy("query_id", "chunk_id").agg(F.count("*").alias("words"), F.round(F.sum("weighted"), 6).alias("score"))


@query(f"with {sql.INDEX} select term, count(distinct chunk_id) as n_chunks, count(*) as n_occurrences from posts group by 1")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(index.postings(_chunks(spark, sf_dir)))


@query(f"with {sql.INDEX} select n_chunks, n_tokens::bigint as n_tokens, round(avg_tokens, 6) as avg_tokens from totals")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(index.chunk_stats(_chunks(spark, sf_dir))).withColumn("avg_tokens", F.round("avg_tokens", 6))


# --- text functions ---------------------------------------------------------------------------------------------------


@query(f"select id, array_to_string({sql.bigrams('content')}, ' ') as bigrams from catalog_records where content is not null")
def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "catalog_records").where("content is not null").select("id", F.array_join(text.cjk_bigrams(F.col("content")), " ").alias("bigrams"))


@query(f"select distinct query_text, array_to_string({sql.bigrams('query_text', 2)}, ' ') as bigrams from search_hits where query_text is not null")
def cjk_query_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "search_hits").where("query_text is not null").select("query_text").distinct()
    return asked.select("query_text", F.array_join(text.cjk_query_bigrams(F.col("query_text")), " ").alias("bigrams"))


@query(f"select query_text, array_to_string({sql.query_tokens('query_text')}, ' ') as tokens from (select query_text from search_hits union select prompt from eval_items) where query_text is not null")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all logged questions and all prompts of the evaluation items."""
    asked = table(spark, sf_dir, "search_hits").select("query_text").unionByName(table(spark, sf_dir, "eval_items").select(F.col("prompt").alias("query_text"))).where("query_text is not null").distinct()
    return asked.select("query_text", F.array_join(text.query_tokens(F.col("query_text")), " ").alias("tokens"))


@query(f"select distinct h.hit_id, {sql.excerpt('c.content', sql.query_tokens('h.query_text'))} as excerpt from search_hits h join catalog_records c using (relative_path) where h.query_text is not null and c.content is not null")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt of each logged hit, made again from its file."""
    hits = table(spark, sf_dir, "search_hits").where("query_text is not null").select("hit_id", "relative_path", "query_text").distinct()
    records = table(spark, sf_dir, "catalog_records").where("content is not null").select("relative_path", "content")
    return hits.join(records, "relative_path").select("hit_id", text.excerpt(F.col("content"), text.query_tokens(F.col("query_text"))).alias("excerpt"))


@query(f"""select id, relative_path, {sql.name('relative_path')} as file_name, {sql.stem('relative_path')} as stem, {sql.suffix('relative_path')} as suffix, {sql.page_path('relative_path')} as page_path,
  strlen(content) as bytes, sha256(content) as content_sha256 from catalog_records""")
def entries_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("relative_path")
    return table(spark, sf_dir, "catalog_records").select(
        "id", "relative_path", text.file_name(path).alias("file_name"), text.stem(path).alias("stem"), text.suffix(path).alias("suffix"), text.page_path(path).alias("page_path"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("content_sha256")
    )


@query("select id, relative_path, status, content from catalog_records where relative_path = (select min(relative_path) from catalog_records)")
def entry_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry by its path; the filter reaches the scan."""
    records = table(spark, sf_dir, "catalog_records")
    return records.where(F.col("relative_path") == records.agg(F.min("relative_path")).first()[0]).select("id", "relative_path", "status", "content")


@query("select id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda r: length(r))), 0))::int) as fence from catalog_records where content is not null")
def fence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "catalog_records").where("content is not null").select("id", text.fence(F.col("content")).alias("fence"))


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunk_sql(budget: int) -> str:
    line = f"[^{sql.LINE_END}\\r]*(?:\\r\\n|[{sql.LINE_END}\\r])|[^{sql.LINE_END}\\r]+"
    return f"""with recursive lines as (select id, unnest(regexp_extract_all(content, '{line}')) as line, generate_subscripts(regexp_extract_all(content, '{line}'), 1) as n from catalog_records where content <> ''),
grouped as (select *, (strlen(line) > {budget})::int as long, 2 * sum((strlen(line) > {budget})::int) over (partition by id order by n) - (strlen(line) > {budget})::int as part from lines),
units as (
  select id, n, part, unnest(case when long = 1 then regexp_extract_all(line, '[^{sql.SPACE}]+[{sql.SPACE}]*|[{sql.SPACE}]+') else [line] end) as unit,
    generate_subscripts(case when long = 1 then regexp_extract_all(line, '[^{sql.SPACE}]+[{sql.SPACE}]*|[{sql.SPACE}]+') else [line] end, 1) as m from grouped),
numbered as (select id, part, unit, strlen(unit) as size, row_number() over (partition by id order by n, m) as k from units),
packed as (
  select id, k, part, 0 as chunk_index, size as held from numbered where k = 1
  union all
  select n.id, n.k, n.part, p.chunk_index + (n.part <> p.part or p.held + n.size > {budget})::int, case when n.part <> p.part or p.held + n.size > {budget} then n.size else p.held + n.size end
  from packed p join numbered n on n.id = p.id and n.k = p.k + 1)
select id as entry_id, chunk_index, string_agg(unit, '' order by k) as content from packed join numbered using (id, k) group by 1, 2
union all select id, 0, '' from catalog_records where coalesce(content, '') = ''"""


@query(chunk_sql(4096))
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(table(spark, sf_dir, "catalog_records"), "id", "content", 4096)


@query(chunk_sql(256))
def chunk_records_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(table(spark, sf_dir, "catalog_records"), "id", "content", 256)


@query("select entry_id, string_agg(content, '' order by chunk_index) as content from (select distinct * from catalog_chunks) group by 1")
def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.reassembled(table(spark, sf_dir, "catalog_chunks"))


@query(f"with {sql.CHUNKS} select id, entry_id, chunk_index, ngrams from chunks")
def migration_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bigram field of all chunks, filled in for those of old catalogs."""
    return _chunks(spark, sf_dir).select("id", "entry_id", "chunk_index", "ngrams")


@query(f"""select e.id as entry_id, 0 as chunk_index, e.relative_path, '' as content, array_to_string({sql.bigrams('e.relative_path')}, ' ') as ngrams
from (select distinct id, relative_path, kind from catalog_entries where snapshot_no = (select max(snapshot_no) from catalog_entries)) e where e.kind = 'file' and not exists (select 1 from catalog_chunks c where c.entry_id = e.id)""")
def path_only_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-only chunks for the files of the last snapshot that have none, such as those that couldn't be read."""
    entries = table(spark, sf_dir, "catalog_entries")
    last = entries.where(F.col("snapshot_no") == entries.agg(F.max("snapshot_no")).first()[0]).select("id", "relative_path", "kind").distinct()
    return chunks.missing_path_chunks(last, table(spark, sf_dir, "catalog_chunks"))


# --- sync: the last snapshot is the scan, the one before it the catalog ------------------------------------------------

SYNC_SQL = """
with latest as (
  select snapshot_no, relative_path, id, absolute_path, kind, size, mtime_ns, status, extractor, error, sha256, wiki_path, indexed_at from catalog_entries
  qualify row_number() over (partition by snapshot_no, relative_path order by delivered_at desc, id desc) = 1),
numbers as (select max(snapshot_no) as this, max(case when snapshot_no < (select max(snapshot_no) from catalog_entries) then snapshot_no end) as before from catalog_entries),
scan as (select l.* from latest l join numbers on snapshot_no = this), old as (select l.* from latest l join numbers on snapshot_no = before),
changes as (
  select relative_path, case when s.id is null then 'removed' when o.id is null then 'added'
    when s.kind is distinct from o.kind or s.size is distinct from o.size or s.mtime_ns is distinct from o.mtime_ns then 'updated'
    when o.status in ('unsupported', 'error') then 'retry' else 'unchanged' end as change
  from scan s full join old o using (relative_path)),
settled as (
  select c.relative_path, case when change <> 'retry' then change
    when s.status is not distinct from o.status and s.extractor is not distinct from o.extractor and s.error is not distinct from o.error and s.sha256 is not distinct from o.sha256 then 'unchanged' else 'updated' end as change
  from changes c left join scan s using (relative_path) left join old o using (relative_path))
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the last snapshot and of the one before it, one a path."""
    entries = table(spark, sf_dir, "catalog_entries")
    numbers = [r[0] for r in entries.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(2).collect()]
    columns = [c for c in entries.columns if c not in ("snapshot_no", "delivered_at", "id", "relative_path")]
    last = entries.groupBy("snapshot_no", "relative_path").agg(F.max(F.struct("delivered_at", "id", *columns)).alias("_r")).select("snapshot_no", "relative_path", "_r.id", *[f"_r.{c}" for c in columns])
    # both are joined several times
    last = cut(last.where(F.col("snapshot_no").isin(numbers)))
    this, before = (last.where(F.col("snapshot_no") == n).drop("snapshot_no") for n in numbers)
    return this, before


@query(SYNC_SQL + "select * from changes")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(*_snapshots(spark, sf_dir), sync.UNREADABLE)


@query(SYNC_SQL + "select * from settled")
def sync_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with retries settled: a file that fails again in the same way is unchanged."""
    this, before = _snapshots(spark, sf_dir)
    return sync.settled(sync.diff(this, before, sync.UNREADABLE), this, before)


@query(SYNC_SQL + "select count_if(change = 'added') as added, count_if(change = 'updated') as updated, count_if(change = 'unchanged') as unchanged, count_if(change = 'removed') as removed from settled")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    this, before = _snapshots(spark, sf_dir)
    return sync.summary(sync.settled(sync.diff(this, before, sync.UNREADABLE), this, before))


@query(SYNC_SQL + f"select relative_path, {sql.page_path('relative_path')} as wiki_path from settled join old using (relative_path) where change = 'removed' and kind = 'file'")
def sync_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    this, before = _snapshots(spark, sf_dir)
    return sync.removed_pages(sync.diff(this, before), before)


@query(
    SYNC_SQL
    + """, top as (select coalesce(max(id), 0) as top from old),
fresh as (select s.*, c.change from scan s join settled c using (relative_path) where change in ('added', 'updated'))
select o.id, o.relative_path, o.kind, o.size, o.mtime_ns, o.status, o.sha256 from old o join settled c using (relative_path) where change = 'unchanged'
union all select o.id, f.relative_path, f.kind, f.size, f.mtime_ns, f.status, f.sha256 from fresh f join old o using (relative_path)
union all select top + row_number() over (order by f.relative_path), f.relative_path, f.kind, f.size, f.mtime_ns, f.status, f.sha256 from fresh f, top where f.change = 'added'"""
)
def sync_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after the sync; known paths keep their ids, new ones are numbered on."""
    this, before = _snapshots(spark, sf_dir)
    changes = sync.settled(sync.diff(this, before, sync.UNREADABLE), this, before)
    return sync.upserted(before, this, changes).select("id", "relative_path", "kind", "size", "mtime_ns", "status", "sha256")


@query("select snapshot_no, kind, status, count(*) as entries from (select distinct snapshot_no, relative_path, kind, status from catalog_entries) group by all")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "catalog_entries").select("snapshot_no", "relative_path", "kind", "status").distinct()
    return rows.groupBy("snapshot_no", "kind", "status").agg(F.count("*").alias("entries"))


@query("select id, relative_path, case when strlen(content) > 8192 then 'too_large' else status end as status from catalog_records")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the records under a limit of 8192 bytes of text."""
    return table(spark, sf_dir, "catalog_records").select("id", "relative_path", F.when(F.octet_length("content") > 8192, "too_large").otherwise(F.col("status")).alias("status"))


EXCLUDED = (*EXCLUDED_DIRECTORIES, "shared", "yellow")
_NAMES = "'.git', '.hg', '.svn', '.omx', '__pycache__', '.venv', 'build', 'dist', 'download', 'downloads', 'env', 'node_modules', 'site-packages', 'third-party', 'third_party', 'vendor', 'venv', 'shared', 'yellow'"


@query(f"""select distinct relative_path from catalog_entries where not list_has_any(case when kind = 'directory' then string_split(lower(relative_path), '/') else string_split(lower(relative_path), '/')[:-2] end, [{_NAMES}])
and len(list_filter(case when kind = 'directory' then string_split(lower(relative_path), '/') else string_split(lower(relative_path), '/')[:-2] end, lambda f: f like '%.git' or f like 're%')) = 0
and (kind = 'directory' or {sql.suffix('relative_path')} not in ('.csv', '.toml'))""")
def scan_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a scan keeps under the default rules and a few more."""
    paths = table(spark, sf_dir, "catalog_entries")
    return paths.where(scan.kept(F.col("relative_path"), EXCLUDED, ("*.git", "re*"), (".csv", ".toml"), F.col("kind") == "directory")).select("relative_path").distinct()


# --- pages ------------------------------------------------------------------------------------------------------------

_v = lambda c: f"coalesce({c}::varchar, '')"
_q = lambda c: f"to_json(coalesce({c}::varchar, ''))::varchar"
PAGE_SQL = f"""select relative_path, {sql.page_path('relative_path')} as wiki_path,
  concat_ws(chr(10), '---', 'source_path: ' || {_q('absolute_path')}, 'relative_path: ' || {_q('relative_path')}, 'status: ' || {_q('status')}, 'extractor: ' || {_q('extractor')}, 'sha256: ' || {_q('sha256')},
    'size_bytes: ' || {_v('size')}, 'modified_ns: ' || {_v('mtime_ns')}, 'indexed_at: ' || {_q('indexed_at')}, '---', '', '# ' || {sql.name('relative_path')}, '', '## Provenance', '',
    '- Original file: `' || {_v('absolute_path')} || '`', '- Relative path: `' || {_v('relative_path')} || '`', '- Extraction status: `' || {_v('status')} || '`',
    case when {_v('error')} <> '' then '- Extraction note: ' || error end, '', '## Extracted content', '',
    case when {_v('content')} <> '' then concat(marks, 'text', chr(10), content, chr(10), marks, chr(10)) else concat('No readable text was extracted. The file remains indexed by path and metadata.', chr(10)) end) as page
from (select *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda r: length(r))), 0))::int) as marks from catalog_records) where kind = 'file'"""


@query(PAGE_SQL)
def wiki_page_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.pages(table(spark, sf_dir, "catalog_records"))


@query(SYNC_SQL + f"""select case when kind = 'file' then 0 else 1 end as section, relative_path, case when kind = 'file'
  then concat('- [', relative_path, '](', regexp_replace({sql.page_path('relative_path')}, '^wiki/', ''), ') — ', status, ', ', size::varchar, ' bytes') else concat('- `', relative_path, '/`') end as line from scan""")
def wiki_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.navigation(_snapshots(spark, sf_dir)[0])


EXPECTED = f"expected as (select relative_path, {sql.page_path('relative_path')} as wiki_path from scan where kind = 'file'), present as (select distinct wiki_path from old where wiki_path <> '')"


@query(SYNC_SQL + f", {EXPECTED} select distinct relative_path, wiki_path from expected e where relative_path in (select relative_path from settled where change in ('added', 'updated')) or wiki_path not in (select wiki_path from present)")
def compile_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to write after the sync: of changed files, and of files whose page the catalog before it didn't name."""
    this, before = _snapshots(spark, sf_dir)
    changes = sync.settled(sync.diff(this, before, sync.UNREADABLE), this, before).where("change in ('added', 'updated')")
    return wiki.to_compile(this, changes, before.where("wiki_path <> ''"))


@query(SYNC_SQL + f""", {EXPECTED} select 'missing' as issue_type, wiki_path as subject, 'Missing source page: ' || wiki_path as message from (select distinct wiki_path from expected) anti join present using (wiki_path)
union all select 'orphan', wiki_path, 'Orphan source page: ' || {sql.name('wiki_path')} from present anti join expected using (wiki_path)""")
def lint_missing_and_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by the catalog before the last sync against the files of now."""
    this, before = _snapshots(spark, sf_dir)
    return wiki.lint(this, before)


# --- extraction -------------------------------------------------------------------------------------------------------


@query("select id, 'extracted' as status, content, 'text:utf-8-sig' as extractor, '' as error, sha256(content) as sha256 from catalog_records where content is not null")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as bytes and read again as text files."""
    got = table(spark, sf_dir, "catalog_records").where("content is not null").select("id", extract.extract(F.lit(".txt"), F.encode("content", "UTF-8")).alias("r"))
    return got.select("id", "r.*")


@query("select doc_id, 'extracted' as status, text as content, 'text-sniffed:utf-8-sig' as extractor from documents where text is not null")
def extract_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of files of unknown kind."""
    got = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", extract.extract(F.lit(".data"), F.encode("text", "UTF-8")).alias("r"))
    return got.select("doc_id", "r.status", "r.content", "r.extractor")
