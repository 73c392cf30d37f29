"""The numbered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *sources: tuple[str, str, str]) -> DataFrame:
    """(source_table, row_id, text) of the given (table, id column, text column), nulls and empty texts left out."""
    out = None
    for name, key, text in sources:
        part = table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.length("text") > 0)
        out = part if out is None else out.unionByName(part)
    return out


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, ("catalog_records", "id", "content"), ("search_hits", "hit_id", "excerpt"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.pii import personal_spans

    return personal_spans(_personal_texts(spark, sf_dir), table(spark, sf_dir, "name_parts"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders for personal information."""
    from siltstone.llm.pii import masked_texts

    return masked_texts(_personal_texts(spark, sf_dir), table(spark, sf_dir, "name_parts"))


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and chunks; the chunks of an entry are pieces of its record."""
    records = texts(spark, sf_dir, ("catalog_records", "id", "content")).withColumns({"whole": F.col("row_id"), "piece": F.lit(None).cast("int")})
    chunks = table(spark, sf_dir, "catalog_chunks").where(F.length("content") > 0)
    return records.unionByName(chunks.select(F.lit("catalog_chunks").alias("source_table"), F.col("id").alias("row_id"), F.col("content").alias("text"), F.col("entry_id").alias("whole"), F.col("chunk_index").alias("piece")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.secrets import found_secrets

    return found_secrets(_secret_texts(spark, sf_dir)).withColumnRenamed("value", "found_text")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its secrets masked; rows without secrets come out unchanged."""
    from siltstone.llm.secrets import redacted

    return redacted(_secret_texts(spark, sf_dir))


#: The statement of problem 3: word triples, a similarity of 0.6, contents of 25 words or more.
NEAR = {"run": 3, "similarity": 0.6, "least_words": 25}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.neardup import similar_pairs

    return similar_pairs(table(spark, sf_dir, "catalog_records"), "id", "content", **NEAR)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a near duplicate, the group it belongs to and the number of its links; copies aren't spelled out as pairs."""
    from siltstone.llm.neardup import groups_of, links

    return groups_of(*links(table(spark, sf_dir, "catalog_records"), "id", "content", **NEAR))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mojibake import restored_lines

    source = texts(spark, sf_dir, ("catalog_records", "id", "content"), ("catalog_chunks", "id", "content"))
    return restored_lines(source, "text", ["source_table", "row_id"]).select("source_table", "row_id", "line_no", "restored_text").distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_capacities"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused room of each container size."""
    from siltstone.llm.packing import usage

    return usage(p6_packed(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one edited word allowed, and the number of edits."""
    return _leaks(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.spans import shared_spans

    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "span_start", "span_end")


def p8_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.spans import shared_share

    return shared_share(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_redacted, p3_found, p3_groups, p5_found, p6_packed, p6_usage, p7_found, p7_near, p8_found, p8_shared_share)}
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = """select {key}, unnest(list_transform(range(1, len(w) - {less} + 1), lambda i: array_to_string(w[i : i + {less}], ' '))) as run from (select {key}, {words} as w from {table} where {text} <> '') where len(w) > {less}"""
_P8 = """with lengths as (select distinct doc_id, text from documents where length(text) >= 400),
windows as (select doc_id, text, unnest(range(0, length(text) - 399)) as i from lengths),
hashed as (select doc_id, i, hash(substring(text, i + 1, 400)) as h from windows),
held as (select h from hashed group by h having min(doc_id) <> max(doc_id)),
shared as (select distinct doc_id, i from hashed join held using (h)),
steps as (select doc_id, i, case when i <= 400 + lag(i) over (partition by doc_id order by i) then 0 else 1 end as fresh from shared),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from steps),
spans as (select doc_id, min(i) as span_start, max(i) + 400 as span_end from runs group by doc_id, run)
"""
_SETS = f"""sets as (select distinct id, run from ({_RUNS.format(key='id', less=2, words=_WORDS.format('content'), table='catalog_records', text='content')}) where id in
  (select id from catalog_records where len({_WORDS.format('content')}) >= 25)),
sizes as (select id, count(*) as n from sets group by id)"""
_NEAR = "select id_a, id_b from common c join sizes x on x.id = id_a join sizes y on y.id = id_b where c.n >= 0.6 * (x.n + y.n - c.n) - 1e-9"
SQL: dict[str, str] = {
    "p3_found": f"""with {_SETS},
common as (select a.id as id_a, b.id as id_b, count(*) as n from sets a join sets b on a.run = b.run and a.id < b.id group by 1, 2)
{_NEAR}""",
    "p3_groups": f"""with recursive {_SETS},
members as (select id, min(id) over (partition by content) as kept, count(*) over (partition by content) as held from (select distinct id, content from catalog_records where content <> '')),
firsts as (select * from sets where id in (select kept from members)),
common as (select a.id as id_a, b.id as id_b, count(*) as n from firsts a join firsts b on a.run = b.run and a.id < b.id group by 1, 2),
near as ({_NEAR}),
edges as (select id_a as a, id_b as b from near union all select id_b, id_a from near),
reach as (select distinct a, a as b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
labels as (select a, min(b) as label from reach group by 1), degrees as (select a, count(*) as links from edges group by 1)
select id, coalesce(label, kept) as group_id, coalesce(links, 0)::bigint as links from members left join labels l on l.a = kept left join degrees d on d.a = kept where held > 1 or label is not null""",
    "p7_found": f"""with docs as ({_RUNS.format(key='doc_id', less=12, words=_WORDS.format('text'), table='documents', text='text')}), items as ({_RUNS.format(key='item_id', less=12, words=_WORDS.format('passage'), table='eval_items', text='passage')})
select distinct doc_id, item_id from docs join items using (run)""",
    "p8_found": _P8 + "select * from spans",
    "p8_shared_share": _P8
    + """, shares as (select doc_id, sum(span_end - span_start)::bigint as shared from spans group by 1)
select doc_id, coalesce(length(text), 0) as n_chars, coalesce(shared, 0) as shared_chars, case when length(text) > 0 then coalesce(shared, 0) / length(text) else 0 end as shared_ratio from documents left join shares using (doc_id)""",
}
