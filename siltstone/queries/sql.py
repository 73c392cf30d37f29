"""Pieces of SQL that several checks share; each function returns an expression or a list of common table expressions for DuckDB.

Nothing here comes from the code that is checked: constants and patterns are spelled out again.
"""

from __future__ import annotations

# Fixed values of the catalog: character blocks, white space, line ends, stop words, letters without their mark, constants of the score.
CJK = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{a960}-\x{a97f}\x{ac00}-\x{d7a3}\x{2e80}-\x{9fff}\x{f900}-\x{faff}]"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\n\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
STOPWORDS = "'a', 'an', 'and', 'are', 'case', 'dataset', 'does', 'find', 'for', 'how', 'in', 'is', 'illustrate', 'me', 'of', 'please', 'problem', 'show', 'tell', 'the', 'to', 'what', 'when', 'where', 'who', 'why', '누구', '누구야', '뭐야', '무엇', '어디', '언제', '왜', '어떻게', '알려줘', '찾아줘', '보여줘'"
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžơưǎǐǒǔǣǧǩǫǯǰǵǹǽǿȁȃȅȇȉȋȍȏȑȓȕȗșțȟȧȩȯȳ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzouaiouægkoʒjgnæøaaeeiioorruusthaeoy"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def bigrams(x: str, stride: int = 1) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '{CJK}{{2,}}'), lambda r: list_transform(range(1, length(r), {stride}), lambda i: substring(r, i, 2))))"


def index_tokens(x: str) -> str:
    lowered = f"regexp_replace(lower({x}), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
    return f"regexp_extract_all(translate({lowered}, '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def query_tokens(x: str) -> str:
    kept = f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*'), lambda t: lower(t) not in ({STOPWORDS}))"
    return f"list_filter({kept}, lambda t, i: list_position(list_transform({kept}, lambda u: lower(u)), lower(t)) = i)"


def excerpt(content: str, tokens: str, n: int = 320) -> str:
    at = f"coalesce(list_min(list_filter(list_transform({tokens}, lambda t: strpos(lower({content}), lower(t))), lambda p: p > 0)), 1) - 1"
    first = f"greatest(0, {at} - {n // 3})"
    end = f"least(length({content}), {first} + {n})"
    start = f"(case when {end} - {first} < {n} then greatest(0, {end} - {n}) else {first} end)"
    window = f"trim(regexp_replace(substring({content}, {start} + 1, {end} - {start}), '[{SPACE}]+', ' ', 'g'))"
    return f"(case when length({content}) > 0 then concat(case when {start} > 0 then '… ' else '' end, {window}, case when {end} < length({content}) then ' …' else '' end) else '' end)"


def name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def stem(path: str) -> str:
    return f"regexp_replace({name(path)}, '^(.+)\\.[^.]+$', '\\1')"


def suffix(path: str) -> str:
    return f"lower(regexp_extract({name(path)}, '^.+(\\.[^.]+)$', 1))"


def page_path(path: str) -> str:
    slug = f"regexp_replace(regexp_replace({stem(path)}, '[^\\p{{L}}\\p{{N}}_.-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')"
    return f"concat('wiki/sources/', left(case when {slug} = '' then 'file' else {slug} end, 60), '-', left(sha1({path}), 12), '.md')"


CHUNKS = f"""chunks as (select distinct id, entry_id, chunk_index, relative_path, content,
  coalesce(ngrams, array_to_string(list_concat({bigrams("coalesce(content, '')")}, {bigrams("coalesce(relative_path, '')")}), ' ')) as ngrams from catalog_chunks)"""

INDEX = f"""{CHUNKS},
fields as (
  select id as chunk_id, entry_id, 'relative_path' as field, {index_tokens("coalesce(relative_path, '')")} as terms from chunks
  union all select id, entry_id, 'content', {index_tokens("coalesce(content, '')")} from chunks
  union all select id, entry_id, 'ngrams', {index_tokens("coalesce(ngrams, '')")} from chunks),
posts as (select chunk_id, entry_id, field, unnest(terms) as term, generate_subscripts(terms, 1) - 1 as pos from fields),
stats as (select chunk_id, sum(len(terms)) as n_tokens from fields group by 1),
totals as (select count(*) as n_chunks, sum(n_tokens) as n_tokens, sum(n_tokens) / count(*) as avg_tokens from stats)"""


def scores(questions: str) -> str:
    """CTEs up to `satisfied` for a CTE body that gives (query_id, query_text)."""
    score = lambda f: f"idf * {f} * {K1 + 1} / ({f} + {K1} * ({1 - B} + {B} * n_tokens / avg_tokens))"
    return f"""{INDEX},
questions as (select query_id, min(query_text) as query_text from ({questions}) group by 1),
listed as (select query_id, {query_tokens("query_text")} as t from questions),
picked as (select query_id, case when len(t) > 8 then list_concat(t[1:4], t[-4:]) else t end as tokens from listed where len(t) > 0),
words as (select query_id, len(tokens) as n_clauses, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as clause from picked),
paired as (select *, {bigrams("token", 2)} as pairs from words),
asked as (
  select query_id, n_clauses, clause, token, 0 as branch, 1 as branch_size, '' as field, {index_tokens("token")} as terms from paired
  union all select query_id, n_clauses, clause, token, 1, len(pairs), 'ngrams', {index_tokens("pair")} from (select *, unnest(pairs) as pair from paired where len(pairs) >= 2)),
phrases as (select distinct field, terms from asked where len(terms) > 0),
parts as (select field, terms, len(terms) as n, unnest(terms) as term, generate_subscripts(terms, 1) - 1 as at from phrases),
met as (select p.field, p.terms, p.n, o.chunk_id, o.entry_id, o.field as place, o.pos - p.at as begins from parts p join posts o on o.term = p.term and (p.field = '' or p.field = o.field)),
whole as (select field, terms, chunk_id, entry_id, place, begins from met group by field, terms, n, chunk_id, entry_id, place, begins having count(*) = n),
hits as (select field, terms, chunk_id, entry_id, sum(case place when 'relative_path' then 8.0 when 'content' then 4.0 else 2.0 end)::double as weighted, count(*)::double as plain from whole group by all),
held as (select field, terms, count(*) as df from hits group by all),
rare as (select field, terms, case when ln((n_chunks - df + 0.5) / (df + 0.5)) <= 0 then {LEAST_IDF} else ln((n_chunks - df + 0.5) / (df + 0.5)) end as idf, avg_tokens from held, totals),
scored as (select field, terms, chunk_id, entry_id, {score("weighted")} as weighted, {score("plain")} as plain from hits join rare using (field, terms) join stats using (chunk_id)),
branches as (
  select query_id, n_clauses, clause, branch_size, chunk_id, entry_id, count(*) as met, sum(weighted) as weighted, sum(plain) as plain
  from asked join scored using (field, terms) group by query_id, n_clauses, clause, branch, branch_size, chunk_id, entry_id),
satisfied as (
  select query_id, n_clauses, clause, chunk_id, b.entry_id, chunk_index, sum(weighted) as weighted, sum(plain) as plain
  from branches b join chunks c on c.id = b.chunk_id where met = branch_size group by all)"""


def ladder(questions: str, limit: int = 5) -> str:
    """CTEs up to `hits_ranked` (query_id, rank, stage, entry_id, chunk_id, score, mask)."""
    return f"""{scores(questions)},
numbers as (select unnest(range(1, 9)) as n_clauses),
subsets as (select n_clauses, unnest(range(1, (1 << n_clauses)::bigint)) as mask from numbers),
groups as (
  select n_clauses, mask, bit_count(mask) as size, list_filter(range(0, 8), lambda i: (mask >> i) & 1 = 1)[1] as first,
    row_number() over (partition by n_clauses order by bit_count(mask) desc, list_filter(range(0, 8), lambda i: (mask >> i) & 1 = 1)) as ordinal
  from subsets where n_clauses = 1 or bit_count(mask) > 1),
file_masks as (select query_id, n_clauses, entry_id, bit_or((1 << clause)::bigint) as held from satisfied group by all),
chosen as (
  select query_id, arg_min(mask, ordinal) as mask, arg_min(size, ordinal) as size, arg_min(first, ordinal) as first
  from file_masks join groups using (n_clauses) where held & mask = mask group by 1),
wanted as (select s.*, c.mask, c.size, c.first from satisfied s left join chosen c using (query_id) where c.mask is null or c.mask & (1 << s.clause)::bigint > 0),
per_chunk as (select query_id, entry_id, chunk_id, chunk_index, mask, bit_or((1 << clause)::bigint) as held, sum(weighted) as score from wanted group by all),
same as (
  select query_id, entry_id, chunk_id, score from per_chunk where mask is null or held = mask
  qualify row_number() over (partition by query_id, entry_id order by round(score, 9) desc, chunk_index, chunk_id) = 1),
best as (select query_id, entry_id, clause, size, max(plain) as best from wanted where size > 1 group by all),
across_all as (select query_id, entry_id, sum(best) as score from best group by query_id, entry_id, size having count(*) = size),
first_chunk as (
  select query_id, entry_id, chunk_id from wanted where size > 1 and clause = first
  qualify row_number() over (partition by query_id, entry_id order by round(plain, 9) desc, chunk_index, chunk_id) = 1),
across as (select query_id, entry_id, chunk_id, a.score from across_all a join first_chunk using (query_id, entry_id) anti join same using (query_id, entry_id)),
both_stages as (select *, 0 as stage from same union all by name select *, 1 as stage from across),
hits_ranked as (
  select b.query_id, b.stage, b.entry_id, b.chunk_id, b.score, r.relative_path, r.absolute_path, r.status,
    row_number() over (partition by b.query_id order by b.stage, case when r.status in ('unsupported', 'error') then 1 else 0 end, round(b.score, 9) desc,
      translate(r.relative_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r.relative_path) as rank
  from both_stages b join entries r on r.id = b.entry_id qualify rank <= {limit}),
group_tokens as (select w.query_id, list(w.token order by w.clause) as tokens from words w left join chosen c using (query_id) where c.mask is null or c.mask & (1 << w.clause)::bigint > 0 group by 1)"""
