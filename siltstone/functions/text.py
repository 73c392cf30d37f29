"""Column expressions over text: tokens, bigrams, excerpts, page paths, fences. All of them run in the JVM; null gives null unless stated."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character blocks, white space, line ends and stop words of the catalog.
CJK = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{a960}-\x{a97f}\x{ac00}-\x{d7a3}\x{2e80}-\x{9fff}\x{f900}-\x{faff}]"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\n\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
STOPWORDS = (
    "a an and are case dataset does find for how in is illustrate me of please problem show tell the to what when where who why "
    "누구 누구야 뭐야 무엇 어디 언제 왜 어떻게 알려줘 찾아줘 보여줘"
).split()
QUERY_TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"
EXCERPT_LENGTH = 320


def _plain_letters() -> tuple[str, str]:
    """Small letters with exactly one mark, U+00E0 to U+024F, and the letters without it."""
    marked, plain = [], []
    for c in map(chr, range(0xE0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and c.islower() and parts[0].isalpha():
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _plain_letters()


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """All pairs of neighbours of each run of CJK characters, in order."""
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2)))
    return F.flatten(F.transform(all_matches(text, CJK + "{2,}"), pairs))


def cjk_query_bigrams(token: Column) -> Column:
    """Pairs of CJK characters that don't overlap; the odd last character of a run is left out."""
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1, F.lit(2)), lambda i: run.substr(i, F.lit(2)))
    return F.flatten(F.transform(all_matches(token, CJK + "{2,}"), pairs))


def index_tokens(text: Column) -> Column:
    """Terms of the index: runs of letters, digits and private characters of the lower-cased text without diacritics."""
    lowered = F.regexp_replace(F.lower(text), "[\\x{300}-\\x{36f}]", "")
    return all_matches(F.translate(lowered, MARKED, PLAIN), INDEX_TOKEN)


def query_tokens(query: Column) -> Column:
    """Words of a question, hyphenated ones in one piece, without stop words and repetitions (case aside; the first spelling stays)."""
    tokens = F.filter(all_matches(query, QUERY_TOKEN), lambda t: ~F.lower(t).isin(STOPWORDS))
    lowered = F.transform(tokens, F.lower)
    return F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def candidate_tokens(tokens: Column) -> Column:
    """At most eight tokens: of a longer list the first four and the last four."""
    return F.when(F.size(tokens) > 8, F.concat(F.slice(tokens, 1, 4), F.slice(tokens, -4, 4))).otherwise(tokens)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def excerpt(content: Column, tokens: Column, length: int = EXCERPT_LENGTH) -> Column:
    """A window of the content around the first place where one of the tokens stands, white space collapsed, '…' at cut ends; '' for no content."""
    first_place = let(F.lower(content), lambda lowered: F.array_min(F.filter(F.transform(tokens, lambda t: F.position(F.lower(t), lowered)), lambda p: p > 0)))
    first = F.greatest(F.lit(0), F.coalesce(first_place, F.lit(1)) - 1 - length // 3)
    bounds = let(first, lambda f: let(F.least(F.length(content), f + length), lambda end: F.struct(F.when(end - f < length, F.greatest(F.lit(0), end - length)).otherwise(f).alias("start"), end.alias("end"))))

    def show(b: Column) -> Column:
        window = F.trim(F.regexp_replace(content.substr(b["start"] + 1, b["end"] - b["start"]), f"[{SPACE}]+", " "))
        return F.concat(F.when(b["start"] > 0, "… ").otherwise(""), window, F.when(b["end"] < F.length(content), " …").otherwise(""))

    return F.when(F.length(content) > 0, let(bounds, show)).otherwise("")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def suffix(path: Column) -> Column:
    """Last suffix in small letters, with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def page_path(path: Column) -> Column:
    """Stable path of the page of a file."""
    slug = F.regexp_replace(F.regexp_replace(stem(path), r"[^\p{L}\p{N}_.-]+", "-"), r"^[-._]+|[-._]+$", "")
    slug = F.left(F.when(slug == "", "file").otherwise(slug), F.lit(60))
    return F.concat(F.lit("wiki/sources/"), slug, F.lit("-"), F.left(F.sha1(path), F.lit(12)), F.lit(".md"))


def fence(content: Column) -> Column:
    """A run of backticks longer than any in the content, three at least."""
    longest = F.array_max(F.transform(all_matches(content, "`+"), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def json_string(value: Column) -> Column:
    """The value as a quoted JSON string, other than ASCII characters kept."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")


def folded(path: Column) -> Column:
    """Path with ASCII capitals made small: the order of results."""
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
