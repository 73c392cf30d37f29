"""Credentials embedded in source code, configuration and prose: find them and redact them.

Method: the literals of assignments, strings and credential places are indexed corpus-wide; values that many unrelated owners
share are placeholders and suppressed; rare values of a credential's structure are confirmed. Then every text is scanned again
for all confirmed secrets by an automaton: one over all of them while they are few enough to be sent to every task, beyond that
one a batch over those whose last words a text of the batch holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut, small

#: A value that more owners hold than this, and than this share of all owners, is a placeholder. An owner is a file with its chunks; files of equal content are one owner.
MAX_OWNERS, MAX_SHARE = 12, 1e-4
#: Characters of the secrets of one automaton at most.
AUTOMATON = 1 << 21
#: Words of a secret by which it meets texts, at most; bits of the map of these keys that every task has; the factor that joins the hashes of neighbours.
ANCHOR, MARKS, MIX = 3, 1 << 27, np.uint64(0x9E3779B97F4A7C15)
#: Kinds of literals that are secrets however many owners share them.
SURE = ("key", "issued", "random")
#: A plain word: it leaves strings, YAML, JSON, URLs and shell lines what they were.
MASK = "REDACTED"

# Public formats of issued keys and tokens, words that name or replace credentials.
ISSUED = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|ya29\.[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{36}|pypi-[\w-]{50,}|dop_v1_[a-f0-9]{64}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
)
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret(?:[_-]?key)?|token|api[_-]?key|apikey|credentials?|auth[_-]?token|access[_-]?key|client[_-]?secret)"
PLACEHOLDER = re.compile(
    r"(?i)^(?:[*xX.•·\-_?#]+|none|null|nil|true|false|changeme|change[_-]?me|change[_-]?it|redacted|masked|hidden|example|sample|dummy|test|todo|tbd|your[\w-]*|my[_-]?(?:password|secret|token)|(?:password|passwd|secret|token|apikey|api[_-]key)"
    r"|<.*>?|\$[\w{(].*|%\(?\w+\)?[s%]?|\{\{.*|.*\*{3,}.*|!.*|.*\.\.\.|process\.env.*|os\.environ.*|getenv.*|env[.\[(].*|vault[:/].*|.*\(.*)$"
)
#: Any issued key of the common shape: a short name, perhaps a second one, and a body of mixed characters behind a separator; or a name in capitals grown into its body.
PREFIXED = r"[A-Za-z]{2,8}(?:[_.-][A-Za-z]{2,6})?[_.-](?:[A-Za-z0-9]{6,12}-)?[A-Za-z0-9_]{16,}|[A-Z]{4}[A-Z0-9]{16}"
#: Lines that may hold a literal: those with a word of a credential place, and those with a long run of characters of several kinds, as issued keys and random strings have.
PLACE_LINE = r"(?i)pass|pwd|pw|secret|token|api[ _-]?key|credential|access[_-]?key|\bauth|login|bearer|\bbasic |x-api-|private key|hmac|client\(|setkey|set_key|://[^\s/@:]*:[^\s/@]+@|비번|비밀번호|암호|토큰"
LONG_LINE = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z0-9_+/=.-]*[0-9])(?=[A-Za-z0-9_+/=.-]*[A-Z])[A-Za-z0-9_+/=.-]{16}"

_VALUE = r"""(?P<q>'''|\"\"\"|["'`])(?P<v1>(?:(?!(?P=q)).){4,})(?P=q)|(?P<v2>[^\s"'`,;<>]{4,})"""
_PLACES = [
    ("key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    ("issued", re.compile(r"(?<![\w.-])(?:" + ISSUED + r")(?![\w-])")),
    ("prefixed", re.compile(r"(?<![\w./+=-])(?:" + PREFIXED + r")(?![\w+/=-])")),
    ("url", re.compile(r"://[^\s/@:\"']*:(?P<v2>[^\s/@\"']+)@")),
    ("header", re.compile(r"(?i)\b(?:bearer|basic)\s+(?P<v2>[A-Za-z0-9_.~+/=-]{8,})")),
    ("header", re.compile(r"(?i)\bx-(?:api|auth)-(?:key|token):\s*(?P<v2>[^\s\"']{8,})")),
    ("xml", re.compile(r"""(?i)\bkey="[\w.-]*""" + NAME + r"""\d*"\s+value="(?P<v2>[^"]{4,})\"""")),
    ("assigned", re.compile(r"""(?i)""" + NAME + r"""["']?\]?\s*(?:=>|:=|[:=])\s*(?:[bruf]{1,2}(?=["']))?(?:""" + _VALUE + ")")),
    ("assigned", re.compile(r"""(?i)\bENV\s+\w*(?:PASSWORD|SECRET|TOKEN|API_KEY|PASSWD)\s+(?P<v2>[^\s"']{4,})""")),
    ("call", re.compile(r"""\bauth\s*=\s*\(\s*["'][^"']*["']\s*,\s*["'](?P<v2>[^"']{4,})["']""")),
    ("call", re.compile(r"""\blogin\(\s*["'][^"']*["']\s*,\s*["'](?P<v2>[^"']{4,})["']""")),
    ("call", re.compile(r"""(?i)\bset_?(?:token|password|secret|key)\(\s*["'](?P<v2>[^"']{4,})["']""")),
    ("call", re.compile(r"""\bhmac\.new\(\s*b?["'](?P<v2>[^"']{4,})["']""")),
    ("call", re.compile(r"""Client\(\s*["']https?://[^"']*["']\s*,\s*["'](?P<v2>[^"']{8,})["']""")),
    ("netrc", re.compile(r"\blogin\s+\S+\s+password\s+(?P<v2>\S{4,})")),
    ("prose", re.compile(r"\blogin\s+\S+\s+/\s+(?P<v2>\S{4,})")),
    ("prose", re.compile(r"(?i)\b(?:pw|password|passphrase|passwd|secret|token)\s*(?:is|:|to|=)?\s+(?P<v2>[^\s\"',;]{6,})")),
    ("prose", re.compile(r"(?:비번|비밀번호|암호|토큰)(?:는|은|:|가)?\s*(?P<v2>[!-~]{4,})")),
    ("prose", re.compile(r"(?i)\bapi key for [^:\n]{1,60}:\s*(?P<v2>\S{8,})")),
]
_PHRASE = re.compile(r"^[a-z]+(?:-[a-z]+){1,4}-\d+$")
_HEX_SUM = re.compile(r"(?i)\b(?:sha(?:1|256|512)|md5|commit|checksum|etag|integrity|digest|uuid|request-id)\b")
_WORDISH = re.compile(r"^[A-Za-z]?[a-z]+$|^[A-Z]+$|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[a-z_]+$|^/|^[\d.,%]+$|^[a-z]+(?:/[a-z]+)+$")


def structured(value: str) -> bool:
    """Whether the value looks like something issued or made up to be secret: several kinds of characters, no plain word, path or number."""
    if PLACEHOLDER.match(value) or _WORDISH.match(value) or "-----" in value:  # a marker's dashes belong to a key, not to a literal
        return False
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    return bool(_PHRASE.match(value)) or (len(value) >= 6 and (kinds >= 2 and (bool(re.search(r"\d", value)) or kinds >= 2 and len(value) >= 8)))


def entropy(value: str) -> float:
    """Bits a character of value."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def issued_body(value: str) -> bool:
    """Whether the long part of a prefixed value is random: characters change between kinds again and again, no words and no hexadecimal sum; capitals alone hold few vowels."""
    body = re.split(r"[_.-]", value)[-1]
    if len(body) < 16 or re.fullmatch(r"[0-9a-fA-F]+|[a-z0-9]+", body):
        return False
    if re.fullmatch(r"[A-Z0-9]+", body):
        return bool(re.search(r"\d", body)) or sum(c in "AEIOU" for c in body) < 0.3 * len(body)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return changes * 3 >= len(body) and entropy(body) >= 3.0 if "d" in kinds else changes * 2.8 >= len(body) and entropy(body) >= 3.9


def literals(line: str) -> list[tuple[str, str]]:
    """(kind of place, value) of the literals of a line that stand where credentials stand; an issued format counts anywhere."""
    found: dict[str, str] = {}
    for kind, place in _PLACES:
        for m in place.finditer(line):
            if kind in ("key", "issued", "prefixed"):
                value = m.group()
                if kind == "prefixed" and (not issued_body(value) or _HEX_SUM.search(line[max(0, m.start() - 24) : m.start()])):
                    continue
            else:
                g = m.groupdict()
                value = g.get("v1") or g["v2"]
                if g.get("v1") is None and kind in ("assigned", "prose", "netrc"):
                    value = value.rstrip(").,;]}")
                if kind == "assigned" and value.startswith(("'", '"')):
                    continue
            if value and (kind in ("key", "issued", "prefixed") or structured(value)) and not _inside(value, found):
                found.setdefault(value, "issued" if kind == "prefixed" else kind)
    return [("random" if k not in ("key", "issued") and random_like(v) else k, v) for v, k in found.items()]


def random_like(value: str) -> bool:
    """Whether the value is too irregular for a placeholder that people write: twelve characters or more of three kinds, no phrase."""
    return len(value) >= 12 and not _PHRASE.match(value) and sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]")) >= 3


def _inside(value: str, found: dict[str, str]) -> bool:
    return any(value != x and (value in x or x in value) for x in found)


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of word characters of text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _by_words(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about a million words, or one text."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy()) >> 20
        starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
        yield from (batch.slice(x, y - x) for x, y in zip(starts, starts[1:]) if y > x)


def _runs(words: pa.Array, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to longest, (row, key) of all runs of so many neighbouring words in each list of word hashes, in order."""
    hashes, counts = words.flatten().to_numpy().view(np.uint64), words.value_lengths().fill_null(0).to_numpy()
    rows, keys, out = np.repeat(np.arange(len(counts)), counts), hashes, []
    for n in range(1, longest + 1):
        if n > 1:
            keys = keys[:-1] * MIX + hashes[n - 1 :]
        whole = rows[: len(keys)] == rows[n - 1 :]
        out.append((rows[: len(keys)][whole], keys[whole].view(np.int64)))
    return out


def _anchor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, anchors = batch.column(1).value_lengths().to_numpy(), np.zeros(len(batch), np.int64)
        for n, (rows, keys) in enumerate(_runs(batch.column(1), ANCHOR), 1):
            last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
            mine = last & ((counts[rows] == n) | (n == ANCHOR))
            anchors[rows[mine]] = keys[mine]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(anchors)], ["value", "anchor"])


def anchored(secrets: DataFrame) -> DataFrame:
    """(value, anchor) of secrets(value): the key of its last words, ANCHOR at most.

    No word character goes on at the ends of an occurrence, so a text that holds the secret has these words whole and side by
    side. One word alone, such as the longest of a phrase, would be met by most texts.
    """
    return secrets.select("value", word_hashes(F.col("value")).alias("words")).mapInArrow(_anchor_task, "value string, anchor bigint")


def _literal_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, kinds, values = [], [], []
        for k, line in enumerate(batch.column(3).to_pylist()):
            for kind, value in literals(line):
                keys.append(k)
                kinds.append(kind)
                values.append(value)
        taken = batch.take(pa.array(keys, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["source_table", "row_id", "whole", "kind", "value"])


def indexed_literals(df: DataFrame) -> DataFrame:
    """(source_table, row_id, whole, kind, value) for df(source_table, row_id, text, whole)."""
    lines = df.select("source_table", "row_id", "whole", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(PLACE_LINE) | F.col("line").rlike(LONG_LINE)).mapInArrow(_literal_task, "source_table string, row_id bigint, whole bigint, kind string, value string")


def owners(df: DataFrame) -> DataFrame:
    """(whole, owner): files of equal content have the same owner. The content is that of a text without a piece number, or else of all pieces."""
    sums = df.select("whole", F.xxhash64("text").alias("_sum"), F.col("piece").isNull().alias("_entire"))
    per = sums.groupBy("whole").agg(F.max(F.when(F.col("_entire"), F.col("_sum"))).alias("_one"), F.sort_array(F.collect_set(F.when(~F.col("_entire"), F.col("_sum")))).alias("_all"))
    return per.select("whole", F.coalesce("_one", F.xxhash64("_all")).alias("owner"))


def counted_values(index: DataFrame, owner: DataFrame) -> DataFrame:
    """(value, owners, sure) of the indexed values."""
    held = index.groupBy("value", "whole").agg(F.max(F.col("kind").isin(*SURE)).alias("sure"))
    per_owner = held.join(owner, "whole").groupBy("value", "owner").agg(F.max("sure").alias("sure"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.max("sure").alias("sure"))


def confirmed(counted: DataFrame, n_owners: int) -> DataFrame:
    """(value): issued formats, key markers and random values, and other structured values that few owners share."""
    return counted.where(F.col("sure") | (F.col("owners") <= max(MAX_OWNERS, MAX_SHARE * n_owners))).select("value")


def suppressed(df: DataFrame) -> DataFrame:
    """(value, owners) of the values in credential places that so many owners share that they are taken for placeholders."""
    df = _with_wholes(df)
    owner = cut(owners(df))
    limit = max(MAX_OWNERS, MAX_SHARE * owner.select("owner").distinct().count())
    return counted_values(indexed_literals(df), owner).where(~F.col("sure") & (F.col("owners") > limit)).select("value", "owners")


def _automaton(secrets: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for s in secrets:
        automaton.add_word(s, len(s))
    automaton.make_automaton()
    return automaton


def _found_task(texts: pa.RecordBatch, automaton: ahocorasick.Automaton) -> pa.RecordBatch:
    taken, values = [], []
    for k, text in enumerate(texts.column(2).to_pylist()):
        for value in {text[a:b] for a, b in free_spans(text, automaton)}:
            taken.append(k)
            values.append(value)
    rows = texts.take(pa.array(taken, pa.int64()))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(values, pa.string())], ["source_table", "row_id", "value"])


def free_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of the automaton's secrets in text, longest first where they overlap, only where no word character goes on at either end."""
    word = lambda c: c == "_" or c.isascii() and c.isalnum()
    free = []
    for end, n in automaton.iter(text) if len(automaton) else ():
        a, b = end + 1 - n, end + 1
        if not (a and word(text[a - 1]) and word(text[a])) and not (b < len(text) and word(text[b]) and word(text[b - 1])):
            free.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(free, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def occurrences(text: str, secrets: list[str]) -> list[tuple[int, int]]:
    return free_spans(text, _automaton(secrets))


FOUND = "source_table string, row_id bigint, value string"


def _scan_all(df: DataFrame, secrets: list[str]) -> DataFrame:
    """Every text by one automaton over the given secrets."""
    sent = df.sparkSession.sparkContext.broadcast(secrets)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in batches:
            yield _found_task(batch, automaton)

    return df.select("source_table", "row_id", "text").mapInArrow(task, FOUND)


def _marked(anchors: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits in which each of anchors(anchor) has two; at most MARKS / 64 numbers pass the driver."""
    bits = anchors.select(F.explode(F.array(F.col("anchor").bitwiseAND(MARKS - 1), F.shiftrightunsigned("anchor", 32).bitwiseAND(MARKS - 1))).alias("_bit"))
    words = bits.groupBy(F.shiftright("_bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return marks.view(np.uint64)


def _scan_held(df: DataFrame, secrets: DataFrame) -> DataFrame:
    """Every text that holds the last words of a secret, by an automaton over the secrets of its batch."""
    known = cut(anchored(secrets))
    sent = df.sparkSession.sparkContext.broadcast(_marked(known))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        has = lambda at: marks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        for batch in _by_words(batches, 3):
            met = []
            for rows, keys in _runs(batch.column(3), ANCHOR):
                k = keys.view(np.uint64)
                hit = (has(k & np.uint64(MARKS - 1)) & has(k >> np.uint64(32) & np.uint64(MARKS - 1))).astype(bool)
                met.append(np.stack([rows[hit], keys[hit]]))
            pairs = np.unique(np.concatenate(met, axis=1), axis=1)
            texts, counts = np.unique(pairs[0], return_counts=True)
            kept = batch.take(pa.array(texts))
            anchors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(pairs[1]))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), anchors], ["source_table", "row_id", "text", "anchors"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if values := {v for held in batch.column(3).to_pylist() for v in held}:
                yield _found_task(batch, _automaton(sorted(values)))

    # only texts and words that the bitmap lets through are written and shuffled; a wrong meeting only scans for one secret more
    words = df.select("source_table", "row_id", "text", word_hashes(F.col("text")).alias("words"))
    maybe = cut(words.mapInArrow(marked, "source_table string, row_id bigint, text string, anchors array<bigint>"))
    pairs = maybe.select("source_table", "row_id", F.explode("anchors").alias("anchor")).join(known, "anchor")
    per_text = cut(pairs.groupBy("source_table", "row_id").agg(F.collect_set("value").alias("secrets")))
    return maybe.join(_small_lists(per_text), ["source_table", "row_id"]).select("source_table", "row_id", "text", "secrets").mapInArrow(task, FOUND)


def _small_lists(df: DataFrame) -> DataFrame:
    return small(df, F.octet_length(F.array_join("secrets", "")) + 32 * F.size("secrets") + 64)


#: Secrets whose last words have fewer characters than this would meet most texts by them: they are scanned for in every text, AUTOMATON characters of them at a time.
SHORT = 4


def _is_short(value: Column) -> Column:
    words = F.regexp_extract_all(value, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    return F.length(F.array_join(F.slice(words, F.greatest(F.size(words) - ANCHOR + 1, F.lit(1)), ANCHOR), "")) < SHORT


def _with_wholes(df: DataFrame) -> DataFrame:
    """df with whole and piece: a text without them, or with null, is a file of its own."""
    if "whole" not in df.columns:
        df = df.withColumns({"whole": F.lit(None).cast("bigint"), "piece": F.lit(None).cast("int")})
    return df.select("source_table", "row_id", "text", F.coalesce("whole", F.xxhash64("source_table", "row_id")).alias("whole"), "piece").where(F.length("text") > 0)


def found_secrets(df: DataFrame) -> DataFrame:
    """(source_table, row_id, value): the distinct secrets of each text of df(source_table, row_id, text).

    Where df has the columns whole and piece, rows of one whole are one file: its text (piece null) and its chunks. A private key
    is told by its opening marker. Null and empty texts give no rows; repeated rows count once.
    """
    df = _with_wholes(df)
    index = cut(indexed_literals(df))
    owner = owners(df)
    n_owners = owner.agg(F.approx_count_distinct("owner")).first()[0]
    secrets = cut(confirmed(counted_values(index, owner), n_owners))
    placed = index.join(small(secrets, F.octet_length("value") + 32), "value", "left_semi").select("source_table", "row_id", "value")
    # markers are found in their place or not at all
    loose = secrets.where(~F.col("value").startswith("-----"))
    if loose.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0] <= AUTOMATON:
        again = _scan_all(df, [r.value for r in loose.collect()])
    else:
        short = loose.where(_is_short(F.col("value")))
        blocks = -(-short.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0] // AUTOMATON)
        again = _scan_held(df, loose.where(~_is_short(F.col("value"))))
        for b in range(blocks):
            again = again.unionByName(_scan_all(df, [r.value for r in short.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == b).collect()]))
    return placed.unionByName(again).distinct()


_BEGIN, _END = (re.compile(rf"-----{word} (?:[A-Z0-9]+ )*PRIVATE KEY-----") for word in ("BEGIN", "END"))
#: Line ends of a key's body: of the text, or written as escapes in a literal.
_BREAK = re.compile(r"\r\n?|\n|(?:\\r)?\\n|\\r")
_BASE64 = re.compile(r"[+/=]*[A-Za-z0-9][A-Za-z0-9+/=]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADER = re.compile(r"\W*[A-Z][A-Za-z]*-[A-Z]\w*: ")
#: Widths of the lines of encoded keys, also behind the sign of an added line; a run of LONG characters or more of both cases is part of a key anyway.
_WIDTHS, LONG = (64, 65, 70, 71, 76, 77), 32


def _body_lines(text: str, a: int, b: int) -> list[tuple[list[tuple[int, int]], bool, bool]]:
    """(base64 runs, whether a run stands alone, whether the line says nothing of the body's end) of the lines of text[a:b]."""
    bounds, at = [], a
    for m in _BREAK.finditer(text, a, b):
        bounds.append((at, m.start()))
        at = m.end()
    out = []
    for x, y in [*bounds, (at, b)]:
        runs = [m.span() for m in _BASE64.finditer(text, x, y)]
        alone = len(runs) == 1 and not any(c.isalnum() for c in text[x : runs[0][0]] + text[runs[0][1] : y])
        out.append((runs, alone, not any(c.isalnum() for c in text[x:y]) or bool(_HEADER.match(text, x, y))))
    return out


def _wordish(run: str) -> bool:
    return len(run) < LONG and bool(_WORD.fullmatch(run))


def _closed_body(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the body between both markers: all runs but words in lines that hold other text, and short lines that go on from the body or end it."""
    lines, out, before = _body_lines(text, a, b), [], False
    last = max((k for k, line in enumerate(lines) if line[0]), default=-1)
    for k, (runs, alone, _) in enumerate(lines):
        taken = [(x, y) for x, y in runs if y - x >= 8 and (alone or not _wordish(text[x:y]))]
        if not taken and alone and (before or out and k == last):
            # padded to a multiple of four characters; a word by itself may be one that an editor put in
            taken = [(x, y) for x, y in runs if text[y - 1] == "=" or not _wordish(text[x:y]) or k == last and (y - x) % 4 == 0]
        before = bool(taken) or before and not runs
        out += taken
    return out


def _open_body(text: str, a: int, b: int, back: bool) -> list[tuple[int, int]]:
    """Spans of the body next to a marker without its counterpart, which text[a:b] follows, or precedes if back.

    Lines that touch the marker or the body are part of it if they hold a long run or nothing but a run that is no word. Behind
    lines of other text only runs as wide as the body's lines are.
    """
    lines, out, width, near = _body_lines(text, a, b), [], 0, True
    for runs, alone, silent in reversed(lines) if back else lines:
        taken = []
        for x, y in runs:
            run, n = text[x:y], y - x
            if n >= LONG and re.search("[a-z]", run) and re.search("[A-Z]", run):
                if near or (n == width if width else n in _WIDTHS):
                    taken.append((x, y))
            elif near and alone and (n >= 8 or width or back) and (run.endswith("=") or not _wordish(run)):
                taken.append((x, y))
        width = max([width, *(y - x for x, y in taken)])
        near = bool(taken) or near and silent
        out += taken
    return out


def key_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the encoded bodies of the private keys in text; either marker may be missing."""
    if "PRIVATE KEY-----" not in text:
        return []
    marks = sorted([(m.start(), m.end(), True) for m in _BEGIN.finditer(text)] + [(m.start(), m.end(), False) for m in _END.finditer(text)])
    out, at, opened = [], 0, False
    for a, b, begins in [*marks, (len(text), len(text), True)]:
        if opened and not begins:
            out += _closed_body(text, at, a)
        elif opened:
            out += _open_body(text, at, a, False)
        elif not begins:
            out += _open_body(text, at, a, True)
        at, opened = b, begins
    return sorted(out)


def _whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, ids, keys = [], [], []
        for source, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, starts, parts = 0, {}, []
            for p in pieces:
                # a piece delivered twice stands once in the whole text
                if (p["piece"], p["text"]) not in starts:
                    starts[p["piece"], p["text"]] = at
                    parts.append(p["text"])
                    at += len(p["text"])
            spans = key_spans("".join(parts))
            for p in pieces:
                start = starts[p["piece"], p["text"]]
                end = start + len(p["text"])
                if mine := [[max(a, start) - start, min(b, end) - start] for a, b in spans if a < end and b > start]:
                    sources.append(source)
                    ids.append(p["row_id"])
                    keys.append(mine)
        yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.list_(pa.int32())))], ["source_table", "row_id", "keys"])


def _keys_of_pieces(df: DataFrame) -> DataFrame:
    """(source_table, row_id, keys): the key bodies of each piece, found in the whole texts of which any piece holds one side of a marker's cut."""
    pieces = df.where("whole is not null and piece is not null").select("source_table", "whole", "piece", "row_id", "text")
    marked = cut(pieces.where(F.col("text").contains("-----BEGIN") | F.col("text").contains("PRIVATE KEY-----") | F.col("text").contains("-----END")).select("source_table", "whole").distinct())
    of_marked = pieces.join(small(marked), ["source_table", "whole"], "left_semi").distinct()
    wholes = of_marked.groupBy("source_table", "whole").agg(F.sort_array(F.collect_list(F.struct("piece", "row_id", "text"))).alias("pieces")).select("source_table", "pieces")
    return wholes.mapInArrow(_whole_task, "source_table string, row_id bigint, keys array<array<int>>")


def _mask_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, secrets, keys = (batch.column(k).to_pylist() for k in (2, 3, 4))
        out = [t if t is None else redact(t, s or [], k or []) for t, s, k in zip(texts, secrets, keys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["source_table", "row_id", "text"])


def redact(text: str, secrets: list[str], keys: list[list[int]] = ()) -> str:
    """text with every occurrence of the secrets masked; of private keys the body goes and line ends, markers and comment signs stay.

    keys are spans of key bodies that are known from the text around this one.
    """
    plain = [s for s in secrets if not s.startswith("-----")]
    spans = key_spans(text) + [(a, b) for a, b in keys] + (occurrences(text, plain) if plain else [])
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame) -> DataFrame:
    """df(source_table, row_id, text) with the secrets of each text masked; texts without secrets, nulls and repeated rows stay as they are.

    Where df has the columns whole and piece, texts of one whole (null: a text of its own) are its pieces in order of piece, and
    private keys are found in the pieces put together.
    """
    per_text = cut(found_secrets(df).groupBy("source_table", "row_id").agg(F.collect_list("value").alias("secrets")))
    out = df.join(_small_lists(per_text), ["source_table", "row_id"], "left")
    if "whole" in df.columns:
        keys = cut(_keys_of_pieces(df).groupBy("source_table", "row_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")))
        out = out.join(small(keys, 24 * F.size("keys") + 64), ["source_table", "row_id"], "left")
    else:
        out = out.withColumn("keys", F.lit(None).cast("array<array<int>>"))
    return out.select("source_table", "row_id", "text", "secrets", "keys").mapInArrow(_mask_task, "source_table string, row_id bigint, text string")
