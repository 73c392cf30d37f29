"""Lines decoded with the wrong encoding: find them and restore the original text.

Method: round-trip repair. The text is re-encoded under a candidate legacy encoding and strictly decoded as the
intended encoding; a repair is accepted when a garbling cost drops, and the step repeats for nested layers.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of scripts that seldom stand alone: two proper signs in a row may happen to decode to a single one of them.
_SCRIPT = re.compile(r"[\u0180-\u0191\u0193-\u02af\u0460-\u10ff]")
_SPLIT = re.compile(r"[^\x00-\x7f]+")


def _single_byte(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes that it leaves undefined stand for themselves (the usual lenient decoding)."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        table.setdefault(chr(b), b) if codec in ("cp1252", "latin-1") else None
    return table


TABLES = {c: _single_byte(c) for c in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "iso8859_15")}
#: Wrong encoding, intended encoding. One-byte pages first; the order decides between repairs of equal cost.
ROUTES = tuple((c, "utf-8") for c in TABLES) + (("cp949", "utf-8"), ("cp1252", "cp949"), ("mac_roman", "cp949"), ("shift_jis", "utf-8"), ("gbk", "utf-8"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"))


def encode(text: str, codec: str) -> bytes | None:
    """Bytes of text under a legacy encoding, or None where one character has none."""
    if (table := TABLES.get(codec)) is None:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for ch in text:
        if ch < "\x80":
            out.append(ord(ch))
        elif (b := table.get(ch)) is None:
            return None
        else:
            out.append(b)
    return bytes(out)


_ODD = re.compile(
    r"(?P<lost>�)|(?P<control>[\x80-\x9f-])|(?P<lead>\xe2[€\x80‚]|[\xc3\xc2][\xa0-\xbfŒ-ƒˆ-˜–-™]|[\xea-\xed][\xa0-\xbf‘-™Œ-ƒ])"
    r"|(?P<glued>(?<=[a-z\xdf-\xff])[가-힣]|[가-힣](?=[a-z])|[㐀-䶿豈-﫿])"
    r"|(?P<han>[一-鿿])|(?P<pair>(?![äöüÄÖÜ]ß)[\xc0-\xffŒœŸŠšŽžƒ](?=[\xc0-\xffŒœŸŠšŽžƒ\xa1-\xbf]))"
    r"|(?P<upper>(?<=[a-z\xdf-\xff])[\xc0-\xd6\xd8-\xdeŸŠŽ])|(?P<mid>(?<=[^\W\d_])[\xa0-\xbfˆ˜†-•…‰‹›€™‚„“”](?=[^\W\d_]|[\x80-\xbf]))"
    r"|(?P<mark>[\xa1\xa2\xa4\xa6-\xaf\xb8\xbfƒˆ˜†‡‰‹›™∂∆∏∑√∞∫≈≠≤≥◊Ωπı˘-˝ﬁﬂ⁄─-⯿\xb5])"
    r"|(?P<jamo>[ᄀ-ᇿㄱ-ㆎ])|(?P<rare>[ƀ-ƑƓ-˅ˇ-˗Ͱ-ΨΪ-ορ-ԯ԰-ჿሀ-᷿])|(?P<ext>[Ā-İĲ-őŔ-şŢ-ŷŹ-ż])"
)
_WEIGHT = {"lost": 2.0, "control": 3.0, "lead": 2.0, "glued": 3.0, "han": 1.0, "pair": 1.0, "upper": 1.0, "mid": 1.0, "mark": 1.0, "jamo": 1.0, "rare": 0.9, "ext": 0.9}


def cost(text: str) -> float:
    """Garbling cost: weighted count of characters that ordinary text seldom has where they stand."""
    return sum(_WEIGHT[m.lastgroup] for m in _ODD.finditer(text))


def lone_letters(text: str) -> set[str]:
    """Letters of a script of which text has no other."""
    found = _SCRIPT.findall(text)
    scripts = Counter(ord(c) >> 8 for c in found)
    return {c for c in found if scripts[ord(c) >> 8] < 2}


def decoded(garbled: str, wrong: str, intended: str) -> str | None:
    """What the characters were before they were decoded wrongly, None where a byte has no meaning or the result wouldn't be garbled like this again."""
    raw = encode(garbled, wrong)
    if raw is None or raw.isascii():
        return None
    try:
        got = raw.decode(intended)
        return got if got.encode(intended) == raw else None
    except UnicodeError:
        return None


def _by_run(text: str, wrong: str, intended: str) -> str:
    """text with each non-ASCII run round-tripped by itself; a run that doesn't survive the strict decoding stays, so lines garbled in part are repaired in part."""
    got = [decoded(run, wrong, intended) or run for run in _SPLIT.findall(text)]
    lone = lone_letters("".join(got)) if got else ()
    parts = iter(got)

    def one(m: re.Match) -> str:
        part = next(parts)
        return m.group() if lone and not lone.isdisjoint(part) else part

    return _SPLIT.sub(one, text)


_WORD_SPLIT = re.compile(r"[^\s!-/:-@\[-`{-~]*[^\x00-\x7f][^\s!-/:-@\[-`{-~]*")
_WESTERN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xde]?[a-z\xdf-\xf6\xf8-\xff\u0153\d'’-]*")


def _by_word(text: str, wrong: str, intended: str) -> str:
    """Like _by_run for intended one-byte encodings, under which nearly all bytes have a meaning: the unit is a word, and the result must be one of small Western letters behind the first.

    Only if a word of three letters or more, half of them at least plain ones, becomes an ordinary one is any word of the line changed.
    """
    words = {w: got for w in set(_WORD_SPLIT.findall(text)) if (got := decoded(w, wrong, intended)) and _WESTERN.fullmatch(got)}
    sure = any(len(got) > 2 and 2 * sum(c.isascii() and c.isalpha() for c in w) >= len(w) and cost(got) < cost(w) for w, got in words.items())
    return _WORD_SPLIT.sub(lambda m: words.get(m.group(), m.group()), text) if sure else text


_HANGUL_SPLIT = re.compile(r"[^\u1100-\u11ff\u3130-\u318f\uac00-\ud7a3\ufffd]+")


def _by_stretch(text: str, wrong: str, intended: str) -> str:
    """Like _by_run for intended encodings whose second bytes may be ASCII letters: the unit is a stretch without Hangul, ASCII included."""

    def one(m: re.Match) -> str:
        if (got := decoded(m.group(), wrong, intended)) is None:
            return m.group()
        high = [c for c in got if c > "\x7f"]
        return got if len(high) > 1 and sum("\uac00" <= c <= "\ud7a3" for c in high) >= 0.9 * len(high) else m.group()

    return _HANGUL_SPLIT.sub(one, text)


def unwrap(text: str) -> tuple[str, int]:
    """The text after all layers whose removal lowers the cost, and their number."""
    layers, now = 0, cost(text)
    while now:
        best, at = text, now
        for wrong, intended in ROUTES:
            got = (_by_run if intended == "utf-8" else _by_stretch if intended == "cp949" else _by_word)(text, wrong, intended)
            if got != text and (c := cost(got)) < at:
                best, at = got, c
        if best == text:
            break
        text, now, layers = best, at, layers + 1
    return text, layers


#: What only wrong decoding leaves behind: controls, private use, a lead byte's letter before a trail byte's sign.
_LEFT = re.compile(r"[\x80-\x9f-]|[\xc3\xc2][\xa0-\xbf]|\xe2€|[\xea-\xed][\xa0-\xbf‚-™Œœ]")


def restore(line: str) -> str | None:
    """The original of a garbled line, '' if characters of it are lost, None for a proper line."""
    got, layers = unwrap(line)
    if "\ufffd" in got:
        return ""
    if not layers:
        return None
    return "" if _LEFT.search(got) or lone_letters(got) - lone_letters(line) else got


#: A line without one of these costs nothing, so there is nothing to repair: a foreign character that isn't Hangul, a dash or an apostrophe, or Hangul glued to a small Latin letter.
SUSPECT = r"[^\x00-\x7f\x{ac00}-\x{d7a3}\x{2013}\x{2014}\x{2018}\x{2019}]|[a-z\xdf-\xff][\x{ac00}-\x{d7a3}]|[\x{ac00}-\x{d7a3}][a-z]"


@F.pandas_udf(T.StringType())
def _restore(lines: pd.Series) -> pd.Series:
    return lines.map(restore, na_action="ignore")


def restored_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row (keys, line_no, garbled_text, restored_text) per garbled line of df[text].

    line_no counts from 1, lines end at '\n' only. restored_text is the whole original line, '' where characters of it are
    lost. Null and empty texts, proper lines and lines of plain ASCII give no row; rows with the same keys and text give the
    same rows again (callers that want a set apply distinct). Other columns of df, whatever their names, play no part.
    Lines are cut and sieved in the JVM, so that only suspicious ones reach Python.
    """
    lines = df.select(F.struct(*keys).alias("_keys"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_no", "_line")).where(F.col("_line").rlike(SUSPECT))
    out = lines.select("_keys.*", (F.col("_no") + 1).cast("int").alias("line_no"), F.col("_line").alias("garbled_text"), _restore("_line").alias("restored_text"))
    return out.where(F.col("restored_text").isNotNull())


def repair_text(df: DataFrame, text: str) -> DataFrame:
    """df with df[text] repaired line by line; lost lines, proper lines, nulls and all other columns stay as they are."""
    return df.withColumn(text, _repair(F.col(text)))


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else "\n".join(restore(x) or x for x in t.split("\n")), na_action="ignore")
