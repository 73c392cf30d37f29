"""Long stretches of text that stand verbatim in more than one document.

Method: relative Lempel-Ziv parsing. Reference blocks are cut out of all documents where the text itself says so: every window of
`length` characters belongs to the least hash of the grams in it, and windows in a row with the same one make a block. Equal
windows therefore lie in blocks of the same gram, so a document is factored against the blocks of its own grams and against no
others. These are indexed together by a suffix array; each block is factored greedily against those of other documents, at every
step by the longest stretch that one of them holds. Factors of `length` characters or more are shared stretches, and two factors
in a row that reach it together are checked at their boundary, where a shared stretch may lie across. Stretches are compared
character for character.

A gram that more blocks hold than HOT is too much for one task: its blocks are cut again by longer grams, at last by the whole
window. There all blocks of one value are the same window, told by two 64-bit hashes, and need no factoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.words import mix
from siltstone.session import cut, small

#: Blocks of one gram that are indexed together at most.
HOT = 1_000
#: Characters that a task hashes, or indexes, at a time.
SLICE, INDEXED = 1 << 20, 1 << 19
#: A longer text is cut in overlapping pieces.
LONGEST = 1 << 21
_BASES = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1)
_powers: dict[int, np.ndarray] = {}


def grams(length: int) -> tuple[int, int, int]:
    """Characters of the grams by which blocks are cut, and cut again where they are held too often."""
    return max(1, length // 3), max(1, 3 * length // 4), length


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when too short."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def stretch_hashes(codes: np.ndarray, length: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A hash of every stretch of `length` codes, by start: differences of running sums, brought to a common power of the base."""
    h = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + base) * _power(base, len(codes)), out=h[1:])
    back = np.uint64(pow(int(base), -1, 1 << 64))
    return mix((h[length:] - h[:-length]) * _power(back, len(h))[: len(h) - length])


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _cuts(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, gram's hash, second hash, first window, last window) of the blocks of all texts, each of at most length - gram + 1 windows.

    Windows that go on with the same least gram for longer, as in rulers and padding, are cut into blocks of that size: the
    number of blocks is bounded by the text's length whatever stands in it. The second hash matters where the gram is a window.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = _codes(texts)
    none = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(codes) < length:
        return none
    width = length - gram + 1
    hashes = stretch_hashes(codes, gram)
    value = _least(hashes, width) if width > 1 else hashes
    window = np.arange(len(value))
    text = np.searchsorted(start, window, "right") - 1
    whole = window + length <= start[text] + sizes[text]  # the others run into the next text
    value, window, text = value[whole], window[whole], text[whole]
    if not len(value):
        return none
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    new |= (window - window[np.flatnonzero(new)][np.cumsum(new) - 1]) % width == 0
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(value)]]) - 1
    t = text[first]
    second = stretch_hashes(codes, gram, _BASES[1])[window[first]] if width == 1 else np.zeros(len(first), np.uint64)
    return t, value[first], second, window[first] - start[t], window[last] - start[t]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters; a longer text is a run by itself."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin = k
            total = 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _cut_task(length: int, gram: int):
    """(doc_id, cut, check, first, last) of rows (doc_id, shift, text), shift being the text's place in its document."""
    names = ["doc_id", "cut", "check", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, shift = [], [], []
            for i, at, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for s in range(0, max(1, len(t) - length + 1), LONGEST):
                    ids.append(i)
                    texts.append(t[s : s + LONGEST + length - 1])
                    shift.append(at + s)
            ids, shift = np.array(ids, np.int64), np.array(shift, np.int64)
            for a, b in _slices([len(t) for t in texts], SLICE):
                text, cuts, check, first, last = _cuts(texts[a:b], length, gram)
                s = shift[a:b][text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a:b][text], cuts.view(np.int64), check.view(np.int64), first + s, last + s)], names)

    return run


BLOCKS = "cut bigint, doc_id bigint, firsts array<bigint>, block string, hot boolean"


def _block_task(length: int):
    """The blocks of each document, as much text as their windows cover; a block that a document repeats is one row with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, cuts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                places: dict[tuple, list[int]] = {}
                for c in cuts:
                    places.setdefault((c["cut"], t[c["first"] : c["last"] + length], c["hot"]), []).append(c["first"])
                key, block, hot = zip(*places) if places else ((), (), ())
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((key, [i] * len(key), list(places.values()), block, hot), types)], ["cut", "doc_id", "firsts", "block", "hot"])

    return run


class Reference:
    """The indexed blocks of some grams: a suffix array of all of them, in which stretches of different grams differ.

    Suffixes are sorted by 2, 4, 8 ... characters; a group of suffixes with equal beginnings is sorted further as long as
    several documents are in it. The ranks of every step are kept, so the common beginning of two suffixes is found in a few steps.
    """

    def __init__(self, group: np.ndarray, owner: np.ndarray, blocks: list[str], longest: int):
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.end = self.start + sizes
        n = int(sizes.sum())
        self.block = np.repeat(np.arange(len(blocks)), sizes)
        self.text = _codes(blocks)
        owner = owner[self.block]
        left = self.end[self.block] - np.arange(n)
        codes = self.text.astype(np.uint64) + np.uint64(1)
        # what lies behind a block's end is zero: nothing goes on into the next block
        key = group[self.block].astype(np.uint64) << np.uint64(42) | codes << np.uint64(21)
        key[:-1] |= np.where(left[:-1] > 1, codes[1:], np.uint64(0))
        order, open_at, rank = np.empty(n, np.int64), np.arange(n), np.zeros(n, np.int64)
        these = np.arange(n)
        self.levels: list[tuple[int, np.ndarray]] = []
        length = 1
        while True:
            by_key = np.argsort(key)
            these, key = these[by_key], key[by_key]
            order[open_at] = these
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([new, [len(key)]]))
            # a suffix's rank is the place of its group's first, from 1
            rank[these] = np.repeat(open_at[new], size) + 1
            length *= 2
            self.levels.append((length, rank.astype(np.uint32)))
            of = owner[these]
            several = np.repeat(np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new), size)
            these, open_at = these[several], open_at[several]
            if length >= longest or not len(these):
                break
            far = np.where(left[these] > length, rank[np.minimum(these + length, n - 1)], 0)
            key = rank[these].astype(np.uint64) << np.uint64(32) | far.astype(np.uint64)
        self.order = order
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        # the nearest suffixes on both sides that are another document's
        of = owner[order]
        edge = np.concatenate([[True], of[1:] != of[:-1]])
        at = np.arange(n)
        self.before = np.maximum.accumulate(np.where(edge, at, 0)) - 1
        last = np.concatenate([edge[1:], [True]])
        self.after = np.minimum.accumulate(np.where(last, at, n)[::-1])[::-1] + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters that the suffixes at a and b, of different documents, have in common up to the ends of their blocks; a single one may be of another gram's block."""
        room = np.minimum(self.end[self.block[a]] - a, self.end[self.block[b]] - b)
        got = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.levels):
            # a rank tells `length` characters only where so many are left; no block has twice as many as the last level
            go = np.flatnonzero(got + length <= room)
            got[go[rank[a[go] + got[go]] == rank[b[go] + got[go]]]] += length
        go = np.flatnonzero(got < room)
        got[go[self.text[a[go] + got[go]] == self.text[b[go] + got[go]]]] += 1
        return got

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest stretch from each place that a block of another document holds."""
        p = self.place[at]
        out = np.zeros(len(at), np.int64)
        for side, ok in ((self.before[p], self.before[p] >= 0), (self.after[p], self.after[p] < len(self.order))):
            k = np.flatnonzero(ok)
            out[k] = np.maximum(out[k], self.common(at[k], self.order[side[k]]))
        return out


def _factored(reference: Reference, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shared stretches of all blocks: each is parsed from its start by the longest factors, all of them a step at a time."""
    at, end = reference.start.copy(), reference.end
    before_at, before_n = at.copy(), np.zeros(len(at), np.int64)
    starts, ends, bounds = [], [], []
    live = np.arange(len(at))
    while len(live):
        n = reference.longest(at[live])
        long = n >= length
        starts.append(at[live][long])
        ends.append((at[live] + n)[long])
        # a shared stretch across the boundary takes up the end of one factor and the beginning of the next
        joined = before_n[live] + n >= length
        bounds.append((before_at[live][joined], at[live][joined], n[joined]))
        before_at[live], before_n[live] = at[live], np.maximum(n, 1)
        at[live] += np.maximum(n, 1)
        live = live[at[live] < end[live]]
    left, bound, n = (np.concatenate(c) for c in zip(*bounds))
    low, high = np.maximum(left + 1, bound - length + 1), np.minimum(bound - 1, bound + n - length)
    count = np.maximum(high - low + 1, 0)
    tried = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    n = reference.longest(tried)
    across = n >= length
    return np.concatenate([*starts, tried[across]]), np.concatenate([*ends, (tried + n)[across]])


def _parse(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of blocks, of which all with the same gram are present."""
    key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    blocks = rows.column(3).to_pylist()
    reference = Reference(np.unique(key, return_inverse=True)[1], np.unique(doc, return_inverse=True)[1], blocks, length)
    start, end = _factored(reference, length)
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    block = reference.block[start]
    # stretches of one block that overlap or touch are one; block numbers keep those of different blocks apart
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.concatenate([[True], (start[1:] > reach[:-1]) | (block[1:] != block[:-1])]) if len(start) else np.empty(0, bool)
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(start)]]) - 1 if len(a) else a
    block, begin, stop = block[a], start[a] - reference.start[block[a]], reach[b] - reference.start[block[a]]
    firsts = rows.column(2).combine_chunks()
    count = firsts.value_lengths().to_numpy()[block]
    row = np.repeat(np.arange(len(block)), count)
    offset = firsts.offsets.to_numpy()[block] - firsts.offsets.to_numpy()[0]
    place = firsts.flatten().to_numpy()[np.repeat(offset - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else offset, count) + np.arange(int(count.sum()))]
    return pa.RecordBatch.from_arrays([pa.array(doc[block[row]]), pa.array(place + begin[row]), pa.array(place + stop[row])], ["doc_id", "span_start", "span_end"])


def _parse_task(length: int):
    """Over rows sorted by gram: parses about INDEXED characters at a time, the last gram's rows kept back until all of them are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                cuts = part.column(0).to_numpy()
                if held and chars >= INDEXED:
                    split = int(np.argmax(cuts != held[-1].column(0)[-1].as_py())) if (cuts != held[-1].column(0)[-1].as_py()).any() else len(cuts)
                    if split < len(cuts):
                        yield _parse(pa.Table.from_batches([*held, part.slice(0, split)]), length)
                        held, chars, part = [], 0, part.slice(split)
                held.append(part)
                chars += part.column(3).nbytes
        if held:
            yield _parse(pa.Table.from_batches(held), length)

    return run


def _of_several(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and hot of the grams that blocks of several documents hold; hot if there are too many to be indexed together."""
    held = cuts.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    return held.where("_a <> _b").select(*keys, (F.col("_n") > HOT).alias("hot"))


CUTS = "doc_id bigint, cut bigint, check bigint, first bigint, last bigint"
SPANS = "doc_id bigint, span_start bigint, span_end bigint"


def _blocks(texts: DataFrame, gone: DataFrame, gram: int, length: int) -> tuple[DataFrame, bool]:
    """The blocks of (doc_id, shift, text) whose gram several documents hold, without those of gone(doc_id), and whether any of these is hot."""
    # texts meet a table of their own once only, so that at most one shuffle moves them
    cuts = cut(texts.mapInArrow(_cut_task(length, gram), CUTS).join(small(gone), "doc_id", "left_anti"))
    wanted = cut(cuts.join(_of_several(cuts, ["cut"]), "cut").groupBy("doc_id").agg(F.collect_list(F.struct("cut", "first", "last", "hot")).alias("_cuts")))
    blocks = texts.join(small(wanted, F.size("_cuts") * 40 + 32), "doc_id").select("doc_id", "text", "_cuts").mapInArrow(_block_task(length), BLOCKS)
    return blocks, not wanted.where(F.exists("_cuts", lambda c: c["hot"])).isEmpty()


def _again(hot: DataFrame, gram: int, length: int) -> DataFrame:
    """(cut, doc_id, firsts, block, hot): the hot blocks cut again by a longer gram, with their text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, firsts, blocks = (batch.column(k).to_pylist() for k in range(3))
            for a, b in _slices([len(t) for t in blocks], SLICE):
                text, cuts, _, first, last = _cuts(blocks[a:b], length, gram)
                rows = [(docs[a + t], [f + int(x) for f in firsts[a + t]], blocks[a + t][x : y + length]) for t, x, y in zip(text, first, last)]
                d, f, t = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(cuts.view(np.int64)), pa.array(d, pa.int64()), pa.array(f, pa.list_(pa.int64())), pa.array(t, pa.string())], ["cut", "doc_id", "firsts", "block"])

    pieces = cut(hot.select("doc_id", "firsts", "block").mapInArrow(task, "cut bigint, doc_id bigint, firsts array<bigint>, block string"))
    return pieces.join(_of_several(pieces, ["cut"]), "cut").select("cut", "doc_id", "firsts", "block", "hot")


def _same_windows(hot: DataFrame, length: int) -> DataFrame:
    """Spans of blocks too frequent for any index: each of their windows by itself, summed up before and after the shuffle."""
    each = hot.select("doc_id", F.explode("firsts").alias("shift"), F.col("block").alias("text"))
    windows = cut(each.mapInArrow(_cut_task(length, length), CUTS))
    several = _of_several(windows, ["cut", "check"]).drop("hot")
    return windows.join(several, ["cut", "check"]).select("doc_id", F.col("first").alias("span_start"), (F.col("last") + length).alias("span_end"))


def shared_spans(df: DataFrame, key: str, text: str, length: int = 400) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of positions that lie in a stretch of `length` characters which stands verbatim in another document too.

    Positions count code points from 0, span_end is exclusive. Rows of one key are one document (its texts should be equal; a
    repetition within one document doesn't count). Null and shorter texts have no spans; documents equal as a whole share all of
    it. Exact copies are set aside first and only their least key is parsed, so a large group of copies costs no more than one.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("shift"), F.col(text).alias("text")).where(F.length("text") >= length)
    sums = docs.select("doc_id", F.length("text").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("sum"))
    groups = sums.groupBy("sum").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("_most")).where("kept <> _most").select("sum", "kept")
    copies = cut(sums.join(groups, "sum").select("doc_id", "n_chars", "kept").distinct())

    first, second, _ = grams(length)
    blocks, any_hot = _blocks(docs, copies.where("doc_id <> kept").select("doc_id"), first, length)
    parsed = lambda b: b.repartition("cut").sortWithinPartitions("cut").mapInArrow(_parse_task(length), SPANS)
    found = parsed(blocks.where("not hot"))
    if any_hot:
        again = cut(_again(blocks.where("hot"), second, length))
        found = found.unionByName(parsed(again.where("not hot")))
        if not (hot := again.where("hot")).isEmpty():
            found = found.unionByName(_same_windows(hot, length))

    partly = found.join(small(copies.select("doc_id").distinct()), "doc_id", "left_anti")
    by_start = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reached = F.max("span_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = partly.withColumn("_new", F.when(F.col("span_start") <= reached, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_start))
    merged = runs.groupBy("doc_id", "_run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_run")
    return merged.unionByName(copies.select("doc_id", F.lit(0).cast("bigint").alias("span_start"), F.col("n_chars").cast("bigint").alias("span_end")))


def shared_share(df: DataFrame, key: str, text: str, length: int = 400) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_ratio) of every document; null and empty texts count 0 characters and a ratio of 0."""
    spans = shared_spans(df, key, text, length).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("_shared"))
    sizes = df.groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("_shared", F.lit(0)).cast("bigint")
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_ratio"))
