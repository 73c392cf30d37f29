"""Evaluation passages that stand, whole or in part, in a training corpus.

Method: pigeonhole edit matching on words. A passage leaks where a stretch of `window` of its words stands in a document with
at most `max_edits` words edited. Passages are cut into pieces so short that every window holds max_edits + 1 of them whole; an
edit spoils one piece at most, so at least one is hit exactly. Each hit is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import run_hashes, words

#: Items, and characters of their passages, held by a task at a time; a larger test set is worked off in blocks of this size, each against all documents.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 1 << 24
#: Longest window, so that its positions are the bits of one number.
MOST_WINDOW = 63
#: Codes of the words of no passage, of the gap between documents and of the gap between passages.
OTHER, GAP, EDGE = 0, 1, 2


class Index:
    """The pieces of a block of passages, to be looked up by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int, max_edits: int):
        self.window, self.max_edits = window, max_edits
        self.piece = (window + 1) // (max_edits + 2)
        if self.piece < 1:
            raise ValueError("window too short for so many edits")
        if window > MOST_WINDOW:
            raise ValueError(f"windows may have {MOST_WINDOW} words at most")
        self.codes: dict[str, int] = {}
        ids, parts = [], []
        for item, passage in items:
            w = words(passage)
            if len(w) >= window:
                ids.append(item)
                parts.append(np.array([self.codes.setdefault(x, len(self.codes) + 3) for x in w], np.uint64))
        self.items = np.array(ids, np.int64)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        # passages one after another, with room on both sides so that windows never reach into a neighbour
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 2 * window)])[:-1].astype(np.int64) + window if parts else np.empty(0, np.int64)
        self.text = np.full(int(self.lengths.sum()) + 2 * window * len(parts) + window, EDGE, np.uint64)
        hashes, owner, at = [], [], []
        for k, p in enumerate(parts):
            self.text[self.starts[k] : self.starts[k] + len(p)] = p
            cut = np.arange(0, len(p) - self.piece + 1, self.piece)
            hashes.append(run_hashes(p, self.piece)[cut])
            owner.append(np.full(len(cut), k))
            at.append(cut)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.owner, self.at = (np.concatenate(x).astype(np.int64)[order] if hashes else np.empty(0, np.int64) for x in (owner, at))


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least number of edits that turn each row of pattern (at most 63 codes) into some stretch of the same row of text, for all rows at once."""
    rows, m = pattern.shape
    one, top = np.uint64(1), np.uint64(1 << (m - 1))
    plus, minus = np.full(rows, (1 << m) - 1, np.uint64), np.zeros(rows, np.uint64)
    score = np.full(rows, m, np.int64)
    best = score.copy()
    bits = (one << np.arange(m, dtype=np.uint64))[None, :]
    for j in range(text.shape[1]):
        eq = np.where(pattern == text[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0).astype(np.int64)
        ph, mh = ph << one, mh << one
        plus, minus = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best


def _verify(index: Index, text: np.ndarray, at: np.ndarray, owner: np.ndarray, piece_at: np.ndarray) -> np.ndarray:
    """Fewest edits of a window around each hit; more than max_edits where none is near enough."""
    w, e, p = index.window, index.max_edits, index.piece
    best = np.full(len(at), e + 1, np.int64)
    reach = np.arange(p - w, w)
    same = text[at[:, None] + reach] == index.text[(index.starts[owner] + piece_at)[:, None] + reach]
    # the longest run of equal words around the hit settles the windows without edits
    left = np.argmin(same[:, w - p - 1 :: -1], axis=1) if w > p else np.zeros(len(at), np.int64)
    left = np.where(same[:, : w - p].all(axis=1), w - p, left)
    right = np.argmin(same[:, w - p :], axis=1)
    right = np.where(same[:, w - p :].all(axis=1), w, right)
    best[left + right >= w] = 0
    rest = np.flatnonzero(best) if e else np.empty(0, np.int64)
    for back in range(w - p + 1):
        start = piece_at[rest] - back
        go = rest[(start >= 0) & (start + w <= index.lengths[owner[rest]]) & (best[rest] > 1)]
        if len(go):
            pattern = index.text[(index.starts[owner[go]] + piece_at[go] - back)[:, None] + np.arange(w)]
            near = text[(at[go] - back)[:, None] + np.arange(-e, w + e)]
            # every word of the window that isn't near costs an edit: most windows fall here
            maybe = _common(pattern, near) >= w - e
            go, pattern, near = go[maybe], pattern[maybe], near[maybe]
            if len(go):
                best[go] = np.minimum(best[go], myers(pattern, near))
    return best


def _common(pattern: np.ndarray, near: np.ndarray) -> np.ndarray:
    """How many codes of each row of pattern occur in the same row of near."""
    found = np.zeros(pattern.shape, bool)
    for j in range(near.shape[1]):
        found |= pattern == near[:, j : j + 1]
    return found.sum(axis=1)


def _task(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, pad = index.codes.get, index.window + index.max_edits
        for batch in batches:
            docs, gaps, parts, at = batch.column(0).to_numpy(zero_copy_only=False), [GAP] * pad, [GAP] * pad, []
            for text in batch.column(1).to_pylist():
                at.append(len(parts))
                parts.extend([code(x, OTHER) for x in words(text)])
                parts.extend(gaps)
            text = np.array(parts, np.uint64)
            h = run_hashes(text, index.piece)
            lo = np.searchsorted(index.hash, h, "left")
            hit = np.flatnonzero(index.hash[np.minimum(lo, len(index.hash) - 1)] == h) if len(index.hash) else np.empty(0, np.int64)
            count = np.searchsorted(index.hash, h[hit], "right") - lo[hit]
            reach = np.cumsum(count)
            out = []
            for k in range(0, int(count.sum()), 50_000):
                each = np.arange(k, min(k + 50_000, int(reach[-1])))
                h = np.searchsorted(reach, each, "right")
                a, i = hit[h], lo[hit[h]] + each - (reach[h] - count[h])
                edits = _verify(index, text, a, index.owner[i], index.at[i])
                ok = edits <= index.max_edits
                doc = docs[np.searchsorted(at, a[ok], "right") - 1]
                out.append(pd.DataFrame({"doc_id": doc, "item_id": index.items[index.owner[i][ok]], "edits": edits[ok]}))
            if out:
                found = pd.concat(out).groupby(["doc_id", "item_id"], as_index=False)["edits"].min()
                yield pa.RecordBatch.from_pandas(found.astype("int64"), preserve_index=False)

    return run


def leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, window: int = 13, max_edits: int = 1) -> DataFrame:
    """(doc_id, item_id, edits): documents holding `window` words in a row of an item's passage with at most max_edits words edited.

    edits is the least number over all such places, 0 for a verbatim run. Passages of fewer words than the window can't leak;
    null and empty passages and texts give no rows. Items that share a beginning are each reported. Repeated documents of one
    id count once. Test items are the stated query set: they are sent to the tasks in blocks of BLOCK_ITEMS, each block against
    all documents, so the size of what is sent is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    wanted = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(passage).alias("passage")).where(F.length("passage") > 0).distinct()
    rows, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    found = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(Index([(r.item_id, r.passage) for r in block], window, max_edits))
        part = corpus.mapInArrow(lambda batches, sent=sent: _task(sent.value)(batches), "doc_id bigint, item_id bigint, edits bigint")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").cast("int").alias("edits"))
