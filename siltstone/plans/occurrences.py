"""Scores of asked words straight from chunks: a chunk is cut into terms within the Arrow batches (terms.py), and it stays one row until its words have their scores."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.index import FIELDS
from siltstone.plans.terms import Terms, letters, pairs

#: Chunks whose scores are made at once.
SLICE = 1_000


class Phrases:
    """Asked phrases (field, terms) as a tree of the codes of their terms; field '' means any."""

    def __init__(self, phrases: list[tuple[str, tuple[str, ...]]]):
        self.terms = sorted({t for _, terms in phrases for t in terms})
        self.n, self.longest = len(phrases), max((len(terms) for _, terms in phrases), default=0)
        code, nodes = {t: k for k, t in enumerate(self.terms)}, {}
        self.ends: dict[str, np.ndarray] = {}
        last = []
        for field, terms in phrases:
            node = 0
            for t in terms:
                node = nodes.setdefault(node * len(code) + code[t], len(nodes) + 1)
            last.append((field, node))
        self.steps = np.array(sorted(nodes), np.int64)
        self.next = np.array([nodes[k] for k in self.steps.tolist()], np.int64)
        for k, (field, node) in enumerate(last):
            if node:
                self.ends.setdefault(field, np.full(len(nodes) + 1, -1, np.int64))[node] = k

    def standing(self, codes: np.ndarray, text: np.ndarray, pos: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(field, place, phrase) of the phrases that begin at places of codes, which hold the asked terms of texts in order."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for depth in range(self.longest):
            if depth:
                inside = at + depth < len(codes)
                at, node = at[inside], node[inside]
                beside = (text[at + depth] == text[at]) & (pos[at + depth] == pos[at] + depth)
                at, node = at[beside], node[beside]
            key = node * len(self.terms) + codes[at + depth]
            step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            met = self.steps[step] == key
            at, node = at[met], self.next[step[met]]
            for field, ends in self.ends.items():
                ending = ends[node] >= 0
                yield field, at[ending], ends[node[ending]]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def counted(chunks: DataFrame, phrases: Phrases, weights: dict[str, float]) -> DataFrame:
    """(chunk_id, chunk_index, entry_id, digest, n_tokens, phrase, weighted, plain): a row for each chunk with the places in the list of the phrases that it holds, and how often; digest is the same for repeated rows only.

    A null bigram field counts as the one that with_ngrams() would give.
    """
    path, content, ngrams = FIELDS
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    own = F.sha2(F.concat(part(path), part(content)), 256).alias("digest"), F.sha2(ngrams, 256).alias("ngrams_digest")
    texts = [F.lower(F.coalesce(path, F.lit(""))).alias(path), F.lower(F.coalesce(content, F.lit(""))).alias(content), F.lower(ngrams).alias(ngrams)]
    each = chunks.select(F.col("id").cast("bigint").alias("chunk_id"), F.col("chunk_index").cast("int"), F.col("entry_id").cast("bigint"), *own, *texts)
    runs, weight = letters(chunks.sparkSession), [weights[f] for f in FIELDS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(phrases.terms, runs)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
            texts = {f: batch.column(f).to_pylist() for f in FIELDS}
            digests = batch.column("ngrams_digest").to_pylist()
            old = [k for k, t in enumerate(texts[ngrams]) if t is None]
            for k, made in zip(old, pairs(*([texts[f][k] for k in old] for f in (content, path)))):
                texts[ngrams][k], digests[k] = made, sha256(made.encode()).hexdigest()
            digest = pa.array([sha256(f"{x} {y}".encode()).digest() for x, y in zip(batch.column("digest").to_pylist(), digests)], pa.binary())
            n_tokens, keys, weighs = np.zeros(len(batch), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
            for name, weigh in zip(FIELDS, weight):
                for a, n, text, pos, codes in terms.standing(texts[name]):
                    n_tokens[a : a + len(n)] += n
                    for field, at, phrase in phrases.standing(codes, text, pos):
                        if field in ("", name):
                            keys.append((text[at] + a) * phrases.n + phrase)
                            weighs.append(np.full(len(at), weigh))
            held, group = np.unique(np.concatenate(keys), return_inverse=True)
            row, phrase = np.divmod(held, phrases.n)
            offsets = np.searchsorted(row, np.arange(len(batch) + 1))
            lists = [_lists(offsets, phrase, pa.int32()), _lists(offsets, np.bincount(group, np.concatenate(weighs), len(held)), pa.float64()), _lists(offsets, np.bincount(group, minlength=len(held)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), digest, pa.array(n_tokens, pa.int32()), *lists], ["chunk_id", "chunk_index", "entry_id", "digest", "n_tokens", "phrase", "weighted", "plain"])

    return each.mapInArrow(task, "chunk_id bigint, chunk_index int, entry_id bigint, digest binary, n_tokens int, phrase array<int>, weighted array<double>, plain array<int>")


class Words:
    """Which branches of words the phrases belong to: rows (word, branch, branch_size, phrase), a row for each time that the branch asks for the phrase."""

    def __init__(self, rows: list[tuple[int, int, int, int]], n_phrases: int):
        branches = {b: k for k, b in enumerate(sorted({r[:3] for r in rows}))}
        words = {w: k for k, w in enumerate(sorted({r[0] for r in rows}))}
        self.words = np.array(list(words), np.int64)
        self.word, self.size = (np.array(x, np.int64) for x in zip(*[(words[w], size) for w, _, size in branches]))
        of = np.array(sorted((p, branches[tuple(b)]) for *b, p in rows), np.int64)
        self.branch, self.begin = of[:, 1], np.searchsorted(of[:, 0], np.arange(n_phrases + 1))

    def rows(self, counts: dict[int, int]) -> int:
        """Rows of scores at most, where so many chunks hold each phrase."""
        return sum(n * int(self.begin[p + 1] - self.begin[p]) for p, n in counts.items())

    def scores(self, row: np.ndarray, phrase: np.ndarray, *scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, word, *scores) of the words of which a row satisfies a branch; only satisfied branches score."""
        times = self.begin[phrase + 1] - self.begin[phrase]
        each = np.repeat(np.arange(len(phrase)), times)
        branch = self.branch[np.repeat(self.begin[phrase] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(len(each))] if len(each) else each
        key, group, met = np.unique(row[each] * len(self.size) + branch, return_inverse=True, return_counts=True)
        at, branch = np.divmod(key, len(self.size))
        whole = met == self.size[branch]
        key, word = np.unique(at[whole] * len(self.words) + self.word[branch[whole]], return_inverse=True)
        sums = [np.bincount(word, np.bincount(group, s[each], len(met))[whole], len(key)) for s in scores]
        at, word = np.divmod(key, len(self.words))
        return at, self.words[word], *sums


def scored(held: DataFrame, words: Words, rarity: np.ndarray, average: float, bm25) -> DataFrame:
    """(word, chunk_id, chunk_index, entry_id, weighted, plain, demoted if held has it): a row for each counted chunk, with lists of the words that it satisfies and of their scores; held stays in its parts."""
    kept = [c for c in ("chunk_id", "chunk_index", "entry_id", "demoted") if c in held.columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
            phrase, weighted, plain = (batch.column(c).flatten().to_numpy().astype(t) for c, t in (("phrase", np.int64), ("weighted", float), ("plain", float)))
            row = np.repeat(np.arange(len(batch)), batch.column("phrase").value_lengths().to_numpy())
            length = batch.column("n_tokens").to_numpy()[row]
            at, word, *values = words.scores(row, phrase, *[bm25(f, rarity[phrase], length, average) for f in (weighted, plain)])
            offsets = np.searchsorted(at, np.arange(len(batch) + 1))
            lists = [_lists(offsets, word, pa.int64()), *(_lists(offsets, v, pa.float64()) for v in values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], [*kept, "word", "weighted", "plain"])

    kinds = dict(held.dtypes)
    schema = [*(f"{c} {kinds[c]}" for c in kept), "word array<bigint>, weighted array<double>, plain array<double>"]
    return held.select(*kept, "n_tokens", "phrase", "weighted", "plain").mapInArrow(task, ", ".join(schema)).where(F.size("word") > 0)
