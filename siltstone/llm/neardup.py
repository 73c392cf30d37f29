"""Near-duplicate records: pairs whose sets of word runs are similar enough, and groups of them.

Method: token-combination prefixes. Sets are ordered from rare to frequent tokens and cut to a prefix so long that two similar
sets have a token of their prefixes in common; prefixes are extended by EXTENDED tokens, so they have several. The class of a
token is what its list holds: tokens of up to HOT records are indexed singly; those of longer lists only by pairs of such tokens,
those of pairs with longer lists by triples, and only for records that have so many of them that a similar record need not share
a rarer token. Lists that stay long are compared in blocks. Pairs of records with enough signatures in common are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import mix, run_hashes, words
from siltstone.session import cut, small

#: Counters by which tokens are ordered, hashed to them; their number is the size of what is sent to the tasks, whatever the data. Any order gives the same pairs.
COUNTERS, SHARDS = 1 << 21, 256
#: Records of a signature that are compared in one task at most.
HOT = 1_000
#: Tokens by which prefixes are extended: two similar sets share at least 1 + EXTENDED of them, or all that they have in common.
EXTENDED = 5
#: Largest combinations.
MOST = 3


class _Codes(dict):
    """Word to 64-bit hash, kept for words seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_codes = _Codes()


def token_sets(texts: list[str], run: int, least_words: int) -> tuple[list[int], list[np.ndarray]]:
    """(number of the text, its sorted distinct tokens) of texts with enough words; a token is the hash of `run` words in a row."""
    which, codes, sizes = [], [], []
    for k, text in enumerate(texts):
        w = words(text)
        if len(w) >= max(least_words, run):
            which.append(k)
            sizes.append(len(w))
            codes.extend(map(_codes.__getitem__, w))
    h = run_hashes(np.array(codes, np.uint64), run)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return which, [np.unique(h[a : b - run + 1]) for a, b in zip(at[:-1], at[1:])]


def _count_task(run: int, least_words: int):
    """(shard, counts): how many records hold the tokens of each counter, one row a shard and task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            _, sets = token_sets(batch.column(1).to_pylist(), run, least_words)
            if sets:
                at, n = np.unique(_counter(np.concatenate(sets)), return_counts=True)
                total[at] += n.astype(np.uint32)
        yield _shards(range(SHARDS), total.reshape(SHARDS, -1))

    return go


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def _shards(numbers, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["shard", "counts"])


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shards of a partition; the counts saturate."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[shard] = total.get(shard, np.uint64(0)) + np.frombuffer(counts, np.uint32).astype(np.uint64)
    if total:
        yield _shards(total, np.minimum(np.stack(list(total.values())), np.iinfo(np.uint32).max).astype(np.uint32))


def need(larger: int, smaller: int, similarity: float) -> int:
    """Least number of common tokens of two sets of these sizes."""
    return max(1, math.ceil(similarity / (1 + similarity) * (larger + smaller) - 1e-9))


def _combinations(tokens: np.ndarray, hot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of the last token) of the combinations of `size` tokens all of whose parts are hot; others have met by a part."""
    if size == 1:
        return tokens.copy(), np.arange(len(tokens))
    if size == 2:
        h = np.flatnonzero(np.isin(tokens, hot))
        i, j = (h[x] for x in np.triu_indices(len(h), 1))
    else:
        i, j = np.triu_indices(len(tokens), 1)
        paired = np.isin(_pair(tokens[i], tokens[j]), hot)
        i, j = i[paired], j[paired]
        linked = np.zeros((len(tokens), len(tokens)), bool)
        linked[i, j] = True
        left, third = np.nonzero(linked[i] & linked[j])
        a, b, c = np.sort(tokens[np.stack([i[left], j[left], third])], axis=0) if len(left) else np.empty((3, 0), np.uint64)
        return mix(_pair(a, b) + mix(c + np.uint64(3))), third
    return _pair(tokens[i], tokens[j]), j


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # in the order of their hashes, so that either record forms the same combination
    return mix(np.minimum(a, b) + mix(np.maximum(a, b)))


def _signature_task(run: int, least_words: int, similarity: float, sent, size: int):
    """(signature, id, n) of rows (id, text, hot): n is negative where the signature lies in the shorter prefix that suffices for the smaller set of a pair.

    Beyond single tokens, hot are the record's signatures of one token less with long lists. Records whose prefix has fewer hot
    tokens than similar sets share have met by a rarer one; the same holds for the shorter prefix.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            ids, hots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            which, sets = token_sets(batch.column(1).to_pylist(), run, least_words)
            signature, owner, sizes = [], [], []
            for k, s in zip(which, sets):
                n = len(s)
                least = math.ceil(similarity * n - 1e-9)
                probe = min(n, n - least + 1 + EXTENDED)
                index = min(n, n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1 + EXTENDED)
                s = s[np.lexsort((s, counts[_counter(s)]))[:probe]]
                common = min(least, 1 + EXTENDED)
                if size == 1:
                    found, place = _combinations(s, s, 1)
                else:
                    hot = np.array(hots[k], np.int64).view(np.uint64)
                    if size == 2:
                        at = np.flatnonzero(np.isin(s, hot))
                        if len(at) < common:
                            continue
                        if np.count_nonzero(at < index) < common:
                            index = 0
                    found, place = _combinations(s, hot, size)
                signature.append(found)
                sizes.append(np.where(place < index, -n, n))
                owner.append(np.full(len(place), ids[k], np.int64))
            if owner:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([x.view(np.int64) for x in signature], owner, sizes)], ["signature", "id", "n"])

    return go


def _pairs_of(signature: np.ndarray, ids: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(smaller, larger, size of smaller, size of larger) of rows of one signature whose sizes allow it; rows are sorted by signature."""
    n, indexed = np.abs(size), size < 0
    out = []
    for gap in range(1, len(ids)):
        at = np.flatnonzero(signature[gap:] == signature[:-gap])
        if not len(at):
            break
        x, y = at, at + gap
        swap = (n[x] > n[y]) | ((n[x] == n[y]) & (ids[x] > ids[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        ok = indexed[x] & (n[x] >= similarity * n[y] - 1e-9) & (ids[x] != ids[y])
        out.append((ids[x[ok]], ids[y[ok]], n[x[ok]], n[y[ok]]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


MET = "hot boolean, a bigint, b bigint, n bigint"


def _pair_task(similarity: float):
    """Over (signature, id, n) sorted by signature: (false, a, b, common) of pairs, a's set the smaller one, common the tokens of the prefixes that similar sets share; (true, signature, id, n) of the rows of signatures with more than HOT."""

    def met(signature: np.ndarray, ids: np.ndarray, n: np.ndarray, long: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, m, l = _pairs_of(signature[~long], ids[~long], n[~long], similarity)
        common = np.minimum(np.ceil(similarity / (1 + similarity) * (m + l) - 1e-9).astype(np.int64), 1 + EXTENDED)
        columns = [[np.zeros(len(a), bool), np.ones(int(long.sum()), bool)], [a, signature[long]], [b, ids[long]], [common, n[long]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["hot", "a", "b", "n"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.empty(0, np.int64) for _ in range(3))
        passed = None  # the signature at the end of what was given out as long
        for batch in batches:
            rows = [np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept)]
            signature = rows[0]
            new = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
            count = np.diff(np.concatenate([new, [len(signature)]]))
            long = (count > HOT) | (signature[new] == passed if passed is not None else False)
            # the last signature may go on: its rows wait unless there are too many already
            end = len(signature) if long[-1] else int(new[-1])
            passed = int(signature[-1]) if long[-1] else None
            kept = tuple(r[end:] for r in rows)
            # one signature without an indexed row has no pairs
            useful = np.repeat(np.logical_or.reduceat(rows[2] < 0, new) | (count > 1) & long, count)[:end]
            yield from met(*(r[:end][useful] for r in rows), np.repeat(long, count)[:end][useful])
        yield from met(*kept, np.zeros(len(kept[0]), bool))

    return go


def _block_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs of (signature, id, n) whose lists are too long for a task: a list's indexed rows and all its rows are dealt to blocks, and a block of either is compared at a time."""
    side = HOT // 2 or 1
    blocks = lambda n: F.ceil(n / side).cast("int")
    indexed = F.col("n") < 0
    counted = rows.groupBy("signature").agg(blocks(F.count(F.when(indexed, 1))).alias("_few"), blocks(F.count("*")).alias("_many"))
    dealt = rows.join(counted, "signature")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small_side = dealt.where(indexed).select("signature", "id", "n", mine("_few").alias("_i"), each("_many").alias("_j"))
    large_side = dealt.where("_few > 0").select("signature", "id", F.abs("n").alias("n"), mine("_many").alias("_j"), each("_few").alias("_i"))
    sides = small_side.unionByName(large_side).select(F.xxhash64("signature", "_i", "_j").alias("signature"), "id", "n")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64) for _ in range(3)]
        for batch in _then_none(batches):
            rows = [np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept)] if batch is not None else kept
            end = len(rows[0]) if batch is None else int(np.searchsorted(rows[0], rows[0][-1]))
            kept = [r[end:] for r in rows]
            a, b, _, _ = _pairs_of(*(r[:end] for r in rows), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return sides.repartition("signature").sortWithinPartitions("signature").mapInArrow(task, "a bigint, b bigint")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _set_task(run: int, least_words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, sets = token_sets(batch.column(1).to_pylist(), run, least_words)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "tokens"])

    return go


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, kept): records whose text another record has too, and the least id with that text."""
    sums = df.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sum"))
    groups = sums.groupBy("sum").agg(F.min("id").alias("kept"), F.max("id").alias("_most")).where("kept <> _most").select("sum", "kept")
    return sums.join(groups, "sum").select("id", "kept").distinct()


def links(df: DataFrame, key: str, text: str, run: int = 5, similarity: float = 0.8, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two tables: (a, b, common, similarity) of similar pairs among the records that stand for their exact copies, and (id, kept) of all copies.

    A record's set are its distinct runs of `run` words; similarity is Jaccard's. Records of fewer than least_words words, null
    and empty texts have no links. Rows of one id count as one record. No pair is lost: signatures only sieve, and no list of
    partners is capped.
    """
    spark = df.sparkSession
    same = cut(copies(df, key, text))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    gone = small(same.where("id <> kept").select("id"))

    counted = rows.mapInArrow(_count_task(run, least_words), "shard int, counts binary").repartition("shard").mapInArrow(_sum_task, "shard int, counts binary")
    counts = np.zeros((SHARDS, COUNTERS // SHARDS), np.uint32)
    for r in counted.collect():  # COUNTERS numbers in all
        counts[r.shard] = np.frombuffer(r.counts, np.uint32)
    sent = spark.sparkContext.broadcast(counts.ravel())

    def met(texts: DataFrame, size: int) -> DataFrame:
        # copies leave here, not before: the texts themselves are not shuffled for them
        signatures = texts.mapInArrow(_signature_task(run, least_words, similarity, sent, size), "signature bigint, id bigint, n bigint").join(gone, "id", "left_anti").select("signature", "id", "n")
        lists = signatures.repartition("signature").sortWithinPartitions("signature").mapInArrow(_pair_task(similarity), MET)
        return lists.groupBy("hot", "a", "b").agg(F.count("*").alias("times"), F.min("n").alias("n"))

    texts, found = rows.select("id", "text", F.lit(None).cast("array<bigint>").alias("hot")), []
    for size in range(1, MOST + 1):
        counted = cut(met(texts, size).where("hot or times >= n" if size == 1 else "true"))
        found.append(counted.where("not hot").select("a", "b"))
        lists = counted.where("hot").select(F.col("a").alias("signature"), F.col("b").alias("id"), "n")
        # what no smaller set shares counts for nothing
        shared = lists.groupBy("signature").agg(F.min("n").alias("_n")).where("_n < 0").select("signature")
        long = cut(lists.join(small(cut(shared), 8), "signature", "left_semi"))
        if long.isEmpty():
            break
        # sets so small that similar ones may share no larger combination
        stay = long if size == MOST else long.where(F.abs("n") * similarity <= size)
        found.append(_block_pairs(stay, similarity))
        hot = cut(long.groupBy("id").agg(F.collect_list("signature").alias("hot")))
        texts = rows.join(small(hot, F.size("hot") * 8 + 32), "id").select("id", "text", "hot")
        if size == 1:
            # two records that both have hot tokens may share fewer others
            both = met(texts, 1).where("not hot and times < n")
            few = lambda c: small(hot.select(F.col("id").alias(c), F.size("hot").alias(f"_{c}")))
            found.append(both.join(few("a"), "a").join(few("b"), "b").where(F.col("times") >= F.col("n") - F.least("_a", "_b")).select("a", "b"))
    candidates = cut(reduce(DataFrame.unionByName, found).distinct())

    wanted = cut(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = cut(rows.join(small(wanted), "id", "left_semi").mapInArrow(_set_task(run, least_words), "id bigint, tokens array<bigint>"))
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("_y"))
    both = candidates.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("_x", "_y")))
    jaccard = F.col("common") / (F.size("_x") + F.size("_y") - F.col("common"))
    similar = both.select("a", "b", "common", jaccard.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    return similar, same


def similar_pairs(df: DataFrame, key: str, text: str, run: int = 5, similarity: float = 0.8, least_words: int = 5) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of similar records, exact copies included; see links()."""
    found, same = links(df, key, text, run, similarity, least_words)
    # a copy stands in for its group on either side; records without copies stand for themselves
    members = same.select(F.col("kept").alias("_kept"), F.col("id").alias("_id"))
    at_a = found.select("a", "b").join(members, F.col("a") == F.col("_kept"), "left").select(F.coalesce("_id", "a").alias("x"), "b")
    across = at_a.join(members, F.col("b") == F.col("_kept"), "left").select("x", F.coalesce("_id", "b").alias("y"))
    long_enough = df.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("text")).join(small(same.where("id = kept").select(F.col("id").alias("_id"))), "_id", "left_semi")
    copied = long_enough.mapInArrow(_set_task(run, least_words), "id bigint, tokens array<bigint>").select(F.col("id").alias("_kept"))
    groups = members.join(copied, "_kept")
    within = groups.select("_kept", F.col("_id").alias("x")).join(groups.select("_kept", F.col("_id").alias("y")), "_kept").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups_of(found: DataFrame, same: DataFrame) -> DataFrame:
    """(id, group_id, links) of every record that has a similar one or a copy: group_id is the least id that chains of links reach, links the number of records linked directly, copies not counted.

    Labels spread along links and then jump to their label's label, so a chain of n records takes about log n rounds; each round
    is written to the shared folder.
    """
    edges = cut(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label"), F.count("*").alias("links")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        spread = labels.join(near, "a").select("a", "links", F.least("label", "_near").alias("_new"), F.col("label").alias("_old"))
        over = labels.select(F.col("a").alias("_new"), F.col("label").alias("_far"))
        new = cut(spread.join(over, "_new", "left").select("a", "links", F.least("_new", F.coalesce("_far", "_new")).alias("label"), "_old"))
        done = new.where("label <> _old").isEmpty()
        labels = new.drop("_old")
        if done:
            break
    kept = labels.select(F.col("a").alias("kept"), "label", "links")
    copied = same.join(kept, "kept", "left").select("id", F.coalesce("label", "kept").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return kept.join(same.select("kept").distinct(), "kept", "left_anti").select(F.col("kept").alias("id"), F.col("label").alias("group_id"), "links").unionByName(copied)
