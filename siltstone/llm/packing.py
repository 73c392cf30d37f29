"""Containers of fixed capacity filled with texts, sizes in tokens.

Method: best-two-fit. A container is filled greedily, largest fitting text first; then its smallest text is replaced by two
unpacked ones that fill the widened gap better, as long as there are such. Texts are dealt to groups of bounded size by hash and
groups are packed side by side: only a group's last containers stay partly empty, whatever the number of texts. The full pieces of
a long text need no packing; they are numbered with their group and never pass through it.
"""

from __future__ import annotations

import base64
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import cut

#: Byte-level BPE vocabulary for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Texts that a task packs at a time.
GROUP_ITEMS = 20_000
#: Container sizes that are worked off together; more are worked off one such set after another.
WINDOWS = 100


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """df with n_tokens, the number of tokens of df[text] as the tokenizer at path cuts it; special tokens' strings are ordinary text, null stays null."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = tokenizer(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)), na_action="ignore").astype("Int64")

    return df.withColumn("n_tokens", count(F.col(text)))


class Unpacked:
    """Items by size, with the largest size up to a limit in a few steps."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.count[0] = 0
        self.sizes = np.flatnonzero(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            at = np.searchsorted(self.sizes, size)
            self.sizes = np.delete(self.sizes, at)

    def put(self, size: int) -> None:
        self.count[size] += 1
        if self.count[size] == 1:
            self.sizes = np.insert(self.sizes, np.searchsorted(self.sizes, size), size)

    def largest(self, limit: int) -> int:
        at = np.searchsorted(self.sizes, limit, "right")
        return int(self.sizes[at - 1]) if at else 0

    def best_two(self, limit: int) -> tuple[int, int]:
        """The two items whose sum is the largest up to limit; (0, 0) if there are none."""
        first = self.sizes[: np.searchsorted(self.sizes, limit)]
        at = np.searchsorted(self.sizes, limit - first, "right") - 1
        ok = at >= 0
        first, at = first[ok], at[ok]
        # an item can't be its own partner: step down where there is only one of the size
        alone = (self.sizes[at] == first) & (self.count[first] < 2)
        at = at - alone
        ok = at >= 0
        first, second = first[ok], self.sizes[at[ok]]
        if not len(first):
            return 0, 0
        k = int(np.argmax(first + second))
        return int(first[k]), int(second[k])


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sizes of the items of each container; every size must be 1 to capacity."""
    left, bins = Unpacked(sizes, capacity), []
    while len(left.sizes):
        held, gap = [], capacity
        while size := left.largest(gap):
            left.take(size)
            held.append(size)
            gap -= size
        while gap and len(left.sizes):  # each replacement fills the container better
            smallest = held[-1]
            a, b = left.best_two(gap + smallest)
            if a + b <= smallest:
                break
            held.pop()
            left.put(smallest)
            for x in (a, b):
                left.take(x)
                held.append(x)
            held.sort(reverse=True)
            gap += smallest - a - b
        bins.append(held)
    return bins


DEALT = "window_name string, capacity_tokens int, doc_id bigint, full bigint, rest bigint, first_full bigint, container_id bigint, position int"


def _pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    """Containers of the group's rests, and the numbers of its full pieces behind them."""
    capacity, group = int(items["capacity_tokens"].iloc[0]), int(key[1]) << 32
    items = items.sort_values(["doc_id", "rest"], kind="stable").reset_index(drop=True)
    rests, queue = items["rest"].to_numpy(), {}
    for row in np.flatnonzero(rests):
        queue.setdefault(int(rests[row]), []).append(row)
    number, position, k = np.zeros(len(items), np.int64), np.zeros(len(items), np.int32), -1
    for k, held in enumerate(best_two_fit(rests[rests > 0], capacity)):
        for p, size in enumerate(held):
            row = queue[size].pop()
            number[row], position[row] = k, p
    first = group + k + 1 + np.concatenate([[0], np.cumsum(items["full"].to_numpy())[:-1]])
    return items.assign(first_full=first.astype(np.int64), container_id=group + number, position=position)[[c.split()[0] for c in DEALT.split(", ")]]


def packed(df: DataFrame, key: str, text: str, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per text, or piece of a text that exceeds the capacity, and container size: which container it is in, where, and which of its tokens these are.

    capacities has window_name and capacity_tokens; null capacities and those below 1 are left out. A text up to the capacity is
    one piece; a longer one is cut into pieces of the full capacity and a rest. container_id is unique within a window_name.
    Null texts and those without tokens are no items; repeated rows are items of their own. The same rows and ids give the same
    containers whatever their order.
    """
    sizes = token_counts(df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0), "text", path)
    counted = cut(sizes.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("_copies")))
    groups = max(1, -(-(counted.agg(F.sum("_copies")).first()[0] or 0) // GROUP_ITEMS))
    # copies of one id are dealt to different groups
    items = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_copy")).withColumn("_group", F.pmod(F.xxhash64("doc_id", "_copy"), F.lit(groups)))
    wanted = [tuple(r) for r in capacities.where("capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("int")).distinct().orderBy("window_name", "capacity_tokens").collect()]
    sets = [wanted[k : k + WINDOWS] for k in range(0, len(wanted), WINDOWS)] or [[]]
    return reduce(DataFrame.unionByName, [_packed_for(items, w) for w in sets])


def _packed_for(items: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    windows = F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).alias("capacity_tokens")) for w, c in wanted]) if wanted else F.array().cast("array<struct<window_name:string,capacity_tokens:int>>")
    each = items.select("doc_id", "n_tokens", "_group", F.inline(windows))
    capacity = F.col("capacity_tokens").cast("bigint")
    dealt = each.select("window_name", "capacity_tokens", "_group", "doc_id", F.floor(F.col("n_tokens") / capacity).alias("full"), (F.col("n_tokens") % capacity).alias("rest"))
    placed = dealt.groupBy("window_name", "_group").applyInPandas(_pack, DEALT)
    piece = lambda container, position, number, size: F.struct(container.alias("container_id"), position.alias("position"), number.cast("int").alias("piece_no"), (number * capacity).alias("token_start"), size.alias("n_tokens"))
    none = F.array().cast("array<struct<container_id:bigint,position:int,piece_no:int,token_start:bigint,n_tokens:bigint>>")
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1), lambda i: piece(F.col("first_full") + i, F.lit(0), i, capacity))).otherwise(none)
    rest = F.when(F.col("rest") > 0, F.array(piece(F.col("container_id"), F.col("position"), F.col("full"), F.col("rest")))).otherwise(none)
    return placed.select("window_name", "capacity_tokens", "doc_id", F.inline(F.concat(whole, rest))).select("window_name", "capacity_tokens", "container_id", "position", "doc_id", "piece_no", "token_start", "n_tokens")


def usage(df: DataFrame) -> DataFrame:
    """(window_name, containers, used_tokens, unused_tokens, fill) of the result of packed()."""
    per = df.groupBy("window_name", "capacity_tokens").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("used_tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return per.select("window_name", "containers", "used_tokens", (room - F.col("used_tokens")).alias("unused_tokens"), F.round(F.col("used_tokens") / room, 6).alias("fill"))
