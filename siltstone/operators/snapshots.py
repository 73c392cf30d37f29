"""What changed between consecutive full snapshots of a table.

Method: every row of a snapshot is unpivoted into signed cells (key, field, value): +1 for the snapshot it belongs to, -1 for
the next one, plus one presence cell per key. Cells that stand in both snapshots cancel out; the nonzero sums say which rows
came, went or changed, and in which fields.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import small

#: Composed form can differ only where one of these stands: marks, jamo and whatever lies outside the blocks known to be stable.
MAY_DECOMPOSE = r"[^\x{0}-\x{2ff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
PRESENCE = ""


@F.pandas_udf(T.StringType())
def _nfc(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: unicodedata.normalize("NFC", p), na_action="ignore")


def canonical_path(path: Column) -> Column:
    """The path in composed Unicode form with '/' for '\\'; null stays null. Python sees only the few paths that may change."""
    slashed = F.translate(path, "\\", "/")
    return F.coalesce(_nfc(F.when(slashed.rlike(MAY_DECOMPOSE), slashed)), slashed)


def latest_rows(df: DataFrame, snapshot: str, key: Column, delivered: str, fields: list[str]) -> DataFrame:
    """(snapshot, key, fields): of all rows of one snapshot and key, the one delivered last.

    Rows delivered at the same time are told apart by their field values (the greater ones hold, null is least), so the result
    doesn't depend on row order. Rows without snapshot or key are left out; a null delivery time is the earliest. Exact
    duplicates fall together before the shuffle, so a key with very many rows costs one task no more than any other.
    """
    rows = df.select(F.col(snapshot).alias("_snapshot"), key.alias("_key"), F.struct(F.col(delivered).alias("_at"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]).alias("_row"))
    held = rows.where("_snapshot is not null and _key is not null").groupBy("_snapshot", "_key").agg(F.max("_row").alias("_row"))
    return held.select("_snapshot", "_key", *[F.col(f"_row._f{i}").alias(f"_f{i}") for i in range(len(fields))])


def changes(df: DataFrame, snapshot: str, key: Column, delivered: str, fields: list[str]) -> DataFrame:
    """(snapshot_no, key, change_type, changed_fields) per key that differs between a snapshot and the one before it.

    Consecutive means the next snapshot number present. change_type is added, removed or changed; changed_fields names the
    differing fields of a changed key, in order, and is empty otherwise. Null is a value of its own. An empty table and a single
    snapshot give no rows. Columns of df other than those named play no part, whatever their names.
    """
    held = latest_rows(df, snapshot, key, delivered, fields)
    numbers = df.select(F.col(snapshot).alias("_snapshot")).where("_snapshot is not null").distinct()
    follow = numbers.select("_snapshot", F.lead("_snapshot").over(Window.orderBy("_snapshot")).alias("_next"), F.lag("_snapshot").over(Window.orderBy("_snapshot")).alias("_before"))
    # from here on all steps group by the key first, so this one exchange serves them all
    rows = held.join(small(follow), "_snapshot").repartition("_key")
    sides = F.filter(
        F.array(F.struct(F.when(F.col("_before").isNotNull(), F.col("_snapshot")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign"))),
        lambda s: s["at"].isNotNull(),
    )
    cells = F.array(
        F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").cast("string").alias("value")) for i, f in enumerate(fields)],
    )
    signed = rows.select("_key", cells.alias("_cells"), F.explode(sides).alias("_side")).select(F.col("_side.at").alias("_at"), "_key", F.col("_side.sign").alias("_sign"), F.inline("_cells").alias("_field", "_value"))
    uncancelled = signed.groupBy("_at", "_key", "_field", "_value").agg(F.sum("_sign").alias("_sum")).where("_sum <> 0")
    came = F.coalesce(F.max(F.when(F.col("_field") == PRESENCE, F.col("_sum"))), F.lit(0))
    found = uncancelled.groupBy("_at", "_key").agg(came.alias("_came"), F.collect_set(F.when(F.col("_field") != PRESENCE, F.col("_field"))).alias("_fields"))
    kind = F.when(F.col("_came") > 0, "added").when(F.col("_came") < 0, "removed").otherwise("changed")
    differing = F.when(F.col("_came") == 0, F.filter(F.array(*map(F.lit, fields)), lambda f: F.array_contains("_fields", f))).otherwise(F.array().cast("array<string>"))
    return found.select(F.col("_at").alias("snapshot_no"), F.col("_key").alias("key"), kind.alias("change_type"), differing.alias("changed_fields"))
