"""Exactly one copy of messages that were delivered at least once (problem 3).

Rank by arrival inside a message identifier, keep the first. One identifier may hold a third of all
deliveries, so the rank is taken in two levels: first inside (identifier, salt), which spreads a hot
identifier over ``salts`` groups, then among the at most ``salts`` winners of each identifier. A
delivery that loses on either level repeats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ranked(df: DataFrame, ids: list[str], order: str, salts: int) -> DataFrame:
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(order)), F.lit(salts)))
    return salted.withColumn("_first", F.row_number().over(Window.partitionBy(*ids, "_salt").orderBy(order)) == 1)


def _identified(ids: list[str]) -> Column:
    known = F.lit(True)
    for c in ids:
        known = known & F.col(c).isNotNull()
    return known


def repeated_deliveries(df: DataFrame, ids: list[str], order: str, salts: int = 256) -> DataFrame:
    """``order`` (a unique arrival number) of every delivery that repeats an earlier one with equal ``ids``.

    A delivery with a null in ``ids`` or in ``order`` identifies no message and is never reported. Other
    columns are ignored, so payloads may differ between copies. An empty table gives no rows.
    """
    narrow = df.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col(order).alias("_order"))
    keys = [f"_id{k}" for k in range(len(ids))]
    marked = _ranked(narrow.where(_identified(keys) & F.col("_order").isNotNull()), keys, "_order", salts)
    # one pass: a salt's winners meet in one group of their message, what lost stays where it is
    group = F.when(F.col("_first"), -1).otherwise(F.col("_salt"))
    placed = marked.withColumn("_group", group).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy("_order")))
    return placed.where(~F.col("_first") | (F.col("_n") > 1)).select("_order").withColumnRenamed("_order", order)


def keep_first_delivery(df: DataFrame, ids: list[str], order: str, salts: int = 256) -> DataFrame:
    """The rows of ``df`` without repeats: the earliest ``order`` of each message, with all its columns.

    Rows with a null identifier can't be matched with anything and are kept as they are. Ties in
    ``order`` (which should be unique) are broken by the hash of the row.
    """
    names = df.columns
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    known = F.lit(True)
    for c in ids:
        known = known & F.col("_row").getField(c).isNotNull()
    keyed = row.where(known).select("_row", *[F.col("_row").getField(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.struct(F.col("_row").getField(order), F.xxhash64("_row")).alias("_order"))
    keys = [f"_id{k}" for k in range(len(ids))]
    winners = _ranked(keyed, keys, "_order", salts).where("_first")
    first = winners.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))).where("_n = 1").select("_row")
    return first.unionByName(row.where(~known)).select("_row.*")


def new_messages(stored: DataFrame, batch: DataFrame, ids: list[str], order: str) -> DataFrame:
    """The messages of ``batch`` that ``stored`` lacks, each once: first delivery inside the batch, then a left anti join.

    ``stored`` needs only the identifier columns; nulls in them never match. Rows of the batch with a
    null identifier are passed on.
    """
    kept = keep_first_delivery(batch, ids, order)
    known = stored.select(*ids).where(_identified(ids)).distinct()
    return kept.join(known, ids, "left_anti").select(*batch.columns)
