"""Set overlap of k id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def membership_masks(sets: Sequence[tuple[str, DataFrame, str]], count_null_id: bool = False) -> DataFrame:
    """(mask, n): how many ids lie in exactly the sets of a mask, for the masks that occur.

    One shuffle: each distinct id gets the bits of the sets that hold it (map-side combined ``bit_or``).
    """
    if not 1 <= len(sets) < 64:
        raise ValueError("between 1 and 63 sets: the mask is a long")
    parts = None
    for i, (_, df, col) in enumerate(sets):
        x = df.select(F.col(col).cast("string").alias("_id"))
        if not count_null_id:
            x = x.where(F.col("_id").isNotNull())
        x = x.select("_id", F.lit(1 << i).cast("long").alias("_bit"))
        parts = x if parts is None else parts.unionByName(x)
    return parts.groupBy("_id").agg(F.bit_or("_bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def member_masks(members: DataFrame, col: str, mask: str, k: int, count_null_id: bool = False) -> DataFrame:
    """``membership_masks`` of k sets from one table: an id's rows carry the bits of sets that hold it, 0 for none."""
    if not 1 <= k < 64:
        raise ValueError("between 1 and 63 sets: the mask is a long")
    x = members.select(F.col(col).cast("string").alias("_id"), F.col(mask).bitwiseAND(F.lit((1 << k) - 1).cast("long")).alias("_bits"))
    x = x.groupBy("_id").agg(F.bit_or("_bits").alias("mask"), F.bool_or(F.col("_id").isNotNull()).alias("_has_id"))
    # through an aggregate's output: a filter on the id itself would be pushed into the scan, with the id's cleaning
    x = x.where("mask <> 0") if count_null_id else x.where("mask <> 0 AND _has_id")
    return x.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def singles_and_pairs(masks: DataFrame, k: int, most: int = 2) -> DataFrame:
    """``superset_sums`` for ``most`` of 1 or 2: each mask is spread to its few combinations, which are added up map-side.

    A mask of m sets has m (m + 1) / 2 of them at most, so there are no rounds over tables of the masks' parts.
    """
    bits = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(1 << i).cast("long")) for i in range(k)]))
    t = masks.select(bits.alias("bits"), "n").select("bits", "n", F.explode("bits").alias("a"))
    if most == 1:
        return t.groupBy(F.col("a").alias("combo")).agg(F.sum("n").alias("size"))
    t = t.select("n", "a", F.explode("bits").alias("b")).where("b >= a")
    return t.groupBy(F.col("a").bitwiseOR(F.col("b")).alias("combo")).agg(F.sum("n").alias("size"))


def superset_sums(masks: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(combo, size): for every combination of sets that some id reaches, the ids that lie in all of its sets.

    One set after the other: a mask with the bit also counts without it, and equal masks are added up before
    the next one (map-side combined).  So there are never more rows than combinations that are reached, each
    of them once; combinations that no id reaches have size 0 and no row.  ``most``: only combinations of up to
    so many sets, which keeps the table within the number of these whatever the masks.
    """
    if most in (1, 2):
        return singles_and_pairs(masks, k, most)
    # (bits still to be decided, bits chosen): bits are decided from the lowest
    t = masks.select(F.col("mask").alias("rest"), F.lit(0).cast("long").alias("combo"), "n")
    for i in range(k):
        bit = F.lit(1 << i).cast("long")
        has = F.col("rest").bitwiseAND(bit) != 0
        without = F.col("rest").bitwiseAND(F.lit(~(1 << i)).cast("long"))
        take = F.struct(without.alias("rest"), F.col("combo").bitwiseOR(bit).alias("combo"))
        leave = F.struct(without.alias("rest"), F.col("combo").alias("combo"))
        may = has if most is None else has & (F.bit_count("combo") < most)
        t = t.select(F.explode(F.when(may, F.array(leave, take)).otherwise(F.array(leave))).alias("x"), "n")
        t = t.groupBy("x.rest", "x.combo").agg(F.sum("n").alias("n"))
        if i % 8 == 7 and i + 1 < k:
            t = t.checkpoint(eager=True)
    return t.where("combo <> 0").groupBy("combo").agg(F.sum("n").alias("size"))


def set_overlap(spark: SparkSession, sets: Sequence[tuple[str, DataFrame, str]] | Sequence[str], count_null_id: bool = False,
                zeros: bool = True, most: int | None = None, members: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """Size of every non-empty combination of the sets (inclusive sizes).

    ``sets`` is ``[(label, df, id_column), ...]``, or the labels alone with ``members``, one table of all sets' rows:
    ``(df, id_column, mask_column)``, where a set's bit is the position of its label.  One shuffle of the ids replaces the 2^k - 1 intersections
    (``membership_masks``); the sizes follow from the masks that occur (``superset_sums``).  Combinations nobody
    reaches are listed with size 0 while ``zeros`` is set, which takes 2^k - 1 rows (at most 20 sets); without it
    they have no row, and dozens of sets are fine.  ``most``: combinations of up to so many sets only.  A NULL id
    is skipped unless ``count_null_id`` (then it is one element, as in R's ``unique``).
    """
    k = len(sets)
    names = list(sets) if members is not None else [lbl for lbl, _, _ in sets]
    masks = membership_masks(sets, count_null_id) if members is None else member_masks(*members, k, count_null_id)
    sizes = superset_sums(masks, k, most)
    if zeros:
        if k > 20:
            raise ValueError("more than 20 sets have too many combinations to list those of size 0: pass zeros=False")
        none = spark.range(1, 1 << k).select(F.col("id").alias("combo"), F.lit(0).cast("long").alias("size"))
        none = none if most is None else none.where(F.bit_count("combo") <= most)
        sizes = sizes.unionByName(none).groupBy("combo").agg(F.sum("size").alias("size"))
    labels = F.array(*[F.lit(lbl) for lbl in names])
    combo = F.col("combo")
    members = F.array_compact(F.array(*[F.when(combo.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(i)) for i in range(k)]))
    single = F.bit_count(combo) == 1
    return sizes.select(
        F.col("combo").cast("int" if k < 32 else "long").alias("mask"),
        members.alias("sets"),
        F.when(single, F.element_at(labels, F.element_at(members, 1) + 1)).alias("label"),
        F.col("size").cast("long").alias("size"),
    )
