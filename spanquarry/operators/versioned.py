"""Append-only logs read as tables: newest version wins, tombstones, upserts."""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanquarry.functions.common import as_col


def pick_first(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() = 1`` is recognised by the optimizer, which keeps a single row per
    key on the map side before it shuffles, so a hot key never moves as a group.
    """
    rank = F.row_number().over(Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest(log: DataFrame, keys: Sequence[str], version: str, tie: Sequence[str] = (),
           tombstone: str | None = None) -> DataFrame:
    """The newest version of each key; keys whose newest version is a tombstone are gone."""
    newest = pick_first(log, keys, [F.col(c).desc_nulls_last() for c in (version, *tie)])
    return newest if tombstone is None else newest.filter(F.col(tombstone) == 0)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[Column | str],
                     order: Sequence[Column]) -> DataFrame:
    """The new rows to append: absent keys only, and the first new row of each key.

    A key may be an expression (``lower(email)``) over columns both sides have.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    cols = [as_col(k).alias(n) for k, n in zip(keys, names)]
    fresh = pick_first(new.select("*", *cols), names, order)
    return fresh.join(existing.select(*cols), names, "left_anti").drop(*names)


def upsert(new: DataFrame, existing: DataFrame, keys: Sequence[str],
           keep: dict[str, Column] | None = None) -> DataFrame:
    """Whole table after an upsert: ``new`` wins column by column.

    ``keep`` maps a column to a condition over the stored row (columns ``old_<name>``)
    under which the stored value stays, e.g. text an administrator has edited.
    """
    keep = keep or {}
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("_old"))
    joined = new.withColumn("_new", F.lit(True)).join(old, list(keys), "full_outer")
    out = []
    for c in values:
        incoming = F.when(F.col("_new"), F.col(c)) if c in new.columns else F.lit(None)
        changed = F.col("_new") if c in new.columns else F.lit(False)
        changed = F.coalesce(changed, F.lit(False))
        if c in keep:
            changed = changed & ~F.coalesce(keep[c], F.lit(False))
        out.append(F.when(changed, incoming).otherwise(F.col(f"old_{c}")).alias(c))
    return joined.select(*keys, *out)


def versions(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A version history, newest first."""
    return log.orderBy(*keys, F.col("version").desc())


def next_versions(new: DataFrame, log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Number new rows after the highest stored version of their key."""
    top = log.groupBy(*keys).agg(F.max("version").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        new.withColumn("_n", rank).join(top, list(keys), "left")
        .withColumn("version", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_top", "_n")
    )


def restore(log: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append so that each wanted ``(key, version)`` is live again.

    The current row stays in the log as history; the restored content gets the number
    after the current one.
    """
    top = log.groupBy(*keys).agg(F.max("version").alias("_top"))
    content = log.join(wanted.select(*keys, "version"), [*keys, "version"], "left_semi")
    return content.join(top, list(keys)).withColumn("version", F.col("_top") + 1).drop("_top")
