"""Label catalogs: union with preference, upsert, delete, gates, eviction, work left, spaced picks, edits of labels."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preferred(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row for each key: the first in order; groups are cut down before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merged(inputs: list[DataFrame], keys: tuple[str, ...], edited: str = "edited") -> DataFrame:
    """Union of corpora: an edited entry wins over one that is not, else the one of the later input."""
    numbered = [d.withColumn("_input", F.lit(k)) for k, d in enumerate(inputs)]
    return preferred(reduce(DataFrame.unionByName, numbered), keys, F.desc(edited), F.desc("_input")).drop("_input")


def upserted(base: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return base.join(changes.select(*keys), list(keys), "left_anti").select(*changes.columns).unionByName(changes)


def deleted(base: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def windows_held(manifest: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("scroll", "level", "z", "y", "x")) -> DataFrame:
    """asked with `held`: whether the manifest has the window."""
    known = manifest.select(*keys).distinct().withColumn("_h", F.lit(True))
    return asked.join(known, list(keys), "left").withColumn("held", F.coalesce("_h", F.lit(False))).drop("_h")


def imported(base: DataFrame, other: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """base with the entries of `other` that ids name on top, byte for byte."""
    return upserted(base, other.join(ids.select(key).distinct(), key, "left_semi").select(*base.columns), (key,))


def gated(scores: DataFrame, key: str, score: str, least: float, count: int) -> DataFrame:
    """Keys with at least `count` scores of `least` or more."""
    return scores.groupBy(key).agg(F.count_if(F.col(score) >= least).alias("passing")).where(F.col("passing") >= count)


def evicted(entries: DataFrame, size: str, order: tuple[str, ...], budget: float, group: str | None = None) -> DataFrame:
    """entries with `evicted`: oldest first, until what is left is within 0.9 of the budget; the newest always stays.

    group: the cache that an entry lies in; each is worked off by itself (a cache index is small by nature).
    """
    part = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    total = F.sum(size).over(part)
    gone = F.coalesce(F.sum(size).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    newest = F.row_number().over(part.orderBy(*(F.desc(c) for c in order))) == 1
    return entries.withColumn("evicted", ((total > budget) & (total - gone > 0.9 * budget) & ~newest).cast("int"))


def remaining(items: DataFrame, done: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Items neither done nor claimed, and claims without a result as orphans."""
    left = items.select(key).join(done.select(key), key, "left_anti")
    state = left.join(claimed.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    return state.select(key, F.when(F.col("_c").isNull(), "open").otherwise("orphan").alias("state"))


def spaced_picks(candidates: DataFrame, group: str, score: str, apart: int, most: int) -> DataFrame:
    """(group, z, y, x, score, pick): greedy choice by falling score, no two within `apart` in any axis, `most` a group."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in rows.sort_values([score, "z", "y", "x"], ascending=[False, True, True, True]).itertuples(index=False):
            if len(kept) == most:
                break
            if all(max(abs(row.z - k.z), abs(row.y - k.y), abs(row.x - k.x)) >= apart for k in kept):
                kept.append(row)
        out = pd.DataFrame(kept, columns=rows.columns)
        out["pick"] = range(1, len(out) + 1)
        return out

    schema = ", ".join(f"{n} {t}" for n, t in candidates.select(group, "z", "y", "x", score).dtypes)
    return candidates.select(group, "z", "y", "x", score).groupBy(group).applyInPandas(choose, schema + ", pick long")


def relabelled(df: DataFrame, label: str, ids: list[int]) -> DataFrame:
    """Every label in ids becomes the first of them."""
    return df.withColumn(label, F.when(F.col(label).isin(ids), F.lit(ids[0])).otherwise(F.col(label)))


def surface_label(magnitude: Column, score: Column, weight: Column, crest: float = 0.91, ignore: float = 0.8) -> Column:
    """0 background, 1 surface, 2 ignore: doubt about the sheet or about the place overrides the surface."""
    return F.when(score < ignore, 2).when((magnitude >= crest) & (weight < 0.5), 2).when(magnitude >= crest, 1).otherwise(0)


def combined_confidence(*channels: Column) -> Column:
    return reduce(lambda a, b: a * b, (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in channels))


def soft_or(*signals: Column) -> Column:
    return 1 - combined_confidence(*(1 - s for s in signals))
