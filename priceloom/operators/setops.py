"""Set operations, upserts and replacements over keyed tables. Keys compare null-safe nowhere: they must not be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of updates written over the rows of equal keys; columns that updates lack keep their value."""
    new = updates.select(*keys, F.struct(*[c for c in updates.columns if c not in keys]).alias("_new"))
    given = set(updates.columns)
    picked = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in target.columns if c not in keys]
    return target.join(new, list(keys), "full_outer").select(*keys, *picked)


def upsert_actions(target: DataFrame, updates: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of updates with action inserted, updated or skipped (equal values)."""
    old = target.select(*keys, F.struct(*values).alias("_old"))
    new = updates.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return new.join(old, list(keys), "left").select(*keys, "_new.*", action.alias("action"))


def action_counts(actions: DataFrame) -> DataFrame:
    of = lambda kind: F.coalesce(F.sum((F.col("action") == kind).cast("int")), F.lit(0))
    return actions.agg(of("inserted").alias("inserted"), of("updated").alias("updated"), of("skipped").alias("skipped"), F.count(F.lit(1)).alias("matched"))


def union_missing(primary: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of primary and those of extra whose keys it lacks."""
    return primary.unionByName(extra.join(primary.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_groups(target: DataFrame, updates: DataFrame, group: Sequence[str]) -> DataFrame:
    """target without the groups that updates touch, and updates."""
    return target.join(updates.select(*group).distinct(), list(group), "left_anti").unionByName(updates, allowMissingColumns=True)


def same_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids that were added or removed; empty if both hold the same set."""
    old, new = before.select(key).distinct(), after.select(key).distinct()
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def assert_same_ids(before: DataFrame, after: DataFrame, key: str) -> None:
    if changed := same_ids(before, after, key).limit(20).collect():
        raise ValueError("ids changed: " + ", ".join(f"{r['change']} {r[key]}" for r in changed))


def select_targets(catalog: DataFrame, key: str, ids: DataFrame | None = None, published: DataFrame | None = None) -> DataFrame:
    """The catalog rows to compute: those of the given ids, else those that are not published yet. Unknown ids fail."""
    if ids is not None:
        if unknown := ids.join(catalog, key, "left_anti").limit(20).collect():
            raise ValueError("unknown ids: " + ", ".join(str(r[key]) for r in unknown))
        return catalog.join(ids.select(key).distinct(), key, "left_semi")
    return catalog if published is None else catalog.join(published.select(key).distinct(), key, "left_anti")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_last(results: DataFrame, key: str, order: str) -> DataFrame:
    """The last result of each id."""
    return keep_first(results, [key], [F.col(order).desc()])


def pending(ledger: DataFrame, results: DataFrame, key: str, order: str, retry: bool = False) -> DataFrame:
    """Ledger rows whose last result did not succeed; failed ones only on retry."""
    done = merge_last(results, key, order).where("status = 'ok'" if retry else "status IN ('ok', 'failed')")
    return ledger.join(done.select(key), key, "left_anti")


def crop_findings(raw: DataFrame, split: DataFrame, least: float = 0.01) -> DataFrame:
    """Raw cards with a mismatch tag or a verified price that differs, and split findings not among them."""
    gap = F.col("verified_price") - F.col("original_price")
    note = F.when(gap >= least, "raised").when(gap <= -least, "lowered").otherwise("tag only")
    tagged = F.coalesce(F.col("review_reasons").contains("crop"), F.lit(False))
    found = raw.where(tagged | F.coalesce(F.abs(gap) >= least, F.lit(False))).withColumn("note", note).withColumn("origin", F.lit("raw"))
    keys = ["feed", "page", "idx", "final_price"]
    rest = split.where(tagged).withColumn("note", F.lit("tag only")).withColumn("origin", F.lit("split")).join(found.select(*keys), keys, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)
