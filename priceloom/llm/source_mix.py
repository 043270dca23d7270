"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Targets: every source gets a share of all words by its weight; a source stops at max_repeats times its own words and the
excess goes to the others by weight. A document's expected copies are target / weighted words of its source, times its own
weight. The whole part is certain; the fraction is its inclusion probability p. Documents rank by the odds of a
hash-derived uniform number over the odds of p, and the lowest ranks are taken until the source's remaining words are
reached, so that each source's mix has a fixed size.

The running sum over a source is split into bins of the rank that hold about equally many documents (of the uniform number
itself where p is the same for a whole source, else between quantiles): bin totals first, then a window inside each
(source, bin). A source with a third of all rows is dealt over as many tasks as it has bins. What is left of the ranking is
one row per source, its last document taken; documents are held against that row and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.llm.common import WORD_PATTERN, fresh_name, small, without, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BINS = 4096
#: Bins where documents of a source are unequally likely.
WEIGHTED_BINS = 256
#: Sources whose rows (some numbers each) are sent to every task; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest; equal keys get equal numbers."""
    digest = F.md5(F.concat_ws("-", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds rank, from 1, by source in code point order, null last: rows are counted range by range, so that sources (hosts,
    say) may be many."""
    by_name = F.col("source").asc_nulls_last()
    ranges = written(sources.repartitionByRange(by_name).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(by_name))
    return ranges.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + inside).drop("range", "start")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of (source, size): source_size and target. Sources in code point order, null last, get the weights in turn.

    The water level rises from round to round: sources that it would fill are full, the others share what is left.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(
        ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * max_repeats)
        .withColumn("level", F.col("most") / F.col("weight")),
        "mix-levels",
    )
    water, full = 0.0, -1
    while True:
        is_full = F.col("level") <= water
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(is_full).alias("full"),
        ).first()
        if row["full"] == full or not row["weight"] or not row["total"]:
            break
        full, water = row["full"], (row["total"] - row["spent"]) / row["weight"]
    return sources.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(water) * F.col("weight")).alias("target"))


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> list[Column]:
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("doc_weight"), F.xxhash64(text_col).alias("text_hash")]


def _expected(rows: DataFrame, max_repeats: int, seed: str) -> DataFrame:
    """Adds whole (certain copies), p and order of documents that carry their source's rate."""
    return (
        rows.withColumn("expected", F.least(F.lit(float(max_repeats)), F.col("rate") * F.col("doc_weight")))
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("order", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    )


#: Documents of a source in their order; equal rows are equal here.
_KEY = ("order", "doc_id", "size", "text_hash")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(small(named, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix_plan(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    seed: str = SEED,
    bins: int = BINS,
) -> DataFrame:
    """One row per source: source_size, target, rate and last, the order key of its last document that gets one copy more
    than its whole ones (null if none does). An empty table gives an empty table."""
    sizes = written(df.select(*_sizes(df, id_col, text_col, source_col, weight_col)), "mix-sizes")
    return _plan(sizes, weights, max_repeats, weight_col is not None, seed, bins)


def _plan(sizes: DataFrame, weights: Sequence[float], max_repeats: int, weighted_docs: bool, seed: str, bins: int) -> DataFrame:
    targets = written(source_targets(sizes, weights, max_repeats), "mix-targets")
    weighted = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("doc_weight")).alias("weighted_size"))
    rate = F.when(F.col("weighted_size") > 0, F.col("target") / F.col("weighted_size")).otherwise(0.0)
    rates = written(_with_source(weighted, targets).select("source", "source_size", "target", rate.alias("rate")), "mix-rates")
    docs = _expected(_with_source(sizes, rates), max_repeats, seed).where("p > 0")
    if weighted_docs:
        cuts = written(docs.groupBy("source").agg(F.percentile_approx("order", [k / WEIGHTED_BINS for k in range(1, WEIGHTED_BINS)], 10 * WEIGHTED_BINS).alias("cuts")), "mix-cuts")
        docs = _with_source(docs, cuts).withColumn("bin", F.expr("size(filter(cuts, c -> c < order))").cast("long")).drop("cuts")
    else:
        docs = docs.withColumn("bin", F.floor(F.col("u") * bins).cast("long"))
    certain = _expected(_with_source(sizes, rates), max_repeats, seed).groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    per_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).select("source", "bin", F.coalesce(F.sum("bin_size").over(per_bin), F.lit(0)).alias("before"))
    # Equal rows are peers of the range frame: they are drawn together, by the middle of their words, or not at all.
    peers = Window.partitionBy("source", "bin").orderBy(*_KEY)
    reached = F.sum("size").over(peers) - F.sum("size").over(Window.partitionBy("source", "bin", *_KEY)) / 2
    summed = docs.withColumn("reached", reached).select("source", "bin", "target", "reached", F.struct(*_KEY).alias("key"))
    open_ = written(certain, "mix-certain")
    within = _with_source(summed, open_)
    drawn = (
        within.alias("d")
        .join(totals.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin")))
        .where(F.col("before") + F.col("reached") <= F.col("target") - F.col("certain"))
        .groupBy("d.source")
        .agg(F.max("key").alias("last"))
    )
    last = written(drawn, "mix-last")
    named = last.withColumnRenamed("source", "_source")
    return written(rates.join(small(named, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-plan")


def _copies(rows: DataFrame, plan: DataFrame, max_repeats: int, seed: str) -> DataFrame:
    drawn = F.coalesce((F.col("p") > 0) & (F.struct(*_KEY) <= F.col("last")), F.lit(False))
    found = _expected(_with_source(rows, plan), max_repeats, seed)
    return found.withColumn("copies", F.col("whole") + F.when(drawn, 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    seed: str = SEED,
    bins: int = BINS,
) -> DataFrame:
    """Per row of df: doc_id, source, size (words), source_size, target, copies and taken (copies * size).

    A null text has size 0; a null source is a source of its own, last in order. weight_col makes documents of one source
    unequally likely (null or negative: 0). Rows with equal ids share one rank and are taken by size, then by a hash of the
    text, so reruns agree whatever the order of the rows; equal rows are taken together. Only the id, the source and the
    text are read. An empty table gives an empty table.
    """
    sizes = written(df.select(*_sizes(df, id_col, text_col, source_col, weight_col)), "mix-sizes")
    rows = _copies(sizes, _plan(sizes, weights, max_repeats, weight_col is not None, seed, bins), max_repeats, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(df: DataFrame, plan: DataFrame, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of df that the mix of mix_plan takes, with their copies and taken words; columns of these names are replaced.

    Rows are held against their source's row of the plan, so repeated ids are told apart and no text is shuffled.
    """
    rows = without(df, ["copies", "taken"])
    whole = fresh_name(df, "mix_row")
    named = df.select(*_sizes(df, id_col, text_col, source_col, None), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(whole))
    return _copies(named, plan, max_repeats, seed).where("copies > 0").select(f"{whole}.*", "copies", "taken")


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes GROUP BY source
), levels AS (
  SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 3 AS most FROM named
), filled AS (
  SELECT *, most / weight AS level,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
  FROM levels
), targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (min(CASE WHEN water <= level THEN {{'a': level, 'b': rank, 'c': water}} END) OVER ()).c) AS target FROM filled
), expected AS (
  SELECT d.doc_id, d.source, d.size, source_size, target,
         least(3.0, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END) AS expected,
         (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '-{SEED}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), parts AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM expected
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ord FROM parts
), summed AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY ord NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS reached,
         sum(whole * size) OVER (PARTITION BY source) AS certain FROM ranked
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND reached - size / 2.0 <= target - certain THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""
