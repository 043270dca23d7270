"""Weekly price series: spines, baselines, as-of lookups, benchmarks and windows.

A series has one row per (keys, week). `keys` defaults to (feed, family); prices may be null where a week has no deal.
Everything is grouped or windowed by the series' keys, so a partition holds whole series and nothing else is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import dimension
from priceloom.functions.units import rounded

KEYS = ("feed", "family")


def _by(keys: Sequence[str], week: str = "week") -> Window:
    return Window.partitionBy(*keys).orderBy(week)


def chartable(series: DataFrame) -> DataFrame:
    """Weeks with a price and a confidence that is not low."""
    return series.where("price IS NOT NULL AND confidence IS NOT NULL AND confidence <> 'low'")


def offers_by_week(offers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Offers of the manifest's weeks with the week's end and source."""
    return offers.join(manifest.select("week_start", "week_end", "source_file"), "week_start")


def attach_baselines(series: DataFrame, baselines: DataFrame, legacy: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of shelf prices. Baselines under a legacy id count for its family unless the family has an entry of its own."""
    feed, family = keys
    direct = baselines.select(feed, family, F.col("price").alias("baseline"), F.lit(0).alias("via"))
    if legacy is not None:
        mapped = baselines.join(legacy, baselines[family] == legacy["legacy_id"]).select(feed, F.col("family_id").alias(family), F.col("price").alias("baseline"), F.lit(1).alias("via"))
        direct = direct.unionByName(mapped)
    best = direct.groupBy(feed, family).agg(F.min_by("baseline", F.struct("via", "baseline")).alias("baseline"))
    return series.join(best, [feed, family], "left")


def price_spine(prices: DataFrame, families: DataFrame, weeks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every family of a feed in every week of the feed; weeks without an entry get a null price. Both sides are dimensions."""
    feed, family = keys
    return families.select(feed, family).distinct().join(weeks.select(feed, "week").distinct(), feed).join(prices, [feed, family, "week"], "left")


def fill_legacy_prices(series: DataFrame, legacy: DataFrame, keys: Sequence[str] = ("family", "week")) -> DataFrame:
    """Prices of the legacy series where the target week is absent or null; filled marks the copied rows."""
    old = legacy.select(*keys, F.col("price").alias("legacy_price"))
    return series.join(old, list(keys), "full_outer").select(
        *keys, F.coalesce("price", "legacy_price").alias("price"), (F.col("price").isNull() & F.col("legacy_price").isNotNull()).alias("filled")
    )


def effective_weekly_price(series: DataFrame) -> DataFrame:
    """The ad price if it is trusted and positive, else the baseline, else the ad price; with its kind and a fallback flag."""
    trusted = F.coalesce((F.col("price") > 0) & (F.coalesce(F.col("confidence"), F.lit("high")) != "low"), F.lit(False))
    return series.withColumns(
        {
            "effective_price": F.when(trusted, F.col("price")).otherwise(F.coalesce("baseline", "price")),
            "price_type": F.when(trusted | F.col("baseline").isNull(), "weekly_ad").otherwise("baseline"),
            "is_baseline_fallback": ~trusted & F.col("baseline").isNotNull(),
        }
    )


def effective_price_as_of(series: DataFrame, date: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series the newest price among the weeks active on the date, else the weeks begun by then, else all; else the baseline."""
    usable = F.col("price").isNotNull() & (F.coalesce(F.col("confidence"), F.lit("high")) != "low")
    begun = F.col("week") <= date
    active = begun & (date <= F.col("week_end"))
    newest = lambda test: F.max_by("price", F.when(test, F.col("week")))
    return series.groupBy(*keys).agg(
        newest(usable & active).alias("active_price"),
        newest(usable & begun).alias("begun_price"),
        newest(usable).alias("any_price"),
        F.max("baseline").alias("baseline"),
    ).select(*keys, F.coalesce("active_price", "begun_price", "any_price", "baseline").alias("effective_price"))


def effective_price_by_first_entry(prices: DataFrame, weeks: DataFrame, ids: DataFrame, baselines: DataFrame, date: Column, feed: str = "feed") -> DataFrame:
    """(feed, product, effective_price) of baselines (feed, product, baseline): the newest trusted price of the weeks that count.

    weeks (feed, week, week_end): those of a feed that are active on the date count, if there are none those begun by then,
    if there are none all. ids (product, family, ord): in each week the first family that has an entry in prices (feed,
    family, week, price, confidence) speaks for the product, priced or not; a price without confidence or of low
    confidence is not trusted. Without a trusted price it is the baseline.
    """
    begun = F.col("week") <= date
    active = begun & (date <= F.col("week_end"))
    tiers = weeks.groupBy(feed).agg(F.count_if(active).alias("n_active"), F.count_if(begun).alias("n_begun"))
    counts = F.when(F.col("n_active") > 0, active).when(F.col("n_begun") > 0, begun).otherwise(True)
    usable = weeks.join(dimension(tiers), feed).where(counts).select(feed, "week").distinct()
    entry = prices.join(ids, "family").join(usable, [feed, "week"]).groupBy(feed, "product", "week").agg(F.min_by(F.struct("price", "confidence"), F.struct("ord", "family")).alias("e"))
    trusted = F.col("e.price").isNotNull() & F.coalesce(F.col("e.confidence") != "low", F.lit(False))
    newest = entry.groupBy(feed, "product").agg(F.max_by("e.price", F.when(trusted, F.col("week"))).alias("price"))
    return baselines.join(newest, [feed, "product"], "left").select(feed, "product", F.coalesce("price", "baseline").alias("effective_price"))


def benchmarks(series: DataFrame, current: DataFrame, keys: Sequence[str] = KEYS, days: int = 90, exclude_current: bool = True) -> DataFrame:
    """Per row of current (keys, week, current_price): all-time low, 90-day low, median, latest price, count and two percentages.

    exclude_current takes the weeks before the row's week as history; otherwise its own week counts too. The 90-day window
    is [week - days, week). Statistics of a series come from one grouping of the join on its keys.
    """
    before = F.col("h.week") < F.col("c.week") if exclude_current else F.col("h.week") <= F.col("c.week")
    names = [F.col(f"c.{k}") for k in keys]
    joined = current.alias("c").join(series.where("price IS NOT NULL").alias("h"), [F.col(f"c.{k}") == F.col(f"h.{k}") for k in keys] + [before], "left")
    price, recent = F.col("h.price"), F.col("h.week") >= F.date_sub(F.col("c.week"), days)
    low, median = F.col("all_time_low"), F.col("median_price")
    grouped = joined.groupBy(*names, F.col("c.week"), F.col("c.current_price")).agg(
        F.min(price).alias("all_time_low"),
        F.min(F.when(recent, price)).alias("ninety_day_low"),
        rounded(F.median(price), 4).alias("median_price"),
        F.max_by(price, F.col("h.week")).alias("latest_price"),
        F.count(price).alias("n_obs"),
    )
    return grouped.withColumns(
        {
            "pct_above_low": F.when(low > 0, F.round((F.col("current_price") - low) / low * 100, 2)),
            "pct_below_median": F.when(median > 0, F.round((median - F.col("current_price")) / median * 100, 2)),
        }
    )


def benchmark_bucket(
    price: Column, low: Column, ninety: Column, median: Column, n: Column, least: int = 2, tolerance: float = 1.001, near: float = 1.05, strong_ninety: float = 0.999, strong: float = 0.97, normal: float = 1.03
) -> Column:
    return (
        F.when(price.isNull() | (n < least), "insufficient history")
        .when(price <= low * tolerance, "all-time low")
        .when(price <= low * near, "near all-time low")
        .when((price < ninety * strong_ninety) | (price < median * strong), "strong sale")
        .when(price <= median * normal, "normal sale")
        .otherwise("weak sale")
    )


def trailing_low(series: DataFrame, keys: Sequence[str] = KEYS, days: int = 90) -> DataFrame:
    """ninety_day_low of each week from the days before it."""
    day = F.datediff("week", F.lit("1970-01-01"))
    window = Window.partitionBy(*keys).orderBy("day").rangeBetween(-days, -1)
    return series.withColumn("day", day).withColumn("ninety_day_low", F.min("price").over(window)).drop("day")


def recent_low(series: DataFrame, keys: Sequence[str] = KEYS, points: int = 13) -> DataFrame:
    """The low of the last points of each series, where no week is given to count days from."""
    newest = Window.partitionBy(*keys).orderBy(F.col("week").desc())
    ranked = series.where("price IS NOT NULL").withColumn("n", F.row_number().over(newest))
    return ranked.where(F.col("n") <= points).groupBy(*keys).agg(F.min("price").alias("recent_low"), F.count(F.lit(1)).alias("n_points"))


def prior_week_price(spine: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """prior_price of the week before on the spine, null where that week has none."""
    return spine.withColumn("prior_price", F.lag("price").over(_by(keys)))


def historical_low_before(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return series.withColumn("low_before", F.min("price").over(_by(keys).rowsBetween(Window.unboundedPreceding, -1)))


def prior_matched_week(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """matched_week and matched_price of the last earlier week that has a price."""
    seen = F.when(F.col("price").isNotNull(), F.struct("week", "price"))
    last = F.last(seen, ignorenulls=True).over(_by(keys).rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn("_m", last).withColumns({"matched_week": F.col("_m.week"), "matched_price": F.col("_m.price")}).drop("_m")


def week_over_week_worsens(series: DataFrame, keys: Sequence[str] = KEYS, factor: float = 1.5, delta: float = 1.5) -> DataFrame:
    """Weeks whose price is at least factor times, or delta above, the last matched one."""
    rows = prior_matched_week(series, keys).where("price IS NOT NULL AND matched_price > 0")
    return rows.withColumn("ratio", F.round(F.col("price") / F.col("matched_price"), 4)).where(
        (F.col("price") / F.col("matched_price") >= factor) | (F.col("price") - F.col("matched_price") >= delta)
    )


def historical_stats(series: DataFrame, keys: Sequence[str] = KEYS, text: str | None = None) -> DataFrame:
    """min, median, average, weeks seen and the first week (and text) at the minimum."""
    extra = [F.min_by(text, F.struct("price", "week")).alias("text_at_min")] if text else []
    return series.where("price IS NOT NULL").groupBy(*keys).agg(
        F.min("price").alias("min_price"),
        rounded(F.median("price"), 4).alias("median_price"),
        rounded(F.avg("price"), 4).alias("avg_price"),
        F.count(F.lit(1)).alias("weeks_seen"),
        F.min_by("week", F.struct("price", "week")).alias("first_week_at_min"),
        *extra,
    )


def inferred_baseline(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The store baseline, else the highest trusted ad price."""
    trusted = F.coalesce(F.col("confidence"), F.lit("high")) != "low"
    return series.groupBy(*keys).agg(F.max(F.when(trusted, F.col("price"))).alias("inferred"), F.max("baseline").alias("store")).select(
        *keys, F.coalesce("store", "inferred").alias("effective_baseline")
    )


def observed_range(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lowest and highest price with the baseline among them, the newest price and its whole percent off the baseline."""
    rows = series.groupBy(*keys).agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.max("baseline").alias("baseline"), F.max_by("price", F.when(F.col("price").isNotNull(), F.col("week"))).alias("current_price"))
    off = F.round((F.col("baseline") - F.col("current_price")) / F.col("baseline") * 100).cast("int")
    return rows.select(
        *keys, F.least("lo", "baseline").alias("range_low"), F.greatest("hi", "baseline").alias("range_high"), "current_price",
        F.when(F.col("baseline") > 0, F.greatest(off, F.lit(0))).alias("discount_percent"),
    )


def member_week_range(members: DataFrame, keys: Sequence[str] = ("family", "week")) -> DataFrame:
    """Per family and week the range of the members' ad prices, else the lowest effective price; the first member's offer text."""
    return members.groupBy(*keys).agg(
        F.coalesce(F.min("price"), F.min("effective_price")).alias("low"),
        F.max("price").alias("high"),
        F.min_by("offer_text", F.when(F.col("price").isNotNull(), F.col("member"))).alias("offer_text"),
        F.count("price").alias("n_members"),
    )


def rank_from_lowest(series: DataFrame, current: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rank of the current price among the distinct prices, and the last week at or below it."""
    joined = current.select(*keys, "current_price").join(series.where("price IS NOT NULL"), list(keys), "left")
    return joined.groupBy(*keys, "current_price").agg(
        (F.count_distinct(F.when(F.col("price") < F.col("current_price"), F.col("price"))) + 1).alias("rank_from_lowest"),
        F.max(F.when(F.col("price") <= F.col("current_price") + 0.001, F.col("week"))).alias("last_week_at_or_below"),
    )


def recent_observations(series: DataFrame, keys: Sequence[str] = KEYS, n: int = 5) -> DataFrame:
    """The last n points, oldest first; ranked before they are collected, so a list holds n entries at most."""
    newest = Window.partitionBy(*keys).orderBy(F.col("week").desc())
    ranked = series.where("price IS NOT NULL").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("week", "price"))).alias("points"))


def chart_rows(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Priced weeks and one anchor row with the baseline at the first week."""
    points = series.where("price IS NOT NULL").select(*keys, "week", "price", F.lit("point").alias("kind"))
    anchors = series.where("baseline IS NOT NULL").groupBy(*keys).agg(F.min("week").alias("week"), F.max("baseline").alias("price")).withColumn("kind", F.lit("anchor"))
    return points.unionByName(anchors)


def current_week(weeks: DataFrame, as_of: Column, keys: Sequence[str] = ("feed",)) -> DataFrame:
    """Per feed the active week (the latest if two overlap), else the latest that is no preview, else the latest."""
    start, end = F.col("week"), F.col("week_end")
    pick = lambda test: F.max(F.when(test, start))
    active = (F.date_sub(start, 1) <= as_of) & (as_of <= end)
    return weeks.groupBy(*keys).agg(F.coalesce(pick(active), pick(F.date_sub(start, 1) <= as_of), F.max(start)).alias("current_week"), F.max(start).alias("latest_week"))


def preview_deals(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest week's price where it beats the week before it on the spine (or has none to beat)."""
    last = Window.partitionBy(*keys)
    rows = prior_week_price(series, keys).withColumn("latest", F.max("week").over(last))
    return rows.where("week = latest AND price IS NOT NULL AND (prior_price IS NULL OR price < prior_price)").select(*keys, "week", "price", "prior_price")


def merge_card_groups(series: DataFrame, group: str = "card", price: str = "unit_price") -> DataFrame:
    """Per (card, week) the lowest unit price, ad weeks before fallback weeks; the card's lowest baseline."""
    best = Window.partitionBy(group, "week").orderBy("is_baseline_fallback", F.col(price).asc_nulls_last(), "family")
    low = Window.partitionBy(group)
    return series.withColumn("n", F.row_number().over(best)).withColumn("card_baseline", F.min("baseline").over(low)).where("n = 1").drop("n")


def collapse_tail(ranked: DataFrame, section: str, order: list[Column], hidden: int) -> DataFrame:
    """Marks the worst-ranked rows of each section as hidden."""
    back = Window.partitionBy(section).orderBy(*order)
    return ranked.withColumn("from_end", F.row_number().over(back)).withColumn("is_hidden", F.col("from_end") <= hidden).drop("from_end")


def preview_summary(series: DataFrame, as_of: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per feed its latest week, the families tracked, matched and unmatched in it, and whether it is a preview."""
    feed, family = keys
    latest = series.groupBy(feed).agg(F.max("week").alias("week"))
    return series.join(latest, [feed, "week"]).groupBy(feed, "week").agg(
        F.count_distinct(family).alias("tracked"),
        F.count("price").alias("matched"),
        F.sum(F.col("price").isNull().cast("int")).alias("unmatched"),
        F.max(as_of < F.date_sub("week", 1)).alias("is_preview"),
    )


def history_coverage(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether each series has any price."""
    return series.groupBy(*keys).agg(F.bool_or(F.col("price").isNotNull()).alias("has_history"))


def deal_quality(current: DataFrame, section: str | None = None) -> DataFrame:
    """Rank within a section: on sale first, bucket, discount, name, id."""
    buckets = ["all-time low", "near all-time low", "strong sale", "normal sale", "weak sale", "insufficient history"]
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket"))
    order = [F.col("on_sale").desc(), place, F.col("discount_percent").desc_nulls_last(), F.col("name"), F.col("id")]
    return current.withColumn("deal_rank", F.row_number().over(Window.partitionBy(section or F.lit(1)).orderBy(*order)))
