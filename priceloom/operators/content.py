"""Watchlists, product views, shortlists and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import dimension


def eligible_watchlist(watchlist: DataFrame, market: str) -> DataFrame:
    """Included rows of the market or of all markets."""
    return watchlist.where(F.col("include") & F.lower("market").isin("all", market.lower()))


def active_catalog(catalog: DataFrame) -> DataFrame:
    """Rows that are not excluded and whose confidence is not inactive."""
    return catalog.where(~F.coalesce("is_excluded", F.lit(False)) & (F.lower(F.coalesce("confidence", F.lit(""))) != "inactive"))


def search_section(view: DataFrame, text: str | None, section: str | None, columns: Sequence[str] = ("name", "subtitle")) -> DataFrame:
    """Rows whose text columns contain the words and that lie in the section; blank filters pass all."""
    if text and text.strip():
        view = view.where(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower()))
    return view.where(F.col("section") == section) if section else view


def open_corrections(corrections: DataFrame, kind: str) -> DataFrame:
    """Reviewed corrections of a kind that carry an id, a family and a text."""
    return corrections.where((F.col("kind") == kind) & (F.col("status") == "reviewed")).where("id IS NOT NULL AND family IS NOT NULL AND trim(text) <> ''")


def match_watchlist(watchlist: DataFrame, best: DataFrame, display: DataFrame) -> DataFrame:
    """Watchlist rows with the best offer of their family and its display name; only those with an accepted offer."""
    return watchlist.join(best.where("decision = 'accepted'"), "family").join(display, "family", "left")


def unmatched_food(offers: DataFrame, matches: DataFrame, key: str, food: str, household: str, text: str = "text") -> DataFrame:
    """Offers that no match uses, whose text looks like food and not like household goods."""
    return offers.join(matches.select(key).distinct(), key, "left_anti").where(F.lower(text).rlike(food) & ~F.lower(text).rlike(household))


def enrich_sparse(view: DataFrame, fallback: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows without a chartable price take all values of a fallback row that has one."""
    other = fallback.where("is_chartable").select(key, F.struct(*values).alias("_f"))
    take = ~F.col("is_chartable") & F.col("_f").isNotNull()
    return view.join(other, key, "left").select(key, *[F.when(take, F.col(f"_f.{v}")).otherwise(F.col(v)).alias(v) for v in values], take.alias("is_enriched"))


def popular_picks(curated: DataFrame, editorial: DataFrame, view: DataFrame) -> DataFrame:
    """Picks of a week: the editorial list where the week has one, else the curated default; the product's price unless overridden."""
    weeks = editorial.select("week").distinct()
    default = curated.join(weeks, "week", "left_anti")
    picks = editorial.unionByName(default, allowMissingColumns=True)
    return picks.join(view, "family", "left").withColumn("shown_price", F.coalesce("price_override", "price"))


#: Rows of a seed list that are sent to every task; a longer list is joined by store.
BROADCAST_SEEDS = 20_000


def shortlist_items(seed: DataFrame, offers: DataFrame) -> DataFrame:
    """Per seed row (item, store, query) the first offer of the store whose text contains the query; seeds without one stay.

    Offers stay where they are while the list is short; what is found is combined before it shuffles.
    """
    hits = dimension(seed, BROADCAST_SEEDS).alias("s").join(offers.alias("o"), (F.col("s.store") == F.col("o.store")) & F.col("o.text").contains(F.col("s.query")))
    first = hits.groupBy("s.item", "s.store").agg(F.min_by("o.text", "o.row_seq").alias("text"), F.min_by("o.price", "o.row_seq").alias("price"))
    return seed.join(first, ["item", "store"], "left")


def mapping_coverage(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """Items per section with warehouse data, with a known gap, and unmapped."""
    joined = items.join(mappings.select("item", "is_coverage_gap").dropDuplicates(["item"]), "item", "left")
    return joined.groupBy("section").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.coalesce(~F.col("is_coverage_gap"), F.lit(False))).alias("n_with_data"),
        F.count_if(F.coalesce("is_coverage_gap", F.lit(False))).alias("n_gap"),
        F.count_if(F.col("is_coverage_gap").isNull()).alias("n_unmapped"),
    )


def handpicked_groups(items: DataFrame, badges: dict[str, str]) -> DataFrame:
    """Items by the category of their badge, in the order of the map; other badges are left out."""
    kind = F.create_map(*[F.lit(x) for pair in badges.items() for x in pair])[F.col("badge")]
    order = list(dict.fromkeys(badges.values()))
    grouped = items.withColumn("category", kind).where("category IS NOT NULL").groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"), F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("category")).cast("int"))


def input_audit(rows: DataFrame) -> DataFrame:
    """Counts of (is_food, search_status, needs_selection) rows."""
    return rows.agg(
        F.count_if("is_food").alias("food_kept"),
        F.count_if(~F.col("is_food")).alias("food_excluded"),
        F.count_if(F.col("search_status") == "ok").alias("ok_searches"),
        F.count_if(F.col("search_status") != "ok").alias("failed_searches"),
        F.count_if("needs_selection").alias("needs_selection"),
    )


def rank_historical(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """historical_rank: lows, ties, near lows, then below the median, then the advantage; review rows last."""
    low = lambda name: F.when(F.col("label") == name, 0).otherwise(1)
    order = [F.col("is_review"), low("all-time low"), low("tied all-time low"), low("within 5% of all-time low"), F.coalesce("pct_below_median", F.lit(0.0)).desc(), F.coalesce("advantage", F.lit(0.0)).desc(), "id"]
    return rows.withColumn("historical_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rank_deals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """deal_order: $5 Friday first, then the score, then the confidence."""
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return rows.withColumn("deal_order", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("is_friday").desc(), F.col("score").desc(), sure, "id")))


def deal_type(promo: Column, availability: Column) -> Column:
    """Label of a promotion; a Friday-only offer is one whatever its mechanic."""
    names = {"bogo": "Buy one, get one", "buy_x_get_y": "Buy some, get some", "multi_buy": "Multi-buy", "member_price": "Member price", "digital_coupon": "Digital coupon"}
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[promo]
    return F.when(availability == "friday_only", "$5 Friday").otherwise(F.coalesce(label, F.lit("Sale")))


def missed_deal_order() -> list[Column]:
    """Sort keys of the report on missed deals: high, medium and info severities, others last."""
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "info", 2).otherwise(9)
    return [severity.asc(), F.col("feed"), F.col("week"), F.col("family")]


def worsened_order() -> list[Column]:
    """Sort keys of the report on prices that worsened: the highest ratio first."""
    return [F.col("ratio").desc(), F.col("family")]


def crop_override_order() -> list[Column]:
    """Sort keys of the report on overridden crops: those that may bleed first."""
    return [F.when(F.col("note").contains("bleed"), 0).otherwise(1).asc(), F.col("feed"), F.col("page"), F.col("offer_index")]


def mention_order() -> list[Column]:
    """Sort keys of mentions: priority, views, then the query."""
    return [F.col("priority").desc(), F.col("views").desc(), F.col("query")]
