"""The two weekly jobs as compositions of operators: price generation and deal analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions import labels, text, units
from priceloom.operators import matching, series


def weekly_prices(offers: DataFrame, catalog: DataFrame, manifest: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """(feed, family, week, price): for every week of the manifest the accepted offer's unit price.

    offers carry feed, week_start, row_seq and the offer columns; catalog rows are compiled (include_pattern,
    exclude_pattern, prefer, rule, baseline, lowest, rules); manifest has feed and week_start; taxonomy has the product types
    (ord, type, pattern) that the rules name. Everything but the history
    checks is computed without state, then one fold per series decides week by week.
    """
    rows = offers.withColumn("text", text.split_text())
    found = units.with_unit_price(matching.match_offers(rows, catalog, "text", "package_text"))
    priced = F.col("unit_price").isNotNull()
    found = found.withColumns({"score": matching.preference_score(F.col("text"), F.col("prefer"), priced), "keyword_confidence": F.coalesce(matching.match_confidence(F.col("text"), F.col("prefer"), priced), F.lit("low"))})
    role, kind, promo, raw = (F.col(c) for c in ("price_role_guess", "promo_type_guess", "promo_text", "raw_offer_text"))
    untrusted = text.is_untrusted_crop(F.col("review_reasons"), promo, kind, F.col("price_basis"), F.col("unit_price"), F.col("baseline"))
    usable = ~text.is_everyday_shelf(role, kind, promo, raw) & ~untrusted & ~text.above_baseline(F.col("unit_price"), F.col("baseline"))
    basis = F.lower(F.coalesce(F.col("price_basis"), F.lit("")))
    found = found.withColumns(
        {
            "full_text": text.joined("split_product_text", "raw_offer_text", "promo_text", "package_text"),
            "unit_hint": units.unit_hint(text.joined("split_product_text", "package_text"), F.col("package_unit"), F.col("price_basis")),
            "priced": F.col("price").isNotNull() | basis.isin("bogo", "buy_x_get_y"),
            "_typed_text": F.concat_ws(" ", "text", F.lower("package_text")),
        }
    )
    if taxonomy is None:
        found = found.withColumn("types", F.array().cast("array<string>"))
    else:
        texts = rows.select(F.concat_ws(" ", "text", F.lower("package_text")).alias("_typed_text")).distinct()
        found = found.join(matching.classify_types(texts, taxonomy, "_typed_text", "_typed_text"), "_typed_text", "left")
    gated = matching.eligibility(found.drop("_typed_text"))
    ranked = matching.rank_candidates(gated.withColumn("week", F.col("week_start")), ["feed", "week", "family"], F.col("lowest"), usable=usable)
    accepted = matching.accept_over_time(ranked.withColumn("advertised_price", F.col("price")), ["feed", "family"])
    entries = accepted.select("feed", "family", "week", F.col("unit_price").alias("price"))
    weeks = manifest.select("feed", F.col("week_start").alias("week"))
    families = catalog.select("family").crossJoin(F.broadcast(manifest.select("feed").distinct()))
    return series.price_spine(entries, families, weeks)


def deal_analysis(prices: DataFrame, current: DataFrame) -> DataFrame:
    """Current prices with their benchmarks, bucket and historical label, ranked within each feed."""
    rows = series.benchmarks(prices, current)
    price, low, median = F.col("current_price"), F.col("all_time_low"), F.col("median_price")
    rows = rows.withColumns(
        {
            "bucket": series.benchmark_bucket(price, low, F.col("ninety_day_low"), median, F.col("n_obs")),
            "label": labels.historical_label(price, low, median, F.col("n_obs")),
            "on_sale": F.coalesce(F.col("pct_below_median") >= 5, F.lit(False)),
            "discount_percent": F.col("pct_below_median"),
            "name": F.col("family"),
            "id": F.col("family"),
        }
    )
    return series.deal_quality(rows, "feed").drop("discount_percent", "name", "id")
