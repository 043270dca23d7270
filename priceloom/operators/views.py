"""Views of a product and of a family: series, baseline, match and warehouse price in one row, and checks on the way there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.units import amount, dealt, measures, rounded, terms_of, tokens
from priceloom.operators.series import effective_weekly_price, inferred_baseline

#: Words of offers that are no groceries, and of party platters.
NON_FOOD = (
    "beer", "wine", "vodka", "whiskey", "liquor", "champagne", "paper towel", "toilet paper", "detergent", "laundry", "fabric softener", "shampoo", "conditioner",
    "pharmacy", "vitamin", "medicine", "dog food", "cat food", "litter", "cleaning", "bleach", "disinfect", "diaper", "baby wipe",
)
PARTY = ("party pack", "party tray", "50 piece", "100 piece", "150 piece")
#: Words of platters that stay.
SPARED_PARTY = ("ben_jerrys",)
#: How far an offer's ounces may lie outside its family's range.
OUNCE_SLACK = 0.05


def is_non_food(text: Column, status: Column | None = None, words: Sequence[str] = NON_FOOD, party: Sequence[str] = PARTY, spared: Sequence[str] = SPARED_PARTY) -> Column:
    """Whether an offer is no grocery, a party platter (unless it says a spared word), or excluded by its status; formula
    counts unless a bar follows."""
    t = F.lower(F.coalesce(text, F.lit("")))
    platter = t.rlike("|".join(party))
    for word in spared:
        platter &= ~F.contains(t, F.lit(word))
    named = t.rlike("|".join(words)) | t.rlike(r"formula(?! bar)") | platter
    return named | F.coalesce(status == "excluded", F.lit(False)) if status is not None else named


def is_listed_query(query: Column, queries: Sequence[str]) -> Column:
    """Whether a query is one of a list, but for case and margins."""
    return F.lower(F.trim(F.coalesce(query, F.lit("")))).isin(*[q.lower() for q in queries])


#: Units that are sold by the piece, a can's highest believable price, and units of a package that count pieces.
PIECE_UNITS = ("each", "ear", "can", "bar")
CAN_LIMIT = 3
COUNTING_UNITS = ("ct", "ct.", "count", "each", "egg", "eggs")


def normalize_for_mapping(rows: DataFrame, reference: str = "baseline") -> DataFrame:
    """Adds unit_price, unit, manual_review, review_reason and confidence of offers in the unit of their mapping.

    rows: offer texts and sizes, price_basis, review_reasons, split_status, advertised_price, comparable_unit and
    match_confidence (null counts as medium). The first that fits: no price; a pound price; a multi-buy of pieces (a can
    above its limit is doubted); a free piece; ounces by the package's size; pieces by its count; the price by its basis.
    Reasons for review are joined in this order: several products, no size where the unit needs one, a broad group, then
    what could not be told. A text without a promotion or size counts as stated.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\$", "").try_cast("double")
    promo = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("promo_text", "raw_offer_text", "split_product_text", "package_text")]))
    least, most = number("package_size_min"), number("package_size_max")
    rows = rows.withColumns({"_promo": promo, "_price": number("advertised_price"), "_size": F.coalesce((least + most) / 2, least, most), "_basis": low("price_basis"), "_why": low("review_reasons")})
    rows = rows.withColumns({"_tokens": tokens(F.col("_promo"))})
    rows = rows.withColumns({"_multi": terms_of(F.col("_tokens"), "multi"), "_free": terms_of(F.col("_tokens"), "buy_get"), "_member": terms_of(F.col("_tokens"), "member"), "_ounces": amount(measures(low("package_text")), "oz")})
    price, unit, size = F.col("_price"), F.col("comparable_unit"), F.col("_size")
    says = lambda *words: F.lit(False) if not words else F.contains(F.col("_why"), F.lit(words[0])) | says(*words[1:])
    grouped = says("ambiguous_multi_product_offer") | F.coalesce(F.col("split_status") == "group_not_split", F.lit(False))
    known = F.array_compact(
        F.array(
            F.when(grouped, "multi-product offer"),
            F.when(says("missing_package_size") & unit.isin("oz", "each"), "missing package size"),
            F.when(says("broad_group_needs_human_grounding"), "broad grouped offer"),
        )
    )
    rows = rows.withColumn("_reasons", known)
    doubts = F.size("_reasons") > 0
    sure = F.when(doubts, "medium").otherwise("high")
    count_price = rounded(F.get("_multi", 1) / F.nullif(F.get("_multi", 0), F.lit(0.0)), 4)
    bought, free = F.get("_free", 0), F.get("_free", 1)
    bogo = F.col("_promo").rlike("bogo") | ((bought == 1) & (free == 1))
    half = F.coalesce(F.when(F.coalesce(bogo, F.lit(False)), rounded(price / 2, 4)), rounded(price * bought / F.nullif(bought + free, F.lit(0.0)), 4))
    ounces = F.coalesce(F.nullif(size, F.lit(0.0)), "_ounces")
    multi_basis = F.col("_basis") == "multi_buy"
    pack = F.when(multi_basis & F.contains("_promo", F.lit("2 for")), price / 2).when(multi_basis, F.coalesce(count_price, price)).otherwise(price)
    chips = multi_basis & (F.get("_multi", 0) == 2) & (F.get("_multi", 1) == 5)
    pieces = F.when(low("package_unit").isin(*COUNTING_UNITS) & (size > 1), size)
    counted = F.when(low("package_unit").isin("", "count", "ct", "each"), F.coalesce(least, most))
    base = dealt(price, F.col("_multi"), F.col("_free"), F.col("_promo").rlike(r"\bbogo\b"), F.col("_member"), F.col("_basis"), counted, counted, F.contains("_promo", F.lit("2 for")), F.col(reference))
    match = F.coalesce("match_confidence", F.lit("medium"))
    nothing = F.lit(None).cast("double")

    def out(value: Column, in_unit: Column | str, confidence: Column | str, more: str | None = None) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        reasons = F.col("_reasons") if more is None else F.array_append("_reasons", F.lit(more))
        return F.struct(value.alias("unit_price"), as_column(in_unit).alias("unit"), (doubts if more is None else F.lit(True)).alias("manual_review"), F.nullif(F.array_join(reasons, "; "), F.lit("")).alias("review_reason"), as_column(confidence).alias("confidence"))

    by_count = count_price.isNotNull() & unit.isin(*PIECE_UNITS)
    result = (
        F.when(price.isNull(), F.struct(nothing.alias("unit_price"), unit.alias("unit"), F.lit(True).alias("manual_review"), F.lit("missing advertised price").alias("review_reason"), F.lit("low").alias("confidence")))
        .when((F.col("_basis") == "per_lb") | (low("package_unit") == "lb"), out(rounded(price, 4), "lb", "high"))
        .when(by_count & (unit == "can") & (count_price > CAN_LIMIT), out(nothing, unit, "low", "soda pack price may need manual review"))
        .when(by_count, out(count_price, unit, sure))
        .when(half.isNotNull(), out(half, unit, sure))
        .when((unit == "oz") & (ounces > 0), out(rounded(pack / ounces, 4), "oz", sure))
        .when((unit == "oz") & F.coalesce(chips, F.lit(False)), out(nothing, "oz", "low", "multi-buy chip offer without package size"))
        .when(unit == "oz", out(nothing, "oz", "low", "cannot normalize to per oz"))
        .when(unit.isin("each", "egg") & pieces.isNotNull(), out(rounded(price / pieces, 4), unit, sure))
        .when(base.isNotNull(), out(rounded(base, 4), unit, match))
        .otherwise(out(nothing, unit, "low", "unable to normalize unit price"))
    )
    done = rows.withColumn("_out", result)
    return done.select(*[c for c in done.columns if not c.startswith("_") and c not in ("unit_price", "unit", "manual_review", "review_reason", "confidence")], "_out.*")


def mapping_weekly_series(rows: DataFrame, keys: Sequence[str] = ("mapping", "week")) -> DataFrame:
    """Per key the row with the highest score (the first in file order), if it has a unit price, needs no review and is not of
    low confidence. rows: keys, score, row_seq, unit_price, manual_review, confidence, text."""
    rest = F.struct("unit_price", "manual_review", "confidence", "text")
    best = rows.groupBy(*keys).agg(F.min_by(rest, F.struct((-F.col("score")).alias("s"), "row_seq")).alias("b")).select(*keys, "b.*")
    return best.where("unit_price IS NOT NULL AND NOT manual_review AND coalesce(confidence, '') <> 'low'").select(*keys, "unit_price", "text")


def feed_to_warehouse(feeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Feeds with the warehouse they are paired with (feed, warehouse); null where none is: never another region's."""
    return feeds.join(pairs.groupBy("feed").agg(F.min("warehouse").alias("warehouse")), "feed", "left")


def product_view(series: DataFrame, warehouse: DataFrame, keys: Sequence[str] = ("feed", "family")) -> DataFrame:
    """One row per product: its effective baseline, newest effective price with its kind, the weeks that fall back to the
    baseline, lowest and highest price, and the warehouse's unit price with the percentage that the product is above it.

    series: keys, week, price, baseline, confidence; warehouse: family, warehouse_price (at most one row each). Weeks are
    summed up and never gathered, so a long series costs no more memory than a short one.
    """
    weekly = effective_weekly_price(series)
    newest = F.struct("effective_price", "price_type")
    rows = weekly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum(F.col("is_baseline_fallback").cast("long")).alias("n_fallback"),
        F.min("effective_price").alias("low"),
        F.max("effective_price").alias("high"),
        F.max_by(newest, "week").alias("newest"),
    )
    above = F.when(F.col("warehouse_price") > 0, rounded((F.col("newest.effective_price") - F.col("warehouse_price")) / F.col("warehouse_price") * 100, 2))
    return (
        rows.join(inferred_baseline(series, keys), list(keys))
        .join(warehouse, keys[-1], "left")
        .select(*keys, "effective_baseline", "n_weeks", "n_fallback", "low", "high", F.col("newest.effective_price").alias("current_price"), F.col("newest.price_type").alias("price_type"), "warehouse_price", above.alias("pct_above_warehouse"))
    )


def family_view(members: DataFrame, target: DataFrame, warehouse: DataFrame, family: str = "family") -> DataFrame:
    """One row per family: the highest baseline of its members, the range of their trusted prices in the target week and the
    members on sale, and the range's low against the warehouse's price.

    members: family, member, week, price, baseline, confidence; target: family, week; warehouse: family, warehouse_price.
    """
    base = members.groupBy(family).agg(F.max("baseline").alias("baseline"), F.count_distinct("member").alias("n_members"))
    trusted = F.when(F.coalesce(F.col("confidence"), F.lit("high")) != "low", F.col("price"))
    week = members.join(target, [family, "week"]).groupBy(family).agg(F.min(trusted).alias("sale_low"), F.max(trusted).alias("sale_high"), F.count(trusted).alias("n_on_sale"))
    share = F.when(F.col("warehouse_price") > 0, rounded(F.col("sale_low") / F.col("warehouse_price"), 4))
    return base.join(week, family, "left").join(warehouse, family, "left").select(family, "baseline", "n_members", "sale_low", "sale_high", F.coalesce("n_on_sale", F.lit(0)).alias("n_on_sale"), "warehouse_price", share.alias("share_of_warehouse"))


def ounce_range(subtitle: Column) -> Column:
    """struct(low, high) of a range such as 5-13 oz, null without one."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*[–-]\s*(\d+(?:\.\d+)?)\s*oz"
    low, high = (F.regexp_extract(subtitle, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def comparability(offers: DataFrame) -> DataFrame:
    """Offers with the reasons that forbid a comparison and their tier of history. offers: tracker, feed (null: unsupported),
    is_known, unit_price, package, subtitle, n_obs. The first of the first three reasons ends the list."""
    asked, ounces = ounce_range(F.col("subtitle")), F.regexp_extract("package", r"(?i)(\d+(?:\.\d+)?)\s*oz", 1).try_cast("double")
    outside = F.coalesce((ounces < asked["low"] - OUNCE_SLACK) | (ounces > asked["high"] + OUNCE_SLACK), F.lit(False))
    gate = (
        F.when(F.trim(F.coalesce("tracker", F.lit(""))) == "", F.array(F.lit("missing_tracker_id")))
        .when(F.col("feed").isNull(), F.array(F.lit("unsupported_retailer")))
        .when(~F.coalesce("is_known", F.lit(False)), F.array(F.lit("unknown_tracker")))
        .otherwise(F.array_compact(F.array(F.when(F.col("unit_price").isNull(), "cannot_normalize_unit_price"), F.when(outside, "package_size_out_of_family_range"))))
    )
    tier = F.when(F.coalesce("n_obs", F.lit(0)) <= 1, "insufficient_data").when(F.col("n_obs") <= 3, "limited_data").otherwise("full")
    return offers.withColumns({"reasons": gate, "history_tier": tier}).withColumn("is_comparable", F.size("reasons") == 0)


def collisions(catalog: DataFrame, category_tokens: Sequence[str], generic_terms: Sequence[str]) -> DataFrame:
    """(kind, phrase, families) of a catalog (family, name, brand, aliases, keep_separate): aliases of several families, names that
    hold a category word, brands of several families, brands that are food words, and excluded names of other families.

    Phrases are compared in lower case with one blank between words. Every kind is a grouping or a hash join on the phrase.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    rows = catalog.select("family", norm(F.col("name")).alias("name"), norm(F.col("brand")).alias("brand"), "aliases", "keep_separate")
    listed = F.array_join(F.array_sort(F.collect_set("family")), ",")

    def shared(df: DataFrame, kind: str) -> DataFrame:
        found = df.groupBy("phrase").agg(F.count_distinct("family").alias("n"), listed.alias("families")).where("n > 1")
        return found.select(F.lit(kind).alias("kind"), "phrase", "families")

    own = lambda df, kind: df.select(F.lit(kind).alias("kind"), "phrase", F.col("family").alias("families")).distinct()
    aliases = rows.select("family", F.explode("aliases").alias("a")).select("family", norm(F.col("a")).alias("phrase")).where(F.length("phrase") >= 3)
    brands = rows.select("family", F.when(F.col("brand") != "", F.col("brand")).otherwise(F.col("name")).alias("phrase")).where("phrase <> ''")
    embedded = rows.where(F.arrays_overlap(F.split("name", " "), F.array(*map(F.lit, category_tokens)))).select("family", F.col("name").alias("phrase"))
    generic = rows.where(F.col("brand").isin(*category_tokens, *generic_terms)).select("family", F.col("brand").alias("phrase"))
    names = rows.select(F.col("family").alias("peer"), F.explode(F.array_distinct(F.array("name", "brand", norm(F.translate("family", "_", " "))))).alias("phrase")).where("phrase <> ''")
    asked = rows.select("family", F.explode("keep_separate").alias("a")).select("family", norm(F.col("a")).alias("phrase")).where(F.length("phrase") >= 3).distinct()
    peers = asked.join(names, "phrase").where("family <> peer").groupBy("family", "phrase").agg(F.slice(F.array_sort(F.collect_set("peer")), 1, 4).alias("peers"))
    peers = peers.select(F.lit("keep_separate_peer").alias("kind"), "phrase", F.concat_ws(",", "family", "peers").alias("families"))
    return (
        shared(aliases, "shared_alias")
        .union(own(embedded, "embedded_category_token"))
        .union(shared(brands, "multi_package_brand"))
        .union(own(generic, "brand_is_generic_food_term"))
        .union(peers)
    )


def catalog_eval(cases: DataFrame) -> DataFrame:
    """Per coverage type: cases, those as expected, and confident choices of a forbidden family. cases: coverage_type,
    expected_status, expected_family, family (whose case it is), forbidden (array), action, selected."""
    went, selected = F.col("action") == "continue", F.col("selected")
    bad = F.coalesce(F.array_contains("forbidden", selected), F.lit(False))
    status = F.col("expected_status")
    good = (
        F.when(status == "continue", went & selected.eqNullSafe(F.col("expected_family")))
        .when(status.isin("clarify", "unsupported"), F.col("action") == status)
        .when(status == "clarify_or_unsupported", F.col("action").isin("clarify", "unsupported"))
        .when(status == "any_non_match", ~(went & selected.eqNullSafe(F.col("family"))))
        .otherwise(False)
    )
    ok = F.coalesce(good, F.lit(False)) & ~bad
    return cases.groupBy("coverage_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(bad).alias("n_forbidden"))


#: Weeks and observations that a page holds at most (ten years); older ones are left to the tables.
PAGE_WEEKS = 520
#: Percentage above the warehouse's unit price up to which a family's variety is worth it.
VARIETY_PCT = 25


def _valid(price: Column) -> Column:
    """The price if it is a finite number above 0, else null."""
    return F.when((price > 0) & (price < float("inf")), price)


def _newest(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


_WEEK = ("week", "price", "ad_price", "confidence", "price_type", "is_baseline_fallback", "text")


def _effective_weeks(rows: DataFrame) -> DataFrame:
    """price of (ad_price, effective_price, is_baseline_fallback, effective_baseline): fallback weeks without a valid price get
    the baseline."""
    backfilled = F.col("is_baseline_fallback") & _valid(F.col("effective_price")).isNull() & F.col("effective_baseline").isNotNull()
    return rows.withColumn("price", F.when(F.coalesce(backfilled, F.lit(False)), F.col("effective_baseline")).otherwise(F.col("effective_price")))


def _baselines(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, inferred, has_ad): the highest trusted ad price, and whether there is any ad price that is not of low confidence."""
    trusted = F.col("ad_price").isNotNull() & F.col("confidence").isNotNull() & (F.col("confidence") != "low")
    return series.groupBy(*keys).agg(F.max(F.when(trusted, _valid(F.col("ad_price")))).alias("inferred"), F.bool_or(F.col("ad_price").isNotNull() & ~F.coalesce(F.col("confidence") == "low", F.lit(False))).alias("has_ad"))


def product_page(products: DataFrame, series: DataFrame, matches: DataFrame, comparisons: DataFrame, history: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("feed", "family"), weeks: int = PAGE_WEEKS) -> DataFrame:
    """One row per product of a feed, with what a page shows: its match, effective baseline and its source, weekly prices with
    fallback weeks filled in, the comparison and the paired warehouse's price history.

    products: keys and its columns. series: keys, week, ad_price, effective_price, confidence, price_type,
    is_baseline_fallback, text. matches: keys, sku, baseline_price, baseline_source. comparisons: keys and its columns (one
    row each at most). history: warehouse, family, date, price; pairs: feed, warehouse. Only the newest weeks are gathered,
    so a list is bounded; they are in order. Products without a row elsewhere keep nulls and empty lists.
    """
    on = list(keys)
    base = products.join(matches, on, "left").join(_baselines(series, keys), on, "left")
    store = _valid(F.col("baseline_price"))
    base = base.withColumn("effective_baseline", F.coalesce(store, "inferred"))
    source = F.coalesce("baseline_source", F.when(F.col("inferred").isNotNull() & F.col("effective_baseline").isNotNull(), "inferred"))
    has_data = store.isNotNull() | F.coalesce("has_ad", F.lit(False)) | F.col("effective_baseline").isNotNull()
    base = base.withColumns({"baseline_source": source, "has_feed_data": has_data}).drop("inferred", "has_ad")
    placed = _effective_weeks(_newest(series, keys, "week", weeks).join(base.select(*on, "effective_baseline"), on))
    weekly = placed.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*_WEEK))).alias("weekly_prices"))
    compared = comparisons.select(*on, F.struct(*[c for c in comparisons.columns if c not in keys]).alias("comparison"))
    points = _newest(history, ["warehouse", keys[-1]], "date", weeks).groupBy("warehouse", keys[-1]).agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("warehouse_history"))
    rows = base.join(weekly, on, "left").join(compared, on, "left").join(feed_to_warehouse(base.select(keys[0]).distinct(), pairs), keys[0], "left").join(points, ["warehouse", keys[-1]], "left")
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return rows.select(*[c for c in base.columns if c != "baseline_price"], empty("weekly_prices", weekly), "comparison", "warehouse", empty("warehouse_history", points))


def family_page(members: DataFrame, as_of: Column, units: DataFrame, keys: Sequence[str] = ("feed", "family"), weeks: int = PAGE_WEEKS) -> DataFrame:
    """One row per family of a feed: its members with their baselines and current prices, its weeks with the range of trusted ad
    prices, baseline, price range, this week's sale price, and the unit price against the warehouse's.

    members: keys, member, week, week_end, is_preview, ad_price, effective_price, confidence, price_type,
    is_baseline_fallback, baseline, text, one row for every week of a feed. units: family, ounces, warehouse_unit_price.
    The sale is that of the latest week active at as_of with an ad price, else of the latest one that is no preview. A
    member whose baseline is null has the highest trusted ad price as one; nulls elsewhere stay nulls.
    """
    on, each = list(keys), [*keys, "member"]
    recent = members.where(F.col("week").isNotNull())
    stated = members.groupBy(*each).agg(F.max(_valid(F.col("baseline"))).alias("stated"))
    base = stated.join(_baselines(members, each), each).select(*each, F.coalesce("stated", "inferred").alias("effective_baseline"))
    placed = _effective_weeks(recent.join(base, each))
    views = placed.groupBy(*each).agg(F.max_by("price", "week").alias("last"), F.max("effective_baseline").alias("member_baseline"))
    views = views.withColumn("current_price", F.coalesce("last", "member_baseline"))
    of_members = views.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct("member", F.coalesce("member_baseline", F.lit(0.0)).alias("baseline"), "current_price"))).alias("members"),
        F.min(_valid(F.col("member_baseline"))).alias("range_low"),
        F.max(_valid(F.col("member_baseline"))).alias("range_high"),
    )
    trusted = F.when(F.col("confidence").isNotNull() & (F.col("confidence") != "low"), F.col("ad_price"))
    weekly = placed.groupBy(*on, "week").agg(
        F.min(trusted).alias("ad_price"), F.max(trusted).alias("ad_max"), F.min("price").alias("lowest"), F.max("week_end").alias("week_end"), F.coalesce(F.bool_or("is_preview"), F.lit(False)).alias("is_preview"),
        F.min_by("text", F.when(F.col("text").isNotNull(), F.col("member"))).alias("text"),
    )
    weekly = weekly.withColumns({"price": F.coalesce("ad_price", "lowest"), "price_type": F.when(F.col("ad_price").isNotNull(), "weekly_ad").otherwise("baseline")})
    active = (F.col("week") <= as_of) & (as_of <= F.coalesce("week_end", "week"))
    when = lambda where: F.when(where & F.col("ad_price").isNotNull(), F.col("week"))
    sums = weekly.groupBy(*on).agg(F.coalesce(F.max_by("ad_price", when(active)), F.max_by("ad_price", when(~F.col("is_preview")))).alias("sale_price"), F.max(_valid(F.col("ad_price"))).alias("inferred"))
    listed = _newest(weekly, keys, "week", weeks).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("week", "price", "ad_price", "ad_max", "price_type", "text"))).alias("weekly_prices"))
    rows = of_members.join(sums, on).join(listed, on).join(units, keys[-1], "left")
    rows = rows.withColumns({"baseline": F.coalesce("range_high", "inferred"), "chart_mode": F.when(F.size("members") > 1, "range").otherwise("single")})
    unit = F.coalesce("sale_price", F.get("members", 0)["baseline"], "baseline") / _valid(F.col("ounces"))
    above = (unit - F.col("warehouse_unit_price")) / _valid(F.col("warehouse_unit_price")) * 100
    rows = rows.withColumns({"unit_price": rounded(unit, 4), "pct_above_warehouse": rounded(above, 2), "badge": F.when(above <= VARIETY_PCT, "more_variety").when(above > VARIETY_PCT, "best_value_warehouse")})
    return rows.select(*on, "members", "weekly_prices", "baseline", "range_low", "range_high", "sale_price", "chart_mode", "unit_price", "pct_above_warehouse", "badge")


def assessment_eval(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases (expect_verdict, verdict), those with an expected verdict, and those of them whose verdict is it; a null verdict
    is none."""
    judged = F.col("expect_verdict").isNotNull()
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("judged"), F.count_if(judged & (F.col("expect_verdict") == F.col("verdict"))).alias("matched"))
