"""The expanded shortlist: every priced offer with its score, label and reason, and the headline of each class by store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions.units import rounded

#: Points of the first of these words in a name, and of a name with none.
POPULARITY = {
    "doritos": 15, "ruffles": 12, "cheetos": 12, "lay": 12, "oreo": 14, "ritz": 13, "cheez-it": 12, "chips ahoy": 11, "butter": 16, "egg": 16, "chicken": 18, "avocado": 17, "strawberr": 16,
    "grape": 14, "cherr": 14, "corn": 13, "salmon": 12, "ben & jerry": 15, "ice cream": 14, "coca": 13, "pepsi": 12, "cereal": 11, "pork": 14, "ground beef": 15, "whole chicken": 17,
}
UNKNOWN_NAME = 5
#: The categories in order, with the words that say them.
CATEGORIES: Mapping[str, Sequence[str]] = {
    "produce": ("avocado", "mango", "grape", "cherr", "corn", "peach", "plum", "nectarine", "berry", "apple", "melon", "banana", "pepper", "lettuce", "salad"),
    "meat": ("chicken", "beef", "pork", "salmon", "shrimp", "lamb", "turkey", "rib", "steak", "ground", "bacon", "sausage"),
    "dairy": ("butter", "egg", "cheese", "yogurt", "milk", "cream cheese"),
    "snacks": ("doritos", "ruffles", "cheetos", "lay", "oreo", "ritz", "cheez", "goldfish", "chips ahoy", "tostitos", "frito", "cracker", "cookie", "bar", "clif", "quest", "kind"),
    "drinks": ("coca", "pepsi", "dr pepper", "sparkling", "la croix", "lacroix", "celsius", "juice", "tea", "water", "soda", "7up"),
    "frozen": ("ice cream", "ben", "jerry", "haagen", "tillamook", "klondike", "talenti", "yasso", "pizza", "frozen"),
    "pantry": ("cereal", "kellogg", "kashi", "pasta", "macaroni", "pillsbury", "oil"),
}
STAPLES = ("dairy", "meat", "pantry")
#: Points by bucket of history, and of steps (at least, points) below the baseline and below the warehouse.
BUCKETS = {"all-time low": 20, "near all-time low": 15, "strong sale": 10, "normal sale": 4}
BELOW_BASELINE = ((40, 25), (20, 15), (10, 8))
BELOW_WAREHOUSE = ((15, 20), (0, 10), (-10, 5))
ABOVE_BASELINE, ABOVE_WAREHOUSE = -10, -8
FULL_WEEK, FRIDAY_ONLY, WRONG_MATCH, BULK, LOW_CONFIDENCE = 10, -12, -40, -3, -15
#: Scores from which an offer leads, supports, is worth a mention or a check, and from which none.
LEAD, SUPPORT, MENTION, CHECK = 70, 55, 35, 30


def _first_word(name: Column, words: Mapping[str, int], default: int) -> Column:
    out = None
    for word, points in words.items():
        hit = F.contains(name, F.lit(word))
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return F.lit(default) if out is None else out.otherwise(default)


def _steps(value: Column, steps: Sequence[tuple[int, int]], below: Column) -> Column:
    out = None
    for least, points in steps:
        out = F.when(value >= least, points) if out is None else out.when(value >= least, points)
    return F.when(value.isNull(), 0).otherwise(out.otherwise(below))


def category_of(name: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    """The first category one of whose words stands in a name, else other."""
    out = F.lit(None).cast("string")
    low = F.lower(F.coalesce(name, F.lit("")))
    for category, words in categories.items():
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(low, F.lit(w))
        out = F.coalesce(out, F.when(hit, category))
    return F.coalesce(out, F.lit("other"))


def shortlist_facts(offers: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """Adds baseline_pct (how far the price lies below the baseline), warehouse_pct (below the warehouse's), category and
    confidence to priced offers (name, price, effective_price, baseline, warehouse_unit_price, caveats, split_confidence);
    offers without a name or a price above 0 are dropped."""
    price = F.coalesce("effective_price", "price")
    below = lambda base: F.when((base > 0) & price.isNotNull(), rounded((base - price) / base * 100, 1))
    low = F.lower("name")
    confidence = (
        F.when(F.contains(low, F.lit("2 liter")) | F.coalesce(F.col("split_confidence") < 0.75, F.lit(False)), "Low")
        .when((F.size(F.coalesce("caveats", F.array().cast("array<string>"))) > 0) | F.contains(low, F.lit("selected varieties")), "Medium")
        .otherwise("High")
    )
    kept = offers.where("price > 0 AND trim(coalesce(name, '')) <> ''")
    return kept.withColumns({"baseline_pct": below(F.col("baseline")), "warehouse_pct": below(F.col("warehouse_unit_price")), "category": category_of(F.col("name"), categories), "confidence": confidence})


def expanded_shortlist(facts: DataFrame, popularity: Mapping[str, int] = POPULARITY) -> DataFrame:
    """Adds script_score, script_label and script_reason to the facts (name, category, bucket, baseline_pct, warehouse_pct,
    availability, confidence, caveats). Unknown numbers neither add nor take; a null availability is another one."""
    low, caveats = F.lower("name"), F.transform(F.coalesce("caveats", F.array().cast("array<string>")), F.lower)
    says = lambda text: F.exists(caveats, lambda c: F.contains(c, F.lit(text)))
    bulk = F.size(F.filter(caveats, lambda c: F.contains(c, F.lit("10 lb bag")) | F.contains(c, F.lit("buy 10")) | F.contains(c, F.lit("buy 4"))))
    b, w = F.col("baseline_pct"), F.col("warehouse_pct")
    of_bucket = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])[F.col("bucket")]
    available = F.coalesce("availability", F.lit(""))
    score = (
        _first_word(low, popularity, UNKNOWN_NAME)
        + _steps(b, BELOW_BASELINE, F.when(b < 0, ABOVE_BASELINE).otherwise(0))
        + F.coalesce(of_bucket, F.lit(0))
        + _steps(w, BELOW_WAREHOUSE, F.lit(ABOVE_WAREHOUSE))
        + F.when(available == "full_week", FULL_WEEK).when(available == "friday_only", FRIDAY_ONLY).otherwise(0)
        + F.when(says("wrong"), WRONG_MATCH).otherwise(0)
        + BULK * bulk
        + F.when(F.col("confidence") == "Low", LOW_CONFIDENCE).otherwise(0)
    )
    rows = facts.withColumn("script_score", score.cast("double"))
    points = F.col("script_score")
    label = (
        F.when(says("do not") | says("wrong match"), "Do not mention")
        .when(F.col("confidence") == "Low", F.when(points < CHECK, "Do not mention").otherwise("Manual verification first"))
        .when((points >= LEAD) & (available == "full_week"), "Lead-worthy")
        .when(points >= SUPPORT, "Strong supporting mention")
        .when(points >= MENTION, "Quick mention only")
        .otherwise("Do not mention")
    )
    whole = lambda c: F.format_string("%.0f", F.rint(c))
    history = F.when(F.col("bucket") == "all-time low", "historical low").when(F.col("bucket") == "near all-time low", "near historical low")
    reasons = F.array_compact(
        F.array(
            F.when(b >= 15, F.concat(whole(b), F.lit("% below baseline"))),
            history,
            F.when(w >= 10, F.concat(F.lit("beats the warehouse by ~"), whole(w), F.lit("% per unit"))).when(w >= -10, "close to the warehouse with smaller pack").when(w < -10, "warehouse cheaper on unit math"),
            F.when(available == "friday_only", "Friday-only"),
        )
    )
    plain = F.when(F.col("category") == "produce", "seasonal promo").otherwise("ad highlight")
    return rows.withColumns({"script_label": label, "script_reason": F.when(F.size(reasons) == 0, plain).otherwise(F.array_join(reasons, "; "))})


def headline_picks(scored: DataFrame, by: Sequence[str] = ("store",), seq: str = "row_seq") -> DataFrame:
    """Per store the item of each headline class: best_lead (lead-worthy, else any full-week one), best_warehouse_beating,
    best_full_week_staple (a staple well below its baseline, else any full-week one), best_friday_only and
    best_warehouse_close; and n_avoid.

    The highest score wins, then file order; an item may head several classes. One grouping: candidates of every class
    combine before they shuffle.
    """
    order = F.struct((-F.col("script_score")).alias("s"), F.col(seq).alias("q"))
    named = F.col("script_label") != "Do not mention"
    week, friday = named & (F.col("availability") == "full_week"), named & (F.col("availability") == "friday_only")
    best = lambda where: F.min_by("name", F.when(F.coalesce(where, F.lit(False)), order))
    w = F.col("warehouse_pct")
    staple = week & F.col("category").isin(*STAPLES) & (F.col("baseline_pct") >= 15)
    return scored.groupBy(*by).agg(
        F.coalesce(best(week & (F.col("script_label") == "Lead-worthy")), best(week)).alias("best_lead"),
        best(week & (w >= 10)).alias("best_warehouse_beating"),
        F.coalesce(best(staple), best(week)).alias("best_full_week_staple"),
        best(friday).alias("best_friday_only"),
        best(week & (w >= -10) & (w < 10)).alias("best_warehouse_close"),
        F.count_if(~named).alias("n_avoid"),
    )
