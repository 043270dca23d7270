"""Grocer against warehouse: newest observations, item matching, unit price comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.units import rounded, units_compatible

TIE = 0.03
#: Products of all warehouses that are sent to every task; more are joined by shuffle.
BROADCAST_PRODUCTS = 50_000


def newest(obs: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """The newest observation of each key; the later row wins ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return obs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def mapped_numbers(products: DataFrame, mappings: DataFrame) -> DataFrame:
    """(product, warehouse, item): the mappings of the warehouse, global ones for products without."""
    own = mappings.where("warehouse IS NOT NULL")
    local = products.join(own, ["product", "warehouse"])
    open_ = products.join(own.select("product", "warehouse").distinct(), ["product", "warehouse"], "left_anti")
    global_ = open_.join(mappings.where("warehouse IS NULL").drop("warehouse"), "product")
    return local.select("product", "warehouse", "item").unionByName(global_.select("product", "warehouse", "item"))


def match_mapped_items(products: DataFrame, mappings: DataFrame, catalog: DataFrame, ts: str) -> DataFrame:
    """Products by mapped item number: warehouse mappings before global ones, the newest item of those in the catalog.

    products: (product, warehouse); mappings: (product, warehouse or null, item); catalog: (warehouse, item, ts, ...). A
    product that is mapped but not in the catalog stays with a null item: it must not be matched by text.
    """
    found = mapped_numbers(products, mappings).join(catalog, ["warehouse", "item"], "left")
    return found.groupBy("product", "warehouse").agg(F.max_by(F.when(F.col(ts).isNotNull(), F.col("item")), F.col(ts)).alias("item"), F.lit("item_number").alias("method"))


def _text_hits(products: DataFrame, patterns: DataFrame, catalog: DataFrame, text: str) -> DataFrame:
    """Rows a (product, patterns) and c (catalog) whose text fits. Warehouses are few, so the products go to every task, up to
    BROADCAST_PRODUCTS of them; beyond, Spark splits the warehouses of a shuffled join."""
    asked = products.join(patterns, "product")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_PRODUCTS else asked
    condition = (F.col("a.warehouse") == F.col("c.warehouse")) & F.expr(f"c.{text} RLIKE a.include_pattern AND NOT c.{text} RLIKE coalesce(a.exclude_pattern, '(?!)')")
    return catalog.alias("c").join(asked.alias("a"), condition)


def match_text_items(products: DataFrame, patterns: DataFrame, catalog: DataFrame, text: str, seq: str) -> DataFrame:
    """Products by text: 10 for an include hit and 5 for each place of every prefer hit, none on an exclude hit; best score wins."""
    hits = _text_hits(products, patterns, catalog, text)
    n = F.size("a.prefer")
    score = F.lit(10) + F.aggregate(F.transform("a.prefer", lambda p, i: F.when(F.regexp_like(F.col(f"c.{text}"), p), (n - i) * 5).otherwise(0)), F.lit(0), lambda x, y: x + y)
    ranked = hits.select("a.product", "a.warehouse", "c.item", score.alias("score"), F.col(f"c.{seq}").alias("_seq"))
    order = Window.partitionBy("product", "warehouse").orderBy(F.col("score").desc(), "_seq")
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("product", "warehouse", "item", F.lit("text").alias("method"))


def match_warehouse_items(products: DataFrame, mappings: DataFrame, patterns: DataFrame, catalog: DataFrame, ts: str = "ts", text: str = "name", seq: str = "seq") -> DataFrame:
    """Mapped products first, text for the others."""
    mapped = match_mapped_items(products, mappings, catalog, ts)
    rest = products.join(mapped, ["product", "warehouse"], "left_anti")
    return mapped.where("item IS NOT NULL").unionByName(match_text_items(rest, patterns, catalog, text, seq))


def match_warehouse_history(products: DataFrame, mappings: DataFrame, patterns: DataFrame, obs: DataFrame, text: str = "name") -> DataFrame:
    """Every observation of each product with its method: by mapped item number, and by text where no number was ever seen."""
    numbers = mapped_numbers(products, mappings).distinct()
    by_number = obs.join(numbers, ["warehouse", "item"]).withColumn("method", F.lit("item_number"))
    rest = products.join(by_number.select("product", "warehouse").distinct(), ["product", "warehouse"], "left_anti")
    by_text = _text_hits(rest, patterns, obs, text).select("a.product", "c.*", F.lit("text").alias("method"))
    return by_number.unionByName(by_text)


def unmatched_products(products: DataFrame, matches: DataFrame) -> DataFrame:
    return products.select("product", "warehouse").join(matches, ["product", "warehouse"], "left_anti")


def winner(grocer: Column, warehouse: Column, tie: float = TIE) -> Column:
    """struct(winner, savings, savings_pct): a tie within 3 % of the cheaper price."""
    cheaper, gap = F.least(grocer, warehouse), F.abs(grocer - warehouse)
    pct = rounded(gap / cheaper * 100)
    dearer = F.greatest(grocer, warehouse)
    is_tie = (pct <= tie * 100) | (cheaper > dearer * (1 - tie))
    return F.struct(
        F.when(is_tie, "tie").when(grocer < warehouse, "grocer").otherwise("warehouse").alias("winner"),
        rounded(gap, 4).alias("savings"),
        F.when(is_tie, pct).otherwise(rounded(gap / dearer * 100)).alias("savings_pct"),
    )


def compare_prices(rows: DataFrame) -> DataFrame:
    """status and winner of (grocer_price, grocer_unit_price, grocer_unit, item, warehouse_unit_price, warehouse_unit, confidence) rows."""
    status = (
        F.when(F.col("grocer_price").isNull(), "missing_grocery_price")
        .when(F.col("item").isNull(), "not_sold")
        .when(F.col("warehouse_unit").isNull() | F.col("grocer_unit_price").isNull() | F.col("warehouse_unit_price").isNull(), "needs_review")
        .when(~units_compatible(F.col("grocer_unit"), F.col("warehouse_unit")), "unit_mismatch")
        .when(F.col("confidence") == "low", "needs_review")
        .otherwise("comparable")
    )
    won = winner(F.col("grocer_unit_price"), F.col("warehouse_unit_price"))
    priced = F.col("grocer_unit_price").isNotNull() & F.col("warehouse_unit_price").isNotNull() & units_compatible(F.col("grocer_unit"), F.col("warehouse_unit"))
    return rows.withColumn("status", status).withColumns(
        {"winner": F.when(F.col("status") == "not_sold", "grocery_only").when(F.col("status").isin("comparable", "needs_review") & F.coalesce(priced, F.lit(False)), won["winner"]).otherwise("unknown"), "savings_pct": F.when(F.coalesce(priced, F.lit(False)), won["savings_pct"])}
    )


def percent_against_warehouse(grocer: Column, warehouse: Column) -> Column:
    """Positive where the grocer is cheaper."""
    return F.when(warehouse > 0, rounded((warehouse - grocer) / warehouse * 100))


#: The warehouse's own brand, and what a match may be.
OWN_BRAND = "kirkland"
MATCH_TYPES = ("no comp", "different brand same category", "exact brand", "category benchmark only")


def warehouse_match_label(rows: DataFrame) -> DataFrame:
    """Adds match_type, match_confidence, own_brand and pct_cheaper (positive where the grocer is cheaper) to compared rows
    (grocer_unit_price, warehouse_unit_price, item_name, prefer, status).

    No grocer price or item gives no comparison. The warehouse's own brand is another brand; a preferred pattern in the
    item's name is the exact brand; anything else is a benchmark, of medium confidence at most. Null patterns prefer nothing.
    """
    none, own, exact, category = MATCH_TYPES
    name = F.lower("item_name")
    prefer = F.coalesce("prefer", F.array().cast("array<string>"))
    is_own = F.contains(name, F.lit(OWN_BRAND))
    kind = F.when(F.col("grocer_unit_price").isNull() | name.isNull(), none).when(is_own, own).when(F.exists(prefer, lambda p: F.regexp_like(name, p)), exact).otherwise(category)
    rows = rows.withColumn("match_type", kind)
    compared = F.col("status").isin("comparable", "needs_review")
    confidence = (
        F.when(F.col("match_type") == none, "low")
        .when(~F.coalesce(compared, F.lit(False)), F.when(F.col("status") == "unit_mismatch", "low").otherwise("medium"))
        .when((F.col("status") == "needs_review") | (F.col("match_type") == category), "medium")
        .otherwise("high")
    )
    pct = F.when(compared & (F.col("match_type") != none), percent_against_warehouse(F.col("grocer_unit_price"), F.col("warehouse_unit_price")))
    return rows.withColumns({"match_confidence": confidence, "own_brand": F.coalesce(is_own, F.lit(False)), "pct_cheaper": pct})
