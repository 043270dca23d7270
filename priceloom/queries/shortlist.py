"""Queries over the expanded shortlist, product and family pages, and the readers and writers of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from priceloom.operators import shortlist as ops
from priceloom.operators import views
from priceloom.queries.base import SALES, SERIES, query, sales, series, table
from priceloom.sources import files

POPULAR = {"ring": 15, "bolt": 12, "small": 9}
GROUPS = {"produce": ("plate", "rod"), "dairy": ("ring", "gizmo"), "meat": ("hot",)}
_CAVEATS = "CASE l_linenumber WHEN 1 THEN 'Sold in 10 lb bag' WHEN 2 THEN 'Wrong match: do not use' END"
_BUCKET = "CASE p_type WHEN 'ECONOMY' THEN 'all-time low' WHEN 'PROMO' THEN 'near all-time low' WHEN 'LARGE' THEN 'strong sale' WHEN 'SMALL' THEN 'normal sale' END"
_AVAILABLE = "CASE l_returnflag WHEN 'R' THEN 'friday_only' WHEN 'A' THEN 'full_week' ELSE NULL END"
_UNIT = "CASE WHEN p_size % 3 > 0 THEN p_retailprice * (1 + p_size % 3 / 10.0) END"


def _facts(spark, sf_dir):
    rows = sales(spark, sf_dir).select(
        F.col("feed").alias("store"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_seq"), F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("name"), "price", F.lit(None).cast("double").alias("effective_price"), F.col("p_retailprice").alias("baseline"),
        F.expr(_UNIT).cast("double").alias("warehouse_unit_price"), F.expr(f"array_compact(array({_CAVEATS}))").alias("caveats"), (F.col("l_quantity") / 20).alias("split_confidence"), F.expr(_BUCKET).alias("bucket"), F.expr(_AVAILABLE).alias("availability"),
    )
    return ops.expanded_shortlist(ops.shortlist_facts(rows, GROUPS), POPULAR)


_SHORT = SALES + f""", offers AS (SELECT feed AS store, l_orderkey * 10 + l_linenumber AS row_seq, p_name || ' ' || lower(p_brand) AS name, price, lower({_CAVEATS}) AS caveat, {_BUCKET} AS bucket, coalesce({_AVAILABLE}, '') AS availability,
    round((p_retailprice - price) / p_retailprice * 100, 1) AS b, {_UNIT} AS unit, CASE WHEN l_quantity / 20 < 0.75 THEN 'Low' WHEN l_linenumber IN (1, 2) THEN 'Medium' ELSE 'High' END AS confidence FROM sales WHERE price > 0
), facts AS (SELECT *, round((unit - price) / unit * 100, 1) AS w, CASE WHEN regexp_matches(name, 'plate|rod') THEN 'produce' WHEN regexp_matches(name, 'hot') AND NOT regexp_matches(name, 'ring|gizmo') THEN 'meat' WHEN regexp_matches(name, 'ring|gizmo') THEN 'dairy' ELSE 'other' END AS category FROM offers
), scored AS (SELECT *, CAST(CASE WHEN contains(name, 'ring') THEN 15 WHEN contains(name, 'bolt') THEN 12 WHEN contains(name, 'small') THEN 9 ELSE 5 END + CASE WHEN b >= 40 THEN 25 WHEN b >= 20 THEN 15 WHEN b >= 10 THEN 8 WHEN b < 0 THEN -10 ELSE 0 END
    + CASE bucket WHEN 'all-time low' THEN 20 WHEN 'near all-time low' THEN 15 WHEN 'strong sale' THEN 10 WHEN 'normal sale' THEN 4 ELSE 0 END + CASE WHEN w IS NULL THEN 0 WHEN w >= 15 THEN 20 WHEN w >= 0 THEN 10 WHEN w >= -10 THEN 5 ELSE -8 END
    + CASE availability WHEN 'full_week' THEN 10 WHEN 'friday_only' THEN -12 ELSE 0 END + CASE WHEN contains(caveat, 'wrong') THEN -40 ELSE 0 END + CASE WHEN contains(caveat, '10 lb bag') THEN -3 ELSE 0 END + CASE WHEN confidence = 'Low' THEN -15 ELSE 0 END AS DOUBLE) AS script_score FROM facts
), labelled AS (SELECT *, CASE WHEN contains(caveat, 'do not') THEN 'Do not mention' WHEN confidence = 'Low' THEN CASE WHEN script_score < 30 THEN 'Do not mention' ELSE 'Manual verification first' END WHEN script_score >= 70 AND availability = 'full_week' THEN 'Lead-worthy'
    WHEN script_score >= 55 THEN 'Strong supporting mention' WHEN script_score >= 35 THEN 'Quick mention only' ELSE 'Do not mention' END AS script_label FROM scored)"""


@query(
    _SHORT
    + """ SELECT row_seq, category, confidence, script_score, script_label, coalesce(nullif(concat_ws('; ', CASE WHEN b >= 15 THEN printf('%.0f', round_even(b, 0)) || '% below baseline' END, CASE bucket WHEN 'all-time low' THEN 'historical low' WHEN 'near all-time low' THEN 'near historical low' END,
  CASE WHEN w >= 10 THEN 'beats the warehouse by ~' || printf('%.0f', round_even(w, 0)) || '% per unit' WHEN w >= -10 THEN 'close to the warehouse with smaller pack' WHEN w < -10 THEN 'warehouse cheaper on unit math' END,
  CASE WHEN availability = 'friday_only' THEN 'Friday-only' END), ''), CASE WHEN category = 'produce' THEN 'seasonal promo' ELSE 'ad highlight' END) AS script_reason FROM labelled"""
)
def expanded_shortlist(spark, sf_dir):
    return _facts(spark, sf_dir).select("row_seq", "category", "confidence", "script_score", "script_label", "script_reason")


@query(
    _SHORT
    + """, o AS (SELECT *, script_label <> 'Do not mention' AS named, script_label <> 'Do not mention' AND availability = 'full_week' AS week FROM labelled)
SELECT store, coalesce(arg_min(name, (-script_score, row_seq)) FILTER (WHERE week AND script_label = 'Lead-worthy'), arg_min(name, (-script_score, row_seq)) FILTER (WHERE week)) AS best_lead, arg_min(name, (-script_score, row_seq)) FILTER (WHERE week AND w >= 10) AS best_warehouse_beating,
  coalesce(arg_min(name, (-script_score, row_seq)) FILTER (WHERE week AND category IN ('dairy', 'meat', 'pantry') AND b >= 15), arg_min(name, (-script_score, row_seq)) FILTER (WHERE week)) AS best_full_week_staple,
  arg_min(name, (-script_score, row_seq)) FILTER (WHERE named AND availability = 'friday_only') AS best_friday_only, arg_min(name, (-script_score, row_seq)) FILTER (WHERE week AND w >= -10 AND w < 10) AS best_warehouse_close, count(*) FILTER (WHERE NOT named) AS n_avoid FROM o GROUP BY store"""
)
def headline_picks(spark, sf_dir):
    return ops.headline_picks(_facts(spark, sf_dir))


# -- pages -----------------------------------------------------------------------------------------------------------

_PAGE_SERIES = SERIES + """, effective AS (SELECT feed, family, week, price AS ad_price, CASE WHEN price > 0 AND confidence <> 'low' THEN price WHEN family LIKE '%1' THEN NULL ELSE baseline END AS effective_price, confidence, confidence = 'low' AS is_fallback FROM series
), stores AS (SELECT feed, family, CASE WHEN family NOT LIKE '%1' THEN max(baseline) END AS store FROM series GROUP BY feed, family
), inferred AS (SELECT feed, family, max(ad_price) FILTER (WHERE confidence <> 'low') AS inferred FROM effective GROUP BY ALL
), bases AS (SELECT s.*, inferred, coalesce(store, inferred) AS effective_baseline FROM stores s JOIN inferred i ON s.feed = i.feed AND s.family = i.family)"""


@query(
    _PAGE_SERIES
    + """, history AS (SELECT feed AS warehouse, p_brand AS family, count(DISTINCT l_shipdate) AS n, max(l_shipdate) AS newest FROM sales GROUP BY ALL)
SELECT b.feed, b.family, effective_baseline, CASE WHEN store IS NOT NULL THEN 'shelf' WHEN inferred IS NOT NULL THEN 'inferred' END AS baseline_source, effective_baseline IS NOT NULL AS has_feed_data, e.week, CASE WHEN is_fallback AND effective_price IS NULL AND effective_baseline IS NOT NULL THEN effective_baseline ELSE effective_price END AS price,
  is_fallback, 'n' || length(b.family) AS winner, h.n AS n_history, h.newest FROM bases b JOIN effective e ON b.feed = e.feed AND b.family = e.family LEFT JOIN history h ON h.family = b.family AND h.warehouse = b.feed AND b.feed < 'E'"""
)
def product_pages(spark, sf_dir):
    """Each product's page, a row for each of its weeks; feeds after E are paired with no warehouse."""
    s = series(spark, sf_dir)
    low = F.col("confidence") == "low"
    odd = F.col("family").endswith("1")
    effective = F.when((F.col("price") > 0) & ~low, F.col("price")).when(odd, F.lit(None)).otherwise(F.col("baseline"))
    weekly = s.select("feed", "family", "week", F.col("price").alias("ad_price"), effective.alias("effective_price"), "confidence", F.when(low, "baseline").otherwise("weekly_ad").alias("price_type"), low.alias("is_baseline_fallback"), F.lit(None).cast("string").alias("text"))
    products = s.select("feed", "family").distinct()
    matches = s.groupBy("feed", "family").agg(F.max("baseline").alias("b")).where(~odd).select("feed", "family", F.lit("sku").alias("sku"), F.col("b").alias("baseline_price"), F.lit("shelf").alias("baseline_source"))
    compared = products.withColumns({"winner": F.concat(F.lit("n"), F.length("family")), "savings": F.lit(1.0)})
    daily = sales(spark, sf_dir).groupBy(F.col("feed").alias("warehouse"), F.col("p_brand").alias("family"), F.col("l_shipdate").alias("date")).agg(F.min("price").alias("price"))
    pairs = products.select("feed").distinct().where("feed < 'E'").withColumn("warehouse", F.col("feed"))
    page = views.product_page(products, weekly, matches, compared, daily, pairs, weeks=100_000)
    rows = page.withColumns({"w": F.explode("weekly_prices"), "last": F.element_at(F.when(F.size("warehouse_history") > 0, F.col("warehouse_history")), -1)})
    n = F.nullif(F.size("warehouse_history"), F.lit(0)).cast("long")
    return rows.select("feed", "family", "effective_baseline", "baseline_source", "has_feed_data", "w.week", "w.price", F.col("w.is_baseline_fallback").alias("is_fallback"), F.col("comparison.winner").alias("winner"), n.alias("n_history"), F.col("last.date").alias("newest"))


_FAMILY_PAGE = SALES + """, m AS (SELECT feed, p_type AS family, p_brand AS member, week, min(price) AS ad_price, CASE WHEN count(*) > 1 THEN 'high' ELSE 'low' END AS confidence, max(p_retailprice) FILTER (WHERE p_brand NOT LIKE '%1') AS baseline FROM sales GROUP BY ALL
), e AS (SELECT *, confidence = 'low' AS fallback, CASE WHEN confidence = 'low' THEN baseline ELSE ad_price END AS effective FROM m
), own AS (SELECT feed, family, member, coalesce(max(baseline), max(ad_price) FILTER (WHERE confidence <> 'low')) AS base FROM e GROUP BY ALL
), p AS (SELECT e.*, base, CASE WHEN fallback AND effective IS NULL AND base IS NOT NULL THEN base ELSE effective END AS price FROM e JOIN own o ON e.feed = o.feed AND e.family = o.family AND e.member = o.member
), v AS (SELECT feed, family, member, max(base) AS base, coalesce(arg_max(price, week) FILTER (WHERE price IS NOT NULL AND week = lastw), max(base)) AS current_price FROM (SELECT *, max(week) OVER (PARTITION BY feed, family, member) AS lastw FROM p) GROUP BY ALL
), f AS (SELECT feed, family, count(*) AS n_members, min(base) AS range_low, max(base) AS range_high, sum(current_price) AS current_total, arg_min(coalesce(base, 0), member) AS first_base FROM v GROUP BY ALL
), w AS (SELECT feed, family, week, min(ad_price) FILTER (WHERE confidence <> 'low') AS ad, max(ad_price) FILTER (WHERE confidence <> 'low') AS ad_max, min(price) AS lowest FROM p GROUP BY ALL
), s AS (SELECT feed, family, count(*) AS n_weeks, sum(coalesce(ad, lowest)) AS week_total, coalesce(arg_max(ad, week) FILTER (WHERE ad IS NOT NULL AND week <= DATE '1997-01-15' AND DATE '1997-01-15' <= week + 6), arg_max(ad, week) FILTER (WHERE ad IS NOT NULL AND week < DATE '1998-01-01')) AS sale_price, max(ad) AS inferred FROM w GROUP BY ALL
), u AS (SELECT f.*, n_weeks, round(week_total, 4) AS week_total, sale_price, coalesce(range_high, inferred) AS baseline, coalesce(sale_price, first_base) / 12 AS unit FROM f JOIN s ON f.feed = s.feed AND f.family = s.family)
SELECT feed, family, n_members, range_low, range_high, round(current_total, 4) AS current_total, n_weeks, week_total, sale_price, baseline, CASE WHEN n_members > 1 THEN 'range' ELSE 'single' END AS chart_mode, round(unit * 10000) / 10000 AS unit_price, CASE WHEN (unit - 80) / 80 * 100 <= 25 THEN 'more_variety' ELSE 'best_value_warehouse' END AS badge FROM u"""


@query(_FAMILY_PAGE)
def family_pages(spark, sf_dir):
    n = F.count(F.lit(1))
    m = sales(spark, sf_dir).groupBy("feed", F.col("p_type").alias("family"), F.col("p_brand").alias("member"), "week").agg(
        F.min("price").alias("ad_price"), F.when(n > 1, "high").otherwise("low").alias("confidence"), F.max(F.when(~F.col("p_brand").endswith("1"), F.col("p_retailprice"))).alias("baseline")
    )
    low = F.col("confidence") == "low"
    m = m.withColumns(
        {
            "week_end": F.date_add("week", 6), "is_preview": F.col("week") >= F.lit("1998-01-01").cast("date"), "effective_price": F.when(low, F.col("baseline")).otherwise(F.col("ad_price")),
            "price_type": F.when(low, "baseline").otherwise("weekly_ad"), "is_baseline_fallback": low, "text": F.lit(None).cast("string"),
        }
    )
    units = m.select("family").distinct().withColumns({"ounces": F.lit(12.0), "warehouse_unit_price": F.lit(80.0)})
    page = views.family_page(m, F.lit("1997-01-15").cast("date"), units, weeks=100_000)
    total = lambda c, f: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x[f], F.lit(0.0))), 4)
    return page.select(
        "feed", "family", F.size("members").cast("long").alias("n_members"), "range_low", "range_high", total("members", "current_price").alias("current_total"), F.size("weekly_prices").cast("long").alias("n_weeks"), total("weekly_prices", "price").alias("week_total"),
        "sale_price", "baseline", "chart_mode", "unit_price", "badge",
    )


# -- files -----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS week_start, count(DISTINCT (l_linenumber, l_quantity, l_orderkey % 3)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def read_raw_cards(spark, sf_dir):
    """Cards in many files, with repeats inside and across them, read back for one banner."""
    cards = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("week_start"), F.when(F.col("l_returnflag") == "R", " Vons").otherwise("Safeway").alias("banner"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("offer_index_on_page"),
        F.concat(F.repeat(F.lit("x"), F.lit(118)), (F.col("l_orderkey") % 3).cast("string"), F.lit(" and what follows "), F.col("l_orderkey").cast("string")).alias("raw_offer_text"), (F.col("l_orderkey") % 5).alias("flyer"),
    )
    path = f"{files.shared_dir(spark)}/cards-{uuid.uuid4().hex}"
    cards.write.partitionBy("flyer").option("header", True).csv(path)
    return files.read_raw_cards(spark, f"{path}/flyer=*", "vons").groupBy("week_start").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 2 = 0 THEN 0 ELSE o_totalprice END) AS total FROM orders GROUP BY 1")
def upsert_partitions(spark, sf_dir):
    """Orders by priority, then every other urgent one with a price of 0, twice; the other partitions stay as they were written."""
    path = f"{files.shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("priority"))
    files.replace_partitions(orders, path, ["priority"])
    urgent = orders.where("priority LIKE '1%' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    for _ in range(2):
        files.upsert_partitions(spark, path, urgent, ["o_orderkey"], ["priority"])
    return spark.read.schema(orders.schema).parquet(path).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
