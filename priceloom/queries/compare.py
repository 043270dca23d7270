"""Queries over grocer-warehouse comparison, verdicts and price checks: one region is the grocer, another the warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.functions import labels
from priceloom.operators import compare as ops
from priceloom.operators import quality
from priceloom.queries.base import LATEST, SALES, SPINE, latest, query, sales, series, spine, table
from priceloom.queries.series import _BENCH, _bench

_CATALOG = SALES + """, obs AS (SELECT feed AS warehouse, l_partkey AS item, p_name AS name, p_brand, week AS ts, l_orderkey * 10 + l_linenumber AS seq, price, p_size FROM sales
), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY warehouse, item ORDER BY ts DESC, seq DESC) AS k FROM obs) WHERE k = 1)"""


def _obs(spark, sf_dir):
    return sales(spark, sf_dir).select(F.col("feed").alias("warehouse"), F.col("l_partkey").alias("item"), F.col("p_name").alias("name"), "p_brand", F.col("week").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "price", "p_size")


def _newest(spark, sf_dir):
    return ops.newest(_obs(spark, sf_dir), ["warehouse", "item"], "ts", "seq")


@query(_CATALOG + "SELECT warehouse, item, ts, price FROM newest")
def latest_catalog(spark, sf_dir):
    return _newest(spark, sf_dir).select("warehouse", "item", "ts", "price")


@query(_CATALOG + "SELECT p_brand, warehouse, ts, price, round(price / p_size * 10000) / 10000 AS unit_price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, warehouse, ts ORDER BY seq DESC) AS k FROM obs) WHERE k = 1")
def warehouse_daily_history(spark, sf_dir):
    rows = ops.newest(_obs(spark, sf_dir), ["p_brand", "warehouse", "ts"], "ts", "seq")
    return rows.select("p_brand", "warehouse", "ts", "price", ops.rounded(F.col("price") / F.col("p_size"), 4).alias("unit_price"))


@query(SALES + "SELECT feed, count(DISTINCT p_brand) AS n_files, min(week) AS first_week, max(week) AS last_week, count(*) AS n_rows FROM sales GROUP BY feed")
def warehouse_manifest(spark, sf_dir):
    return sales(spark, sf_dir).groupBy("feed").agg(F.count_distinct("p_brand").alias("n_files"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count(F.lit(1)).alias("n_rows"))


_PRODUCTS = _CATALOG + """, products AS (SELECT DISTINCT p_brand AS product, r_name AS warehouse FROM part CROSS JOIN region
), mappings AS (SELECT CASE WHEN p_brand < 'Brand#2' THEN p_brand ELSE p_type END AS product, CASE WHEN p_size % 2 = 0 THEN 'ASIA' END AS warehouse, p_partkey AS item FROM part
), local AS (SELECT p.product, p.warehouse, m.item FROM products p JOIN mappings m ON p.product = m.product AND p.warehouse = m.warehouse
), global AS (SELECT p.product, p.warehouse, m.item FROM products p JOIN mappings m ON p.product = m.product AND m.warehouse IS NULL WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.product = p.product AND l.warehouse = p.warehouse)
), mapped AS (SELECT a.product, a.warehouse, arg_max(n.item, n.seq2) AS item FROM (SELECT * FROM local UNION ALL SELECT * FROM global) a LEFT JOIN (SELECT *, (ts, item) AS seq2 FROM newest) n ON n.warehouse = a.warehouse AND n.item = a.item GROUP BY ALL
), scored AS (SELECT p.product, p.warehouse, n.item, 10 + CASE WHEN regexp_matches(n.name, 'small') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(n.name, 'hot') THEN 5 ELSE 0 END AS score, n.item AS s2
  FROM products p JOIN newest n ON p.warehouse = n.warehouse AND regexp_matches(n.name, '(ring|gear)') AND NOT regexp_matches(n.name, 'old') WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.product = p.product AND m.warehouse = p.warehouse)
), matched AS (SELECT product, warehouse, item, 'item_number' AS method FROM mapped WHERE item IS NOT NULL UNION ALL
  SELECT product, warehouse, arg_max(item, (score, -s2)), 'text' FROM scored GROUP BY product, warehouse)"""


def _asked(spark, sf_dir):
    """Products with their mappings and patterns, and the newest catalog."""
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    products = part.select(F.col("p_brand").alias("product")).distinct().crossJoin(F.broadcast(region.select(F.col("r_name").alias("warehouse"))))
    mappings = part.select(F.when(F.col("p_brand") < "Brand#2", F.col("p_brand")).otherwise(F.col("p_type")).alias("product"), F.when(F.col("p_size") % 2 == 0, "ASIA").alias("warehouse"), F.col("p_partkey").alias("item"))
    patterns = products.select("product").distinct().select("product", F.lit("(ring|gear)").alias("include_pattern"), F.lit("old").alias("exclude_pattern"), F.array(F.lit("small"), F.lit("hot")).alias("prefer"))
    catalog = _newest(spark, sf_dir).withColumn("rank_ts", F.struct("ts", "item")).withColumn("seq", F.col("item"))
    return products, mappings, patterns, catalog


def _matched(spark, sf_dir):
    products, mappings, patterns, catalog = _asked(spark, sf_dir)
    return products, ops.match_warehouse_items(products, mappings, patterns, catalog, ts="rank_ts")


@query(_PRODUCTS + "SELECT product, warehouse, item, method FROM matched")
def match_warehouse_items(spark, sf_dir):
    return _matched(spark, sf_dir)[1]


@query(_PRODUCTS + """, seen AS (SELECT a.product, a.warehouse, o.item, o.ts, o.seq, o.price, 'item_number' AS method FROM (SELECT * FROM local UNION SELECT * FROM global) a JOIN obs o ON o.warehouse = a.warehouse AND o.item = a.item)
SELECT * FROM seen UNION ALL
SELECT p.product, p.warehouse, o.item, o.ts, o.seq, o.price, 'text' FROM products p JOIN obs o ON o.warehouse = p.warehouse AND regexp_matches(o.name, '(ring|gear)') AND NOT regexp_matches(o.name, 'old')
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.product = p.product AND s.warehouse = p.warehouse)""")
def match_warehouse_history(spark, sf_dir):
    products, mappings, patterns, _ = _asked(spark, sf_dir)
    return ops.match_warehouse_history(products, mappings, patterns, _obs(spark, sf_dir)).select("product", "warehouse", "item", "ts", "seq", "price", "method")


@query(_PRODUCTS + ", few AS (SELECT * FROM matched WHERE method = 'item_number') SELECT product, warehouse FROM products p WHERE NOT EXISTS (SELECT 1 FROM few m WHERE m.product = p.product AND m.warehouse = p.warehouse)")
def unmatched_products(spark, sf_dir):
    products, matches = _matched(spark, sf_dir)
    return ops.unmatched_products(products, matches.where("method = 'item_number'"))


_COMPARED = LATEST + """, g AS (SELECT family, current_price FROM latest WHERE feed = 'EUROPE'), w AS (SELECT family, current_price FROM latest WHERE feed = 'ASIA' AND family > 'Brand#12'
), pairs AS (SELECT g.family, CASE WHEN right(g.family, 1) <> '3' THEN g.current_price END AS grocer_price, CASE WHEN right(g.family, 1) <> '3' THEN g.current_price END AS gu, w.current_price AS wu, w.family AS item,
   CASE WHEN w.family IS NULL THEN NULL WHEN right(g.family, 1) = '5' THEN 'lb' WHEN right(g.family, 1) = '6' THEN 'fl_oz' ELSE 'oz' END AS unit, CASE WHEN right(g.family, 1) = '7' THEN 'low' ELSE 'high' END AS confidence
  FROM g LEFT JOIN w ON g.family = w.family
), judged AS (SELECT *, CASE WHEN grocer_price IS NULL THEN 'missing_grocery_price' WHEN item IS NULL THEN 'not_sold' WHEN unit = 'lb' THEN 'unit_mismatch' WHEN confidence = 'low' THEN 'needs_review' ELSE 'comparable' END AS status,
   least(gu, wu) AS cheap, greatest(gu, wu) AS dear, abs(gu - wu) AS gap FROM pairs
), won AS (SELECT *, round(gap / cheap * 100 * 100) / 100 AS pct FROM judged)
SELECT family, status, CASE WHEN status = 'not_sold' THEN 'grocery_only' WHEN status IN ('comparable', 'needs_review') THEN CASE WHEN pct <= 3 OR cheap > dear * 0.97 THEN 'tie' WHEN gu < wu THEN 'grocer' ELSE 'warehouse' END ELSE 'unknown' END AS winner,
  CASE WHEN unit <> 'lb' THEN CASE WHEN pct <= 3 OR cheap > dear * 0.97 THEN pct ELSE round(gap / dear * 100 * 100) / 100 END END AS savings_pct FROM won"""


@query(_COMPARED)
def compare_prices(spark, sf_dir):
    now = latest(spark, sf_dir)
    grocer = now.where("feed = 'EUROPE'").select("family", F.col("current_price").alias("g"))
    other = now.where("feed = 'ASIA' AND family > 'Brand#12'").select("family", F.col("current_price").alias("warehouse_unit_price"), F.col("family").alias("item"))
    tail = F.substring("family", -1, 1)
    rows = grocer.join(other, "family", "left").withColumn("grocer_price", F.when(tail != "3", F.col("g"))).withColumns(
        {"grocer_unit_price": F.col("grocer_price"), "grocer_unit": F.lit("oz"), "confidence": F.when(tail == "7", "low").otherwise("high"),
         "warehouse_unit": F.when(F.col("item").isNotNull(), F.when(tail == "5", "lb").when(tail == "6", "fl_oz").otherwise("oz"))})
    return ops.compare_prices(rows).select("family", "status", "winner", "savings_pct")


_LABEL = _BENCH + """, h AS (SELECT *, greatest(all_time_low * 0.005, 0.001) AS eps, pct_below_median AS pct FROM labelled
), named AS (SELECT *, CASE WHEN all_time_low IS NULL OR n_obs < 2 THEN 'insufficient history' WHEN current_price < all_time_low - eps THEN 'all-time low' WHEN abs(current_price - all_time_low) <= eps THEN 'tied all-time low'
   WHEN current_price <= all_time_low * 1.05 THEN 'within 5% of all-time low' WHEN current_price < median_price * 0.97 THEN 'historically good but not near low' ELSE 'not special historically' END AS label FROM h)"""


@query(_LABEL + """SELECT feed, family, label, CASE WHEN family = 'Brand#7' THEN 'manual_review' WHEN label IN ('all-time low', 'tied all-time low') THEN 'all_time_low' WHEN label = 'within 5% of all-time low' THEN 'near_all_time_low'
  WHEN pct <= 0 THEN 'parity' WHEN pct > 15 THEN 'warehouse_wins' WHEN label = 'historically good but not near low' THEN 'good_buy' WHEN label = 'not special historically' AND pct IS NULL THEN 'manual_review'
  WHEN label = 'not special historically' THEN 'warehouse_wins' ELSE 'good_buy' END AS section FROM named""")
def classify_historical(spark, sf_dir):
    rows = _bench(spark, sf_dir).withColumn("label", labels.historical_label(F.col("current_price"), F.col("all_time_low"), F.col("median_price"), F.col("n_obs")))
    return rows.select("feed", "family", "label", labels.summary_section(F.col("family") == "Brand#7", F.col("label"), F.col("pct_below_median"), F.lit(True)).alias("section"))


@query(_BENCH + """, s AS (SELECT *, pct_below_median AS pct, n_obs % 2 = 0 AS tracked FROM labelled)
SELECT feed, family, CAST(CASE WHEN tracked THEN CASE WHEN pct >= 20 THEN 5 WHEN pct >= 5 THEN 3 WHEN pct >= -5 THEN 2 ELSE 0 END ELSE 0 END
  + CASE bucket WHEN 'all-time low' THEN 5 WHEN 'near all-time low' THEN 4 WHEN 'strong sale' THEN 3 WHEN 'normal sale' THEN 1 ELSE 0 END + 3 + 2 + CASE WHEN pct >= -5 AND pct < 5 THEN 1 ELSE 0 END
  - CASE WHEN n_obs < 100 THEN 2 ELSE 0 END - CASE WHEN tracked AND pct < -5 THEN 4 ELSE 0 END + CASE WHEN feed = 'ASIA' THEN 3 ELSE 0 END AS INTEGER) AS score,
  CASE WHEN tracked AND pct >= 5 THEN 'clear win' WHEN tracked AND pct >= -5 THEN 'on par' WHEN NOT tracked AND bucket IN ('all-time low', 'near all-time low', 'strong sale') THEN 'historically strong'
       WHEN tracked AND pct < -5 THEN 'not a win' ELSE 'skip' END AS deal_bucket FROM s""")
def score_deals(spark, sf_dir):
    tracked, pct, bucket = F.col("n_obs") % 2 == 0, F.col("pct_below_median"), F.col("bucket")
    score = labels.deal_score(bucket, pct, tracked, F.lit(3), F.lit(2), F.lit(False), F.col("n_obs") < 100, F.col("feed") == "ASIA")
    return _bench(spark, sf_dir).select("feed", "family", score.cast("int").alias("score"), labels.deal_bucket(bucket, pct, tracked).alias("deal_bucket"))


@query("""WITH p AS (SELECT p_partkey, p_size - 10.0 AS pct, p_size % 2 = 0 AS usable, p_brand < 'Brand#15' AS brand, p_type = 'PROMO' AS popular, p_size > 30 AS near, CASE p_size % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS strength FROM part)
SELECT p_partkey, least(100, CASE WHEN brand THEN 15 ELSE 6 END + CASE WHEN popular THEN 12 ELSE 2 END + CAST(round(CASE WHEN pct > 0 THEN CASE WHEN usable THEN least(22.0, pct / 25 * 22) ELSE least(6.0, pct / 25 * 6) END ELSE 0 END) AS INTEGER)
  + CASE WHEN near THEN 12 ELSE 0 END + CASE strength WHEN 'strong' THEN 15 WHEN 'moderate' THEN 9 ELSE 5 END + 6 + 0 + CASE strength WHEN 'strong' THEN 10 WHEN 'moderate' THEN 6 ELSE 3 END) AS score FROM p""")
def score_content(spark, sf_dir):
    size = F.col("p_size")
    strength = F.when(size % 3 == 0, "strong").when(size % 3 == 1, "moderate").otherwise("weak")
    score = labels.content_score(F.col("p_brand") < "Brand#15", F.col("p_type") == "PROMO", size.cast("double") - 10.0, size % 2 == 0, size > 30, strength, F.lit(True), F.lit(False), strength)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query(_BENCH + """SELECT feed, family, CASE WHEN family = 'Brand#9' THEN 'not_comparable' WHEN n_obs <= 1 THEN 'insufficient_data' WHEN n_obs <= 3 THEN 'limited_data' ELSE replace(replace(bucket, ' ', '_'), '-', '_') END AS verdict FROM labelled""")
def assess_deals(spark, sf_dir):
    return _bench(spark, sf_dir).select("feed", "family", labels.verdict(F.col("bucket"), F.col("n_obs"), F.col("current_price"), F.col("family") != "Brand#9").alias("verdict"))


@query(_BENCH + """, b AS (SELECT *, round(pct_below_median) AS off, feed = 'ASIA' AS preview, CASE WHEN family < 'Brand#2' THEN pct_above_low END AS vs FROM labelled)
SELECT feed, family, CASE WHEN preview AND off >= 15 THEN 'strong preview deal' WHEN preview AND off >= 5 THEN 'good preview deal' WHEN NOT preview AND off >= 15 THEN 'great week to buy' WHEN NOT preview AND off >= 5 THEN 'good deal this week'
  WHEN vs <= 0 THEN 'grocer wins' WHEN vs > 25 THEN 'warehouse wins' WHEN vs IS NOT NULL THEN 'close enough' WHEN coalesce(off < 5, TRUE) AND NOT preview THEN 'wait for a sale' ELSE 'regular price' END AS label FROM b""")
def buy_wait_labels(spark, sf_dir):
    off = F.round("pct_below_median")
    vs = F.when(F.col("family") < "Brand#2", F.col("pct_above_low"))
    label = labels.buy_wait(F.coalesce(off >= 5, F.lit(False)), off, vs, F.col("feed") == "ASIA")
    return _bench(spark, sf_dir).select("feed", "family", label.alias("label"))


_CHECKED = SPINE + """, w AS (SELECT *, lag(price) OVER (PARTITION BY feed, family ORDER BY week) AS prior, median(price) OVER (PARTITION BY feed, family) AS med, count(price) OVER (PARTITION BY feed, family) AS k FROM spine
), r AS (SELECT feed, family, week, price, concat_ws('; ', CASE WHEN family LIKE 'old%' THEN 'keyword' END, CASE WHEN k >= 2 AND price > 2 * med THEN 'above_median' WHEN prior > 0 AND price > 3 * prior THEN 'above_prior' WHEN prior > 0 AND price < 0.5 * prior THEN 'below_prior' END,
  CASE WHEN price > baseline + 0.009 THEN 'above_baseline' END) AS reason FROM w WHERE price IS NOT NULL) SELECT * FROM r WHERE reason <> ''"""


@query(_CHECKED)
def validate_prices(spark, sf_dir):
    return quality.validate_prices(spine(spark, sf_dir), keyword=F.col("family").startswith("old")).select("feed", "family", "week", "price", "reason")
