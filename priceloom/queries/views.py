"""Queries over product and family views, collisions of the catalog, comparability and catalog evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import views
from priceloom.queries.base import SALES, SERIES, query, sales, series, table

_WAREHOUSE = "warehouse AS (SELECT p_brand AS family, min(p_retailprice) / 10 AS warehouse_price FROM part GROUP BY p_brand)"


def _warehouse(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg((F.min("p_retailprice") / 10).alias("warehouse_price"))


@query(SERIES + f""", {_WAREHOUSE}, weekly AS (SELECT *, price > 0 AND confidence <> 'low' AS trusted FROM series
), eff AS (SELECT *, CASE WHEN trusted THEN price ELSE coalesce(baseline, price) END AS ep, CASE WHEN trusted OR baseline IS NULL THEN 'weekly_ad' ELSE 'baseline' END AS kind FROM weekly
), v AS (SELECT feed, family, coalesce(max(baseline), max(CASE WHEN confidence <> 'low' THEN price END)) AS effective_baseline, count(*) AS n_weeks, CAST(count(*) FILTER (WHERE kind = 'baseline') AS BIGINT) AS n_fallback,
  min(ep) AS low, max(ep) AS high, arg_max(ep, week) AS current_price, arg_max(kind, week) AS price_type FROM eff GROUP BY feed, family)
SELECT v.*, w.warehouse_price, round((current_price - warehouse_price) / warehouse_price * 100 * 100) / 100 AS pct_above_warehouse FROM v LEFT JOIN warehouse w ON v.family = w.family""")
def product_view(spark, sf_dir):
    return views.product_view(series(spark, sf_dir), _warehouse(spark, sf_dir))


_MEMBERS = SALES + """, members AS (SELECT p_brand AS family, p_name AS member, week, min(price) AS price, max(p_retailprice) AS baseline, CASE WHEN count(*) > 1 THEN 'high' ELSE 'low' END AS confidence FROM sales GROUP BY ALL
), target AS (SELECT family, max(week) AS week FROM members GROUP BY family)"""


@query(_MEMBERS + f""", {_WAREHOUSE}, b AS (SELECT family, max(baseline) AS baseline, count(DISTINCT member) AS n_members FROM members GROUP BY family
), s AS (SELECT m.family, min(price) FILTER (WHERE confidence <> 'low') AS sale_low, max(price) FILTER (WHERE confidence <> 'low') AS sale_high, count(price) FILTER (WHERE confidence <> 'low') AS n_on_sale
  FROM members m JOIN target t ON m.family = t.family AND m.week = t.week GROUP BY m.family)
SELECT b.family, baseline, n_members, sale_low, sale_high, coalesce(n_on_sale, 0) AS n_on_sale, warehouse_price, round(sale_low / warehouse_price * 10000) / 10000 AS share_of_warehouse
FROM b LEFT JOIN s ON b.family = s.family LEFT JOIN warehouse w ON b.family = w.family""")
def family_view(spark, sf_dir):
    n = F.count(F.lit(1))
    members = sales(spark, sf_dir).groupBy(F.col("p_brand").alias("family"), F.col("p_name").alias("member"), "week").agg(F.min("price").alias("price"), F.max("p_retailprice").alias("baseline"), F.when(n > 1, "high").otherwise("low").alias("confidence"))
    return views.family_view(members, members.groupBy("family").agg(F.max("week").alias("week")), _warehouse(spark, sf_dir))


@query(SALES + """, r AS (SELECT feed, p_brand AS mapping, week, l_orderkey * 10 + l_linenumber AS row_seq, l_quantity AS score, CASE WHEN l_discount < 0.09 THEN price END AS unit_price, l_returnflag = 'R' AS manual_review,
  CASE WHEN l_discount < 0.02 THEN 'low' ELSE 'high' END AS confidence, p_name AS text FROM sales
), b AS (SELECT feed, mapping, week, arg_min((unit_price, manual_review, confidence, text, row_seq), (-score, row_seq)) AS b FROM r GROUP BY ALL)
SELECT feed, mapping, week, b[1] AS unit_price FROM b WHERE b[1] IS NOT NULL AND NOT b[2] AND b[3] <> 'low'""")
def mapping_weekly_series(spark, sf_dir):
    rows = sales(spark, sf_dir).select("feed", F.col("p_brand").alias("mapping"), "week", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_seq"), F.col("l_quantity").alias("score"),
        F.when(F.col("l_discount") < 0.09, F.col("price")).alias("unit_price"), (F.col("l_returnflag") == "R").alias("manual_review"), F.when(F.col("l_discount") < 0.02, "low").otherwise("high").alias("confidence"), F.col("p_name").alias("text"))
    return views.mapping_weekly_series(rows, ["feed", "mapping", "week"]).drop("text")


@query("""SELECT p_partkey, regexp_matches(p_name, 'ring|bolt') OR p_size % 10 = 0 OR p_type = 'PROMO' AS non_food FROM part""")
def non_food_offers(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("text", F.concat(F.upper("p_name"), F.when(F.col("p_size") % 10 == 0, " party tray").otherwise(" formula bar")))
    status = F.when(F.col("p_type") == "PROMO", "excluded")
    return part.select("p_partkey", views.is_non_food(F.col("text"), status, words=("ring", "bolt")).alias("non_food"))


@query("SELECT r_name AS feed, CASE WHEN r_regionkey % 2 = 0 THEN 'warehouse ' || r_regionkey END AS warehouse FROM region")
def feed_to_warehouse(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    pairs = region.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("feed"), F.concat(F.lit("warehouse "), F.col("r_regionkey")).alias("warehouse"))
    return views.feed_to_warehouse(region.select(F.col("r_name").alias("feed")), pairs)


@query("""WITH o AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'missing_tracker_id' WHEN l_returnflag = 'N' THEN 'unsupported_retailer' WHEN l_partkey % 5 = 0 THEN 'unknown_tracker' END AS first_reason FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n_obs, coalesce(first_reason, concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'cannot_normalize_unit_price' END, CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN 'package_size_out_of_family_range' END)) AS reasons,
  CASE WHEN l_quantity <= 1 THEN 'insufficient_data' WHEN l_quantity <= 3 THEN 'limited_data' ELSE 'full' END AS history_tier FROM o""")
def offer_comparability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 1, F.col("l_partkey").cast("string")).alias("tracker"), F.when(F.col("l_returnflag") != "N", "feed").alias("feed"), (F.col("l_partkey") % 5 != 0).alias("is_known"),
        F.when(F.col("l_discount") <= 0.05, F.col("l_extendedprice")).alias("unit_price"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" OZ")).alias("package"), F.lit("assorted, 10–40 oz").alias("subtitle"), F.col("l_quantity").cast("int").alias("n_obs"))
    return views.comparability(rows).select("l_orderkey", "l_linenumber", "n_obs", F.array_join("reasons", ",").alias("reasons"), "history_tier")


@query("""WITH c AS (SELECT p_brand || '_' || p_size AS family, min(p_name) AS name, p_brand AS brand, [min(p_name), max(p_name)] AS aliases, [max(p_name), 'no'] AS keep FROM part GROUP BY p_brand, p_size
), a AS (SELECT family, unnest(aliases) AS phrase FROM c), k AS (SELECT DISTINCT family, unnest(keep) AS phrase FROM c
), n AS (SELECT family AS peer, name AS phrase FROM c UNION SELECT family, lower(brand) FROM c UNION SELECT family, lower(replace(family, '_', ' ')) FROM c)
SELECT 'shared_alias' AS kind, phrase, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM a WHERE length(phrase) >= 3 GROUP BY phrase HAVING count(DISTINCT family) > 1
UNION ALL SELECT 'embedded_category_token', name, family FROM c WHERE list_has_any(string_split(name, ' '), ['ring', 'hot'])
UNION ALL SELECT 'multi_package_brand', lower(brand), string_agg(DISTINCT family, ',' ORDER BY family) FROM c GROUP BY lower(brand) HAVING count(DISTINCT family) > 1
UNION ALL SELECT 'brand_is_generic_food_term', lower(brand), family FROM c WHERE lower(brand) = 'brand#11'
UNION ALL SELECT 'keep_separate_peer', phrase, family || ',' || array_to_string(list_slice(list_sort(list(DISTINCT peer)), 1, 4), ',') FROM k JOIN n USING (phrase) WHERE length(phrase) >= 3 AND family <> peer GROUP BY family, phrase""")
def collision_kinds(spark, sf_dir):
    low, high = F.min("p_name"), F.max("p_name")
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(low.alias("name"), F.array(low, high).alias("aliases"), F.array(high, F.lit("no")).alias("keep_separate"))
    c = c.select(F.concat_ws("_", "p_brand", "p_size").alias("family"), "name", F.col("p_brand").alias("brand"), "aliases", "keep_separate")
    return views.collisions(c, ["ring", "hot"], ["brand#11"])


@query("""WITH c AS (SELECT d.*, quality, toxic, CASE WHEN quality = 1 THEN 'continue' WHEN toxic = 1 THEN 'any_non_match' WHEN n_chars % 2 = 0 THEN 'clarify' ELSE 'clarify_or_unsupported' END AS want,
  CASE WHEN n_chars > 900 THEN 'continue' WHEN n_chars > 400 THEN 'clarify' ELSE 'unsupported' END AS action, CASE WHEN n_chars > 900 THEN source END AS selected FROM documents d JOIN labels l ON d.doc_id = l.doc_id
), j AS (SELECT *, coalesce(selected = 'src0', FALSE) AS bad, CASE want WHEN 'continue' THEN action = 'continue' AND selected IS NOT DISTINCT FROM source WHEN 'clarify' THEN action = 'clarify' WHEN 'clarify_or_unsupported' THEN action IN ('clarify', 'unsupported')
  ELSE NOT (action = 'continue' AND selected IS NOT DISTINCT FROM 'src1') END AS good FROM c)
SELECT lang AS coverage_type, count(*) AS n, count(*) FILTER (WHERE good AND NOT bad) AS n_ok, count(*) FILTER (WHERE bad) AS n_forbidden FROM j GROUP BY lang""")
def catalog_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    want = F.when(F.col("quality") == 1, "continue").when(F.col("toxic") == 1, "any_non_match").when(n % 2 == 0, "clarify").otherwise("clarify_or_unsupported")
    cases = rows.select(F.col("lang").alias("coverage_type"), want.alias("expected_status"), F.col("source").alias("expected_family"), F.lit("src1").alias("family"), F.array(F.lit("src0")).alias("forbidden"),
        F.when(n > 900, "continue").when(n > 400, "clarify").otherwise("unsupported").alias("action"), F.when(n > 900, F.col("source")).alias("selected"))
    return views.catalog_eval(cases)
