"""Queries over weekly price series."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import series as ops
from priceloom.queries.base import LATEST, SALES, SERIES, SPARSE, SPINE, latest, query, sales, series, sparse, spine, table

AS_OF = "2001-06-15"

_BENCH = LATEST + """, bench AS (
  SELECT c.feed, c.family, c.week, c.current_price, min(h.price) AS all_time_low,
         min(h.price) FILTER (WHERE h.week >= c.week - INTERVAL 90 DAY) AS ninety_day_low, round(median(h.price) * 10000) / 10000 AS median_price,
         arg_max(h.price, h.week) AS latest_price, count(h.price) AS n_obs
  FROM latest c LEFT JOIN series h ON c.feed = h.feed AND c.family = h.family AND h.week < c.week
  GROUP BY c.feed, c.family, c.week, c.current_price
), labelled AS (
  SELECT *, round((current_price - all_time_low) / all_time_low * 100, 2) AS pct_above_low, round((median_price - current_price) / median_price * 100, 2) AS pct_below_median,
    CASE WHEN n_obs < 2 THEN 'insufficient history' WHEN current_price <= all_time_low * 1.001 THEN 'all-time low' WHEN current_price <= all_time_low * 1.05 THEN 'near all-time low'
         WHEN current_price < ninety_day_low * 0.999 OR current_price < median_price * 0.97 THEN 'strong sale' WHEN current_price <= median_price * 1.03 THEN 'normal sale' ELSE 'weak sale' END AS bucket
  FROM bench
)"""


def _bench(spark, sf_dir):
    rows = ops.benchmarks(series(spark, sf_dir), latest(spark, sf_dir))
    return rows.withColumn("bucket", ops.benchmark_bucket(F.col("current_price"), F.col("all_time_low"), F.col("ninety_day_low"), F.col("median_price"), F.col("n_obs")))


@query(_BENCH + """
SELECT feed, family, week, current_price, all_time_low, ninety_day_low, median_price, latest_price, n_obs, pct_above_low, pct_below_median, bucket,
       CAST(row_number() OVER (PARTITION BY feed ORDER BY CASE bucket WHEN 'all-time low' THEN 1 WHEN 'near all-time low' THEN 2 WHEN 'strong sale' THEN 3 WHEN 'normal sale' THEN 4 WHEN 'weak sale' THEN 5 ELSE 6 END,
                               pct_below_median DESC NULLS LAST, family) AS INTEGER) AS deal_rank
FROM labelled""")
def benchmarks(spark, sf_dir):
    rows = _bench(spark, sf_dir).withColumns({"on_sale": F.lit(True), "discount_percent": F.col("pct_below_median"), "name": F.col("family"), "id": F.col("family")})
    return ops.deal_quality(rows, "feed").drop("on_sale", "discount_percent", "name", "id")


@query(SERIES + "SELECT feed, family, week, price, confidence FROM series WHERE price IS NOT NULL AND confidence <> 'low'")
def chartable(spark, sf_dir):
    return ops.chartable(series(spark, sf_dir)).select("feed", "family", "week", "price", "confidence")


@query(SALES + """, weeks AS (SELECT DISTINCT week AS week_start, week + 6 AS week_end, 'ad-' || CAST(week AS VARCHAR) AS source_file FROM sales WHERE extract(year FROM week) = 2000)
SELECT s.week AS week_start, week_end, source_file, count(*) AS n_offers, min(price) AS low FROM sales s JOIN weeks ON s.week = weeks.week_start GROUP BY ALL""")
def offers_by_week(spark, sf_dir):
    offers = sales(spark, sf_dir).withColumn("week_start", F.col("week"))
    manifest = offers.where(F.year("week") == 2000).select("week_start").distinct().withColumns({"week_end": F.date_add("week_start", 6), "source_file": F.concat(F.lit("ad-"), F.col("week_start").cast("string"))})
    return ops.offers_by_week(offers, manifest).groupBy("week_start", "week_end", "source_file").agg(F.count(F.lit(1)).alias("n_offers"), F.min("price").alias("low"))


@query(SERIES + """, shelf AS (SELECT r_name AS feed, p_brand AS family, min(p_retailprice) AS price FROM part CROSS JOIN region GROUP BY ALL
), legacy(legacy_id, family_id) AS (VALUES ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#99')
), named AS (SELECT feed, family, price, 0 AS via FROM shelf UNION ALL SELECT feed, family_id, price, 1 FROM shelf JOIN legacy ON family = legacy_id
), best AS (SELECT feed, family, arg_min(price, via) AS shelf_price FROM named GROUP BY ALL)
SELECT s.feed, s.family, s.week, s.price, b.shelf_price FROM series s LEFT JOIN best b ON s.feed = b.feed AND s.family = b.family""")
def attach_baselines(spark, sf_dir):
    shelf = table(spark, sf_dir, "part").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).groupBy(F.col("r_name").alias("feed"), F.col("p_brand").alias("family")).agg(F.min("p_retailprice").alias("price"))
    legacy = spark.sql("SELECT * FROM VALUES ('Brand#1', 'Brand#2'), ('Brand#3', 'Brand#99') AS t(legacy_id, family_id)")
    return ops.attach_baselines(series(spark, sf_dir).drop("baseline"), shelf, legacy).select("feed", "family", "week", "price", F.col("baseline").alias("shelf_price"))


@query(SPINE + "SELECT feed, family, week, price FROM spine")
def price_spine(spark, sf_dir):
    return spine(spark, sf_dir).select("feed", "family", "week", "price")


@query(SERIES + """, a AS (SELECT family, week, min(price) AS price FROM series WHERE feed = 'ASIA' GROUP BY ALL), b AS (SELECT family, week, min(price) AS price FROM series WHERE feed = 'EUROPE' GROUP BY ALL)
SELECT coalesce(a.family, b.family) AS family, coalesce(a.week, b.week) AS week, coalesce(a.price, b.price) AS price, a.price IS NULL AND b.price IS NOT NULL AS filled
FROM a FULL JOIN b ON a.family = b.family AND a.week = b.week""")
def fill_legacy_prices(spark, sf_dir):
    own = lambda feed: series(spark, sf_dir).where(F.col("feed") == feed).groupBy("family", "week").agg(F.min("price").alias("price"))
    return ops.fill_legacy_prices(own("ASIA"), own("EUROPE"))


@query(SERIES + """SELECT feed, family, week, CASE WHEN confidence <> 'low' AND price > 0 THEN price ELSE coalesce(baseline, price) END AS effective_price,
  CASE WHEN confidence <> 'low' AND price > 0 THEN 'weekly_ad' WHEN baseline IS NULL THEN 'weekly_ad' ELSE 'baseline' END AS price_type,
  NOT (confidence <> 'low' AND price > 0) AND baseline IS NOT NULL AS is_baseline_fallback FROM series""")
def effective_weekly_price(spark, sf_dir):
    return ops.effective_weekly_price(series(spark, sf_dir)).select("feed", "family", "week", "effective_price", "price_type", "is_baseline_fallback")


@query(SPARSE + f"""SELECT feed, family, coalesce(arg_max(price, week) FILTER (WHERE ok AND week <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= week + 6),
  arg_max(price, week) FILTER (WHERE ok AND week <= DATE '{AS_OF}'), arg_max(price, week) FILTER (WHERE ok), max(baseline)) AS effective_price
FROM (SELECT *, price IS NOT NULL AND confidence <> 'low' AS ok FROM sparse) GROUP BY feed, family""")
def effective_price_as_of(spark, sf_dir):
    return ops.effective_price_as_of(sparse(spark, sf_dir).withColumn("week_end", F.date_add("week", 6)), F.lit(AS_OF).cast("date"))


@query(SERIES + """SELECT feed, family, week, price, min(price) OVER (PARTITION BY feed, family ORDER BY week RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS ninety_day_low FROM series""")
def trailing_low(spark, sf_dir):
    return ops.trailing_low(series(spark, sf_dir)).select("feed", "family", "week", "price", "ninety_day_low")


@query(SERIES + """SELECT feed, family, min(price) AS recent_low, count(*) AS n_points FROM (SELECT *, row_number() OVER (PARTITION BY feed, family ORDER BY week DESC) AS k FROM series) WHERE k <= 13 GROUP BY ALL""")
def recent_low(spark, sf_dir):
    return ops.recent_low(series(spark, sf_dir))


@query(SPINE + "SELECT feed, family, week, price, lag(price) OVER (PARTITION BY feed, family ORDER BY week) AS prior_price FROM spine")
def prior_week_price(spark, sf_dir):
    return ops.prior_week_price(spine(spark, sf_dir)).select("feed", "family", "week", "price", "prior_price")


@query(SPINE + "SELECT feed, family, week, price, min(price) OVER (PARTITION BY feed, family ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM spine")
def historical_low_before(spark, sf_dir):
    return ops.historical_low_before(spine(spark, sf_dir)).select("feed", "family", "week", "price", "low_before")


_MATCHED = SPINE + """, m AS (SELECT feed, family, week, price, last_value(CASE WHEN price IS NOT NULL THEN week END IGNORE NULLS) OVER w AS matched_week,
  last_value(price IGNORE NULLS) OVER w AS matched_price FROM spine WINDOW w AS (PARTITION BY feed, family ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(_MATCHED + "SELECT * FROM m")
def prior_matched_week(spark, sf_dir):
    return ops.prior_matched_week(spine(spark, sf_dir)).select("feed", "family", "week", "price", "matched_week", "matched_price")


@query(_MATCHED + "SELECT *, round(price / matched_price, 4) AS ratio FROM m WHERE price IS NOT NULL AND matched_price > 0 AND (price / matched_price >= 1.5 OR price - matched_price >= 1.5)")
def week_over_week_worsens(spark, sf_dir):
    return ops.week_over_week_worsens(spine(spark, sf_dir)).select("feed", "family", "week", "price", "matched_week", "matched_price", "ratio")


@query(SERIES + """SELECT feed, family, min(price) AS min_price, round(median(price) * 10000) / 10000 AS median_price, round(avg(price) * 10000) / 10000 AS avg_price, count(*) AS weeks_seen, arg_min(week, (price, week)) AS first_week_at_min
FROM series GROUP BY feed, family""")
def historical_stats(spark, sf_dir):
    return ops.historical_stats(series(spark, sf_dir))


@query(SERIES + "SELECT feed, family, coalesce(CASE WHEN family > 'Brand#2' THEN max(baseline) END, max(price) FILTER (WHERE confidence <> 'low')) AS effective_baseline FROM series GROUP BY feed, family")
def inferred_baseline(spark, sf_dir):
    return ops.inferred_baseline(series(spark, sf_dir).withColumn("baseline", F.when(F.col("family") > "Brand#2", F.col("baseline"))))


@query(SERIES + """SELECT feed, family, least(min(price), max(baseline)) AS range_low, greatest(max(price), max(baseline)) AS range_high, arg_max(price, week) AS current_price,
  CAST(greatest(round((max(baseline) - arg_max(price, week)) / max(baseline) * 100), 0) AS INTEGER) AS discount_percent FROM series GROUP BY feed, family""")
def observed_range(spark, sf_dir):
    return ops.observed_range(series(spark, sf_dir))


_MEMBERS = SALES + """, members AS (SELECT p_type AS family, week, p_name AS member, min(price) FILTER (WHERE l_discount > 0.05) AS price, min(price) AS effective_price, min(p_name || ' ' || p_brand) AS offer_text FROM sales GROUP BY ALL)"""


@query(_MEMBERS + """SELECT family, week, coalesce(min(price), min(effective_price)) AS low, max(price) AS high, arg_min(offer_text, CASE WHEN price IS NOT NULL THEN member END) AS offer_text, count(price) AS n_members
FROM members GROUP BY family, week""")
def member_week_range(spark, sf_dir):
    members = sales(spark, sf_dir).groupBy(F.col("p_type").alias("family"), "week", F.col("p_name").alias("member")).agg(
        F.min(F.when(F.col("l_discount") > 0.05, F.col("price"))).alias("price"), F.min("price").alias("effective_price"), F.min(F.concat_ws(" ", "p_name", "p_brand")).alias("offer_text"))
    return ops.member_week_range(members)


@query(LATEST + """SELECT c.feed, c.family, c.current_price, count(DISTINCT s.price) FILTER (WHERE s.price < c.current_price) + 1 AS rank_from_lowest, max(s.week) FILTER (WHERE s.price <= c.current_price + 0.001) AS last_week_at_or_below
FROM latest c LEFT JOIN series s ON c.feed = s.feed AND c.family = s.family GROUP BY ALL""")
def rank_from_lowest(spark, sf_dir):
    return ops.rank_from_lowest(series(spark, sf_dir), latest(spark, sf_dir))


@query(SERIES + """SELECT feed, family, string_agg(CAST(week AS VARCHAR), ',' ORDER BY week) AS weeks, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY feed, family ORDER BY week DESC) AS k FROM series) WHERE k <= 5 GROUP BY feed, family""")
def recent_observations(spark, sf_dir):
    return ops.recent_observations(series(spark, sf_dir)).select("feed", "family", F.concat_ws(",", F.transform("points.week", lambda w: w.cast("string"))).alias("weeks"), F.size("points").cast("long").alias("n"))


@query(SERIES + "SELECT feed, family, week, price, 'point' AS kind FROM series UNION ALL SELECT feed, family, min(week), max(baseline), 'anchor' FROM series GROUP BY feed, family")
def chart_rows(spark, sf_dir):
    return ops.chart_rows(series(spark, sf_dir))


@query(SERIES + f""", weeks AS (SELECT DISTINCT feed, week, week + 6 AS week_end FROM series)
SELECT feed, coalesce(max(week) FILTER (WHERE week - 1 <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= week_end), max(week) FILTER (WHERE week - 1 <= DATE '{AS_OF}'), max(week)) AS current_week, max(week) AS latest_week FROM weeks GROUP BY feed""")
def current_week(spark, sf_dir):
    return ops.current_week(series(spark, sf_dir).select("feed", "week", F.date_add("week", 6).alias("week_end")).distinct(), F.lit(AS_OF).cast("date"))


@query(SPINE + """, p AS (SELECT *, lag(price) OVER (PARTITION BY feed, family ORDER BY week) AS prior_price, max(week) OVER (PARTITION BY feed, family) AS latest FROM spine)
SELECT feed, family, week, price, prior_price FROM p WHERE week = latest AND price IS NOT NULL AND (prior_price IS NULL OR price < prior_price)""")
def preview_deals(spark, sf_dir):
    return ops.preview_deals(spine(spark, sf_dir))


@query(SERIES + """, e AS (SELECT feed || right(family, 1) AS card, family, week, price AS unit_price, baseline, confidence = 'low' AS is_baseline_fallback FROM series)
SELECT card, week, family, unit_price, is_baseline_fallback, card_baseline FROM (SELECT *, row_number() OVER (PARTITION BY card, week ORDER BY is_baseline_fallback, unit_price NULLS LAST, family) AS k,
  min(baseline) OVER (PARTITION BY card) AS card_baseline FROM e) WHERE k = 1""")
def merge_card_groups(spark, sf_dir):
    rows = series(spark, sf_dir).select(F.concat("feed", F.substring("family", -1, 1)).alias("card"), "family", "week", F.col("price").alias("unit_price"), "baseline", (F.col("confidence") == "low").alias("is_baseline_fallback"))
    return ops.merge_card_groups(rows).drop("baseline")


@query(_BENCH + "SELECT feed, family, current_price, row_number() OVER (PARTITION BY feed ORDER BY pct_below_median NULLS FIRST, family) <= 3 AS is_hidden FROM labelled")
def collapse_tail(spark, sf_dir):
    return ops.collapse_tail(_bench(spark, sf_dir), "feed", [F.col("pct_below_median").asc_nulls_first(), F.col("family")], 3).select("feed", "family", "current_price", "is_hidden")


@query(SPINE + f"""SELECT s.feed, s.week, count(DISTINCT family) AS tracked, count(price) AS matched, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, bool_or(DATE '{AS_OF}' < s.week - 1) AS is_preview
FROM spine s JOIN (SELECT feed, max(week) AS week FROM spine GROUP BY feed) l ON s.feed = l.feed AND s.week = l.week GROUP BY s.feed, s.week""")
def preview_summary(spark, sf_dir):
    return ops.preview_summary(spine(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query(SPINE + "SELECT feed, family, bool_or(price IS NOT NULL AND confidence <> 'low') AS has_history FROM spine GROUP BY feed, family")
def history_coverage(spark, sf_dir):
    return ops.history_coverage(spine(spark, sf_dir).withColumn("price", F.when(F.col("confidence") != "low", F.col("price"))))


@query(SPARSE + f""", ids AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS product, p_name AS family, CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 0 WHEN 'red' THEN 1 ELSE 2 END AS ord FROM part
), weeks AS (SELECT DISTINCT feed, week FROM sparse WHERE feed <> 'ASIA' OR week > DATE '{AS_OF}'
), tiers AS (SELECT feed, bool_or(week <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= week + 6) AS has_active, bool_or(week <= DATE '{AS_OF}') AS has_begun FROM weeks GROUP BY feed
), usable AS (SELECT w.* FROM weeks w JOIN tiers t ON w.feed = t.feed WHERE CASE WHEN has_active THEN week <= DATE '{AS_OF}' AND DATE '{AS_OF}' <= week + 6 WHEN has_begun THEN week <= DATE '{AS_OF}' ELSE TRUE END
), entry AS (SELECT s.feed, product, s.week, arg_min((CASE WHEN s.n % 5 > 0 THEN price END, confidence), (ord, s.family)) AS e FROM sparse s JOIN ids i ON s.family = i.family JOIN usable u ON s.feed = u.feed AND s.week = u.week GROUP BY ALL
), newest AS (SELECT feed, product, arg_max(e[1], week) FILTER (WHERE e[1] IS NOT NULL AND e[2] <> 'low') AS price FROM entry GROUP BY ALL
), b AS (SELECT feed, split_part(family, ' ', 2) AS product, max(baseline) AS baseline FROM sparse GROUP BY ALL)
SELECT b.feed, b.product, coalesce(price, baseline) AS effective_price FROM b LEFT JOIN newest n ON b.feed = n.feed AND b.product = n.product""")
def effective_price_by_first_entry(spark, sf_dir):
    """Products that stand for several families of different order; one feed has no week begun by the date."""
    s = sparse(spark, sf_dir)
    noun = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(2))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    ids = table(spark, sf_dir, "part").select(noun("p_name").alias("product"), F.col("p_name").alias("family"), F.when(first == "small", 0).when(first == "red", 1).otherwise(2).alias("ord")).distinct()
    weeks = s.select("feed", "week").distinct().where((F.col("feed") != "ASIA") | (F.col("week") > F.lit(AS_OF).cast("date"))).withColumn("week_end", F.date_add("week", 6))
    baselines = s.groupBy("feed", noun("family").alias("product")).agg(F.max("baseline").alias("baseline"))
    prices = s.withColumn("price", F.when(F.col("n") % 5 > 0, F.col("price")))
    return ops.effective_price_by_first_entry(prices, weeks, ids, baselines, F.lit(AS_OF).cast("date"))
