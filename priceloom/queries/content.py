"""Queries over watchlists, views, shortlists and report orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import content as ops
from priceloom.queries.base import LATEST, SALES, latest, query, sales, table
from priceloom.queries.compare import _LABEL
from priceloom.queries.series import _bench
from priceloom.functions import labels


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('ALL', 'MACHINERY')")
def eligible_watchlist(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("include"), F.col("c_mktsegment").alias("market"))
    return ops.eligible_watchlist(rows, "machinery").select("id")


@query("SELECT p_partkey FROM part WHERE p_size <= 45 AND p_type <> 'PROMO'")
def active_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 45, True).alias("is_excluded"), F.when(F.col("p_type") == "PROMO", "Inactive").alias("confidence"))
    return ops.active_catalog(rows).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%ring%' AND p_brand = 'Brand#7'")
def search_and_section(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("subtitle"), F.col("p_brand").alias("section"))
    return ops.search_section(rows, " Ring ", "Brand#7").select("p_partkey")


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND value > 50")
def open_corrections(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "reviewed").otherwise("new").alias("status"), F.col("user_id").alias("family"), F.col("props").alias("text"))
    return ops.open_corrections(rows, "click").select("id")


@query(LATEST + "SELECT l.feed, l.family, current_price, name FROM latest l JOIN (SELECT DISTINCT p_brand AS family FROM part) w ON l.family = w.family LEFT JOIN (SELECT p_brand AS family, min(p_name) AS name FROM part GROUP BY p_brand) d ON l.family = d.family WHERE l.feed <> 'ASIA'")
def match_watchlist(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    best = latest(spark, sf_dir).withColumn("decision", F.when(F.col("feed") != "ASIA", "accepted").otherwise("rejected"))
    return ops.match_watchlist(part.select(F.col("p_brand").alias("family")).distinct(), best, part.groupBy(F.col("p_brand").alias("family")).agg(F.min("p_name").alias("name"))).select("feed", "family", "current_price", "name")


@query(SALES + "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM sales WHERE l_quantity > 48) AND regexp_matches(p_name, 'ring|bolt|plate') AND NOT regexp_matches(p_name, 'old')")
def unmatched_food_offers(spark, sf_dir):
    used = sales(spark, sf_dir).where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return ops.unmatched_food(table(spark, sf_dir, "part"), used, "p_partkey", "ring|bolt|plate", "old", "p_name").select("p_partkey")


@query(LATEST + "SELECT a.family, CASE WHEN a.family > 'Brand#2' AND b.family <> 'Brand#22' THEN b.current_price ELSE a.current_price END AS price, a.family > 'Brand#2' AND b.family <> 'Brand#22' AS is_enriched FROM latest a JOIN latest b ON a.family = b.family WHERE a.feed = 'ASIA' AND b.feed = 'EUROPE'")
def enrich_sparse(spark, sf_dir):
    now = latest(spark, sf_dir).withColumn("price", F.col("current_price"))
    view = now.where("feed = 'ASIA'").withColumn("is_chartable", F.col("family") <= "Brand#2")
    return ops.enrich_sparse(view, now.where("feed = 'EUROPE'").withColumn("is_chartable", F.col("family") != "Brand#22"), "family", ["price"])


@query(LATEST + """, picks AS (SELECT week, family, 5.0 AS o FROM latest WHERE feed = 'ASIA' UNION ALL SELECT week, family, NULL FROM latest WHERE feed = 'EUROPE' AND week NOT IN (SELECT week FROM latest WHERE feed = 'ASIA'))
SELECT p.week, p.family, coalesce(o, v.price) AS shown_price FROM picks p LEFT JOIN (SELECT family, min(current_price) AS price FROM latest GROUP BY family) v ON p.family = v.family""")
def popular_picks(spark, sf_dir):
    now = latest(spark, sf_dir)
    editorial = now.where("feed = 'ASIA'").select("week", "family", F.lit(5.0).alias("price_override"))
    view = now.groupBy("family").agg(F.min("current_price").alias("price"))
    return ops.popular_picks(now.where("feed = 'EUROPE'").select("week", "family"), editorial, view).select("week", "family", "shown_price")


@query(SALES + """, s(item, query) AS (VALUES (1, 'ring'), (2, 'red b'), (3, 'nothing')), o AS (SELECT feed, p_name, price, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS row_seq FROM sales)
SELECT item, r_name AS store, arg_min(p_name, row_seq) AS text, arg_min(price, row_seq) AS price FROM s CROSS JOIN region LEFT JOIN o ON o.feed = r_name AND contains(p_name, query) GROUP BY item, r_name""")
def shortlist_items(spark, sf_dir):
    offers = sales(spark, sf_dir).select(F.col("feed").alias("store"), F.col("p_name").alias("text"), "price", (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("row_seq"))
    seed = spark.sql("SELECT * FROM VALUES (1, 'ring'), (2, 'red b'), (3, 'nothing') AS t(item, query)").crossJoin(table(spark, sf_dir, "region").select(F.col("r_name").alias("store")))
    return ops.shortlist_items(seed, offers).select("item", "store", "text", "price")


@query("SELECT p_brand AS section, count(*) AS n_items, count(*) FILTER (WHERE p_size % 3 = 0) AS n_with_data, count(*) FILTER (WHERE p_size % 3 = 1) AS n_gap, count(*) FILTER (WHERE p_size % 3 = 2) AS n_unmapped FROM part GROUP BY p_brand")
def mapping_coverage_audit(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("section"), "p_size")
    return ops.mapping_coverage(part.drop("p_size"), part.where("p_size % 3 < 2").select("item", (F.col("p_size") % 3 == 1).alias("is_coverage_gap")))


@query("SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'deals' ELSE 'staples' END AS category, string_agg(p_partkey, ',' ORDER BY p_partkey) AS items, count(*) AS n, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 2 END AS place FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY ALL")
def handpicked_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("badge"))
    return ops.handpicked_groups(rows, {"ECONOMY": "deals", "PROMO": "deals", "STANDARD": "staples"})


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS food_kept, count(*) FILTER (WHERE event_type = 'error') AS food_excluded, count(*) FILTER (WHERE value > 20) AS ok_searches, count(*) FILTER (WHERE value <= 20) AS failed_searches, count(*) FILTER (WHERE user_id % 2 = 0) AS needs_selection FROM events")
def input_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ops.input_audit(e.select((F.col("event_type") != "error").alias("is_food"), F.when(F.col("value") > 20, "ok").otherwise("failed").alias("search_status"), (F.col("user_id") % 2 == 0).alias("needs_selection")))


@query(_LABEL + """SELECT feed, family, CAST(row_number() OVER (PARTITION BY feed ORDER BY family = 'Brand#7', label <> 'all-time low', label <> 'tied all-time low', label <> 'within 5% of all-time low', coalesce(pct_below_median, 0) DESC, coalesce(pct_above_low, 0) DESC, family) AS INTEGER) AS historical_rank FROM named""")
def rank_historical(spark, sf_dir):
    rows = _bench(spark, sf_dir).withColumns({"label": labels.historical_label(F.col("current_price"), F.col("all_time_low"), F.col("median_price"), F.col("n_obs")), "is_review": F.col("family") == "Brand#7", "advantage": F.col("pct_above_low"), "id": F.col("family")})
    return ops.rank_historical(rows, ["feed"]).select("feed", "family", "historical_rank")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'PROMO' DESC, p_size DESC, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_partkey) AS INTEGER) AS deal_order, CASE WHEN p_type = 'PROMO' THEN '$5 Friday' WHEN p_size > 25 THEN 'Multi-buy' ELSE 'Sale' END AS deal_type FROM part")
def rank_deals(spark, sf_dir):
    kind = F.col("p_type")
    rows = table(spark, sf_dir, "part").withColumns({"is_friday": kind == "PROMO", "score": F.col("p_size"), "confidence": F.when(kind == "ECONOMY", "high").when(kind == "STANDARD", "medium"), "id": F.col("p_partkey")})
    label = ops.deal_type(F.when(F.col("p_size") > 25, "multi_buy"), F.when(kind == "PROMO", "friday_only").otherwise("all_week"))
    return ops.rank_deals(rows, ["p_brand"]).select("p_partkey", "deal_order", label.alias("deal_type"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size - 20.5 AS pct, p_size % 2 = 0 AS usable, p_size % 2 = 1 AND p_type = 'PROMO' AS proxy, p_size % 5 = 0 AS gap, p_size = 7 AS manual, CASE WHEN p_type = 'ECONOMY' THEN 'Strong' END AS strength, p_type = 'STANDARD' AS friday, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS wp FROM part)
SELECT p_partkey, CASE WHEN manual THEN 'manual verification' WHEN usable AND NOT gap AND pct >= 20 THEN 'lead-worthy' WHEN usable AND NOT gap AND pct >= 8 THEN 'strong supporting mention' WHEN usable AND NOT gap THEN 'quick mention'
    WHEN proxy AND NOT gap AND pct > 0 OR strength = 'Strong' THEN 'strong supporting mention' ELSE 'quick mention' END AS safety, usable AND NOT gap AND pct >= 8 AS cheaper,
  CASE WHEN wp IS NULL OR gap THEN 'Good ad price, but no Warehouse comparison available.' WHEN pct >= 8 THEN p_brand || ' is about ' || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '% cheaper than Warehouse on this.'
    ELSE 'Warehouse is similar or a little cheaper, but ' || p_brand || ' wins if you want variety or smaller quantity.' END
  || CASE WHEN proxy AND wp IS NOT NULL AND NOT gap THEN ' This is a directional comparison, not exact.' ELSE '' END || CASE WHEN friday THEN ' (Friday-only, not valid all week.)' ELSE '' END AS line FROM p""")
def shortlist_labels(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_type")
    pct, usable, proxy, gap = size - F.lit(20.5), size % 2 == 0, (size % 2 == 1) & (kind == "PROMO"), size % 5 == 0
    strength = F.when(kind == "ECONOMY", "Strong")
    line = labels.script_line(F.col("p_brand"), F.when(size % 3 > 0, F.col("p_retailprice")), gap, pct, proxy, kind == "STANDARD")
    return table(spark, sf_dir, "part").select(
        "p_partkey", labels.script_safety(usable, proxy, pct, gap, size == 7, strength).alias("safety"), labels.can_say_cheaper(usable, gap, pct).alias("cheaper"), line.alias("line")
    )


@query("""WITH p AS (SELECT p_partkey, p_name, p_type, p_size, string_split(p_name, ' ') AS words, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN floor(p_retailprice) ELSE round(p_retailprice, 2) END AS price FROM part
), q AS (SELECT *, CASE WHEN price IS NULL THEN 'on sale' WHEN price = floor(price) THEN '$' || CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE printf('$%.2f', price) END AS said,
  CASE WHEN p_size % 3 = 0 THEN words[1] WHEN p_size % 3 = 1 THEN words[1] || ' and ' || words[2] ELSE words[1] || ', ' || words[2] || ', and ' || p_type END AS lines FROM p)
SELECT p_partkey, CASE WHEN p_size > 25 AND p_type <> 'PROMO' THEN lines || ' family-size boxes are ' || said || ' this week, the app labels it as ' || p_type || ', but those are the actual eligible items.' ELSE p_name || ' are ' || said || ' this week.' END AS blurb FROM q""")
def shortlist_blurb(spark, sf_dir):
    size, word = F.col("p_size"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    price = F.when(size % 4 == 0, None).when(size % 4 == 1, F.floor("p_retailprice").cast("double")).otherwise(F.round("p_retailprice", 2))
    lines = F.when(size % 3 == 0, F.array(word(1), F.lit(""))).when(size % 3 == 1, F.array(word(1), word(2))).otherwise(F.array(word(1), word(2), F.col("p_type")))
    blurb = labels.shortlist_blurb(F.col("p_name"), price, lines, size > 25, F.col("p_type") != "PROMO", F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", blurb.alias("blurb"))
