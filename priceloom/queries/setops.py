"""Queries over upserts and set operations: two halves of the sales as old and new."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import setops as ops
from priceloom.queries.base import SALES, query, sales, table

CUT = "2000-01-01"
_HALVES = SALES + f""", old AS (SELECT p_name AS family, week, floor(min(price)) AS price FROM sales WHERE l_returnflag <> 'N' GROUP BY p_name, week
), new AS (SELECT p_name AS family, week, floor(min(price)) AS price FROM sales WHERE week >= DATE '{CUT}' GROUP BY p_name, week)"""
KEYS = ["family", "week"]


def _halves(spark, sf_dir):
    s = sales(spark, sf_dir)
    weekly = lambda rows: rows.groupBy(F.col("p_name").alias("family"), "week").agg(F.floor(F.min("price")).cast("double").alias("price"))
    return weekly(s.where("l_returnflag <> 'N'")), weekly(s.where(f"week >= DATE '{CUT}'"))


@query(_HALVES + "SELECT coalesce(n.family, o.family) AS family, coalesce(n.week, o.week) AS week, CASE WHEN n.family IS NOT NULL THEN n.price ELSE o.price END AS price FROM old o FULL JOIN new n ON o.family = n.family AND o.week = n.week")
def upsert_table(spark, sf_dir):
    return ops.upsert(*_halves(spark, sf_dir), KEYS)


@query(_HALVES + """, a AS (SELECT CASE WHEN o.family IS NULL THEN 'inserted' WHEN o.price IS NOT DISTINCT FROM n.price THEN 'skipped' ELSE 'updated' END AS action FROM new n LEFT JOIN old o ON o.family = n.family AND o.week = n.week)
SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'skipped') AS skipped, count(*) AS matched FROM a""")
def upsert_week_prices(spark, sf_dir):
    return ops.action_counts(ops.upsert_actions(*_halves(spark, sf_dir), KEYS, ["price"]))


@query(_HALVES + "SELECT family, week, price FROM new UNION ALL SELECT o.family, o.week, o.price FROM old o ANTI JOIN new n ON o.family = n.family AND o.week = n.week")
def union_weeks(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return ops.union_missing(new, old, KEYS)


@query(_HALVES + ", n2 AS (SELECT * FROM new WHERE family < 'm') SELECT family, week, price FROM n2 UNION ALL SELECT * FROM old WHERE family NOT IN (SELECT family FROM n2)")
def replace_candidates(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return ops.replace_groups(old, new.where("family < 'm'"), ["family"])


@query(_HALVES + "SELECT * FROM old WHERE week NOT IN (SELECT week FROM new) UNION ALL SELECT * FROM new")
def replace_week_partition(spark, sf_dir):
    return ops.replace_groups(*_halves(spark, sf_dir), ["week"])


@query(SALES + f"""SELECT DISTINCT l_partkey, 'removed' AS change FROM sales WHERE week < DATE '{CUT}' AND l_partkey NOT IN (SELECT l_partkey FROM sales WHERE week >= DATE '{CUT}')
UNION ALL SELECT DISTINCT l_partkey, 'added' FROM sales WHERE week >= DATE '{CUT}' AND l_partkey NOT IN (SELECT l_partkey FROM sales WHERE week < DATE '{CUT}')""")
def same_ids(spark, sf_dir):
    s = sales(spark, sf_dir)
    return ops.same_ids(s.where(f"week < DATE '{CUT}'"), s.where(f"week >= DATE '{CUT}'"), "l_partkey")


@query(SALES + f"SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM sales WHERE week < DATE '{CUT}' AND l_returnflag = 'R')")
def select_targets(spark, sf_dir):
    published = sales(spark, sf_dir).where(f"week < DATE '{CUT}' AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return ops.select_targets(table(spark, sf_dir, "part"), "p_partkey", published=published).select("p_partkey", "p_name")


_RESULTS = """results AS (SELECT user_id AS id, event_id AS n, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'open' END AS status FROM events
), last AS (SELECT id, arg_max(status, n) AS status, max(n) AS n FROM results GROUP BY id)"""


def _results(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("n"), F.when(kind == "purchase", "ok").when(kind == "error", "failed").otherwise("open").alias("status"))


@query("WITH " + _RESULTS + " SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM last WHERE status = 'ok')")
def pending_items(spark, sf_dir):
    ledger = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return ops.pending(ledger, _results(spark, sf_dir), "id", "n", retry=True)


@query("WITH " + _RESULTS + " SELECT id, n, status FROM last")
def merge_results(spark, sf_dir):
    return ops.merge_last(_results(spark, sf_dir), "id", "n")


_CROPS = SALES + """, raw AS (SELECT feed, l_partkey AS page, l_linenumber AS idx, round(min(price)) AS original_price, round(min(price) * CASE WHEN max(l_discount) > 0.09 THEN 1.1 WHEN max(l_discount) < 0.01 THEN 0.9 ELSE 1 END) AS verified_price,
    CASE WHEN max(l_orderkey) % 10 = 0 THEN 'crop_tile_mismatch' ELSE 'ok' END AS review_reasons FROM sales GROUP BY ALL
), raw2 AS (SELECT *, verified_price AS final_price FROM raw), split AS (SELECT feed, page, idx, CASE WHEN idx = 1 THEN final_price + 1 ELSE final_price END AS final_price, review_reasons FROM raw2
), found AS (SELECT *, CASE WHEN verified_price - original_price >= 0.01 THEN 'raised' WHEN verified_price - original_price <= -0.01 THEN 'lowered' ELSE 'tag only' END AS note, 'raw' AS origin FROM raw2 WHERE review_reasons LIKE '%crop%' OR abs(verified_price - original_price) >= 0.01)
SELECT feed, page, idx, final_price, note, origin FROM found UNION ALL
SELECT feed, page, idx, final_price, 'tag only', 'split' FROM split s WHERE review_reasons LIKE '%crop%' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.feed = s.feed AND f.page = s.page AND f.idx = s.idx AND f.final_price = s.final_price)"""


@query(_CROPS)
def crop_override_findings(spark, sf_dir):
    rows = sales(spark, sf_dir).groupBy("feed", F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("idx")).agg(F.min("price").alias("p"), F.max("l_discount").alias("d"), F.max("l_orderkey").alias("k"))
    raw = rows.select(
        "feed", "page", "idx", F.round("p").alias("original_price"), F.round(F.col("p") * F.when(F.col("d") > 0.09, 1.1).when(F.col("d") < 0.01, 0.9).otherwise(1)).alias("verified_price"),
        F.when(F.col("k") % 10 == 0, "crop_tile_mismatch").otherwise("ok").alias("review_reasons"),
    ).withColumn("final_price", F.col("verified_price"))
    split = raw.select("feed", "page", "idx", F.when(F.col("idx") == 1, F.col("final_price") + 1).otherwise(F.col("final_price")).alias("final_price"), "review_reasons")
    return ops.crop_findings(raw, split).select("feed", "page", "idx", "final_price", "note", "origin")
