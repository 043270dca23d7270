"""Queries over votes, service logs and labelled cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import quality, votes
from priceloom.queries.base import query, table

_VOTES = "WITH votes AS (SELECT event_id, ts, event_type, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS item, value FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), "value")


@query(_VOTES + ", items AS (SELECT DISTINCT item FROM votes), t AS (SELECT item, count(DISTINCT u) AS n FROM votes WHERE event_type = 'view' GROUP BY item) SELECT i.item, coalesce(n, 0) AS votes FROM items i LEFT JOIN t ON i.item = t.item")
def vote_totals(spark, sf_dir):
    e = _events(spark, sf_dir)
    return votes.vote_totals(e.select("item").distinct(), e.where("event_type = 'view'"))


@query(_VOTES + ", t AS (SELECT item, count(DISTINCT u) AS votes FROM votes WHERE event_type = 'view' GROUP BY item) SELECT item, votes, CAST(sum(votes) OVER (PARTITION BY item % 7) AS BIGINT) AS poll_total, votes / sum(votes) OVER (PARTITION BY item % 7) AS share FROM t")
def poll_shares(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'view'")
    totals = votes.vote_totals(e.select("item").distinct(), e).withColumn("poll", F.col("item") % 7)
    return votes.poll_shares(totals, "poll").drop("poll")


@query(_VOTES + "SELECT event_id, item, u AS user_id FROM votes WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY item, u ORDER BY ts, event_id) = 1")
def first_votes(spark, sf_dir):
    return votes.first_votes(_events(spark, sf_dir).where("event_type = 'click'")).select("event_id", "item", F.col("user").alias("user_id"))


@query(_VOTES + """, t AS (SELECT item, count(DISTINCT u) AS votes, min(ts) FILTER (WHERE event_type = 'signup') AS approved_at, min(ts) AS created_at FROM votes GROUP BY item)
SELECT item, votes, CAST(row_number() OVER (ORDER BY votes DESC, approved_at NULLS LAST, created_at NULLS LAST, item) AS INTEGER) AS vote_rank FROM t""")
def rank_votes(spark, sf_dir):
    e = _events(spark, sf_dir)
    t = e.groupBy("item").agg(F.count_distinct("user").alias("votes"), F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("approved_at"), F.min("ts").alias("created_at"))
    return votes.rank_votes(t).select("item", "votes", "vote_rank")


@query("SELECT event_id AS id, value FROM events WHERE event_type = 'purchase' AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50")
def live_finds(spark, sf_dir):
    finds = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"), F.when(F.col("event_type") == "purchase", "approved").otherwise("pending").alias("status"))
    return votes.live_finds(finds, F.lit("2024-01-20").cast("timestamp")).select("id", "value")


_APPLY = _VOTES + """, e AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'vote' WHEN 'click' THEN 'suggest' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'merge' ELSE 'reject' END AS kind, 'item ' || item AS item, CAST(u AS VARCHAR) AS u, 'item ' || (item + 1) AS into_item FROM votes
), seq AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM e
), known AS (SELECT DISTINCT item, CASE WHEN length(item) = 6 THEN 'approved' ELSE 'pending' END AS status, 0 AS votes FROM e WHERE kind <> 'suggest' AND item < 'item 5'
), begun AS (SELECT item, status, 0 AS pos FROM known UNION ALL SELECT item, 'pending', min(pos) FROM seq WHERE kind = 'suggest' AND item NOT IN (SELECT item FROM known) GROUP BY item
), changes AS (SELECT * FROM begun UNION ALL SELECT s.item, CASE kind WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'merged' END, s.pos FROM seq s JOIN begun b ON s.item = b.item AND s.pos > b.pos WHERE kind IN ('approve', 'reject', 'merge')
), votes_ AS (SELECT item, u, pos FROM seq WHERE kind IN ('vote', 'suggest') AND u IS NOT NULL UNION ALL SELECT into_item, 'merge:' || item, pos FROM seq WHERE kind = 'merge'
), held AS (SELECT v.item, v.u, (SELECT arg_max(c.status, c.pos) FROM changes c WHERE c.item = v.item AND c.pos < v.pos) AS status FROM votes_ v
), added AS (SELECT item, count(DISTINCT u) AS n FROM held WHERE status = 'approved' GROUP BY item
)
SELECT c.item, arg_max(c.status, c.pos) AS status, coalesce(max(n), 0) AS votes FROM changes c LEFT JOIN added d ON c.item = d.item GROUP BY c.item"""


@query(_APPLY)
def apply_vote_events(spark, sf_dir):
    kind = F.col("event_type")
    name = F.concat(F.lit("item "), F.col("item"))
    e = _events(spark, sf_dir).select(
        "event_id", "ts", F.when(kind == "view", "vote").when(kind == "click", "suggest").when(kind == "purchase", "approve").when(kind == "signup", "merge").otherwise("reject").alias("kind"),
        name.alias("item"), F.concat(F.lit("  Item  "), F.col("item")).alias("raw_text"), F.col("user").cast("string").alias("user"), F.concat(F.lit("item "), F.col("item") + 1).alias("merge_into"))
    items = e.where("kind <> 'suggest' AND item < 'item 5'").select("item", F.when(F.length("item") == 6, "approved").otherwise("pending").alias("status"), F.lit(0).cast("long").alias("votes")).distinct()
    return votes.apply_vote_events(items, e)


@query("""SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE user_id % 5 = 0) AS errors, count(*) FILTER (WHERE user_id % 5 = 0) / count(*) AS error_rate, round(avg(value), 6) AS mean_latency, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def query_service_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 5 == 0, "error").otherwise("ok").alias("kind"), F.col("value").alias("latency"))
    return quality.service_metrics(e, ["event_type"]).withColumn("mean_latency", F.round("mean_latency", 6))


@query("""WITH t AS (SELECT event_id, user_id, ts, substr(sha256(event_type || '|' || props), 1, 16) AS digest FROM events) SELECT event_id, digest, row_number() OVER (PARTITION BY user_id, digest ORDER BY ts, event_id) > 1 AS is_loop FROM t""")
def clarify_loops(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return quality.clarify_loops(e, "user_id", "at", ["event_type", "props"]).select("event_id", "digest", "is_loop")


_CASES = """WITH cases AS (SELECT d.doc_id, lang, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS want, CASE WHEN toxic = 1 THEN 'x' ELSE lang END AS expected_family, lang AS family,
   CASE WHEN n_chars > 2000 THEN 'accepted' WHEN n_chars > 500 THEN 'manual_review' ELSE 'rejected' END AS got FROM documents d JOIN labels l ON d.doc_id = l.doc_id
), o AS (SELECT *, CASE WHEN want = 'accept' THEN CASE got WHEN 'accepted' THEN CASE WHEN family = expected_family THEN 'true_accept' ELSE 'wrong_family' END WHEN 'manual_review' THEN 'review_of_good' ELSE 'missed' END
   ELSE CASE got WHEN 'accepted' THEN 'false_accept' WHEN 'manual_review' THEN 'review_of_bad' ELSE 'true_reject' END END AS outcome FROM cases
), m AS (SELECT lang, count(*) AS n_cases, count(*) FILTER (WHERE outcome = 'true_accept') AS n_good, count(*) FILTER (WHERE outcome IN ('wrong_family', 'false_accept')) AS n_wrong, count(*) FILTER (WHERE want = 'accept') AS n_accept FROM o GROUP BY lang)
SELECT lang, n_cases, n_good, n_wrong, n_good / nullif(n_good + n_wrong, 0) AS precision, n_good / nullif(n_accept, 0) AS recall, n_wrong / n_cases AS false_match_rate FROM m"""


@query(_CASES)
def match_eval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = rows.select("lang", F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("expected_decision"), F.when(F.col("toxic") == 1, "x").otherwise(F.col("lang")).alias("expected_family"), F.col("lang").alias("family"),
                        F.when(F.col("n_chars") > 2000, "accepted").when(F.col("n_chars") > 500, "manual_review").otherwise("rejected").alias("decision"))
    return quality.match_metrics(quality.match_outcomes(cases), ["lang"])


@query("""WITH a AS (SELECT doc_id, quality = 1 AS quality, toxic = 0 AS toxic FROM labels), b AS (SELECT doc_id, n_chars > 600 AS quality, lang = 'en' AS toxic FROM documents),
u AS (SELECT 'quality' AS field, a.quality AS w, b.quality AS i FROM a JOIN b ON a.doc_id = b.doc_id UNION ALL SELECT 'toxic', a.toxic, b.toxic FROM a JOIN b ON a.doc_id = b.doc_id)
SELECT field, count(*) AS n, count(*) FILTER (WHERE w) AS n_was, count(*) FILTER (WHERE i) AS n_is, count(*) FILTER (WHERE NOT w AND i) AS improved, count(*) FILTER (WHERE w AND NOT i) AS regressed FROM u GROUP BY field""")
def compare_runs(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 0).alias("toxic"))
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 600).alias("quality"), (F.col("lang") == "en").alias("toxic"))
    return quality.compare_runs(a, b, "doc_id", ["quality", "toxic"])


_ACTIONS = "CASE event_type WHEN 'view' THEN 'clarify' WHEN 'click' THEN 'continue' WHEN 'purchase' THEN 'continue' WHEN 'signup' THEN 'unsupported' ELSE 'invalid' END"


@query(f"""WITH e AS (SELECT user_id, ts, {_ACTIONS} AS action, ts - lag(ts) OVER w > INTERVAL 2 DAY AS apart FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), n AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e
), t AS (SELECT user_id, s, date_trunc('month', min(ts)) AS month, min(ts) FILTER (WHERE action = 'clarify') AS asked_at, min(ts) FILTER (WHERE action = 'continue') AS first_go, max(ts) FILTER (WHERE action = 'continue') AS last_go FROM n GROUP BY ALL)
SELECT month, count(*) AS sessions, count(asked_at) AS asked, count(*) FILTER (WHERE last_go > asked_at) AS completed, count(*) FILTER (WHERE last_go > asked_at) / nullif(count(asked_at), 0) AS completion_rate,
  count(*) FILTER (WHERE first_go IS NOT NULL AND (asked_at IS NULL OR first_go < asked_at)) / count(*) AS direct_rate FROM t GROUP BY month""")
def session_completion(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_ACTIONS).alias("action"))
    sessions = quality.shopper_sessions(answers, gap="2 days").withColumn("month", F.date_trunc("month", "session_start"))
    return quality.completion_metrics(sessions, ["month"])


_FINDS = _VOTES + """, e AS (SELECT event_id, ts, item AS id, u AS voter, CASE event_type WHEN 'view' THEN 'vote' WHEN 'click' THEN 'vote' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'reject' ELSE 'report' END AS kind FROM votes
), f AS (SELECT item AS id, min(ts) + INTERVAL 3 DAY AS expires_at FROM votes WHERE item % 10 > 0 GROUP BY item
), s AS (SELECT id, arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('approve', 'reject')) AS last, max(ts) FILTER (WHERE kind = 'approve') AS approved, count(DISTINCT voter) FILTER (WHERE kind = 'vote') AS n, count(*) FILTER (WHERE kind = 'report') AS reports FROM e GROUP BY id)
SELECT f.id, CASE last WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, coalesce(approved + INTERVAL 3 DAY, expires_at) AS expires_at, 1 + n AS votes, reports FROM f JOIN s ON f.id = s.id"""


@query(_FINDS)
def apply_find_events(spark, sf_dir):
    kinds = F.col("event_type")
    e = _events(spark, sf_dir).select("event_id", "ts", F.col("item").alias("id"), F.col("user").alias("voter"), F.when(kinds.isin("view", "click"), "vote").when(kinds == "purchase", "approve").when(kinds == "signup", "reject").otherwise("report").alias("kind"))
    finds = e.where("id % 10 > 0").groupBy("id").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at")).withColumns({"status": F.lit("pending"), "votes": F.lit(1)})
    return votes.apply_find_events(finds, e)
