"""Queries that write tables as the files that the readers expect and read them back, and labels of weeks and matches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from priceloom.functions import text
from priceloom.operators import compare, content, views
from priceloom.operators.series import week_over_week_worsens
from priceloom.queries.base import SPARSE, query, sparse, table
from priceloom.sources import files


def _written(spark, df, name, **options):
    path = f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(header=True, **options).csv(path)
    return path


@query("SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS banner, min(CAST(o_orderdate AS DATE)) AS first_week, max(CAST(o_orderdate AS DATE) + 6) AS last_end, count(*) AS n FROM orders GROUP BY 1")
def read_manifest(spark, sf_dir):
    """Blank banners come back as null, dates as dates."""
    day = F.col("o_orderdate").cast("date")
    banner = F.when(F.col("o_orderpriority").startswith("1"), "  ").otherwise(F.col("o_orderpriority"))
    columns = {"source_file": F.lit("f"), "parent_company": F.lit(""), "banner": banner, "region": F.lit("r"), "representative_store_id": F.col("o_orderkey"), "week_start": day, "week_end": F.date_add(day, 6), "notes": F.lit("a, \"b\"")}
    path = _written(spark, table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in columns.items()]), "manifest", escape='"')
    return files.read_manifest(spark, path).groupBy("banner").agg(F.min("week_start").alias("first_week"), F.max("week_end").alias("last_end"), F.count(F.lit(1)).alias("n"))


def _offers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    banner = F.when(F.col("l_returnflag") == "R", " VONS ").when(F.col("l_returnflag") == "A", "Safeway").otherwise("")
    price = F.concat(F.lit("$"), F.floor("l_quantity").cast("string"), F.lit(".50"))
    known = {
        "split_item_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "banner": banner, "week_start": F.date_format("l_shipdate", "yyyy-MM-dd"), "page_number": F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("string")).otherwise("cover"),
        "split_product_text": F.lit("a, \"quoted\" text"), "advertised_price": F.when(F.col("l_linenumber") == 7, "$").otherwise(price), "split_status": F.when(F.col("l_linenumber") == 1, "excluded").otherwise("ok"),
    }
    return _written(spark, lines.select(*[known.get(c, F.lit("")).alias(c) for c in files.OFFER_STRINGS]), "offers", escape='"')


@query("SELECT CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, count(*) AS n_items FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def read_offers(spark, sf_dir):
    rows = files.read_offers(spark, _offers(spark, sf_dir), "vons")
    return rows.groupBy(F.split_part("split_item_id", F.lit("-"), F.lit(2)).cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_seq").alias("n_items"))


@query("SELECT CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS INTEGER) END AS page_number, count(*) AS n, sum(CASE WHEN l_linenumber <> 7 THEN floor(l_quantity) + 0.5 END) AS total, min(CAST(l_shipdate AS DATE)) AS first_week FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber <> 1 GROUP BY 1")
def read_typed_offers(spark, sf_dir):
    rows = files.read_typed_offers(spark, _offers(spark, sf_dir), "Vons")
    return rows.groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), F.sum("advertised_price").alias("total"), F.min("week_start").alias("first_week"))


@query("SELECT p_brand AS region, count(*) AS n, sum(CASE WHEN p_brand = 'Brand#7' THEN p_retailprice + 1 ELSE p_retailprice END) AS total FROM part GROUP BY 1")
def cache_observations(spark, sf_dir):
    """All regions, then one of them again with other prices: the rest stay."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_brand").alias("region"))
    path = f"{files.shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    files.cache_observations(rows, path)
    files.cache_observations(rows.where("region = 'Brand#7'").withColumn("price", F.col("price") + 1), path)
    return files.load_cached(spark, path).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("SELECT CAST(p_size AS VARCHAR) AS size, count(*) AS n FROM part GROUP BY p_size")
def write_report(spark, sf_dir):
    path = f"{files.shared_dir(spark)}/report-{uuid.uuid4().hex}"
    files.write_report(table(spark, sf_dir, "part").withColumnRenamed("p_size", "size"), ["size", "p_name"], path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("size", "p_name").groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT conv_id, turn, length(coalesce(text, '')) + length(role) + 1 AS n_text, CAST(conv_id AS VARCHAR) AS title FROM conversations WHERE text IS NOT NULL")
def read_transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = rows.select(F.col("conv_id").cast("string").alias("Video_Title"), F.to_json(F.struct("conv_id", "turn")).alias("url"), F.col("text").alias("full_transcript"), F.col("role").alias("caption"))
    read = files.read_transcripts(rows)
    key = F.from_json("url", "conv_id bigint, turn bigint")
    return read.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), F.length("text").cast("long").alias("n_text"), "title")


@query("SELECT event_id, event_type AS search_query FROM events WHERE event_type <> 'view' AND user_id % 3 <> 0")
def read_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("search_query"), F.when(F.col("user_id") % 3 == 0, "Done ").otherwise(" OPEN").alias("status"))
    return files.read_ledger(rows, ["open"]).select("event_id", "search_query")


@query(
    """WITH docs AS (SELECT user_id, ts, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS price, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS candidate_rank FROM events WHERE user_id IS NOT NULL)
SELECT user_id, candidate_rank, 'item ' || event_id AS product_name, price FROM docs WHERE candidate_rank <= 10"""
)
def search_result_ranks(spark, sf_dir):
    """Responses of many products, whose names and prices stand under different keys; the first ten of each."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    k, name = F.get_json_object("props", "$.k"), F.concat(F.lit('"item '), F.col("event_id").cast("string"), F.lit('"'))
    doc = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"name": '), name, F.lit(', "price": {"value": '), k, F.lit("}}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"title": '), name, F.lit(', "price": '), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"title": '), name, F.lit(', "basePrice": '), k, F.lit("}")))
    )
    bodies = e.groupBy("user_id").agg(F.concat(F.lit('{"response": {"docs": ['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", doc.alias("doc")))), lambda x: x["doc"]), ", "), F.lit("]}}")).alias("body"))
    return files.flatten_search_results(bodies, "user_id", "body").select("user_id", F.col("candidate_rank").cast("long").alias("candidate_rank"), "product_name", "price")


@query(
    """WITH w AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(l_linenumber AS INTEGER) AS s FROM lineitem)
SELECT s AS week_start, 'Vons weekly ad, ' || strftime(s, '%b %-d') || ' to ' || strftime(s + 6, '%b %-d, %Y') AS label, CAST(s + CAST((12 - isodow(s)) % 7 AS INTEGER) AS DATE) AS friday, CASE WHEN DATE '1997-01-15' < s - 1 THEN 'preview' WHEN DATE '1997-01-15' <= s + 6 THEN 'active' ELSE 'past' END AS state FROM w"""
)
def week_labels(spark, sf_dir):
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").select(F.date_add(week, F.col("l_linenumber").cast("int")).alias("week_start")).distinct()
    start, end = F.col("week_start"), F.date_add("week_start", 6)
    return rows.select("week_start", text.week_label(F.lit("Vons"), start, end).alias("label"), text.friday_of_week(start).alias("friday"), text.preview_state(F.lit("1997-01-15").cast("date"), start, end).alias("state"))


_STATUS = "CASE p_type WHEN 'ECONOMY' THEN 'unit_mismatch' WHEN 'PROMO' THEN 'needs_review' WHEN 'LARGE' THEN 'not_sold' ELSE 'comparable' END"
_ITEM = "CASE WHEN p_size % 5 = 0 THEN 'Kirkland ' || p_name WHEN p_size % 7 > 0 THEN p_name END"


@query(f"""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_retailprice / p_size END AS g, p_retailprice / 20 AS w, lower({_ITEM}) AS item, {_STATUS} AS status FROM part
), k AS (SELECT *, CASE WHEN g IS NULL OR item IS NULL THEN 'no comp' WHEN contains(item, 'kirkland') THEN 'different brand same category' WHEN regexp_matches(item, 'ring|^red') THEN 'exact brand' ELSE 'category benchmark only' END AS match_type FROM r)
SELECT p_partkey, match_type, CASE WHEN match_type = 'no comp' THEN 'low' WHEN status = 'unit_mismatch' THEN 'low' WHEN status = 'not_sold' THEN 'medium' WHEN status = 'needs_review' OR match_type = 'category benchmark only' THEN 'medium' ELSE 'high' END AS match_confidence,
  coalesce(contains(item, 'kirkland'), FALSE) AS own_brand, CASE WHEN status IN ('comparable', 'needs_review') AND match_type <> 'no comp' THEN round((w - g) / w * 100 * 100) / 100 END AS pct_cheaper FROM k""")
def warehouse_match_label(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice") / F.col("p_size")).alias("grocer_unit_price"), (F.col("p_retailprice") / 20).alias("warehouse_unit_price"), F.expr(_ITEM).alias("item_name"), F.array(F.lit("ring"), F.lit("^red")).alias("prefer"), F.expr(_STATUS).alias("status")
    )
    return compare.warehouse_match_label(rows).select("p_partkey", "match_type", "match_confidence", "own_brand", "pct_cheaper")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars % 3 > 0) AS judged, count(*) FILTER (WHERE n_chars % 3 > 0 AND (n_chars % 3 = 1) = (quality = 1)) AS matched FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def assessment_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expected = F.when(F.col("n_chars") % 3 == 1, "good").when(F.col("n_chars") % 3 == 2, "bad")
    return views.assessment_eval(rows.select("lang", expected.alias("expect_verdict"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict")), ["lang"])


@query(
    SPARSE
    + """, p AS (SELECT feed, family, week, price, last_value(price IGNORE NULLS) OVER (PARTITION BY feed, family ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM sparse
), w AS (SELECT feed, family, week, price / prior AS ratio FROM p WHERE prior > 0 AND (price / prior >= 1.5 OR price - prior >= 1.5))
SELECT feed, family, week, CAST(row_number() OVER (PARTITION BY feed ORDER BY round(ratio, 6) DESC, family, week) AS BIGINT) AS place FROM w QUALIFY place <= 100"""
)
def worsened_report(spark, sf_dir):
    """The hundred worst of each feed (a top-k report)."""
    from pyspark.sql import Window

    rows = week_over_week_worsens(sparse(spark, sf_dir)).withColumn("ratio", F.round(F.col("price") / F.col("matched_price"), 6))
    order = Window.partitionBy("feed").orderBy(*content.worsened_order(), "week")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 100").select("feed", "family", "week", "place")
