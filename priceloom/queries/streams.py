"""Streaming queries over the events table, run to completion with what is available, and source round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.queries.base import query, table
from priceloom.sources import files
from priceloom.streaming import flows


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result as a table once its input is used up; result and checkpoint lie in the shared folder."""
    root = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/result")
    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/result")


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS item, count(DISTINCT user_id) AS votes FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_vote_tally(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'view'").select("ts", F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"))
    return _drained(spark, flows.stream_vote_tally(e, delay="400 days"), "complete")


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS item, count(DISTINCT user_id) AS votes FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_voters(spark, sf_dir):
    """The votes of all events, with the voters as a table and none that repeats within 400 days."""
    e = _events(spark, sf_dir).where("event_type = 'view'").select("ts", F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("item"))
    root = f"{files.shared_dir(spark)}/voters-{uuid.uuid4().hex}"
    flows.stream_voters(e, root, 400).trigger(availableNow=True).start().awaitTermination()
    return flows.voter_tally(spark, root)


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1")
def stream_query_metrics(spark, sf_dir):
    e = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"), F.col("value").alias("latency"))
    return _drained(spark, flows.stream_query_metrics(e, width="1 hour"), "complete").withColumn("mean_latency", F.round("mean_latency", 6))


@query("SELECT p_brand AS family, count(*) AS n_weeks, min(p_retailprice) AS low FROM (SELECT p_brand, p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand, p_size) GROUP BY p_brand")
def price_map_round_trip(spark, sf_dir):
    """Rows to nested JSON maps and back."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_size").cast("string").alias("week")).agg(F.min("p_retailprice").alias("price"))
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("offerText", "confidence", "availabilityType", "promoNote")})
    maps = files.nest_price_map(full).select(F.to_json(F.create_map("family", F.from_json("json", f"map<string, {files.PRICE_ENTRY}>"))).alias("json"))
    return files.flatten_price_map(maps).groupBy("family").agg(F.count(F.lit(1)).alias("n_weeks"), F.min("price").alias("low"))


@query("SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def read_offer_history(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat_ws("-", "l_orderkey", "l_partkey").alias("split_item_id"), F.lit(None).cast("string").alias("week_start"), F.lit(None).cast("string").alias("split_product_text"),
        F.lit(None).cast("string").alias("advertised_price"), F.lit(None).cast("string").alias("raw_offer_text"), F.col("l_linenumber").alias("row_seq"))
    return files.dedupe_offer_history(rows).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n_patterns FROM part")
def load_mappings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "|").alias("patterns"), F.lit("").alias("exclude_patterns"), F.lit(None).cast("string").alias("prefer_patterns"))
    return files.load_mappings(rows).select("p_partkey", F.size("patterns").cast("long").alias("n_patterns"))


@query("SELECT event_id, 1 AS candidate_rank, CAST(json_extract(props, '$.k') AS DOUBLE) AS price FROM events")
def flatten_search_results(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"docs": [{"name": "x", "price": {"value": '), F.get_json_object("props", "$.k"), F.lit("}}]}")).alias("body"))
    return files.flatten_search_results(rows, "event_id", "body").select("event_id", "candidate_rank", "price")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'bad lang' AS fault FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT CAST(doc_id AS VARCHAR), 'bad source' FROM documents WHERE source <> 'src0'")
def case_faults(spark, sf_dir):
    return files.case_faults(table(spark, sf_dir, "documents"), "doc_id", {"lang": ["en", "fr"], "source": ["src0"]})
