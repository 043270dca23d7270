"""Readers and writers: explicit schemas, null for blank, no inference. Tables are CSV or JSON lines at the edge, Parquet inside."""

from __future__ import annotations

import datetime
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import dimension

MANIFEST = "source_file string, parent_company string, banner string, region string, representative_store_id string, week_start date, week_end date, notes string"
OFFER_STRINGS = (
    "split_item_id banner region source_file week_start week_end page_number split_product_text raw_product_text raw_offer_text promo_text package_text advertised_price price_basis "
    "package_size_min package_size_max package_unit promo_type_guess availability_type_guess price_role_guess review_reasons split_status"
).split()
OFFERS = ", ".join(f"{c} string" for c in OFFER_STRINGS)
WAREHOUSE = "itemNumber string, sellPrice string, timestamp string, itemSign string, inventoryStatus string"
RAW_CARDS = (
    "week_start string, banner string, page_number string, offer_index_on_page string, raw_offer_text string, raw_product_text string, verified_raw_product_text string, "
    "advertised_price string, original_advertised_price string, verified_advertised_price string, layout_type string, review_reasons string"
)
PRICE_ENTRY = "struct<price: double, offerText: string, confidence: string, availabilityType: string, promoNote: string>"
PRICE_MAP = f"map<string, map<string, {PRICE_ENTRY}>>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a session on one machine gets a
    new temporary one, and a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_csv(spark: SparkSession, path: str | list[str], schema: str, multi_line: bool = False, numbered: bool = False) -> DataFrame:
    """CSV with a header, blank as null. Only files whose fields hold line ends need multi_line; such a file is one task.

    numbered adds row_seq, which follows the files by name and the rows in each: (name's rank, block, row in block).
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if not numbered:
        return blank_to_null(rows)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return blank_to_null(rows.withColumn("row_seq", place))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The week spine of each banner."""
    return read_csv(spark, path, MANIFEST)


def of_banner(banner: str | None) -> Column:
    return F.lower(F.trim(F.coalesce("banner", F.lit("")))) == banner.strip().lower() if banner else F.lit(True)


def read_offers(spark: SparkSession, path: str, banner: str | None = None) -> DataFrame:
    """Offer rows of one banner, compared without case and margins; row_seq orders them by file, block and row."""
    return read_csv(spark, path, OFFERS, numbered=True).where(of_banner(banner))


def read_typed_offers(spark: SparkSession, path: str, banner: str | None = None) -> DataFrame:
    """Offers with typed numbers and dates; rows without a banner pass, excluded ones do not."""
    rows = read_csv(spark, path, OFFERS).where(of_banner(banner) | F.col("banner").isNull()).where("coalesce(split_status, '') <> 'excluded'")
    numbers = {c: F.regexp_replace(c, r"\$", "").try_cast("double") for c in ("advertised_price", "package_size_min", "package_size_max")}
    return rows.withColumns(numbers | {c: F.col(c).try_cast("date") for c in ("week_start", "week_end")} | {"page_number": F.col("page_number").try_cast("int")})


def dedupe_raw_cards(cards: DataFrame) -> DataFrame:
    """The first row per week, page, index and text start, by file and row."""
    key = ["week_start", "page_number", "offer_index_on_page", F.substring(F.coalesce("raw_product_text", F.lit("")), 1, 120)]
    return cards.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("source_file", "row_seq"))).where("_n = 1").drop("_n")


def read_raw_cards(spark: SparkSession, paths: str | list[str], banner: str | None = None) -> DataFrame:
    """Cards of many per-flyer files (globs or folders), of one banner and with a week; of cards with equal week, page, index and
    first 120 letters of their text the first stays, by file name and place in the file.

    The place is the block's start and the order in it, so neither file sizes nor packing change what stays. A grouping,
    so that repeated cards combine before they shuffle.
    """
    rows = read_csv(spark, paths, RAW_CARDS, numbered=True).where(of_banner(banner)).where("trim(week_start) <> ''")
    key = [F.trim("week_start").alias("_week"), F.coalesce("page_number", F.lit("")).alias("_page"), F.coalesce("offer_index_on_page", F.lit("")).alias("_index"), F.substring(F.coalesce("raw_offer_text", F.lit("")), 1, 120).alias("_text")]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), "row_seq").alias("row")).select("row.*")


def newest_cards(spark: SparkSession, paths: str | list[str], week: datetime.date) -> DataFrame:
    """The cards of the newest file of a week, by modification time and then name: of the files whose folder's name holds the
    week (2026-07-15 or 7-15), else of those that hold a card of it. No file gives no rows."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", F.col("_metadata.file_path").alias("file"))
    folder = F.element_at(F.split("path", "/"), -2)
    token = f"{week.month}-{week.day}"
    newest = lambda df: df.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1).collect()
    found = newest(listed.where(F.contains(folder, F.lit(token)) | F.contains(folder, F.lit(week.isoformat()))))
    if not found:
        cards = spark.read.schema(RAW_CARDS).option("header", True).option("escape", '"').csv(paths)
        holds = cards.where(F.trim("week_start") == week.isoformat()).select(F.col("_metadata.file_path").alias("file")).distinct()
        found = newest(listed.join(holds, "file", "left_semi"))
    return read_csv(spark, found[0]["path"], RAW_CARDS, numbered=True) if found else spark.createDataFrame([], RAW_CARDS)


def read_offer_history(spark: SparkSession, paths: list[str], banner: str | None = None, excluded: Column | None = None) -> DataFrame:
    """Offers of several files, of one banner, without those that excluded (a condition on their columns) holds for, and once
    each by their id, else by week, texts and price."""
    rows = read_csv(spark, paths, OFFERS, numbered=True).where(of_banner(banner))
    return dedupe_offer_history(rows if excluded is None else rows.where(~F.coalesce(excluded, F.lit(False))))


def read_cases(spark: SparkSession, path: str, schema: str, key: str, required: Sequence[str], enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Labelled cases of JSON lines; blank lines and those that begin with # are left out. Lines that are no JSON, blank required
    fields, ids that repeat and values outside their list fail the load, with some of the faults in the message."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND line NOT LIKE '#%'")
    parsed = lines.withColumn("case", F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    broken = parsed.where("case IS NULL OR case._broken IS NOT NULL").select(F.substring("line", 1, 60).alias(key), F.lit("no JSON").alias("fault"))
    cases = parsed.where("case IS NOT NULL AND case._broken IS NULL").select("case.*").drop("_broken")
    faults = broken.union(case_faults(cases, key, enums))
    for column in required:
        faults = faults.union(cases.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "").select(F.col(key).cast("string"), F.lit(f"missing {column}")))
    if bad := faults.orderBy(key, "fault").limit(5).collect():
        raise ValueError("faulty cases: " + "; ".join(f"{r[0]}: {r[1]}" for r in bad))
    return cases


def dedupe_offer_history(offers: DataFrame) -> DataFrame:
    """One row per item id, or per week, text, price and raw text where there is none."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("week_start", "split_product_text", "advertised_price", "raw_offer_text")])
    key = F.coalesce(F.when(F.trim("split_item_id") != "", F.concat(F.lit("id:"), F.col("split_item_id"))), F.concat(F.lit("row:"), text))
    return offers.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("row_seq"))).where("_n = 1").drop("_n")


def read_warehouse_prices(spark: SparkSession, path: str, slugs: DataFrame) -> DataFrame:
    """Warehouse snapshots named <date>_<slug>.csv; unknown slugs, blank items and prices that are not positive are dropped.

    The row's date is its timestamp's, else the file's; date_mismatch marks rows where they differ.
    """
    raw = spark.read.schema(WAREHOUSE).option("header", True).csv(path).withColumn("source_file", F.col("_metadata.file_name"))
    stamp = F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", ""))
    rows = raw.select(
        F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("file_date"),
        F.regexp_extract("source_file", r"^\d{4}-\d{2}-\d{2}[_-](.+?)\.csv$", 1).alias("slug"),
        F.trim("itemNumber").alias("item"), F.col("itemSign").alias("name"), F.regexp_replace("sellPrice", r"\$", "").try_cast("double").alias("price"),
        F.col("inventoryStatus").alias("availability"), stamp.alias("ts"), "source_file",
    )
    dated = rows.withColumn("date", F.coalesce(F.to_date("ts"), F.col("file_date")))
    return dated.join(dimension(slugs), "slug").where("item <> '' AND price > 0").withColumn("date_mismatch", F.coalesce(F.to_date("ts") != F.col("file_date"), F.lit(False)))


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df and replaces just the partitions that it has rows of; written again, it leaves the same table. A run that
    fails before its commit changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], by: Sequence[str]) -> None:
    """Rows of updates take the place of those with equal keys in the table under path; only partitions that updates have rows
    of are read and written. Of updates with equal keys any one stays, so keys should be distinct; null keys are equal."""
    if not path_exists(spark, path):
        return replace_partitions(updates, path, by)
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    old = spark.read.schema(updates.schema).parquet(path)
    touched = updates.select(*by).distinct()
    kept = old.join(touched, same(old, touched, by), "left_semi").join(updates, same(old, updates, keys), "left_anti")
    replace_partitions(kept.unionByName(updates), path, by)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cache_observations(obs: DataFrame, path: str) -> None:
    """A cache that readers prune by region; regions without a row in obs stay as they are."""
    replace_partitions(obs, path, ["region"])


def observations(spark: SparkSession, cache: str, raw: str, slugs: DataFrame, region: str | None = None, prefer_cache: bool = True) -> DataFrame:
    """The cached observations if there are any and they are preferred, else those of the raw snapshots, of one region or all."""
    rows = spark.read.parquet(cache) if prefer_cache and path_exists(spark, cache) else read_warehouse_prices(spark, raw, slugs)
    return rows.where(F.col("region") == region) if region else rows


def load_cached(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("region") == region) if region else rows


def flatten_price_map(df: DataFrame, column: str = "json") -> DataFrame:
    """(family, week, price, ...) of a JSON map family -> week -> entry."""
    families = df.select(F.explode(F.from_json(column, PRICE_MAP)).alias("family", "weeks"))
    return families.select("family", F.explode("weeks").alias("week", "entry")).select("family", "week", "entry.*")


def nest_price_map(rows: DataFrame) -> DataFrame:
    """(family, json): the weeks of each family as a JSON map, in order."""
    entry = F.struct("price", "offerText", "confidence", "availabilityType", "promoNote")
    return rows.groupBy("family").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("week", entry))))).alias("json"))


def write_report(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """A CSV report of fixed columns, with a header even when it has no rows; other columns are left out. One file per task."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def first_present(df: DataFrame, column: str, paths: Sequence[str]) -> Column:
    """The first non-null of several JSON paths."""
    return F.coalesce(*[F.get_json_object(column, p) for p in paths])


def flatten_search_results(responses: DataFrame, key: str, column: str, top: int = 10) -> DataFrame:
    """Products of search responses with their 1-based rank; alternate names of each field are tried in turn."""
    docs = responses.select(key, F.posexplode(F.from_json(F.coalesce(F.get_json_object(column, "$.response.docs"), F.get_json_object(column, "$.docs")), "array<string>")).alias("pos", "doc"))
    names: Mapping[str, list[str]] = {"product_name": ["$.name", "$.title"], "price": ["$.price.value", "$.price", "$.basePrice"], "pid": ["$.pid", "$.id"], "upc": ["$.upc"], "size": ["$.size", "$.unitOfMeasure"]}
    fields = [first_present(docs, "doc", p).alias(n) if n != "price" else first_present(docs, "doc", p).try_cast("double").alias(n) for n, p in names.items()]
    return docs.where(F.col("pos") < top).select(key, (F.col("pos") + 1).alias("candidate_rank"), *fields)


def read_transcripts(df: DataFrame) -> DataFrame:
    """title, url, views and text of a table whose column names vary; all text columns are joined. No text column fails."""
    aliases = {"title": ("video_title", "title"), "url": ("video_url", "url", "link"), "views": ("views", "view_count")}
    named = {c.lower(): c for c in df.columns}
    picked = [F.col(named[next(a for a in names if a in named)]).alias(n) if any(a in named for a in names) else F.lit(None).cast("string").alias(n) for n, names in aliases.items()]
    texts = [c for c in df.columns if any(w in c.lower() for w in ("transcript", "caption", "text"))]
    if not texts:
        raise ValueError(f"no transcript column among {df.columns}")
    return df.select(*picked, F.concat_ws("\n", *texts).alias("text"))


def read_ledger(df: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Trimmed rows that have a query, of the given statuses."""
    rows = df.withColumn("search_query", F.trim("search_query")).where("search_query <> ''")
    return rows.where(F.lower(F.trim("status")).isin(*statuses)) if statuses else rows


def load_mappings(df: DataFrame, columns: Sequence[str] = ("patterns", "exclude_patterns", "prefer_patterns")) -> DataFrame:
    """Pipe-separated lists as arrays; rows without a pattern are dropped."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), F.trim), lambda x: x != "")
    return df.withColumns({c: listed(c) for c in columns}).where(F.size(columns[0]) > 0)


def case_faults(cases: DataFrame, key: str, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, fault) of labelled cases: missing and repeated ids, values outside their list."""
    empty = cases.where(F.col(key).isNull()).select(F.col(key).cast("string").alias(key), F.lit("missing id").alias("fault"))
    twice = cases.groupBy(key).count().where(f"count > 1 AND {key} IS NOT NULL").select(F.col(key).cast("string").alias(key), F.lit("repeated id").alias("fault"))
    faults = empty.union(twice)
    for column, allowed in enums.items():
        faults = faults.union(cases.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(F.col(key).cast("string").alias(key), F.lit(f"bad {column}").alias("fault")))
    return faults


def catalog_faults(catalog: DataFrame, sections: Sequence[str]) -> DataFrame:
    """(id, fault) of a catalog: missing names, repeated ids, unknown sections, no patterns."""
    fault = F.explode(F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name"), F.when(~F.coalesce(F.col("section").isin(*sections), F.lit(False)), "bad section"), F.when(F.size("include") <= 0, "no patterns"))))
    twice = catalog.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault"))
    return catalog.select("id", fault.alias("fault")).union(twice)
