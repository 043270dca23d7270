"""Queries over offer texts, unit prices, pattern matching and the acceptance gate. Offers are derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.functions import text as tx
from priceloom.functions import units
from priceloom.operators import content
from priceloom.operators import matching as ops
from priceloom.operators import views
from priceloom.operators.series import historical_low_before
from priceloom.queries.base import SALES, query, sales, table
from priceloom.sources import files

PROMO = "CASE l_linenumber WHEN 1 THEN '2 for $5' WHEN 2 THEN 'Buy 2 Get 3 Free' WHEN 3 THEN 'Member Price: $1.25 ea' WHEN 4 THEN '5 ct pack' WHEN 5 THEN '3 lb' WHEN 6 THEN '18 ct' ELSE 'Everyday Price' END"
BASIS = "CASE l_linenumber WHEN 2 THEN 'bogo' WHEN 4 THEN 'per_pack' WHEN 6 THEN 'multi_buy' ELSE 'each' END"
RULE = "CASE p_type WHEN 'ECONOMY' THEN 'per_lb' WHEN 'STANDARD' THEN 'per_dozen' WHEN 'PROMO' THEN 'per_cup' WHEN 'SMALL' THEN 'per_16oz' WHEN 'MEDIUM' THEN 'pack_total' END"
_COLUMNS = f"""l_orderkey * 10 + l_linenumber AS row_seq, feed, week, p_type, p_brand, p_retailprice, p_name AS split_product_text, CAST(NULL AS STRING) AS raw_offer_text,
  {PROMO} AS promo_text, {BASIS} AS price_basis, {RULE} AS rule, concat(CAST(p_size AS STRING), ' oz') AS package_text, CAST(NULL AS STRING) AS package_unit,
  CAST(NULL AS DOUBLE) AS package_size_min, CAST(NULL AS DOUBLE) AS package_size_max,
  CASE WHEN l_orderkey % 7 = 0 THEN '$' ELSE concat('$', CAST(CAST(floor(price / 100) AS INT) AS STRING), '.49') END AS advertised_price"""
OFFERS = SALES + f""", offers AS (SELECT {_COLUMNS.replace("STRING", "VARCHAR")} FROM sales), priced AS (
  SELECT *, TRY_CAST(replace(advertised_price, '$', '') AS DOUBLE) AS price, lower(promo_text || ' ' || split_product_text || ' ' || package_text) AS promo FROM offers)"""


def offers(spark, sf_dir):
    return sales(spark, sf_dir).selectExpr(*[c.strip() for c in _split_columns(_COLUMNS)])


def _split_columns(text: str) -> list[str]:
    """The select list cut at its outer commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


@query(OFFERS + "SELECT row_seq, lower(split_product_text) AS split_text, lower(split_product_text || ' ' || promo_text || ' ' || package_text) AS full_text, price FROM priced")
def offer_text(spark, sf_dir):
    return offers(spark, sf_dir).select("row_seq", tx.split_text().alias("split_text"), tx.full_text().alias("full_text"), tx.parse_price("advertised_price").alias("price"))


_N = r"'(\d+)\s*(?:for|/)\s*\$?\s*(\d+(?:\.\d+)?)'"
_UNIT = OFFERS + rf""", parts AS (
  SELECT *, round(TRY_CAST(regexp_extract(promo, {_N}, 2) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(promo, {_N}, 1) AS DOUBLE), 0), 2) AS n_for,
    TRY_CAST(regexp_extract(promo, 'member\s+price\s*:?\s*\$?\s*(\d+(?:\.\d+)?)\s*(?:ea\.?|each)\b', 1) AS DOUBLE) AS each_price,
    TRY_CAST(regexp_extract(promo, 'buy\s+(\d+)[,\s]+get\s+(\d+)\s+free', 1) AS DOUBLE) AS buy, TRY_CAST(regexp_extract(promo, 'buy\s+(\d+)[,\s]+get\s+(\d+)\s+free', 2) AS DOUBLE) AS free,
    TRY_CAST(regexp_extract(promo, '\b(\d+)\s*-?\s*(?:ct|count)\b', 1) AS DOUBLE) AS pieces,
    TRY_CAST(regexp_extract(promo, '(\d+(?:\.\d+)?)\s*(?:-|\s)?\s*lb', 1) AS DOUBLE) AS lbs,
    TRY_CAST(regexp_extract(promo, '(\d+)\s*(?:-?\s*pack|pk|ct|count)', 1) AS DOUBLE) AS pack,
    TRY_CAST(regexp_extract(promo, '(\d+(?:\.\d+)?)\s*oz', 1) AS DOUBLE) AS oz FROM priced
), based AS (
  SELECT *, CASE WHEN price IS NULL THEN CASE WHEN price_basis = 'bogo' THEN round(p_retailprice * buy / (buy + free), 2) END
    ELSE coalesce(n_for, CASE WHEN each_price < price THEN each_price END, CASE WHEN price_basis = 'bogo' THEN round(price * buy / (buy + free), 2) END,
                  CASE WHEN price_basis = 'per_pack' AND pieces > 1 THEN round(price / pieces, 2) END, round(price, 2)) END AS base FROM parts
), united AS (
  SELECT *, CASE WHEN price IS NULL THEN base
    WHEN rule = 'per_lb' THEN CASE WHEN lbs > 0 AND NOT (base > 0 AND abs(lbs - base) / base < 0.02) THEN round(base / lbs, 2) ELSE base END
    WHEN rule = 'per_dozen' THEN CASE WHEN regexp_matches(promo, '24\s*[- ]?(?:ct|count)\b') THEN round(base * 12 / 24, 2) WHEN regexp_matches(promo, '18\s*[- ]?(?:ct|count)\b') THEN round(base * 12 / 18, 2)
         WHEN regexp_matches(promo, '12\s*[- ]?(?:ct|count)\b') THEN round(base * 12 / 12, 2) ELSE base END
    WHEN rule = 'per_cup' THEN CASE WHEN pack > 1 THEN round(base / pack, 2) WHEN oz / 5.3 > 1 THEN round(base / (oz / 5.3), 2) WHEN base > 8 THEN round(base / 4, 2) ELSE base END
    WHEN rule = 'per_16oz' THEN CASE WHEN oz > 0 THEN round(base * 16 / oz, 2) ELSE base END
    WHEN rule = 'pack_total' THEN coalesce(n_for, CASE WHEN each_price < price THEN each_price END, round(price, 2)) ELSE base END AS unit_price FROM based
)"""


@query(_UNIT + "SELECT row_seq, rule, price, unit_price FROM united")
def normalize_unit_prices(spark, sf_dir):
    rows = units.with_unit_price(offers(spark, sf_dir), reference="p_retailprice")
    return rows.select("row_seq", "rule", "price", "unit_price")


@query(_UNIT + """SELECT row_seq, promo_text = 'Everyday Price' AS everyday, price_basis = 'bogo' AND row_seq % 3 = 0 OR coalesce(unit_price > p_retailprice + 0.009, FALSE) AND row_seq % 3 = 0 AS untrusted,
  coalesce(unit_price > p_retailprice + 0.009, FALSE) AS above FROM united""")
def offer_filters(spark, sf_dir):
    rows = units.with_unit_price(offers(spark, sf_dir), reference="p_retailprice")
    none, unit, base = F.lit(None).cast("string"), F.col("unit_price"), F.col("p_retailprice")
    tag = F.when(F.col("row_seq") % 3 == 0, "crop_tile_mismatch")
    crop = tx.is_untrusted_crop(tag, F.lit(""), none, F.col("price_basis"), unit, base)
    return rows.select("row_seq", tx.is_everyday_shelf(none, none, F.col("promo_text"), none).alias("everyday"), crop.alias("untrusted"), tx.above_baseline(unit, base).alias("above"))


@query(SALES + """SELECT l_orderkey, l_linenumber, unit_price, method FROM (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount > 0.08 AND l_quantity >= 25 THEN NULL WHEN l_linenumber = 1 THEN round(price / l_quantity, 4) WHEN l_linenumber = 2 THEN round(price / 2, 4) ELSE round(price, 4) END AS unit_price,
  CASE WHEN l_discount > 0.08 AND l_quantity >= 25 THEN 'none' WHEN l_linenumber = 1 THEN 'multi_buy' WHEN l_linenumber = 2 THEN 'bogo' ELSE 'as_stated' END AS method FROM sales)""")
def normalize_structured_offers(spark, sf_dir):
    price = F.when(~((F.col("l_discount") > 0.08) & (F.col("l_quantity") >= 25)), F.col("price"))
    got = units.structured_unit_price(price, F.when(F.col("l_linenumber") == 1, "multi_buy").otherwise("each"), F.when(F.col("l_linenumber") == 2, "bogo").otherwise("none"), F.col("l_quantity"))
    return sales(spark, sf_dir).withColumn("u", got).select("l_orderkey", "l_linenumber", "u.unit_price", "u.method")


_PACKAGE = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' LB' WHEN 1 THEN '2 x ' || p_size || ' OZ' WHEN 2 THEN p_size || ' BARS 1.5 OUNCE EA' WHEN 3 THEN p_size || '/5.3 OZ' WHEN 4 THEN p_size || ' CT EGGS' ELSE 'PLAIN' END"


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_retailprice, {_PACKAGE} AS package_text FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN 2.0 * p_size WHEN 2 THEN p_size WHEN 3 THEN p_size * 5.3 WHEN 4 THEN p_size ELSE 1 END AS unit_count,
  CASE p_partkey % 6 WHEN 0 THEN 'lb' WHEN 1 THEN 'oz' WHEN 2 THEN 'bar' WHEN 3 THEN 'oz' WHEN 4 THEN 'egg' ELSE 'oz' END AS unit_type,
  CASE p_partkey % 6 WHEN 0 THEN 'medium' WHEN 4 THEN 'medium' WHEN 5 THEN 'low' ELSE 'high' END AS confidence FROM p""")
def parse_package_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("package_text", F.expr(_PACKAGE))
    return rows.withColumn("p", units.package(F.col("package_text"), F.lit("oz"))).select("p_partkey", "p.unit_count", "p.unit_type", "p.confidence")


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 0 THEN round(p_retailprice / p_size, 2) WHEN p_type = 'PROMO' AND p_size > 1 THEN round(p_retailprice / p_size, 2) ELSE p_retailprice END AS baseline FROM part""")
def normalize_baselines(spark, sf_dir):
    rule = F.when(F.col("p_type") == "ECONOMY", "per_lb").when(F.col("p_type") == "PROMO", "per_bar")
    name = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_type") == "ECONOMY", " lb bag").otherwise(" bars"))
    return table(spark, sf_dir, "part").select("p_partkey", units.normalized_baseline(F.col("p_retailprice"), rule, name).alias("baseline"))


@query("""SELECT p_partkey, CASE WHEN p_size > 1 THEN round(p_retailprice / p_size, 2) ELSE p_retailprice END AS each_price FROM part""")
def deal_adjusted_unit_price(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", units.deal_adjusted_unit_price(F.col("p_retailprice"), F.concat(F.col("p_size").cast("string"), F.lit("-pack cans"))).alias("each_price"))


@query(OFFERS + """SELECT promo_text, CASE WHEN promo_text = '2 for $5' THEN 2.5 WHEN promo_text LIKE 'Member%' THEN 1.25 END AS price,
  CASE WHEN promo_text = '2 for $5' THEN 'multi_buy' WHEN promo_text LIKE 'Buy%' THEN 'buy_x_get_y' WHEN promo_text LIKE 'Member%' THEN 'member_price' ELSE 'sale' END AS promo_type, count(*) AS n FROM offers GROUP BY ALL""")
def classify_offer_lines(spark, sf_dir):
    lines = offers(spark, sf_dir).withColumn("line", F.explode(F.split("promo_text", "\n"))).withColumn("l", units.offer_line(F.col("line")))
    return lines.groupBy("promo_text", "l.price", "l.promo_type").agg(F.count(F.lit(1)).alias("n"))


NOUNS = ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil")
ADJECTIVES = ("small", "red", "blue", "hot", "old", "large", "cold", "new")
_FAMILIES = ", ".join(f"('{n}', '\\b{n}\\b', '\\b(?:{ADJECTIVES[i]}|{ADJECTIVES[i + 1]})\\b', '{ADJECTIVES[(i + 2) % 8]}', '{ADJECTIVES[(i + 3) % 8]}', {'TRUE' if i % 2 else 'FALSE'})" for i, n in enumerate(NOUNS))
CATALOG = f"catalog(family, include_pattern, exclude_pattern, prefer1, prefer2, lowest) AS (VALUES {_FAMILIES})"


def catalog(spark):
    rows = [(n, rf"\b{n}\b", rf"\b(?:{ADJECTIVES[i]}|{ADJECTIVES[i + 1]})\b", ADJECTIVES[(i + 2) % 8], ADJECTIVES[(i + 3) % 8], bool(i % 2)) for i, n in enumerate(NOUNS)]
    df = spark.createDataFrame(rows, "family string, include_pattern string, exclude_pattern string, prefer1 string, prefer2 string, lowest boolean")
    return df.withColumns({"prefer": F.array("prefer1", "prefer2"), "token": F.col("family")})


_MATCHES = _UNIT + ", " + CATALOG + """, matches AS (
  SELECT row_seq, feed, week, family, lowest, split_product_text AS text, price, unit_price, p_retailprice AS baseline, promo_text, price_basis, package_text,
         CASE WHEN regexp_matches(split_product_text, prefer1) THEN 20 WHEN regexp_matches(split_product_text, prefer2) THEN 10 ELSE 0 END + CASE WHEN unit_price IS NOT NULL THEN 1 ELSE 0 END AS score,
         CASE WHEN unit_price IS NULL THEN NULL WHEN regexp_matches(split_product_text, prefer1) OR regexp_matches(split_product_text, prefer2) THEN 'high' ELSE 'medium' END AS confidence
  FROM united JOIN catalog ON regexp_matches(split_product_text, include_pattern) AND NOT regexp_matches(split_product_text, exclude_pattern)
)"""


def _matches(spark, sf_dir, by_token: bool = False):
    rows = units.with_unit_price(offers(spark, sf_dir), reference="p_retailprice").withColumn("text", tx.split_text())
    found = ops.match_by_token(rows, catalog(spark), "text") if by_token else ops.match_offers(rows, catalog(spark), "text")
    priced = F.col("unit_price").isNotNull()
    return found.withColumns(
        {"baseline": F.col("p_retailprice"), "score": ops.preference_score(F.col("text"), F.col("prefer"), priced), "confidence": ops.match_confidence(F.col("text"), F.col("prefer"), priced)}
    )


@query(_MATCHES + "SELECT row_seq, family, score, confidence FROM matches")
def match_offers(spark, sf_dir):
    return _matches(spark, sf_dir).select("row_seq", "family", "score", "confidence")


@query(_MATCHES + "SELECT row_seq, family, unit_price FROM matches")
def match_offers_by_token(spark, sf_dir):
    return _matches(spark, sf_dir, by_token=True).select("row_seq", "family", "unit_price")


_BEST = """SELECT feed, week, family, row_seq, unit_price, score FROM (SELECT *, row_number() OVER (PARTITION BY feed, week, {by} ORDER BY CASE WHEN lowest THEN unit_price END NULLS LAST, CASE WHEN lowest THEN 0 ELSE score END DESC, row_seq) AS k
  FROM matches WHERE promo_text <> 'Everyday Price' AND NOT coalesce(unit_price > baseline + 0.009, FALSE)) WHERE k = 1"""


def _usable():
    none = F.lit(None).cast("string")
    return ~tx.is_everyday_shelf(none, none, F.col("promo_text"), none) & ~tx.above_baseline(F.col("unit_price"), F.col("baseline"))


@query(_MATCHES + _BEST.format(by="family"))
def pick_best_offer(spark, sf_dir):
    return ops.pick_best(_matches(spark, sf_dir), ["feed", "week", "family"], F.col("lowest"), _usable()).select("feed", "week", "family", "row_seq", "unit_price", "score")


@query(_MATCHES + _BEST.format(by="family, text").replace("SELECT feed,", "SELECT text AS member, feed,", 1))
def pick_best_member_offer(spark, sf_dir):
    rows = _matches(spark, sf_dir).withColumn("member", F.col("text"))
    return ops.pick_best(rows, ["feed", "week", "family", "member"], F.col("lowest"), _usable()).select("member", "feed", "week", "family", "row_seq", "unit_price", "score")


@query("SELECT l_orderkey, arg_min(l_partkey, (CASE WHEN l_quantity > 40 THEN 99 ELSE l_linenumber END, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def rank1_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("rank", F.when(F.col("l_quantity") <= 40, F.col("l_linenumber")))
    return ops.rank1_candidates(rows, "l_orderkey", "rank", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey")


TAXONOMY = "taxonomy(ord, type, pattern) AS (VALUES (1, 'metal', 'bolt|gear|anvil'), (2, 'round', 'ring|gear'), (3, 'warm', 'hot|red'), (4, 'flat', 'plate'))"


@query(f"WITH {TAXONOMY} SELECT p_partkey, string_agg(type, ',' ORDER BY ord) AS types, arg_min(type, ord) AS primary_type FROM part JOIN taxonomy ON regexp_matches(p_name, pattern) GROUP BY p_partkey")
def classify_product_type(spark, sf_dir):
    taxonomy = spark.sql("SELECT * FROM VALUES (1, 'metal', 'bolt|gear|anvil'), (2, 'round', 'ring|gear'), (3, 'warm', 'hot|red'), (4, 'flat', 'plate') AS t(ord, type, pattern)")
    return ops.classify_types(table(spark, sf_dir, "part"), taxonomy, "p_partkey", "p_name").select("p_partkey", F.array_join("types", ",").alias("types"), "primary_type")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' THEN 'bolt' WHEN p_name LIKE '%red%' THEN 'red' END AS brand,
  concat_ws(',', CASE WHEN p_name LIKE '%hot%' THEN 'hot' END, CASE WHEN p_name LIKE '%old%' THEN 'old' END) AS requirements FROM part""")
def tag_brand(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tx.first_in_list(name, ["ring", "bolt", "red"]).alias("brand"), F.array_join(tx.requirement_phrases(name, ["hot", "old"]), ",").alias("requirements"))


def _gated(spark, sf_dir):
    """Matches with their rules, types and the gate's state-free verdict."""
    rules = spark.createDataFrame(
        [
            (n, ("metal" if i % 2 else None, [ADJECTIVES[(i + 4) % 8]], [ADJECTIVES[(i + 5) % 8]], ["metal", "round", "flat"], ["warm"] if i % 3 == 0 else [], [], [], [], [], [], [("size", [], [r"\b[1-4]\d\s*oz"])], 0.6))
            for i, n in enumerate(NOUNS[:-1])
        ],
        f"family string, rules {ops.RULES}",
    )
    taxonomy = spark.sql("SELECT * FROM VALUES (1, 'metal', 'bolt|gear|anvil'), (2, 'round', 'ring|gear'), (3, 'warm', 'hot|red'), (4, 'flat', 'plate') AS t(ord, type, pattern)")
    found = _matches(spark, sf_dir)
    types = ops.classify_types(found.select("text").distinct(), taxonomy, "text", "text")
    rows = found.join(F.broadcast(rules), "family", "left").join(types, "text", "left")
    return ops.eligibility(rows.withColumns({"unit_hint": F.lit("oz"), "priced": F.col("price").isNotNull(), "keyword_confidence": F.coalesce("confidence", F.lit("low"))}).drop("confidence"))


_RULES = ", ".join(f"('{n}', {"'metal'" if i % 2 else 'NULL'}, '{ADJECTIVES[(i + 4) % 8]}', '{ADJECTIVES[(i + 5) % 8]}', {'TRUE' if i % 3 == 0 else 'FALSE'})" for i, n in enumerate(NOUNS[:-1]))


@query(_MATCHES + rf""", rules(rule_family, intent, pos, neg, no_warm) AS (VALUES {_RULES}
), typed AS (SELECT m.*, r.*, coalesce(m.confidence, 'low') AS level, rule_family IS NULL AS free,
    list_filter([CASE WHEN regexp_matches(text, 'bolt|gear|anvil') THEN 'metal' END, CASE WHEN regexp_matches(text, 'ring|gear') THEN 'round' END, CASE WHEN regexp_matches(text, 'hot|red') THEN 'warm' END, CASE WHEN text LIKE '%plate%' THEN 'flat' END], lambda x: x IS NOT NULL) AS types
  FROM matches m LEFT JOIN rules r ON m.family = r.rule_family
), hits AS (SELECT *, list_contains(string_split(text, ' '), neg) AS negative, list_contains(string_split(text, ' '), pos) AS positive, regexp_matches(package_text, '\b[1-4]\d\s*oz') AS sized,
    no_warm AND list_contains(types, 'warm') AS bad_type, types = ['warm'] AS only_warm FROM typed
), scored AS (SELECT *, NOT bad_type AND only_warm AS off_type, CASE level WHEN 'high' THEN 0.9 WHEN 'low' THEN 0.45 ELSE 0.7 END AS start FROM hits
), sure AS (SELECT *, CAST(CASE WHEN free THEN start ELSE least(1.0, greatest(0.0, least(1.0, start + CASE WHEN positive THEN 0.03 ELSE -0.15 END + CASE WHEN types[1] = intent THEN 0.1 WHEN types[1] IN ('metal', 'round', 'flat') THEN 0.05 ELSE 0 END
    - CASE WHEN price IS NULL THEN 0.3 ELSE 0 END)) + CASE WHEN sized THEN 0.15 ELSE 0 END) END AS DOUBLE) AS sureness FROM scored
), judged AS (SELECT *, level = 'medium' AND round(sureness, 4) < 0.7 AS unsure, negative OR bad_type OR off_type AS refused FROM sure
)
SELECT row_seq, family, round(sureness, 4) AS confidence,
  CASE WHEN free THEN 'accepted' WHEN refused THEN 'rejected' WHEN round(sureness, 4) < 0.6 OR NOT sized OR unsure THEN 'manual_review' ELSE 'accepted' END AS base_decision,
  CASE WHEN free THEN '' ELSE concat_ws('; ', CASE WHEN negative THEN 'hard negative: ' || neg END, CASE WHEN bad_type THEN 'disallowed product type' END, CASE WHEN off_type THEN 'product type not allowed' END,
    CASE WHEN NOT sized THEN 'missing: size' END, CASE WHEN unsure THEN 'medium confidence' END) END AS reasons,
  CASE WHEN free THEN NULL WHEN refused THEN 'explicit_attribute_conflict' WHEN round(sureness, 4) < 0.6 OR NOT sized OR unsure THEN 'insufficient_information' END AS reason_code
FROM judged""")
def evaluate_eligibility(spark, sf_dir):
    return _gated(spark, sf_dir).select("row_seq", "family", "confidence", "base_decision", F.array_join("reasons", "; ").alias("reasons"), "reason_code")


@query()
def accept_over_time(spark, sf_dir):
    rows = ops.rank_candidates(_gated(spark, sf_dir), ["feed", "week", "family"], F.col("lowest"), usable=_usable())
    return ops.accept_over_time(rows.withColumn("advertised_price", F.col("price")), ["feed", "family"])


_DECIDED = _MATCHES + """, decided AS (SELECT feed, family, week, min(unit_price) AS unit_price, CASE WHEN min(score) > 10 THEN 'accepted' WHEN min(score) = 1 THEN 'manual_review' ELSE 'rejected' END AS decision FROM matches GROUP BY ALL
), seen AS (SELECT *, min(unit_price) OVER (PARTITION BY feed, family ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM decided)
SELECT week, CAST(count(*) FILTER (WHERE decision = 'accepted') AS BIGINT) AS n_accepted, CAST(count(*) FILTER (WHERE decision = 'manual_review') AS BIGINT) AS n_review, CAST(count(*) FILTER (WHERE decision = 'rejected') AS BIGINT) AS n_rejected,
  coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (WHERE decision = 'accepted'), '') AS updated_families,
  CAST(count(*) FILTER (WHERE decision = 'accepted' AND unit_price < low_before) AS BIGINT) AS new_lows, CAST(count(*) FILTER (WHERE decision <> 'accepted' AND unit_price IS NOT NULL) AS BIGINT) AS blocked_points FROM seen GROUP BY week"""


@query(_DECIDED)
def match_audit_rollup(spark, sf_dir):
    decision = F.when(F.min("score") > 10, "accepted").when(F.min("score") == 1, "manual_review").otherwise("rejected")
    rows = _matches(spark, sf_dir).groupBy("feed", "family", "week").agg(F.min("unit_price").alias("unit_price"), decision.alias("decision"))
    lows = historical_low_before(rows.withColumnRenamed("unit_price", "price")).withColumnRenamed("price", "unit_price")
    return ops.match_audit(lows)


_MISSED = _MATCHES + """, hits AS (SELECT feed, week, family, text, unit_price AS price, CASE WHEN row_seq % 2 = 0 THEN 'raw' ELSE 'split' END AS origin, price_basis = 'multi_buy' AS is_multi, price_basis AS disposition
  FROM united JOIN catalog c ON regexp_matches(split_product_text, include_pattern), LATERAL (SELECT split_product_text AS text)
), good AS (SELECT DISTINCT feed, week, family FROM matches WHERE score > 10)
SELECT h.feed, h.week, h.family, min(price) AS candidate_price, bool_or(origin = 'raw') AS in_raw_cards, bool_or(origin = 'split') AS in_split_items, bool_and(is_multi) AS all_multi, arg_min(text, (price, text)) AS example_text,
  string_agg(DISTINCT disposition, ',' ORDER BY disposition) AS dispositions,
  CASE WHEN bool_or(origin = 'split') AND NOT bool_and(is_multi) THEN 'high' WHEN bool_or(origin = 'raw') AND NOT bool_and(is_multi) THEN 'medium' ELSE 'low' END AS severity
FROM hits h ANTI JOIN good g ON h.feed = g.feed AND h.week = g.week AND h.family = g.family WHERE price IS NOT NULL GROUP BY h.feed, h.week, h.family"""


@query(_MISSED)
def missed_deals(spark, sf_dir):
    """Texts are read once each, and offers of one key that say the same stand as one card before the patterns are tried."""
    rows = units.with_unit_price(offers(spark, sf_dir), reference="p_retailprice", store=lambda df: files.stored(df, "promotions")).withColumn("text", tx.split_text())
    origin = F.when(F.col("row_seq") % 2 == 0, "raw").otherwise("split")
    cards = files.stored(rows.groupBy("feed", "week", "text", origin.alias("origin"), F.col("price_basis").alias("disposition")).agg(F.min("unit_price").alias("price")), "cards")
    hits = ops.match_offers(cards, catalog(spark), include_only=True).withColumn("is_multi", F.col("disposition") == "multi_buy")
    score = ops.preference_score(F.col("text"), F.col("prefer"), F.col("price").isNotNull())
    good = ops.match_offers(cards, catalog(spark)).where(score > 10).select("feed", "week", "family").distinct()
    return ops.missed_deals(hits, good, ["feed", "week", "family"])


@query("WITH d AS (WITH " + _MISSED + """) SELECT feed, week, family, severity, candidate_price FROM d
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'info' THEN 2 ELSE 9 END, feed, week, family""")
def missed_deal_report(spark, sf_dir):
    return missed_deals(spark, sf_dir).select("feed", "week", "family", "severity", "candidate_price").orderBy(*content.missed_deal_order())


_MAP_UNIT = "CASE p_type WHEN 'ECONOMY' THEN 'oz' WHEN 'STANDARD' THEN 'can' WHEN 'PROMO' THEN 'each' WHEN 'SMALL' THEN 'egg' WHEN 'MEDIUM' THEN 'bag' ELSE 'oz' END"
_MAP_WHY = "CASE row_seq % 4 WHEN 0 THEN 'missing_package_size; x' WHEN 1 THEN 'ambiguous_multi_product_offer' WHEN 2 THEN 'broad_group_needs_human_grounding, missing_package_size' END"
_MAP_PACK = "CASE WHEN p_type IN ('PROMO', 'SMALL') AND row_seq % 3 = 0 THEN 'ct' END"
_MAP_TEXT = "CASE WHEN p_type = 'LARGE' THEN 'no size' ELSE package_text END"


@query(OFFERS + f""", m AS (SELECT *, {_MAP_UNIT} AS u, coalesce({_MAP_WHY}, '') AS why, coalesce({_MAP_PACK}, '') AS pu, {_MAP_TEXT} AS pt, TRY_CAST(p_retailprice AS DOUBLE) AS ref FROM priced
), t AS (SELECT *, CASE WHEN pu = 'ct' THEN 6.0 END AS size, list_filter([CASE WHEN contains(why, 'ambiguous') THEN 'multi-product offer' END, CASE WHEN contains(why, 'missing_package_size') AND u IN ('oz', 'each') THEN 'missing package size' END, CASE WHEN contains(why, 'broad') THEN 'broad grouped offer' END], lambda x: x IS NOT NULL) AS r,
    CASE WHEN promo_text = '2 for $5' THEN 2.5 END AS count_price, promo_text = 'Buy 2 Get 3 Free' AS free, CASE WHEN pt <> 'no size' THEN CAST(split_part(pt, ' ', 1) AS DOUBLE) END AS oz FROM m
), o AS (SELECT *, CASE WHEN price IS NULL THEN (NULL::DOUBLE, u, TRUE, 'missing advertised price', 'low')
    WHEN count_price IS NOT NULL AND u IN ('each', 'can') THEN (count_price, u, len(r) > 0, NULL, CASE WHEN len(r) > 0 THEN 'medium' ELSE 'high' END)
    WHEN free THEN (round(price * 2 / 5 * 10000) / 10000, u, len(r) > 0, NULL, CASE WHEN len(r) > 0 THEN 'medium' ELSE 'high' END)
    WHEN u = 'oz' AND coalesce(size, oz) > 0 THEN (round(CASE WHEN price_basis = 'multi_buy' THEN price ELSE price END / coalesce(size, oz) * 10000) / 10000, 'oz', len(r) > 0, NULL, CASE WHEN len(r) > 0 THEN 'medium' ELSE 'high' END)
    WHEN u = 'oz' THEN (NULL, 'oz', TRUE, 'cannot normalize to per oz', 'low')
    WHEN u IN ('each', 'egg') AND size > 1 THEN (round(price / size * 10000) / 10000, u, len(r) > 0, NULL, CASE WHEN len(r) > 0 THEN 'medium' ELSE 'high' END)
    ELSE (CASE WHEN promo_text = '2 for $5' THEN 2.5 WHEN promo_text LIKE 'Member%' AND price > 1.25 THEN 1.25 WHEN price_basis = 'multi_buy' AND size > 1 THEN round(price / size * 100) / 100 WHEN price_basis = 'per_pack' AND size > 1 THEN round(price / size * 100) / 100 ELSE round(price * 100) / 100 END, u, len(r) > 0, NULL, 'medium') END AS x FROM t)
SELECT row_seq, x[1] AS unit_price, x[2] AS unit, x[3] AS manual_review, CASE WHEN x[4] = 'missing advertised price' THEN x[4] ELSE nullif(array_to_string(CASE WHEN x[4] IS NULL THEN r ELSE list_append(r, x[4]) END, '; '), '') END AS review_reason, x[5] AS confidence FROM o""")
def normalize_offers_for_mapping(spark, sf_dir):
    """All offers in the unit of their type's mapping."""
    rows = offers(spark, sf_dir).drop("package_unit", "package_size_min", "package_size_max")
    sized = F.when(F.expr(_MAP_PACK) == "ct", "6")
    rows = rows.withColumns(
        {
            "comparable_unit": F.expr(_MAP_UNIT), "review_reasons": F.expr(_MAP_WHY), "split_status": F.lit(None).cast("string"), "package_unit": F.expr(_MAP_PACK), "package_text": F.expr(_MAP_TEXT),
            "package_size_min": sized, "package_size_max": sized, "match_confidence": F.lit(None).cast("string"),
        }
    )
    return views.normalize_for_mapping(rows, "p_retailprice").select("row_seq", "unit_price", "unit", "manual_review", "review_reason", "confidence")
