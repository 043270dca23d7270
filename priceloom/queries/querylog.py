"""Queries over a query log (the users' turns of conversations with a price phrase derived from the row) and the parts catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceloom.operators import querylog as ops
from priceloom.queries.base import query, table
from priceloom.sources import files

_LOG = r"""WITH log AS (SELECT conv_id * 100 + turn AS query_id, CASE turn % 4 WHEN 0 THEN 'Two for five bucks small ring at Vons' WHEN 2 THEN 'red  bolt $3.49 or $2.99 B1G1' ELSE '' END || ' ' || coalesce(text, '') AS raw_query FROM conversations WHERE role = 'user')"""


def _log(spark, sf_dir, text="text"):
    phrase = F.when(F.col("turn") % 4 == 0, "Two for five bucks small ring at Vons").when(F.col("turn") % 4 == 2, "red  bolt $3.49 or $2.99 B1G1").otherwise("")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(phrase, F.lit(" "), F.coalesce(F.expr(text), F.lit(""))).alias("raw_query"))


def _parsed(spark, sf_dir):
    return ops.parse_queries(ops.normalize_queries(_log(spark, sf_dir)), ["vons", "safeway"])


def _steps_sql() -> str:
    """The rewriting chain in SQL; a look-ahead becomes a capture, which RE2 has."""
    layers, names = ["q0 AS (SELECT query_id, trim(lower(raw_query), ' ') AS t0 FROM log)"], ["numbers", *[n for n, _, _ in ops.STEPS]]
    spelled = "t0"
    for i, word in enumerate(ops.NUMBER_WORDS, 1):
        spelled = rf"regexp_replace({spelled}, '\b{word}(\s+(?:bucks?|dollars?|cents?|for)\b)', '{i}\1', 'g')"
    layers.append(f"q1 AS (SELECT *, {spelled} AS t1 FROM q0)")
    for i, (_, pattern, replacement) in enumerate(ops.STEPS, 2):
        quoted, new = pattern.replace("'", "''"), replacement.replace("'", "''").replace(r"\$", chr(0)).replace("$1", r"\1").replace(chr(0), "$")
        layers.append(f"q{i} AS (SELECT *, regexp_replace(t{i - 1}, '{quoted}', '{new}', 'g') AS t{i} FROM q{i - 1})")
    steps = ", ".join(f"CASE WHEN t{i} <> t{i - 1} THEN '{n}' END" for i, n in enumerate(names, 1))
    return f"{_LOG}, {', '.join(layers)}, normal AS (SELECT query_id, trim(t{len(names)}, ' ') AS query, concat_ws(',', {steps}) AS steps FROM q{len(names)})"


_MULTI = r"(\d+)\s*(?:for|/)\s*\$?(\d+(?:\.\d+)?)"
_PARSED = rf"""{_steps_sql()}, parsed AS (
  SELECT query_id, query, nullif(regexp_extract(query, '\b(vons|safeway)\b', 1), '') AS retailer, CAST(TRY_CAST(regexp_extract(query, '{_MULTI}', 1) AS DOUBLE) AS INTEGER) AS quantity,
    coalesce(TRY_CAST(regexp_extract(query, '{_MULTI}', 2) AS DOUBLE), TRY_CAST(regexp_extract(query, '\$(\d+(?:\.\d+)?)', 1) AS DOUBLE)) AS price,
    CASE WHEN regexp_matches(query, '{_MULTI}') THEN 'multi_buy' WHEN regexp_matches(query, 'per lb|/lb|a pound') THEN 'per_lb' WHEN regexp_matches(query, '\$\d') THEN 'each' END AS basis,
    CASE WHEN regexp_matches(query, '\bbogo\b') THEN 'bogo' WHEN regexp_matches(query, 'when you buy \d+') THEN 'conditional' END AS promotion,
    len(list_distinct(regexp_extract_all(query, '\$(\d+(?:\.\d+)?)', 1))) > 1 AS is_conflict,
    trim(regexp_replace(regexp_replace(regexp_replace(query, '{_MULTI}', ' ', 'g'), '\$\d+(?:\.\d+)?|\b(?:vons|safeway|bogo|at|is|a|the|for)\b', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS product_text FROM normal)"""


@query(_steps_sql() + " SELECT * FROM normal")
def normalize_queries(spark, sf_dir):
    return ops.normalize_queries(_log(spark, sf_dir)).select("query_id", "query", F.array_join("steps", ",").alias("steps"))


@query(_PARSED + " SELECT query_id, retailer, quantity, price, basis, promotion, is_conflict, product_text FROM parsed")
def parse_queries(spark, sf_dir):
    return _parsed(spark, sf_dir).select("query_id", "retailer", "quantity", "price", "basis", "promotion", "is_conflict", "product_text")


_ALIASES = ", aliases AS (SELECT DISTINCT p_name AS alias, p_brand AS family, TRUE AS is_primary, p_name LIKE 'old%' AS is_generic FROM part UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), p_brand, FALSE, FALSE FROM part)"


def _aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    full = part.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("family"), F.lit(True).alias("is_primary"), F.col("p_name").startswith("old").alias("is_generic")).distinct()
    nouns = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("alias"), F.col("p_brand").alias("family"), F.lit(False).alias("is_primary"), F.lit(False).alias("is_generic")).distinct()
    return full.union(nouns)


_HITS = _LOG + _ALIASES + r""", hits AS (SELECT query_id, family, max(CASE WHEN is_primary THEN 0.95 ELSE 0.85 END + length(alias) / 1000) AS score
  FROM log JOIN aliases ON NOT is_generic AND contains(' ' || regexp_replace(lower(raw_query), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ' || alias || ' ') GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, family) AS k, max(score) OVER (PARTITION BY query_id) AS top FROM hits
), best AS (SELECT query_id, arg_min(family, k) AS family, max(score) AS score, coalesce(max(score) - max(score) FILTER (WHERE k = 2) >= 0.05, TRUE) AS is_unique,
  string_agg(family, ',' ORDER BY family) FILTER (WHERE top - score <= 0.02 AND k <= 5) AS near FROM ranked GROUP BY query_id)"""


@query(_HITS + "SELECT * FROM best")
def alias_hits(spark, sf_dir):
    return ops.alias_hits(_log(spark, sf_dir), _aliases(spark, sf_dir), "query_id", "raw_query")


@query(_HITS.replace(_LOG, _PARSED, 1) + """SELECT p.query_id, CASE WHEN product_text = '' THEN 'invalid' WHEN is_conflict THEN 'clarify' WHEN b.family IS NULL THEN 'unsupported' WHEN NOT is_unique THEN 'clarify'
  WHEN price IS NULL AND promotion IS NULL THEN 'clarify' ELSE 'continue' END AS behavior, b.family FROM parsed p LEFT JOIN best b ON p.query_id = b.query_id""")
def resolve_queries(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    found = ops.alias_hits(parsed, _aliases(spark, sf_dir), "query_id", "raw_query")
    return ops.decide_behavior(parsed.join(found, "query_id", "left")).select("query_id", "behavior", "family")


@query("WITH x" + _ALIASES.replace(", aliases", " AS (SELECT 1), aliases", 1) + " SELECT alias, count(DISTINCT family) AS n_families, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM aliases GROUP BY alias HAVING count(DISTINCT family) > 1")
def catalog_collisions(spark, sf_dir):
    return ops.shared_aliases(_aliases(spark, sf_dir))


@query("""WITH c AS (SELECT p_brand AS family, min(p_name) AS name, [max(p_name), min(p_name)] AS excludes FROM part GROUP BY p_brand), e AS (SELECT family, unnest(excludes) AS phrase FROM c)
SELECT DISTINCT e.family, c.family AS peer FROM e JOIN c ON e.phrase = c.name AND e.family <> c.family""")
def keep_separate_peers(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.min("p_name").alias("name"), F.array(F.max("p_name"), F.min("p_name")).alias("excludes"))
    return ops.keep_separate_peers(c)


@query()
def package_siblings(spark, sf_dir):
    """Parts and customers that orders link, over all line items; tested against a plain search."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.col("l_partkey").alias("a"), (F.col("o_custkey") + 1_000_000_000_000).alias("b")).distinct()
    return ops.family_components(edges, lambda df: files.stored(df, "siblings"))


@query("""WITH n AS (SELECT p_brand AS family, p_name AS phrase FROM part), w AS (SELECT family, phrase, unnest(string_split(phrase, ' ')) AS word FROM n)
SELECT phrase, count(DISTINCT family) AS n_families, string_agg(DISTINCT word, ',' ORDER BY word) AS words, CASE WHEN count(DISTINCT family) > 1 THEN 'suppress' ELSE 'select' END AS kind FROM w WHERE word IN ('ring', 'bolt', 'hot') GROUP BY phrase""")
def protected_phrases(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_name").alias("name"))
    return ops.protected_phrases(part, spark.sql("SELECT * FROM VALUES ('ring'), ('bolt'), ('hot') AS t(word)"))


@query(r"""WITH lex(item, query, pattern) AS (VALUES ('licence', 'licensed', 'licensed under'), ('the', 'the th', 'the th'), ('und', 'und', ' und ')), h AS (SELECT doc_id, item, length(regexp_extract(lower(text), '(?s)^(.*?)' || pattern, 1)) + 1 AS pos, text FROM documents JOIN lex ON regexp_matches(lower(text), pattern))
SELECT doc_id, item, CAST(pos AS INTEGER) AS pos, substr(text, greatest(pos - 90, 1), pos - greatest(pos - 90, 1) + 90) AS snippet FROM h""")
def food_mentions(spark, sf_dir):
    lexicon = spark.createDataFrame([("licence", "licensed", "licensed under"), ("the", "the th", "the th"), ("und", "und", " und ")], "item string, query string, pattern string")
    return ops.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon, "doc_id", "text").select("doc_id", "item", F.col("at").alias("pos"), "snippet")
