"""Batch jobs over a log of shopper queries and the catalog's language: normalize, parse, resolve, decide."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import dimension
from priceloom.functions.text import captured
from priceloom.functions.units import rounded

#: The rewriting steps in order, as (name, pattern, replacement).
STEPS: tuple[tuple[str, str, str], ...] = (
    ("quotes", r"[‘’“”]", "'"),
    ("dashes", r"[‒-―]", "-"),
    ("bogo", r"\b(?:b1g1|bogof|buy one,? get one(?: free)?)\b", "bogo"),
    ("bucks", r"\b(\d+(?:\.\d+)?)\s*(?:bucks?|dollars?)\b", r"\$$1"),
    ("cents", r"\b(\d{2})\s*cents?\b", r"\$0.$1"),
    ("need", r"\bneed to buy (\d+)\b", "when you buy $1"),
    ("sized", r"\b(family|party|king)\s+sized\b", "$1 size"),
    ("spaces", r"\s+", " "),
)
#: Number words in prices.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def normalize_queries(log: DataFrame, text: str = "raw_query") -> DataFrame:
    """Adds query and steps, the names of the rewriting steps that changed it. Each step is a column, so none runs twice."""
    rows = log.withColumn("_q0", F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))))
    spelled = F.col("_q0")
    for i, word in enumerate(NUMBER_WORDS, 1):
        spelled = F.regexp_replace(spelled, rf"\b{word}(?=\s+(?:bucks?|dollars?|cents?|for)\b)", str(i))
    rows = rows.withColumn("_q1", spelled)
    names = ["numbers"]
    for i, (name, pattern, replacement) in enumerate(STEPS, 2):
        rows = rows.withColumn(f"_q{i}", F.regexp_replace(f"_q{i - 1}", pattern, replacement))
        names.append(name)
    changed = [F.when(F.col(f"_q{i}") != F.col(f"_q{i - 1}"), name) for i, name in enumerate(names, 1)]
    return rows.withColumns({"query": F.trim(F.col(f"_q{len(names)}")), "steps": F.array_compact(F.array(*changed))}).drop(*[f"_q{i}" for i in range(len(names) + 1)])


def parse_queries(rows: DataFrame, retailers: Sequence[str], text: str = "query") -> DataFrame:
    """Adds retailer, price, quantity, basis, promotion, package, product_text, missing and is_conflict."""
    q = F.col(text)
    names = "|".join(retailers)
    multi = r"(\d+)\s*(?:for|/)\s*\$?(\d+(?:\.\d+)?)"
    prices = F.regexp_extract_all(q, F.lit(r"\$(\d+(?:\.\d+)?)"), 1)
    rows = rows.withColumns(
        {
            "retailer": F.nullif(F.regexp_extract(q, rf"\b({names})\b", 1), F.lit("")),
            "quantity": captured(q, multi, 1).cast("int"),
            "price": F.coalesce(captured(q, multi, 2), captured(q, r"\$(\d+(?:\.\d+)?)")),
            "promotion": F.when(q.rlike(r"\bbogo\b"), "bogo").when(q.rlike(r"when you buy \d+"), "conditional"),
            "package": F.nullif(F.regexp_extract(q, r"(\d+(?:\.\d+)?\s*(?:oz|lb|ct|count|pack)\b)", 1), F.lit("")),
            "basis": F.when(q.rlike(multi), "multi_buy").when(q.rlike(r"per lb|/lb|a pound"), "per_lb").when(q.rlike(r"\$\d"), "each"),
            "is_conflict": F.size(F.array_distinct(prices)) > 1,
            "product_text": F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(q, multi, " "), rf"\$\d+(?:\.\d+)?|\b(?:{names}|bogo|at|is|a|the|for)\b", " "), r"\s+", " ")),
        }
    )
    missing = [F.when(F.col("price").isNull() & F.col("promotion").isNull(), "price"), F.when(F.col("retailer").isNull(), "retailer"), F.when(F.col("product_text") == "", "product")]
    return rows.withColumn("missing", F.array_compact(F.array(*missing))).withColumn("unit_price", F.when(F.col("quantity") > 0, rounded(F.col("price") / F.col("quantity"))).otherwise(F.col("price")))


def alias_hits(queries: DataFrame, aliases: DataFrame, key: str, text: str, near: float = 0.02, clear: float = 0.05, most: int = 5) -> DataFrame:
    """Per query the families whose alias stands in it as a whole phrase: best family, its score, whether it is unique, and the ambiguous ones.

    aliases: (alias, family, is_primary, is_generic); generic ones do not count. Score: 0.95 primary or 0.85, and length / 1000.
    Queries are exploded to their word sequences of up to as many words as the longest alias has, and hash-joined.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = aliases.where("NOT is_generic").withColumn("run", F.array_join(split(F.col("alias")), " "))
    longest = known.agg(F.max(F.size(split(F.col("alias"))))).first()[0] or 0
    words = queries.select(key, split(F.col(text)).alias("w"))
    runs = words.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[_runs("w", n) for n in range(1, max(longest, 1) + 1)])))).alias("run"))
    score = F.when(F.col("is_primary"), 0.95).otherwise(0.85) + F.length("alias") / 1000
    hits = runs.join(known, "run").groupBy(key, "family").agg(F.max(score).alias("score"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "family")
    ranked = hits.withColumns({"k": F.row_number().over(order), "top": F.max("score").over(Window.partitionBy(key))})
    return ranked.groupBy(key).agg(
        F.min_by("family", "k").alias("family"),
        F.max("score").alias("score"),
        F.coalesce(F.max("score") - F.max(F.when(F.col("k") == 2, F.col("score"))) >= clear, F.lit(True)).alias("is_unique"),
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("top") - F.col("score") <= near) & (F.col("k") <= most), F.col("family")))), ",").alias("near"),
    )


def _runs(words: str, n: int) -> Column:
    w = F.col(words)
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def decide_behavior(rows: DataFrame) -> DataFrame:
    """behavior and reason of parsed and resolved rows: (missing, is_conflict, family, is_unique, product_text)."""
    lacks = lambda name: F.array_contains("missing", name)
    behavior = (
        F.when(lacks("product"), F.struct(F.lit("invalid").alias("behavior"), F.lit("no_product").alias("reason")))
        .when(F.col("is_conflict"), F.struct(F.lit("clarify").alias("behavior"), F.lit("conflicting_prices").alias("reason")))
        .when(F.col("family").isNull(), F.struct(F.lit("unsupported").alias("behavior"), F.lit("no_match").alias("reason")))
        .when(~F.col("is_unique"), F.struct(F.lit("clarify").alias("behavior"), F.lit("ambiguous_product").alias("reason")))
        .when(lacks("price"), F.struct(F.lit("clarify").alias("behavior"), F.lit("missing_price").alias("reason")))
        .otherwise(F.struct(F.lit("continue").alias("behavior"), F.lit("none").alias("reason")))
    )
    return rows.withColumn("_b", behavior).withColumns({"behavior": F.col("_b.behavior"), "reason": F.col("_b.reason")}).drop("_b")


def shared_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that name several families."""
    return aliases.groupBy("alias").agg(F.count_distinct("family").alias("n_families"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families")).where("n_families > 1")


def keep_separate_peers(catalog: DataFrame) -> DataFrame:
    """(family, peer): an excluded phrase of a family names another one. catalog: family, name, excludes."""
    phrases = catalog.select("family", F.explode("excludes").alias("phrase")).select("family", F.lower(F.trim(F.col("phrase"))).alias("phrase")).distinct()
    return phrases.join(catalog.select(F.col("family").alias("peer"), F.lower(F.trim(F.col("name"))).alias("phrase")), "phrase").where("family <> peer").select("family", "peer").distinct()


def family_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of an undirected graph (a, b), the smallest member naming each; store writes a round's table.

    Nodes hang on to the smallest neighbour of their smallest neighbour by turns (large and small stars), so rounds grow
    with the logarithm of the nodes and not with the diameter. Loops and repeated edges change nothing.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).union(loops).distinct()
    while True:
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        after = store(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            roots = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        now = after


def protected_phrases(catalog: DataFrame, live_words: DataFrame) -> DataFrame:
    """Names of several words that hold a word of the live catalog; shared ones only suppress."""
    names = catalog.select("family", F.lower(F.trim(F.col("name"))).alias("phrase")).where(F.size(F.split("phrase", " ")) > 1)
    words = names.select("family", "phrase", F.explode(F.split("phrase", " ")).alias("word")).join(live_words, "word", "left_semi")
    return words.groupBy("phrase").agg(F.count_distinct("family").alias("n_families"), F.array_join(F.sort_array(F.collect_set("word")), ",").alias("words")).withColumn("kind", F.when(F.col("n_families") > 1, "suppress").otherwise("select"))


def mentions(texts: DataFrame, lexicon: DataFrame, key: str, text: str, around: int = 90) -> DataFrame:
    """First hit of each lexicon item (item, query, pattern) in each text, with a snippet around it."""
    hits = texts.join(dimension(lexicon), F.expr(f"lower({text}) RLIKE pattern")).withColumn("at", F.expr(f"regexp_instr(lower({text}), pattern)"))
    first = Window.partitionBy(key, "item").orderBy("at", "query")
    start = F.greatest(F.col("at") - around, F.lit(1))
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("snippet", F.substring(F.col(text), start, F.col("at") - start + around)).drop("_n")


def parsed_views(views: Column) -> Column:
    """12.5k and 3m as numbers."""
    number = captured(F.lower(views), r"([0-9]+(?:\.[0-9]+)?)")
    return (number * F.when(F.lower(views).contains("m"), 1_000_000).when(F.lower(views).contains("k"), 1000).otherwise(1)).cast("long")


def mention_priority(views: Column) -> Column:
    return F.when(views >= 20_000, 3).when(views >= 10_000, 2).otherwise(1)
