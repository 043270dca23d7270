"""Resolving shopper queries to the families of a catalog.

The catalog (family, name, brand, form, include, aliases, excludes) is a dimension; its language, its package siblings and
the names that are safe to use are worked out once as tables and joined with the query log by equality: by family, by the
word runs of a query, or by a brand's name. Nothing is compared with every row of a log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.operators.querylog import family_components

#: The signs of a package or form in a text, by name.
MARKERS: tuple[tuple[str, str], ...] = (
    ("party_size", r"\bparty[\s-]*size\b"),
    ("family_size", r"\bfamily[\s-]*size\b"),
    ("giant_size", r"\bgiant[\s-]*size\b"),
    ("regular", r"\bregular(?:\s+size)?\b"),
    ("tub", r"\btubs?\b"),
    ("cup", r"\bcups?\b"),
    ("pint", r"\bpints?\b"),
    ("bar", r"\b(?:ice\s*cream\s*)?bars?\b|\bnovelties\b"),
    ("per_lb", r"\bper\s*lb\b|/lb\b"),
    ("shredded", r"\bshredded\b"),
    ("sliced", r"\bsliced\b"),
    ("block", r"\bblock\b"),
    ("multipack", r"\bmulti[\s-]*packs?\b|\bvariety\s*packs?\b"),
)
#: Words that say no more than the kind of product, and words of a name that say a package or nothing.
GENERIC_WORDS = ("cereal", "yogurt", "chips", "cookies", "crackers", "popcorn", "butter", "cheese", "milk", "eggs", "bread", "snack", "snacks", "ice", "cream")
NOISE_WORDS = ("family", "size", "party", "giant", "regular", "tub", "tubs", "cup", "cups", "pint", "pints", "bag", "bags", "and", "or", "the", "a", "an", "of", "in", "with", "for")
#: Ends of a family id that say its package, the first that fits counts.
SIZE_SUFFIXES = ("_bars_novelties", "_party_size", "_family_size", "_giant_size", "_regular_bags", "_per_cup", "_regular", "_pints", "_tubs", "_tub", "_cups", "_bags")
#: Category words in names and their category, categories that the live parser guesses from one word, and
#: further words that are no brand by themselves.
CATEGORY_WORDS = {
    "chip": "chips", "chips": "chips", "cereal": "cereal", "cookie": "cookies", "cookies": "cookies", "cracker": "crackers", "crackers": "crackers", "yogurt": "yogurt", "oats": "oats",
    "oatmeal": "oats", "honey": "honey", "apple": "apple", "pop": "pop", "food": "food", "cream": "cream", "butter": "butter", "cheese": "cheese", "bar": "bars", "bars": "bars",
}
LIVE_CATEGORIES = ("chips", "cereal")
FOOD_WORDS = ("eggs", "milk", "bread", "rice", "pasta", "chicken", "beef", "pork", "fish", "shrimp")
#: Points of a shared package sign, of one that the family lacks, of a line of its own, and of a phrase.
SAME_MARKER, OTHER_MARKER, OWN_LINE, PHRASE = 5, -3, 4, 3
#: What a shopper is asked for, by field.
PROMPTS = {
    "product": "Which product did you mean?",
    "price": "What was the price?",
    "required_quantity": "How many do you have to buy?",
    "price_basis": "Is that price for one or for all of them?",
    "product_text": "Which product was it?",
    "package_size": "What size was the package?",
}


def normalized_name(c: Column) -> Column:
    """A name in lower case without marks and punctuation, & as and, dashes and blanks as one blank."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "’‘", "''"), "[®™©!.,]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), r"[-\s]+", " "))


def name_words(c: Column) -> Column:
    return F.regexp_extract_all(normalized_name(c), F.lit("([a-z0-9']+)"), 1)


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _strings(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def markers_in(text: Column) -> Column:
    """Names of the package signs that stand in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in MARKERS]))


def family_stem(family: Column, suffixes: Sequence[str] = SIZE_SUFFIXES) -> Column:
    """A family id without the end that says its package."""
    out = F.lit(None).cast("string")
    for s in suffixes:
        out = F.coalesce(out, F.when(family.endswith(s), F.left(family, F.length(family) - len(s))))
    return F.coalesce(out, family)


# -- package siblings ------------------------------------------------------------------------------------------------


def sibling_links(catalog: DataFrame) -> DataFrame:
    """(a, b): families of one stem, and families of one brand of which one is kept separate from a phrase of the other."""
    stems = catalog.select("family", family_stem(F.col("family")).alias("stem"))
    first = stems.groupBy("stem").agg(F.min("family").alias("first"))
    same_stem = stems.join(first, "stem").where("family <> first").select(F.col("family").alias("a"), F.col("first").alias("b"))
    brand = normalized_name(F.col("brand"))
    phrases = catalog.select(F.col("family").alias("a"), brand.alias("brand"), F.explode(F.array_distinct(F.transform(_strings("excludes"), normalized_name))).alias("phrase")).where("length(phrase) >= 4")
    named = catalog.select(F.col("family").alias("b"), brand.alias("brand"), F.concat_ws(" ", normalized_name(F.col("name")), normalized_name(F.translate("family", "_", " "))).alias("hay"))
    apart = phrases.join(named, "brand").where("a <> b AND (contains(hay, phrase) OR contains(phrase, hay))").select("a", "b")
    return same_stem.union(apart).distinct()


def package_siblings(catalog: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(family, component, n_siblings) of every family; a family without siblings is a component of its own."""
    linked = family_components(sibling_links(catalog), store)
    every = catalog.select("family").join(linked, F.col("family") == F.col("node"), "left").select("family", F.coalesce("component", "family").alias("component"))
    return every.join(every.groupBy("component").agg(F.count(F.lit(1)).alias("n_siblings")), "component").select("family", "component", "n_siblings")


def package_profiles(catalog: DataFrame, siblings: DataFrame, generic: Sequence[str] = GENERIC_WORDS, noise: Sequence[str] = NOISE_WORDS) -> DataFrame:
    """Per family: component, n_siblings, brand, markers, lines (phrases of its own, which no sibling has in this or another
    package) and phrases (names of a family without siblings)."""
    drop = lambda words, gone: F.filter(words, lambda w: ~F.array_contains(_words(gone), w))
    brand, name = normalized_name(F.col("brand")), normalized_name(F.col("name"))
    blob = F.concat_ws(" ", "family", "name", F.coalesce("form", F.lit("")), F.array_join(F.slice(_strings("include"), 1, 8), " "))
    of_id = F.array_compact(F.array(*[F.when(F.contains("family", F.lit(n)), F.lit(n)) for n, _ in MARKERS]))
    base = catalog.join(siblings, "family").select(
        "family", "component", "n_siblings", brand.alias("brand"), name.alias("name"),
        F.array_union(markers_in(blob), of_id).alias("markers"),
        F.array_distinct(F.transform(F.concat(F.array("name"), F.slice(_strings("include"), 1, 10), F.slice(_strings("aliases"), 1, 6)), normalized_name)).alias("names"),
        F.array_distinct(F.transform(_strings("include"), normalized_name)).alias("includes"),
    )
    brand_words = F.split("brand", " ")
    lines = base.select("family", "component", "brand", "name", F.explode("includes").alias("phrase")).where("phrase <> ''")
    lines = lines.withColumn("words", F.split("phrase", " ")).withColumn("core", F.array_join(drop(F.col("words"), noise), " "))
    kind = drop(F.col("words"), generic)
    unmarked = F.lit(True)
    for n, _ in MARKERS:
        unmarked &= ~F.contains("phrase", F.lit(n))
    only_brand = F.size(F.array_except(kind, F.array_union(brand_words, _words(generic)))) == 0
    brand_level = (F.col("phrase") == F.col("brand")) | (kind == brand_words) | (F.col("phrase") == F.col("name")) & unmarked & only_brand
    # A phrase, or what is left of it without package words, that two siblings have tells them apart no more.
    owners = lambda c: F.size(F.collect_set("family").over(Window.partitionBy("component", c)))
    own = lines.withColumns({"n_phrase": owners("phrase"), "n_core": owners("core")}).where(~brand_level & (F.col("n_phrase") == 1) & ((F.col("core") == "") | (F.col("n_core") == 1)))
    kept = own.groupBy("family").agg(F.sort_array(F.collect_set("phrase")).alias("lines"))
    return base.join(kept, "family", "left").select("family", "component", "n_siblings", "brand", "markers", _strings("lines").alias("lines"), "names")


def fit_score(text: str = "product_text") -> Column:
    """How well a text fits a family's package, for rows that carry its package profile."""
    norm, signs = normalized_name(F.col(text)), markers_in(F.col(text))
    words = F.split(norm, " ")
    has_line = F.exists("lines", lambda p: F.contains(norm, p) | (F.size(F.array_except(F.filter(F.split(p, " "), lambda w: F.length(w) > 2), words)) == 0))
    shared = F.size(F.array_intersect(signs, F.col("markers")))
    several = SAME_MARKER * shared + OTHER_MARKER * (F.size(signs) - shared) + F.when(has_line, OWN_LINE).otherwise(0)
    alone = PHRASE * F.size(F.filter("names", lambda p: (F.length(p) >= 3) & ((p == norm) | (F.length(p) >= 6) & F.contains(norm, p))))
    return F.when(F.col("n_siblings") > 1, several).otherwise(alone).cast("int")


def package_fit(pairs: DataFrame, profiles: DataFrame, key: str, text: str = "product_text") -> DataFrame:
    """(key, family, score) of pairs (key, family, text); families that the catalog lacks score 0."""
    return pairs.join(profiles, "family", "left").select(key, "family", F.coalesce(fit_score(text), F.lit(0)).alias("score"))


def best_fit(scores: DataFrame, key: str) -> DataFrame:
    """(key, best, winners): the families of the highest score above 0, which is a decision only if it is one."""
    top = scores.groupBy(key).agg(F.max("score").alias("best"))
    winners = scores.join(top, key).where("score = best AND score > 0").groupBy(key).agg(F.sort_array(F.collect_set("family")).alias("winners"))
    return top.join(winners, key, "left").select(key, "best", _strings("winners").alias("winners"))


# -- resolution ------------------------------------------------------------------------------------------------------


def _outcome(status: str, family: Column | None, candidates: Column, reason: Column | str | None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(status).alias("status"), (none if family is None else family).alias("family"), candidates.cast("array<string>").alias("candidates"), as_column(reason).cast("string").alias("reason")
    )


def gated_outcome(accepted: Column, review: Column) -> Column:
    """What the families that the gate accepts or sends to review say: one is a match, several are ambiguous."""
    a, r = F.size(accepted), F.size(review)
    return (
        F.when((a == 1) & (r == 0), _outcome("matched", F.get(accepted, 0), accepted, None))
        .when(a > 0, _outcome("ambiguous", None, accepted, "multiple_plausible_trackers"))
        .when(r > 1, _outcome("ambiguous", None, review, "multiple_manual_review_candidates"))
        .when(r == 1, _outcome("matched", F.get(review, 0), review, "single_manual_review_elevated"))
        .otherwise(_outcome("no_match", None, F.array(), "no_accepted_tracker"))
    )


def brand_only(queries: DataFrame, profiles: DataFrame, key: str, text: str = "product_text", generic: Sequence[str] = GENERIC_WORDS) -> DataFrame:
    """(key, brand_families): queries that name a brand with several packages and nothing else but generic words. Of a
    brand's components with siblings the first one is offered."""
    groups = profiles.where("n_siblings > 1").groupBy("brand", "component").agg(F.sort_array(F.collect_set("family")).alias("families"))
    first = groups.groupBy("brand").agg(F.min_by("families", "component").alias("brand_families"))
    norm = normalized_name(F.col(text))
    kind = F.array_join(F.filter(F.split(norm, " "), lambda w: ~F.array_contains(_words(generic), w)), " ")
    named = queries.select(key, F.explode(F.array_distinct(F.array(kind, norm))).alias("brand"), kind.alias("kind")).where("kind <> ''")
    return named.join(first, "brand").groupBy(key).agg(F.min("brand_families").alias("brand_families"))


def resolve(
    queries: DataFrame, decisions: DataFrame, aliases: DataFrame, profiles: DataFrame, key: str = "query_id", text: str = "product_text", generic: Sequence[str] = GENERIC_WORDS
) -> DataFrame:
    """Adds status (matched, ambiguous, no_match, error), family, candidates and reason to queries, one row for each.

    decisions: (key, family, decision), the pattern hits with the gate's word (accepted, manual_review, rejected).
    aliases: (key, family, is_unique, near), the phrase hits, near being the comma-separated families close to the best.
    First the gate speaks; where it accepts nothing, a bare brand, then a unique alias, then several. Then packages: a match
    among siblings must fit the text's package best or it changes or becomes ambiguous, and one best fit settles an
    ambiguous query. A blank text is an error; a query that nothing names has no match. Null decisions count as rejected.
    """
    gate = decisions.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(F.col("decision") == "accepted", F.col("family")))).alias("_accepted"),
        F.sort_array(F.collect_set(F.when(F.col("decision") == "manual_review", F.col("family")))).alias("_review"),
    )
    hits = aliases.select(key, F.col("family").alias("_alias"), F.col("is_unique").alias("_unique"), F.split("near", ",").alias("_near"))
    rows = queries.select(key, text).join(gate, key, "left").join(hits, key, "left").join(brand_only(queries, profiles, key, text, generic), key, "left")
    base = gated_outcome(_strings("_accepted"), _strings("_review"))
    none = F.col("_base.status") == "no_match"
    fallback = (
        F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", _outcome("error", None, F.array(), "empty_product_text"))
        .when(none & (F.size(_strings("brand_families")) > 1), _outcome("ambiguous", None, F.col("brand_families"), "brand_only_package_ambiguous"))
        .when(none & F.coalesce("_unique", F.lit(False)), _outcome("matched", F.col("_alias"), F.array("_alias"), "shopper_alias_unique"))
        .when(none & (F.size(_strings("_near")) > 1), _outcome("ambiguous", None, F.col("_near"), "shopper_alias_ambiguous"))
        .otherwise(F.col("_base"))
    )
    found = rows.withColumn("_base", base).withColumn("_first", fallback).select(key, text, "_first.*")
    # The families to weigh: the siblings of a match, or what is ambiguous (a bare brand excepted).
    members = profiles.groupBy("component").agg(F.sort_array(F.collect_set("family")).alias("siblings"))
    of_family = profiles.select("family", "component", "n_siblings").join(members, "component").select("family", "siblings", "n_siblings")
    placed = found.join(of_family, "family", "left").withColumn("n_siblings", F.coalesce("n_siblings", F.lit(1)))
    open_ = (F.col("status") == "ambiguous") & (F.size("candidates") > 1) & (F.col("reason") != "brand_only_package_ambiguous")
    weighed = F.when((F.col("status") == "matched") & (F.col("n_siblings") > 1), F.col("siblings")).when(open_, F.col("candidates"))
    pairs = placed.select(key, text, F.explode(weighed).alias("family"))
    fit = best_fit(package_fit(pairs, profiles, key, text), key)
    one = F.size(_strings("winners")) == 1
    winner = F.get(F.col("winners"), 0)
    gated = (
        F.when((F.col("status") == "matched") & (F.col("n_siblings") > 1) & one & (winner != F.col("family")), _outcome("matched", winner, F.col("winners"), "package_form_rematch"))
        .when((F.col("status") == "matched") & (F.col("n_siblings") > 1) & ~one, _outcome("ambiguous", None, F.col("siblings"), "package_form_ambiguous"))
        .when(open_ & one, _outcome("matched", winner, F.col("winners"), "package_form_disambiguated"))
        .otherwise(F.struct("status", "family", "candidates", "reason"))
    )
    done = placed.join(fit.select(key, "winners"), key, "left").withColumn("_last", gated).select(key, "_last.*")
    return queries.join(done, key)


def next_action(rows: DataFrame, most: int = 3) -> DataFrame:
    """Adds behavior, reason_code, action, ask (ambiguous_product or missing_field), prompt and options to resolved rows.

    rows: status, family, candidates, product_text, price, quantity, promotion, is_conflict, and, if they are there,
    unsupported_retailer, package_unclear and basis. Contradictory prices are invalid; unknown retailers and products are
    unsupported; several products, a missing price and a missing quantity are asked for; all else goes on.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit(False)
    blank = F.trim(F.coalesce(F.col("product_text"), F.lit(""))) == ""
    say = lambda behavior, reason: F.struct(F.lit(behavior).alias("behavior"), F.lit(reason).alias("reason_code"))
    unresolved = F.col("status").isin("no_match", "error")
    bought = F.col("promotion").isin("multi_buy", "buy_x_get_y", "bogo")
    decided = (
        F.when(flag("is_conflict"), say("invalid", "conflicting_or_malformed_price"))
        .when(flag("unsupported_retailer"), say("unsupported", "unsupported_retailer"))
        .when(flag("package_unclear"), say("clarify", "package_synonym_ambiguous"))
        .when(F.col("status") == "ambiguous", say("clarify", "ambiguous_tracker_match"))
        .when(unresolved & blank, say("clarify", "missing_product_text"))
        .when(unresolved, say("unsupported", "no_tracker_match"))
        .when(F.col("price").isNull(), say("clarify", "missing_price"))
        .when(bought & F.col("quantity").isNull(), say("clarify", "missing_required_quantity"))
        .otherwise(say("continue", "unique_tracker_match"))
    )
    out = rows.withColumn("_d", decided).withColumns({"behavior": F.col("_d.behavior"), "reason_code": F.col("_d.reason_code")}).drop("_d")
    basis = F.col("basis") if "basis" in rows.columns else F.lit(None).cast("string")
    unclear = F.col("price").isNotNull() & F.col("quantity").isNotNull() & F.coalesce(basis == "each", F.lit(True)) & F.col("promotion").isNull()
    asked = (
        F.when(F.col("behavior") == "clarify", F.create_map(*[F.lit(x) for kv in {"ambiguous_tracker_match": "product", "missing_price": "price", "missing_required_quantity": "required_quantity", "missing_product_text": "product_text", "package_synonym_ambiguous": "package_size"}.items() for x in kv])[F.col("reason_code")])
        .when((F.col("behavior") == "continue") & unclear, F.lit("price_basis"))
    )
    prompts = F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv])
    return out.withColumn("_asked", asked).withColumns(
        {
            "action": F.when(F.col("_asked").isNotNull(), F.lit("clarify")).otherwise(F.col("behavior")),
            "ask": F.when(F.col("_asked") == "product", "ambiguous_product").when(F.col("_asked").isNotNull(), "missing_field"),
            "prompt": prompts[F.col("_asked")],
            "options": F.slice(_strings("candidates"), 1, most),
        }
    ).drop("_asked")


# -- the catalog's language ------------------------------------------------------------------------------------------


def unique_runs(catalog: DataFrame, name: str = "name", most: int = 6) -> DataFrame:
    """(family, short_name): of the word runs of a family's name that no other family's name holds the one with the fewest
    words, then letters. Families whose whole name is part of another's have none."""
    words = catalog.select("family", name_words(F.col(name)).alias("w")).where("size(w) > 0")
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(most))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    runs = words.select("family", F.explode(F.array_distinct(starts)).alias("run"))
    own = runs.groupBy("run").agg(F.min("family").alias("family"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return own.groupBy("family").agg(F.min(F.struct(F.size(F.split("run", " ")).alias("a"), F.length("run").alias("b"), F.col("run").alias("run")))["run"].alias("short_name"))


def language_profiles(
    catalog: DataFrame, siblings: DataFrame, categories: dict[str, str] = CATEGORY_WORDS, live: Sequence[str] = LIVE_CATEGORIES, no_brand: Sequence[str] = FOOD_WORDS
) -> DataFrame:
    """Per family: normalized aliases, category words in its names, protected phrases, whether the brand alone names it, a
    safe short name, the families it may be taken for, its resolution class and whether it needs a question.

    A phrase is protected if it has several words and one of a live category. Classes, the first that holds: siblings ask
    for the package; protected phrases with category words; a brand that names only this family; category words without a
    protected phrase ask for their context; names of more than three words only are a gap; the rest is safe.
    """
    category_of = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    kinds = lambda c: F.array_distinct(F.array_compact(F.transform(name_words(c), lambda w: category_of[w])))
    phrases = F.concat(F.array("name", "brand"), _strings("include"), _strings("aliases"))
    live_phrase = lambda p: (F.size(name_words(p)) > 1) & (F.size(F.array_intersect(kinds(p), _words(live))) > 0)
    others = siblings.groupBy("component").agg(F.sort_array(F.collect_set("family")).alias("_all"))
    peers = siblings.join(others, "component").select("family", F.array_except("_all", F.array("family")).alias("ambiguous_with"))
    brand = normalized_name(F.col("brand"))
    not_brand = F.array_contains(_words([*categories, *no_brand]), brand)
    rows = catalog.join(peers, "family").join(unique_runs(catalog), "family", "left").select(
        "family", "name", "brand", "ambiguous_with", "short_name",
        F.array_distinct(F.filter(F.transform(F.concat(F.array("brand", "name"), F.slice(_strings("include"), 1, 5), F.slice(_strings("aliases"), 1, 8)), normalized_name), lambda a: a != "")).alias("aliases"),
        F.array_distinct(F.flatten(F.transform(F.concat(F.array("name"), _strings("include")), kinds))).alias("category_words"),
        F.array_distinct(F.transform(F.filter(phrases, live_phrase), normalized_name)).alias("protected"),
        ((brand != "") & ~not_brand & (F.size("ambiguous_with") == 0)).alias("brand_only_safe"),
    )
    shortest = F.get(F.array_sort(F.transform("protected", lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), 0)["p"]
    resolution = (
        F.when(F.size("ambiguous_with") > 0, "package_clarification_required")
        .when((F.size("protected") > 0) & (F.size("category_words") > 0), "protected_phrase_required")
        .when(F.col("brand_only_safe"), "exact_alias_safe")
        .when((F.size("category_words") > 0) & (F.size("protected") == 0), "category_context_required")
        .when(~F.exists("aliases", lambda a: F.size(name_words(a)) <= 3), "natural_language_gap")
        .otherwise("exact_alias_safe")
    )
    named = rows.withColumns({"safe_name": F.coalesce(F.when(F.col("brand_only_safe"), F.trim("brand")), shortest), "resolution_class": resolution})
    asks = ("package_clarification_required", "category_context_required", "natural_language_gap")
    return named.withColumn("needs_question", F.col("resolution_class").isin(*asks))


def probes(catalog: DataFrame, profiles: DataFrame, store_name: str = "safeway", price: str = "$2.49") -> DataFrame:
    """(family, ord, kind, raw_query): up to about a dozen things that a shopper may say for each family, each wording once."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("wording"))
    several = lambda kind, c: F.transform(F.slice(_strings(c), 1, 4), lambda x: one(kind, x))
    listed = F.concat(
        F.array(one("safe_short", F.coalesce("safe_name", "short_name")), one("brand", F.col("brand")), one("display", F.col("name")), one("protected", F.get("protected", 0))), several("include", "include"), several("alias", "aliases")
    )
    rows = catalog.join(profiles.select("family", "safe_name", "short_name", "protected"), "family").select("family", F.posexplode(listed).alias("ord", "p")).where("trim(coalesce(p.wording, '')) <> ''")
    first = Window.partitionBy("family", normalized_name(F.col("p.wording"))).orderBy("ord")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("family", "ord", "p.kind", F.concat_ws(" ", F.lit(store_name), F.trim("p.wording"), F.lit(f"are {price}")).alias("raw_query"))


def reachability(asked: DataFrame, answers: DataFrame, keys: Sequence[str] = ("family", "ord")) -> DataFrame:
    """Per family: n_probes, n_reached, the first probe that reaches it and reachable.

    A probe reaches its family if the answer (keys, selected, action, ask, candidates) selects it and goes on or asks, or
    asks which product and lists it.
    """
    lists = (F.col("action") == "clarify") & (F.col("ask") == "ambiguous_product") & F.array_contains(_strings("candidates"), F.col("family"))
    selects = (F.col("selected") == F.col("family")) & F.col("action").isin("continue", "clarify")
    reached = asked.join(answers, list(keys), "left").withColumn("_ok", F.coalesce(selects, F.lit(False)) | F.coalesce(lists, F.lit(False)))
    return reached.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_probes"),
        F.count_if("_ok").alias("n_reached"),
        F.min_by("kind", F.when(F.col("_ok"), F.col("ord"))).alias("via"),
        F.bool_or("_ok").alias("reachable"),
    )
