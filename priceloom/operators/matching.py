"""Matching offers to a catalog with pattern joins, ranking the candidates and the acceptance gate.

The catalog is a dimension: id, include, exclude and prefer patterns as arrays, a rule and a baseline. Its size does not
grow with the offers; it is sent to the tasks in blocks of at most BROADCAST_FAMILIES rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import dimension

BROADCAST_FAMILIES = 50_000

#: Qualifier words that may stand between two words of a phrase, up to three in a row.
QUALIFIERS = (
    "family", "size", "party", "value", "mega", "king", "jumbo", "large", "grade", "share", "sharing", "fun",
    "snack", "big", "grab", "original", "classic", "selected", "variety", "varieties", "brand", "new", "farms",
)
#: Confidence by keyword confidence, and the least confidence of families that state none.
START_CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.45}
MIN_CONFIDENCE = 0.65
#: Reason codes of one missing attribute; several give ambiguous_product_variant.
MISSING_CODES = {
    "package_size": "missing_package_size",
    "package_count": "missing_package_count",
    "brand": "missing_brand",
    "product_form": "ambiguous_product_variant",
    "product_line": "ambiguous_product_variant",
    "container_type": "ambiguous_product_variant",
}
#: Units and words that state a package, and containers by family.
PACKAGE_UNITS = ("oz", "fl oz", "ct", "count", "pk", "pack", "lb", "liter", "litre", "l")
PACKAGE_WORDS = ("dozen", "party size", "family size", "tub", "cup", "cups", "bottle", "bottles", "can", "cans")
CONTAINERS = {"can": "cans?", "bottle": "bottles?", "cup": "cups?", "tub": "tub"}

#: The rules of a family, as the gate reads them.
RULES = (
    "struct<canonical_intent:string,positive_keywords:array<string>,negative_keywords:array<string>,allowed_types:array<string>,disallowed_types:array<string>,"
    "allowed_units:array<string>,disallowed_units:array<string>,allowed_package_patterns:array<string>,disallowed_package_patterns:array<string>,"
    "require_confirmation_keywords:array<string>,required_attributes:array<struct<name:string,any_of:array<string>,any_of_patterns:array<string>>>,min_confidence:double>"
)


def _escaped(words: Column) -> Column:
    return F.regexp_replace(words, r"([\\.^$|()\[\]{}*+?])", r"\\$1")


def phrase_pattern(phrase: Column, qualifiers: tuple[str, ...] = QUALIFIERS, most: int = 3) -> Column:
    """A phrase as a regular expression: up to `most` qualifiers between its words, word edges where it has no digit, and
    any dash or blanks inside a range of sizes. A blank phrase matches nothing."""
    plain = F.regexp_replace(F.trim(F.lower(phrase)), "–|n/a", "-")
    ranged = F.regexp_replace(plain, r"(\d)\s*-\s*(\d)", "$1-$2")
    gap = rf"\s+(?:(?:{'|'.join(qualifiers)})\s+){{0,{most}}}"
    body = F.array_join(F.transform(F.split(ranged, r"\s+"), _escaped), gap)
    body = F.regexp_replace(body, r"(\d)-(\d)", r"$1\\s*[-–]\\s*$2")
    return F.when(plain == "", "(?!)").when(plain.rlike(r"\d"), body).otherwise(F.concat(F.lit(r"\b"), body, F.lit(r"\b")))


def compile_phrases(catalog: DataFrame, include: str = "include", exclude: str = "exclude", name: str | None = None) -> DataFrame:
    """The catalog with include_pattern and exclude_pattern, one alternation per family (null where there is no phrase). The
    family's own name, if its column is given, counts among the included phrases."""
    own = F.array_union(F.array(name), F.coalesce(include, F.array().cast("array<string>"))) if name else F.col(include)
    alternation = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda p: phrase_pattern(p)), "|"))
    return catalog.withColumns({"include_pattern": alternation(own), "exclude_pattern": alternation(F.col(exclude))})


def match_offers(offers: DataFrame, catalog: DataFrame, text: str = "text", package: str | None = None, include_only: bool = False, block: int = BROADCAST_FAMILIES) -> DataFrame:
    """Pairs of offers and families whose include pattern is in the text and whose exclude pattern is not in text and package.

    A theta join by regular expression; the condition holds no equality, so the catalog side is sent to every task. A
    larger catalog is sent in blocks of about that many rows, with equal results; match_by_token costs less there.
    """
    hit = F.expr(f"{text} RLIKE include_pattern")
    if not include_only:
        around = f"concat_ws(' ', {text}, {package})" if package else text
        hit = hit & ~F.expr(f"coalesce({around}, '') RLIKE coalesce(exclude_pattern, '(?!)')")
    blocks = max(1, -(-catalog.count() // block))
    found = None
    for k in range(blocks):
        part = catalog.where(F.pmod(F.xxhash64("include_pattern", "exclude_pattern"), F.lit(blocks)) == k) if blocks > 1 else catalog
        pairs = offers.join(F.broadcast(part), hit)
        found = pairs if found is None else found.union(pairs)
    return found


def match_by_token(offers: DataFrame, catalog: DataFrame, text: str = "text", token: str = "token") -> DataFrame:
    """As match_offers, for large catalogs: families carry one literal token that each of their matches must hold.

    Offers are exploded to their distinct tokens and hash-joined; the pattern then decides. A family without such a token
    must not be passed here.
    """
    tokens = offers.withColumn(token, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))))
    shut = F.expr(f"{text} RLIKE coalesce(exclude_pattern, '(?!)')")
    return tokens.join(catalog, token).where(F.expr(f"{text} RLIKE include_pattern") & ~shut).drop(token)


def literal_tokens(phrase: Column) -> Column:
    """The tokens that every text with a phrase holds as its own: all of them, or, where a digit lifts the word edges, those
    between the first and the last word."""
    plain = F.trim(F.lower(phrase))
    words = F.split(plain, r"\s+")
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    kept = F.when(plain.rlike(r"\d|–|n/a"), inner).otherwise(words)
    return F.array_distinct(F.regexp_extract_all(F.array_join(kept, " "), F.lit(r"([\p{L}\p{N}]+)"), 1))


def match_phrases(offers: DataFrame, catalog: DataFrame, key: str, text: str = "text", block: int = BROADCAST_FAMILIES) -> DataFrame:
    """(key, family) of texts that hold an included phrase of a family (family, include, exclude) and none of its excluded ones.

    A hash join: each phrase is looked up by the one of its literal tokens that the fewest phrases have, and its pattern is
    tried only where all of its tokens are in the text. Phrases without such a token are tried on every text, in blocks.
    Null and blank texts match nothing; a phrase that a text holds twice counts once.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    texts = offers.select(key, low.alias("_text"))
    phrases = catalog.select("family", F.explode(F.array_distinct("include")).alias("phrase")).where("trim(phrase) <> ''")
    phrases = phrases.select("family", phrase_pattern(F.col("phrase")).alias("pattern"), literal_tokens(F.col("phrase")).alias("tokens"))
    rarity = phrases.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = phrases.select("family", "pattern", "tokens", F.explode("tokens").alias("token")).join(rarity, "token").groupBy("family", "pattern", "tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    held = texts.withColumn("_held", F.array_distinct(F.regexp_extract_all("_text", F.lit(r"([\p{L}\p{N}]+)"), 1)))
    near = held.withColumn("token", F.explode("_held")).join(rarest, "token").where((F.size(F.array_except("tokens", "_held")) == 0) & F.expr("_text RLIKE pattern"))
    found = near.select(key, "family", "_text")
    bare = phrases.where("size(tokens) = 0").select("family", F.col("pattern").alias("include_pattern"), F.lit(None).cast("string").alias("exclude_pattern"))
    if not bare.isEmpty():
        found = found.union(match_offers(texts, bare, "_text", include_only=True, block=block).select(key, "family", "_text"))
    shut = compile_phrases(catalog).select("family", "exclude_pattern")
    return found.distinct().join(shut, "family").where("NOT _text RLIKE coalesce(exclude_pattern, '(?!)')").select(key, "family")


def preference_score(text: Column, prefer: Column, priced: Column) -> Column:
    """10 for each place from the end of the best preferred pattern, one more if the offer has a price."""
    n = F.size(prefer)
    best = F.array_max(F.transform(prefer, lambda p, i: F.when(F.regexp_like(text, p), (n - i) * 10).otherwise(0)))
    return F.coalesce(best, F.lit(0)) + priced.cast("int")


def match_confidence(text: Column, prefer: Column, priced: Column) -> Column:
    """medium for lists, high for a preferred pattern, else medium; none without a price."""
    return F.when(~priced, F.lit(None).cast("string")).when(text.rlike(r",|\sor\s"), "medium").when(F.exists(prefer, lambda p: F.regexp_like(text, p)), "high").otherwise("medium")


def rank_candidates(matches: DataFrame, keys: list[str], lowest: Column, score: str = "score", price: str = "unit_price", seq: str = "row_seq", usable: Column | None = None) -> DataFrame:
    """candidate_rank within each key: by unit price for the families where lowest holds, else by score; ties keep file order.

    Rows that are not usable go. They are ranked last and dropped behind the window, since a filter before it would be
    pushed below the columns it reads and would compute them again.
    """
    order = [F.when(lowest, F.col(price)).asc_nulls_last(), F.when(lowest, F.lit(0)).otherwise(F.col(score)).desc(), F.col(seq)]
    if usable is None:
        return matches.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = matches.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    ranked = rows.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_usable").desc(), *order)))
    return ranked.where("_usable").drop("_usable")


def pick_best(matches: DataFrame, keys: list[str], lowest: Column, usable: Column, score: str = "score", price: str = "unit_price", seq: str = "row_seq") -> DataFrame:
    """The first usable candidate of each key; a grouping, so that candidates combine before they shuffle."""
    by_price = F.when(lowest, F.col(price))
    order = F.struct(by_price.isNull().alias("a"), by_price.alias("b"), F.when(lowest, F.lit(0)).otherwise(-F.col(score)).alias("c"), F.col(seq).alias("d"))
    rest = [c for c in matches.columns if c not in keys]
    best = matches.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.when(usable, order)).alias("_best"))
    return best.where("_best IS NOT NULL").select(*keys, "_best.*")


def rank1_candidates(candidates: DataFrame, key: str, rank: str, seq: list[str]) -> DataFrame:
    """Per product the candidate of the lowest rank (blank counts as 99); the first wins ties."""
    place = F.coalesce(F.col(rank).cast("int"), F.lit(99))
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(place, *seq))).where("_n = 1").drop("_n")


def keyword_hits(text: Column, keywords: Column) -> Column:
    """The keywords that stand in the text as whole words or phrases."""
    edge = lambda k: F.concat(F.lit(r"(?<!\w)"), F.regexp_replace(F.regexp_replace(F.lower(F.trim(k)), r"([\\.^$|()\[\]{}*+?])", r"\\$1"), " ", r"\\s+"), F.lit(r"(?!\w)"))
    return F.filter(keywords, lambda k: (F.trim(k) != "") & F.regexp_like(F.lower(text), edge(k)))


def pattern_hits(text: Column, patterns: Column) -> Column:
    return F.filter(patterns, lambda p: F.regexp_like(F.lower(text), p))


def classify_types(rows: DataFrame, taxonomy: DataFrame, key: str, text: str) -> DataFrame:
    """(key, types, primary_type): all types (ord, type, pattern) that hit, in taxonomy order."""
    hits = rows.select(key, text).join(dimension(taxonomy), F.expr(f"{text} RLIKE pattern"))
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("ord", "type"))).alias("t"))
    return grouped.select(key, F.col("t.type").alias("types"), F.get("t.type", 0).alias("primary_type"))


def eligibility(rows: DataFrame) -> DataFrame:
    """The gate without its history checks: adds confidence, base_decision, reasons, reason_code and exempt to (text, package_text,
    types, unit_hint, priced, keyword_confidence) rows that carry a struct RULES; full_text, if there, is the whole offer.

    Hard negatives, types, units and packages outside the rules reject. Missing attributes, mixed packages, open variant
    lists and low or unclear confidence ask for review. A row whose rules are null is accepted and exempt from the history
    checks too.
    """
    r = lambda name: F.coalesce(F.col(f"rules.{name}"), F.array().cast("array<string>"))
    attributes = F.coalesce(F.col("rules.required_attributes"), F.array().cast("array<struct<name:string,any_of:array<string>,any_of_patterns:array<string>>>"))
    text, full, types, unit = F.col("_text"), F.col("_full"), F.col("_types"), F.col("_unit")
    whole = F.col("full_text") if "full_text" in rows.columns else F.concat_ws(" ", "text", "package_text")
    listed = lambda c: c.rlike(r"\bor\b") | (F.size(F.split(c, ",")) > 2)
    contains = lambda name, value: F.coalesce(F.array_contains(r(name), value), F.lit(False))
    stated = rf"\b\d+(?:\.\d+)?\s*(?:{'|'.join(u.replace(' ', chr(92) + '.?' + chr(92) + 's*') for u in PACKAGE_UNITS)})\b|\b(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in PACKAGE_WORDS)})\b"
    containers = sum(full.rlike(rf"(?<!\w){p}(?!\w)").cast("int") for p in CONTAINERS.values())
    ounces = F.size(F.array_distinct(F.regexp_extract_all(full, F.lit(r"\b(\d+(?:\.\d+)?)\s*oz\b"), 1)))
    unmet = F.transform(F.filter(attributes, lambda a: (F.size(keyword_hits(full, a["any_of"])) + F.size(pattern_hits(full, a["any_of_patterns"]))) == 0), lambda a: a["name"])
    unconfirmed = F.when((F.size(r("require_confirmation_keywords")) > 0) & (F.size(keyword_hits(full, r("require_confirmation_keywords"))) == 0), "confirmation")
    # One layer of columns after another, so that no pattern is tried twice.
    rows = rows.withColumns(
        {
            "_text": F.lower("text"),
            "_full": F.lower(whole),
            "_types": F.coalesce(F.col("types"), F.array().cast("array<string>")),
            "_unit": F.when(F.col("unit_hint") == "per_lb", "lb").otherwise(F.col("unit_hint")),
        }
    ).withColumns(
        {
            "_negatives": F.array_distinct(F.concat(keyword_hits(text, r("negative_keywords")), pattern_hits(full, r("disallowed_package_patterns")))),
            "_bad_type": F.size(F.array_intersect(types, r("disallowed_types"))) > 0,
            "_good_type": F.size(F.array_intersect(types, r("allowed_types"))) > 0,
            "_bad_unit": contains("disallowed_units", F.col("unit_hint"))
            | F.coalesce((F.size(r("allowed_units")) > 0) & ~contains("allowed_units", F.col("unit_hint")) & ~contains("allowed_units", unit) & ~((unit == "oz") & contains("allowed_units", F.lit("lb"))) & unit.isNotNull(), F.lit(False)),
            "_has_package": full.rlike(stated),
            "_package_hit": (F.size(r("allowed_package_patterns")) == 0) | (F.size(pattern_hits(full, r("allowed_package_patterns"))) > 0),
            "_unmet": F.array_compact(F.concat(unmet, F.array(unconfirmed))),
            "_asks": (F.size(attributes) > 0) | (F.size(r("require_confirmation_keywords")) > 0),
            "_listed": listed(text),
            "_mixed": listed(full) & ((containers >= 2) | (ounces >= 2)),
            "_n_positive": F.size(keyword_hits(text, r("positive_keywords"))),
        }
    )
    is_ = F.col
    lacks = ~is_("_package_hit") & ~is_("_has_package")
    rows = rows.withColumn("_missing", F.when(lacks, F.array_union("_unmet", F.array(F.lit("package_size")))).otherwise(F.col("_unmet")))
    off_type = ~is_("_bad_type") & (F.size(r("allowed_types")) > 0) & (F.size(types) > 0) & ~is_("_good_type")
    outside = ~is_("_package_hit") & is_("_has_package")
    confirmed = is_("_asks") & (F.size("_missing") == 0) & ~is_("_mixed")
    level = F.coalesce(F.col("keyword_confidence"), F.lit("medium"))
    start = F.when(level == "high", START_CONFIDENCE["high"]).when(level == "low", START_CONFIDENCE["low"]).otherwise(START_CONFIDENCE["medium"])
    primary = F.get(types, 0)
    score = (
        start
        + F.when(F.size(r("positive_keywords")) == 0, 0.0).when(F.col("_n_positive") > 0, F.least(F.lit(0.1), F.col("_n_positive") * 0.03)).otherwise(-0.15)
        + F.when(primary == F.col("rules.canonical_intent"), 0.1).when(contains("allowed_types", primary), 0.05).otherwise(0.0)
        - F.when(is_("_listed"), 0.15).otherwise(0.0)
        - F.when(F.coalesce(F.col("priced"), F.lit(False)), 0.0).otherwise(0.3)
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) + F.when(confirmed, 0.15).otherwise(0.0)
    # Without rules there is nothing to doubt.
    rows = rows.withColumn("confidence", F.when(F.col("rules").isNull(), start).otherwise(F.round(F.least(F.lit(1.0), score), 4)))
    open_list = is_("_listed") & ~confirmed
    floor = F.coalesce(F.col("rules.min_confidence"), F.lit(MIN_CONFIDENCE))
    unsure = F.coalesce((F.col("keyword_confidence") == "medium") & (F.col("confidence") < F.round(floor + 0.1, 4)), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.size("_negatives") > 0, F.concat(F.lit("hard negative: "), F.array_join("_negatives", ", "))),
            F.when(is_("_bad_type"), "disallowed product type"),
            F.when(off_type, "product type not allowed"),
            F.when(is_("_bad_unit"), "unit not allowed"),
            F.when(outside, "package not allowed"),
            F.when(lacks, "no package signal"),
            F.when(F.size("_missing") > 0, F.concat(F.lit("missing: "), F.array_join("_missing", ", "))),
            F.when(is_("_mixed"), "conflicting packages"),
            F.when(open_list, "variant list"),
            F.when(unsure, "medium confidence"),
        )
    )
    rejected = (F.size("_negatives") > 0) | is_("_bad_type") | off_type | is_("_bad_unit") | outside
    review = (F.col("confidence") < floor) | (F.size("_missing") > 0) | is_("_mixed") | open_list | unsure
    decision = F.when(F.col("rules").isNull(), "accepted").when(rejected, "rejected").when(review, "manual_review").otherwise("accepted")
    of_missing = F.element_at(F.create_map(*[F.lit(x) for kv in MISSING_CODES.items() for x in kv]), F.get("_missing", 0))
    code = (
        F.when(F.col("rules").isNull() | ~(rejected | review), F.lit(None).cast("string"))
        .when(rejected, "explicit_attribute_conflict")
        .when((F.size("_missing") > 1) | (F.size("_missing") == 0) & is_("_mixed"), "ambiguous_product_variant")
        .otherwise(F.coalesce(of_missing, F.lit("insufficient_information")))
    )
    done = rows.withColumns({"reasons": F.when(F.col("rules").isNull(), F.array().cast("array<string>")).otherwise(reasons), "base_decision": decision, "reason_code": code, "exempt": F.col("rules").isNull()})
    return done.drop(*[c for c in done.columns if c in ("_text", "_full", "_types", "_unit", "_negatives", "_bad_type", "_good_type", "_bad_unit", "_has_package", "_package_hit", "_unmet", "_missing", "_asks", "_listed", "_mixed", "_n_positive")])


def accept_over_time(candidates: DataFrame, keys: list[str], atl_confidence: float = 0.85, large_change_pct: float = 40.0) -> DataFrame:
    """Per series and week the first candidate that the gate accepts, given the weeks accepted before.

    candidates: keys, week, candidate_rank, advertised_price, unit_price, confidence, base_decision. The state is the low
    and the last week's unit price of accepted weeks; the advertised price is held against it. A fold over each series'
    sorted weeks, since a week's verdict depends on the weeks before. Only candidates that the gate accepts reach the fold,
    of the sure ones the first of each week, of the others the first of each price with their number. Every week of the input appears, with a null unit_price where nothing was
    accepted.
    """
    confidence = F.col("confidence").cast("double")
    confidence = F.when(F.col("exempt"), 1.0).otherwise(confidence) if "exempt" in candidates.columns else confidence
    one = F.struct("candidate_rank", "advertised_price", "unit_price", confidence.alias("confidence"), "base_decision")
    accepted = F.col("base_decision") == "accepted"
    sure_ = accepted & (confidence >= atl_confidence)
    unsure = F.coalesce(accepted & ~sure_, F.lit(False))
    # Unsure candidates of one advertised price share their fate: the first of them and their count are enough.
    prices = candidates.groupBy(*keys, "week", F.when(unsure, F.col("advertised_price")).alias("_price")).agg(
        F.min(F.when(unsure, one)).alias("_unsure"), F.count_if(unsure).alias("_n"), F.min(F.when(sure_, one)).alias("_sure")
    )
    counted = lambda c, n: F.when(c.isNotNull(), F.struct(c["candidate_rank"].alias("candidate_rank"), c["advertised_price"].alias("advertised_price"), c["unit_price"].alias("unit_price"), c["confidence"].alias("confidence"), c["base_decision"].alias("base_decision"), n.alias("n")))
    weeks = prices.groupBy(*keys, "week").agg(
        F.sort_array(F.concat(F.collect_list(counted(F.col("_unsure"), F.col("_n"))), F.array_compact(F.array(counted(F.min("_sure"), F.lit(1).cast("long")))))).alias("ranked")
    )
    ordered = weeks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("week", "ranked"))).alias("weeks"))
    start = F.expr("named_struct('low', CAST(NULL AS DOUBLE), 'prior', CAST(NULL AS DOUBLE), 'out', CAST(array() AS ARRAY<STRUCT<week: DATE, rank: INT, unit_price: DOUBLE, n_held: INT>>))")

    def step(state: Column, week: Column) -> Column:
        def passes(c: Column) -> Column:
            sure = c["confidence"] >= atl_confidence
            new_low = F.coalesce(c["advertised_price"] < state["low"], F.lit(False))
            jump = F.coalesce((state["prior"] > 0) & (F.abs(c["advertised_price"] - state["prior"]) / state["prior"] * 100 >= large_change_pct), F.lit(False))
            return (c["base_decision"] == "accepted") & (sure | ~(new_low | jump))

        good = F.filter(week["ranked"], passes)
        price = F.get(F.transform(good, lambda c: c["unit_price"]), 0)
        entry = F.struct(
            week["week"].alias("week"), F.get(F.transform(good, lambda c: c["candidate_rank"]), 0).cast("int").alias("rank"), price.cast("double").alias("unit_price"),
            F.aggregate(F.filter(week["ranked"], lambda c: ~passes(c)), F.lit(0).cast("long"), lambda n, c: n + c["n"]).cast("int").alias("n_held"),
        )
        return F.struct(F.least(state["low"], price.cast("double")).alias("low"), price.cast("double").alias("prior"), F.concat(state["out"], F.array(entry)).alias("out"))

    folded = ordered.select(*keys, F.explode(F.aggregate("weeks", start, step)["out"]).alias("w"))
    return folded.select(*keys, "w.week", F.col("w.rank").alias("accepted_rank"), "w.unit_price", "w.n_held")


def match_audit(decisions: DataFrame, week: str = "week") -> DataFrame:
    """Per week: counts by decision, the families updated, the new lows and the blocked points."""
    is_ = lambda d: F.col("decision") == d
    return decisions.groupBy(week).agg(
        F.sum(is_("accepted").cast("int")).alias("n_accepted"),
        F.sum(is_("manual_review").cast("int")).alias("n_review"),
        F.sum(is_("rejected").cast("int")).alias("n_rejected"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_("accepted"), F.col("family")))), ",").alias("updated_families"),
        F.sum((is_("accepted") & F.coalesce(F.col("unit_price") < F.col("low_before"), F.lit(False))).cast("int")).alias("new_lows"),
        F.sum((~is_("accepted") & F.col("unit_price").isNotNull()).cast("int")).alias("blocked_points"),
    )


def missed_deals(hits: DataFrame, priced: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with pattern hits and a printed price but no priced entry: what the hits say and how bad it is."""
    found = hits.where("price IS NOT NULL").join(priced.select(*keys), keys, "left_anti").groupBy(*keys).agg(
        F.min("price").alias("candidate_price"),
        F.bool_or(F.col("origin") == "raw").alias("in_raw_cards"),
        F.bool_or(F.col("origin") == "split").alias("in_split_items"),
        F.bool_and("is_multi").alias("all_multi"),
        F.min_by("text", F.struct("price", "text")).alias("example_text"),
        F.array_join(F.sort_array(F.collect_set("disposition")), ",").alias("dispositions"),
    )
    severity = F.when(F.col("in_split_items") & ~F.col("all_multi"), "high").when(F.col("in_raw_cards") & ~F.col("all_multi"), "medium").otherwise("low")
    return found.withColumn("severity", severity)
