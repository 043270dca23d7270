"""Queries that resolve shopper queries to families. The catalog is derived from the parts (a family for each brand, name and
type, the type giving its package), the log from the users' turns, which name a part in one of seven ways."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from priceloom.operators import matching, quality, querylog
from priceloom.operators import resolution as ops
from priceloom.queries.base import query, table
from priceloom.queries.querylog import _LOG, _PARSED
from priceloom.sources import files

#: Package words and id ends by type.
FORMS = {"STANDARD": ("", ""), "MEDIUM": ("regular", "_regular"), "LARGE": ("family size", "_family_size"), "ECONOMY": ("party size", "_party_size"), "PROMO": ("tub", "_tub"), "SMALL": ("cups", "_cups")}
GENERIC = (*ops.GENERIC_WORDS, "are")
CATEGORIES = {"ring": "rings", "bolt": "bolts", "gear": "gears", "widget": "widgets"}
LIVE = ("rings", "bolts")

_WORDS = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{w}'" for t, (w, _) in FORMS.items()) + " END"
_END = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{e}'" for t, (_, e) in FORMS.items()) + " END"
_FAMILY = f"lower(replace(p_brand, '#', '')) || '_' || replace(p_name, ' ', '_') || {_END}"
_LINE = "CASE p_type WHEN 'SMALL' THEN 'mini ' || p_name WHEN 'PROMO' THEN p_name || ' deluxe' END"
_APART = "CASE WHEN p_name LIKE 'red %' AND p_type = 'STANDARD' THEN 'old ' || split_part(p_name, ' ', 2) END"
_BRAND = "replace(p_brand, '#', ' ')"
_NUMBER = "replace(p_brand, 'Brand#', 'b')"


def catalog(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type").distinct()
    return parts.select(
        F.expr(_FAMILY).alias("family"),
        F.expr(f"trim({_BRAND} || ' ' || p_name || ' ' || {_WORDS})").alias("name"),
        F.expr(_BRAND).alias("brand"),
        F.expr(_WORDS).alias("form"),
        F.expr(f"array_compact(array(lower({_BRAND}) || ' ' || p_name, {_LINE}))").alias("include"),
        F.expr(f"array(trim({_NUMBER} || ' ' || p_name || ' ' || {_WORDS}), trim(p_name || ' ' || {_WORDS}))").alias("aliases"),
        F.expr(f"array_compact(array({_APART}))").alias("excludes"),
    )


_CATALOG = f""", catalog AS MATERIALIZED (SELECT DISTINCT {_FAMILY} AS family, trim({_BRAND} || ' ' || p_name || ' ' || {_WORDS}, ' ') AS name, {_BRAND} AS brand, p_type, p_name, {_WORDS} AS form, {_LINE} AS line, {_APART} AS apart,
  trim({_NUMBER} || ' ' || p_name || ' ' || {_WORDS}, ' ') AS alias1, trim(p_name || ' ' || {_WORDS}, ' ') AS alias2 FROM part)"""

_PHRASE = f"""CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'Vons ' || {_BRAND} || ' ' || p_name || ' ' || {_WORDS} || ' are $2.49 ' || said WHEN 1 THEN 'Vons ' || {_BRAND} || ' ' || p_name || ' are $2.49 ' || said
  WHEN 2 THEN {_BRAND} || ' chips are $2.49' WHEN 3 THEN {_NUMBER} || ' ' || p_name || ' are $3.49 or $2.99 ' || said WHEN 4 THEN p_name || ' ' || {_WORDS} || ' at Safeway $5 ' || said
  WHEN 5 THEN said ELSE 'Safeway ' || {_BRAND} || ' ' || p_name || ' mini deluxe, 2 per household' END"""


def log(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("said", F.coalesce("text", F.lit("")))
    named = turns.withColumn("p_partkey", (F.col("conv_id") * 31 + F.col("turn") * 7) % parts.count()).join(parts, "p_partkey")
    return named.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.expr(_PHRASE).alias("raw_query"))


_TURNS = f"""WITH log AS (SELECT conv_id * 100 + turn AS query_id, {_PHRASE} AS raw_query FROM (SELECT *, coalesce(text, '') AS said FROM conversations WHERE role = 'user') c
  JOIN part ON p_partkey = (conv_id * 31 + turn * 7) % (SELECT count(*) FROM part))"""


def parsed(rows):
    return querylog.parse_queries(querylog.normalize_queries(rows), ["vons", "safeway"])


def decisions(queries, families):
    """The families whose brand and name are in the text, by the gate's word: other packages' words reject, and the two
    largest packages must be named."""
    found = matching.match_phrases(queries, families.withColumn("include", F.slice("include", 1, 1)).withColumn("exclude", F.array().cast("array<string>")), "query_id", "product_text")
    forms = [w for w, _ in FORMS.values() if w]
    others = F.filter(F.array(*[F.lit(w) for w in forms]), lambda w: w != F.col("form"))
    asks = F.when(F.col("form").isin("family size", "party size"), F.array(F.struct(F.lit("package_size").alias("name"), F.array("form").alias("any_of"), F.array().cast("array<string>").alias("any_of_patterns"))))
    rules = F.struct(*[(others if n == "negative_keywords" else asks if n == "required_attributes" else F.lit(None)).cast(t).alias(n) for n, t in (f.split(":", 1) for f in _fields(matching.RULES))])
    rows = found.join(queries.select("query_id", F.col("product_text").alias("text"), F.col("price").isNotNull().alias("priced")), "query_id").join(families.select("family", "form"), "family")
    gated = matching.eligibility(
        rows.withColumns({"rules": rules, "package_text": F.lit(None).cast("string"), "types": F.array().cast("array<string>"), "unit_hint": F.lit(None).cast("string"), "keyword_confidence": F.lit("high")})
    )
    return gated.select("query_id", "family", F.col("base_decision").alias("decision"))


def _fields(struct: str) -> list[str]:
    """The outer fields of a struct type's text."""
    out, depth, start, body = [], 0, 0, struct[len("struct<") : -1]
    for i, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def profiles(spark, families):
    siblings = files.stored(ops.package_siblings(families, lambda df: files.stored(df, "siblings")), "families")
    return siblings, files.stored(ops.package_profiles(families, siblings, GENERIC), "package-profiles")


def resolved(spark, sf_dir, rows):
    """The log with its parse, its resolution and the next action; what is small and used often is written once."""
    families = files.stored(catalog(spark, sf_dir), "catalog")
    queries = files.stored(parsed(rows), "parsed")
    named = families.select(F.posexplode("aliases").alias("k", "alias"), "family").select("alias", "family", (F.col("k") == 0).alias("is_primary"), F.lit(False).alias("is_generic"))
    hits = querylog.alias_hits(queries, named, "query_id", "product_text")
    _, packages = profiles(spark, families)
    return ops.next_action(ops.resolve(queries, decisions(queries, families), hits, packages, generic=GENERIC))


_GAP = rf"\s+(?:(?:{'|'.join(matching.QUALIFIERS)})\s+){{0,3}}"
_EDGE = r"(^|[^0-9A-Za-z_]){}($|[^0-9A-Za-z_])"
_HAS = lambda w, t: f"regexp_matches({t}, '{_EDGE.format(w)}')"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(replace(replace(lower({c}), '’', chr(39)), '‘', chr(39)), '[®™©!.,]', '', 'g'), '[-\\s]+', ' ', 'g'), ' ')"
_MARKS = lambda t: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN '{n}' END" for n, p in ops.MARKERS) + "], lambda x: x IS NOT NULL)"
_SIGN = "CASE p_type WHEN 'MEDIUM' THEN ['regular'] WHEN 'LARGE' THEN ['family_size'] WHEN 'ECONOMY' THEN ['party_size'] WHEN 'PROMO' THEN ['tub'] WHEN 'SMALL' THEN ['cup'] ELSE CAST([] AS VARCHAR[]) END"

#: From the catalog: its components (a brand's parts of one name, and red ones that are kept apart from old ones).
_SIBLINGS = (
    _CATALOG
    + """, stems AS (SELECT family, brand, p_name, CASE WHEN EXISTS (SELECT 1 FROM catalog r WHERE r.brand = c.brand AND r.apart IS NOT NULL AND (contains(c.p_name, r.apart) OR r.p_name = c.p_name)
    AND EXISTS (SELECT 1 FROM catalog o WHERE o.brand = r.brand AND contains(o.p_name, r.apart))) THEN 'old and red ' || split_part(p_name, ' ', 2) ELSE p_name END AS stem FROM catalog c
), siblings AS (SELECT family, min(family) OVER (PARTITION BY brand, stem) AS component, count(*) OVER (PARTITION BY brand, stem) AS n_siblings FROM stems
), packages AS MATERIALIZED (SELECT c.*, s.component, s.n_siblings, """
    + _SIGN
    + f""" AS markers, list_filter([CASE WHEN count(*) OVER (PARTITION BY s.component, c.p_name) = 1 THEN lower(c.brand) || ' ' || c.p_name END, line], lambda x: x IS NOT NULL) AS lines, {_NORM("c.brand")} AS brand_name, list_distinct(list_filter([{_NORM("name")}, lower(c.brand) || ' ' || p_name, line, alias1, alias2], lambda x: x IS NOT NULL)) AS names FROM catalog c JOIN siblings s ON c.family = s.family)"""
)

#: From parsed: pattern hits and the gate, alias hits, bare brands, then the fusion and the package gate.
_FUSED = (
    _SIBLINGS
    + rf""", texts AS MATERIALIZED (SELECT query_id, product_text, lower(product_text) AS t, {_NORM("product_text")} AS norm, price IS NOT NULL AS priced,
    regexp_matches(lower(product_text), '(^|[^\p{{L}}\p{{N}}_])or($|[^\p{{L}}\p{{N}}_])') OR len(string_split(lower(product_text), ',')) > 2 AS listed, {_MARKS("lower(product_text)")} AS marks FROM parsed
), near_hits AS MATERIALIZED (SELECT q.*, c.family, c.form, c.p_type, lower(c.brand) || ' ' || c.p_name AS phrase FROM texts q JOIN catalog c ON contains(t, ' ' || split_part(p_name, ' ', 1) || ' ') AND contains(t, ' ' || split_part(c.brand, ' ', 2) || ' ')
), hits AS MATERIALIZED (SELECT * FROM near_hits WHERE regexp_matches(t, replace(phrase, ' ', '{_GAP}'))
), gate AS (SELECT query_id, family, CASE WHEN """
    + " OR ".join(f"form <> '{w}' AND {_HAS(w, 't')}" for w, _ in FORMS.values() if w)
    + rf""" THEN 'rejected'
    WHEN asks AND NOT named OR listed AND ({_HAS("cans?", "t")}::INT + {_HAS("bottles?", "t")}::INT + {_HAS("cups?", "t")}::INT + {_HAS("tub", "t")}::INT >= 2) OR NOT (asks AND named) AND (listed OR NOT priced) OR asks AND named AND listed AND NOT priced THEN 'manual_review'
    ELSE 'accepted' END AS decision
  FROM (SELECT *, p_type IN ('LARGE', 'ECONOMY') AS asks, CASE p_type WHEN 'LARGE' THEN {_HAS("family size", "t")} WHEN 'ECONOMY' THEN {_HAS("party size", "t")} ELSE FALSE END AS named FROM hits)
), by_gate AS (SELECT query_id, coalesce(list_sort(list(DISTINCT family) FILTER (WHERE decision = 'accepted')), []) AS accepted, coalesce(list_sort(list(DISTINCT family) FILTER (WHERE decision = 'manual_review')), []) AS review FROM gate GROUP BY query_id
), named AS (SELECT family, alias1 AS alias, 0.95 AS base FROM catalog UNION ALL SELECT family, alias2, 0.85 FROM catalog
), scored AS (SELECT query_id, family, max(base + length(alias) / 1000) AS score FROM (SELECT query_id, ' ' || trim(regexp_replace(lower(product_text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') || ' ' AS run FROM parsed) q
    JOIN named ON contains(run, ' ' || alias || ' ') GROUP BY ALL
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, family) AS k, max(score) OVER (PARTITION BY query_id) AS top FROM scored
), by_alias AS (SELECT query_id, arg_min(family, k) AS alias_family, coalesce(max(score) - max(score) FILTER (WHERE k = 2) >= 0.05, TRUE) AS is_unique, list(family ORDER BY family) FILTER (WHERE top - score <= 0.02 AND k <= 5) AS near FROM placed GROUP BY query_id
), groups AS (SELECT brand_name, component, list_sort(list(family)) AS families FROM packages WHERE n_siblings > 1 GROUP BY ALL
), brands AS (SELECT brand_name, arg_min(families, component) AS families FROM groups GROUP BY brand_name
), kinds AS (SELECT query_id, norm, array_to_string(list_filter(string_split(norm, ' '), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in GENERIC)}], w)), ' ') AS kind FROM texts
), by_brand AS (SELECT query_id, min(families) AS brand_families FROM kinds JOIN brands ON brand_name IN (norm, kind) WHERE kind <> '' GROUP BY query_id
), started AS MATERIALIZED (SELECT q.*, coalesce(accepted, []) AS a, coalesce(review, []) AS r, alias_family, is_unique, near, brand_families FROM texts q LEFT JOIN by_gate USING (query_id) LEFT JOIN by_alias USING (query_id) LEFT JOIN by_brand USING (query_id)
), first AS (SELECT *, CASE WHEN trim(product_text, ' ') = '' THEN {{'status': 'error', 'family': NULL::VARCHAR, 'candidates': []::VARCHAR[], 'reason': 'empty_product_text'}}
    WHEN len(a) = 1 AND len(r) = 0 THEN {{'status': 'matched', 'family': a[1], 'candidates': a, 'reason': NULL::VARCHAR}}
    WHEN len(a) > 0 THEN {{'status': 'ambiguous', 'family': NULL::VARCHAR, 'candidates': a, 'reason': 'multiple_plausible_trackers'}}
    WHEN len(r) > 1 THEN {{'status': 'ambiguous', 'family': NULL::VARCHAR, 'candidates': r, 'reason': 'multiple_manual_review_candidates'}}
    WHEN len(r) = 1 THEN {{'status': 'matched', 'family': r[1], 'candidates': r, 'reason': 'single_manual_review_elevated'}}
    WHEN len(brand_families) > 1 THEN {{'status': 'ambiguous', 'family': NULL::VARCHAR, 'candidates': brand_families, 'reason': 'brand_only_package_ambiguous'}}
    WHEN is_unique THEN {{'status': 'matched', 'family': alias_family, 'candidates': [alias_family], 'reason': 'shopper_alias_unique'}}
    WHEN len(near) > 1 THEN {{'status': 'ambiguous', 'family': NULL::VARCHAR, 'candidates': near, 'reason': 'shopper_alias_ambiguous'}}
    ELSE {{'status': 'no_match', 'family': NULL::VARCHAR, 'candidates': []::VARCHAR[], 'reason': 'no_accepted_tracker'}} END AS o FROM started
), members AS (SELECT component, list_sort(list(family)) AS siblings FROM packages GROUP BY component
), second AS MATERIALIZED (SELECT f.query_id, f.o, coalesce(p.n_siblings, 1) AS n, m.siblings, f.norm, f.marks, f.o.status = 'ambiguous' AND len(f.o.candidates) > 1 AND f.o.reason <> 'brand_only_package_ambiguous' AS is_open
    FROM first f LEFT JOIN packages p ON p.family = f.o.family LEFT JOIN members m ON m.component = p.component
), pairs AS (SELECT query_id, norm, marks, unnest(CASE WHEN o.status = 'matched' AND n > 1 THEN siblings WHEN is_open THEN o.candidates END) AS family FROM second
), fits AS MATERIALIZED (SELECT query_id, p.family, CASE WHEN n_siblings > 1 THEN 5 * len(list_intersect(marks, markers)) - 3 * len(list_filter(marks, lambda x: NOT list_contains(markers, x)))
      + CASE WHEN len(list_filter(lines, lambda p: contains(norm, p) OR len(list_filter(string_split(p, ' '), lambda w: length(w) > 2 AND NOT list_contains(string_split(norm, ' '), w))) = 0)) > 0 THEN 4 ELSE 0 END
    ELSE 3 * len(list_filter(names, lambda x: length(x) >= 3 AND (x = norm OR length(x) >= 6 AND contains(norm, x)))) END AS score FROM pairs p JOIN packages c ON p.family = c.family
), tops AS (SELECT query_id, max(score) AS best FROM fits GROUP BY query_id
), won AS (SELECT query_id, list_sort(list(family)) AS winners FROM fits JOIN tops USING (query_id) WHERE score = best AND score > 0 GROUP BY query_id
), done AS MATERIALIZED (SELECT s.query_id, CASE
    WHEN o.status = 'matched' AND n > 1 AND len(winners) = 1 AND winners[1] <> o.family THEN {{'status': 'matched', 'family': winners[1], 'candidates': winners, 'reason': 'package_form_rematch'}}
    WHEN o.status = 'matched' AND n > 1 AND coalesce(len(winners), 0) <> 1 THEN {{'status': 'ambiguous', 'family': NULL::VARCHAR, 'candidates': siblings, 'reason': 'package_form_ambiguous'}}
    WHEN is_open AND len(winners) = 1 THEN {{'status': 'matched', 'family': winners[1], 'candidates': winners, 'reason': 'package_form_disambiguated'}} ELSE o END AS o FROM second s LEFT JOIN won w USING (query_id)
), answered AS (SELECT p.*, o.status, o.family, o.candidates, o.reason, CASE WHEN is_conflict THEN 'invalid' WHEN o.status = 'ambiguous' THEN 'clarify' WHEN o.status IN ('no_match', 'error') AND trim(product_text, ' ') = '' THEN 'clarify'
    WHEN o.status IN ('no_match', 'error') THEN 'unsupported' WHEN price IS NULL OR promotion IN ('multi_buy', 'bogo') AND quantity IS NULL THEN 'clarify' ELSE 'continue' END AS behavior FROM parsed p JOIN done USING (query_id)
), acted AS (SELECT *, CASE WHEN behavior = 'continue' AND quantity IS NOT NULL AND coalesce(basis, 'each') = 'each' AND promotion IS NULL THEN 'clarify' ELSE behavior END AS action,
    CASE WHEN behavior = 'clarify' AND status = 'ambiguous' THEN 'ambiguous_product' WHEN behavior = 'clarify' OR behavior = 'continue' AND quantity IS NOT NULL AND coalesce(basis, 'each') = 'each' AND promotion IS NULL THEN 'missing_field' END AS ask FROM answered)"""
)
#: Each rewriting step once, and not once for every step behind it.
_PARSED_ONCE = re.sub(r"\b(q\d+|normal|parsed) AS \(", r"\1 AS MATERIALIZED (", _PARSED)
_CHAIN = _PARSED_ONCE.replace(_LOG, _TURNS, 1) + _FUSED


@query(_CHAIN + " SELECT query_id, status, family, array_to_string(candidates, ',') AS candidates, reason FROM acted")
def resolve_products(spark, sf_dir):
    rows = resolved(spark, sf_dir, log(spark, sf_dir))
    return rows.select("query_id", "status", "family", F.array_join("candidates", ",").alias("candidates"), "reason")


@query(_CHAIN + " SELECT query_id, behavior, action, ask, array_to_string(candidates[1:3], ',') AS options FROM acted")
def next_actions(spark, sf_dir):
    rows = resolved(spark, sf_dir, log(spark, sf_dir))
    return rows.select("query_id", "behavior", "action", "ask", F.array_join("options", ",").alias("options"))


@query(
    _CHAIN.replace("pairs AS (SELECT query_id, norm, marks, unnest(CASE WHEN o.status = 'matched' AND n > 1 THEN siblings WHEN is_open THEN o.candidates END) AS family FROM second", "pairs AS (SELECT query_id, norm, marks, family FROM hits")
    + " SELECT query_id, family, score, score = best AND score > 0 AS is_best FROM fits JOIN tops USING (query_id)"
)
def package_fit(spark, sf_dir):
    """Every query with every family that its brand and name hit."""
    families = files.stored(catalog(spark, sf_dir), "catalog")
    queries = files.stored(parsed(log(spark, sf_dir)), "parsed")
    hits = decisions(queries, families).select("query_id", "family").join(queries.select("query_id", "product_text"), "query_id")
    scores = files.stored(ops.package_fit(hits, profiles(spark, families)[1], "query_id"), "fit")
    best = ops.best_fit(scores, "query_id")
    return scores.join(best, "query_id").select("query_id", "family", "score", F.array_contains("winners", F.col("family")).alias("is_best"))


_CATEGORY = "CASE split_part(p_name, ' ', 2) " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in CATEGORIES.items()) + " END"
_LANGUAGE = (
    "WITH none AS (SELECT 1)"
    + _SIBLINGS
    + rf""", name_words AS (SELECT family, p_name, regexp_extract_all({_NORM("name")}, '[a-z0-9'']+') AS w FROM catalog
), runs AS (SELECT family, unnest(list_distinct(flatten(list_transform(range(1, least(len(w), 6) + 1), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' ')))))) AS run FROM name_words
), own AS (SELECT run, min(family) AS family FROM runs GROUP BY run HAVING count(*) = 1
), short AS (SELECT family, arg_min(run, (len(string_split(run, ' ')), length(run), run)) AS short_name FROM own GROUP BY family
), listed AS (SELECT p.family, p.n_siblings, p.brand, {_CATEGORY} AS category, list_sort(list_distinct(list_transform(list_filter([name, lower(brand) || ' ' || p_name, line, alias1, alias2], lambda x: x IS NOT NULL AND {_CATEGORY} IN ('rings', 'bolts')), lambda x: {_NORM("x")}))) AS protected FROM packages p
), profiled AS MATERIALIZED (SELECT l.*, short_name, n_siblings = 1 AS brand_only_safe, CASE WHEN n_siblings = 1 THEN brand ELSE (SELECT arg_min(x, (length(x), x)) FROM (SELECT unnest(protected) AS x)) END AS safe_name,
    CASE WHEN n_siblings > 1 THEN 'package_clarification_required' WHEN len(protected) > 0 THEN 'protected_phrase_required' ELSE 'exact_alias_safe' END AS resolution_class FROM listed l LEFT JOIN short s ON l.family = s.family)"""
)


@query(
    _LANGUAGE
    + """ SELECT family, CAST(n_siblings - 1 AS INTEGER) AS n_ambiguous, short_name, brand_only_safe, safe_name, category AS category_words, array_to_string(protected, ',') AS protected, resolution_class, resolution_class = 'package_clarification_required' AS needs_question FROM profiled"""
)
def language_profiles(spark, sf_dir):
    families = files.stored(catalog(spark, sf_dir), "catalog")
    rows = ops.language_profiles(families, profiles(spark, families)[0], CATEGORIES, LIVE)
    words = F.nullif(F.array_join("category_words", ","), F.lit(""))
    return rows.select("family", F.size("ambiguous_with").alias("n_ambiguous"), "short_name", "brand_only_safe", "safe_name", words.alias("category_words"), F.array_join(F.sort_array("protected"), ",").alias("protected"), "resolution_class", "needs_question")


_PROBES = (
    _LANGUAGE
    + f""", listing AS (SELECT c.family, unnest([(0, 'safe_short', coalesce(safe_name, short_name)), (1, 'brand', c.brand), (2, 'display', name), (3, 'protected', CASE WHEN len(protected) > 0 THEN {_NORM('name')} END), (4, 'include', lower(c.brand) || ' ' || p_name), (5, 'include', line),
    (CASE WHEN line IS NULL THEN 5 ELSE 6 END, 'alias', alias1), (CASE WHEN line IS NULL THEN 6 ELSE 7 END, 'alias', alias2)]) AS x FROM catalog c JOIN profiled p ON c.family = p.family
), worded AS (SELECT family, x[1] AS ord, x[2] AS kind, x[3] AS wording, row_number() OVER (PARTITION BY family, {_NORM("x[3]")} ORDER BY x[1]) AS n FROM listing WHERE x[3] IS NOT NULL
), asked AS MATERIALIZED (SELECT family, ord, kind, row_number() OVER (ORDER BY family, ord) AS query_id, 'safeway ' || trim(wording, ' ') || ' are $2.49' AS raw_query FROM worded WHERE n = 1)"""
)


def probe_log(spark, sf_dir):
    families = files.stored(catalog(spark, sf_dir), "catalog")
    siblings, _ = profiles(spark, families)
    return ops.probes(families, ops.language_profiles(families, siblings, CATEGORIES, LIVE))


@query(
    _PROBES
    + _PARSED_ONCE.replace(_LOG, ", log AS (SELECT query_id, raw_query FROM asked)", 1)
    + _FUSED.replace(_SIBLINGS, "", 1)
    + """, reached AS (SELECT k.family, k.ord, k.kind, coalesce(a.family = k.family AND action IN ('continue', 'clarify'), FALSE) OR action = 'clarify' AND ask = 'ambiguous_product' AND list_contains(candidates, k.family) AS ok FROM asked k LEFT JOIN acted a USING (query_id))
SELECT family, count(*) AS n_probes, count(*) FILTER (WHERE ok) AS n_reached, arg_min(kind, ord) FILTER (WHERE ok) AS via, bool_or(ok) AS reachable FROM reached GROUP BY family"""
)
def reachability(spark, sf_dir):
    asked = files.stored(probe_log(spark, sf_dir), "probes")
    answers = resolved(spark, sf_dir, asked.select(F.concat_ws("#", "family", "ord").alias("query_id"), "raw_query"))
    found = answers.select("query_id", F.col("family").alias("selected"), "action", "ask", "candidates")
    named = asked.withColumn("query_id", F.concat_ws("#", "family", "ord"))
    return ops.reachability(named, found, ["query_id"])


#: What the log's turns should give, by the way in which they name their part.
_KIND = "query_id // 100 * 3 + query_id % 100"
_WANT_PRICE = "CASE kind WHEN 4 THEN 5.0 WHEN 3 THEN 3.49 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 2.49 END"
_WANT_BEHAVIOR = "CASE kind WHEN 0 THEN 'continue' WHEN 3 THEN 'invalid' WHEN 5 THEN 'unsupported' ELSE 'clarify' END"


@query(
    _CHAIN
    + rf""", cases AS (SELECT a.*, ({_KIND}) % 7 AS kind, a.candidates AS c, {_FAMILY} AS own, lower({_BRAND} || ' ' || p_name) AS spoken FROM acted a JOIN part ON p_partkey = (query_id // 100 * 31 + query_id % 100 * 7) % (SELECT count(*) FROM part)
), wanted AS (SELECT *, {_WANT_PRICE} AS want_price, {_WANT_BEHAVIOR} AS want_behavior, CASE WHEN kind IN (0, 6) THEN own END AS want_tracker, kind IN (0, 1, 6) AS has_text FROM cases
), words AS (SELECT *, list_filter(string_split(spoken, ' '), lambda w: length(w) >= 3) AS w FROM wanted
), flags AS (SELECT *, NOT has_text OR len(list_filter(w, lambda x: contains(trim(regexp_replace(lower(product_text), '\s+', ' ', 'g'), ' '), x))) >= greatest(1, (len(w) + 1) // 2) AS product_ok,
    want_price IS NULL AND price IS NULL OR coalesce(abs(want_price - price) < 0.011, FALSE) AS price_ok, promotion IS NULL AS promotion_ok, quantity IS NULL AS quantity_ok,
    CASE WHEN want_tracker IS NULL THEN NOT (action = 'continue' AND family IS NOT NULL) ELSE coalesce(family = want_tracker, FALSE) OR family IS NULL AND want_behavior IN ('clarify', 'invalid') AND len(c) = 1 AND coalesce(c[1] = want_tracker, FALSE) END AS tracker_ok,
    action = want_behavior AS behavior_ok, (action = 'continue') = (want_behavior = 'continue') AS safe_ok FROM words
), judged AS (SELECT *, action = 'continue' AND (want_tracker IS NOT NULL AND family IS DISTINCT FROM want_tracker OR want_behavior <> 'continue' OR NOT price_ok AND want_price IS NOT NULL) AS wrong FROM flags
), long AS (SELECT unnest([('accuracy', 'product_text', product_ok), ('accuracy', 'price', price_ok), ('accuracy', 'promotion_type', promotion_ok), ('accuracy', 'required_quantity', quantity_ok), ('accuracy', 'package_size', TRUE), ('accuracy', 'tracker', tracker_ok),
    ('accuracy', 'behavior', behavior_ok), ('accuracy', 'safe', safe_ok), ('passed', 'all', product_ok AND price_ok AND promotion_ok AND quantity_ok AND tracker_ok AND behavior_ok AND safe_ok AND NOT wrong),
    ('failure', CASE WHEN NOT product_ok THEN 'product_text' END, TRUE), ('failure', CASE WHEN NOT price_ok THEN 'price' END, TRUE), ('failure', CASE WHEN NOT promotion_ok THEN 'promotion_type' END, TRUE), ('failure', CASE WHEN NOT quantity_ok THEN 'required_quantity' END, TRUE),
    ('failure', CASE WHEN NOT tracker_ok THEN 'tracker' END, TRUE), ('failure', CASE WHEN NOT behavior_ok THEN 'behavior' END, TRUE), ('failure', CASE WHEN NOT safe_ok THEN 'safe_resolution' END, TRUE), ('failure', CASE WHEN wrong THEN 'confident_wrong' END, TRUE)]) AS m FROM judged)
SELECT measure, name, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, CASE WHEN measure <> 'failure' THEN count(*) FILTER (WHERE hit) / count(*) END AS share
FROM (SELECT m[1] AS measure, m[2] AS name, m[3] AS hit FROM long) WHERE name IS NOT NULL GROUP BY measure, name"""
)
def query_eval_metrics(spark, sf_dir):
    """The log's answers against what its turns should give."""
    rows = resolved(spark, sf_dir, log(spark, sf_dir)).withColumn("kind", F.expr(f"({_KIND.replace('//', 'DIV')}) % 7"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    rows = rows.withColumn("p_partkey", F.expr(f"(query_id DIV 100 * 31 + query_id % 100 * 7) % {parts.count()}")).join(parts, "p_partkey")
    none = F.lit(None)
    expected = F.struct(F.expr(f"lower({_BRAND} || ' ' || p_name)").alias("product_text"), F.expr(f"CAST({_WANT_PRICE} AS DOUBLE)").alias("price"), none.cast("string").alias("promotion_type"), none.cast("int").alias("required_quantity"), none.cast("string").alias("package_size"))
    actual = F.struct("product_text", "price", F.col("promotion").alias("promotion_type"), F.col("quantity").alias("required_quantity"), none.cast("string").alias("package_size"))
    labels = F.when(F.col("kind").isin(0, 1, 6), F.lit("product_text"))
    cases = rows.select(
        F.array_compact(F.array(labels, *map(F.lit, ("price", "promotion_type", "required_quantity", "package_size")))).alias("labels"), expected.alias("expected"), actual.alias("actual"), F.col("family").alias("tracker"), "candidates",
        F.expr(f"CASE WHEN kind IN (0, 6) THEN {_FAMILY} END").alias("expected_tracker"), F.expr(_WANT_BEHAVIOR).alias("expected_behavior"), F.col("action").alias("behavior"),
        (F.expr(_WANT_BEHAVIOR) == "continue").alias("expected_safe"), (F.col("action") == "continue").alias("is_safe"),
    )
    return quality.query_eval_metrics(quality.score_queries(cases))
