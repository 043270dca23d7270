"""Checks of price series and evaluations of labelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions.dims import DIMENSION_ROWS
from priceloom.operators.series import KEYS, prior_week_price


def validate_prices(spine: DataFrame, keys: Sequence[str] = KEYS, per_lb: Column | None = None, friday: Column | None = None, keyword: Column | None = None) -> DataFrame:
    """Priced weeks that fail a check, with the reasons joined: keyword, over twice the median (of 2 or more), over 3 times or
    under half the spine's week before, outside 0.25 to 50 per pound, the $5 Friday trap, above the baseline."""
    whole = Window.partitionBy(*keys)
    rows = prior_week_price(spine, keys).withColumns({"median_price": F.median(F.when(F.col("price") > 0, F.col("price"))).over(whole), "n_prices": F.count(F.when(F.col("price") > 0, 1)).over(whole)})
    price, prior = F.col("price"), F.col("prior_price")
    none = F.lit(False)
    outlier = (
        F.when((F.col("n_prices") >= 2) & (price > 2.0 * F.col("median_price")), "above_median")
        .when((prior > 0) & (price > 3.0 * prior), "above_prior")
        .when((prior > 0) & (price < 0.5 * prior), "below_prior")
    )
    reasons = F.array_compact(
        F.array(
            F.when(keyword if keyword is not None else none, "keyword"),
            outlier,
            F.when((per_lb if per_lb is not None else none) & ((price < 0.25) | (price > 50)), "per_lb"),
            F.when((friday if friday is not None else none) & (F.abs(price - 5.0) <= 1e-6), "friday_multibuy"),
            F.when(price > F.col("baseline") + 0.009, "above_baseline"),
        )
    )
    return rows.where("price IS NOT NULL").withColumn("reason", F.concat_ws("; ", reasons)).where("reason <> ''")


def match_outcomes(cases: DataFrame) -> DataFrame:
    """outcome of (expected_decision, expected_family, decision, family) rows."""
    same = F.col("family").eqNullSafe(F.col("expected_family"))
    want, got = F.col("expected_decision"), F.col("decision")
    return cases.withColumn(
        "outcome",
        F.when((want == "accept") & (got == "accepted"), F.when(same, "true_accept").otherwise("wrong_family"))
        .when((want == "accept") & (got == "manual_review"), "review_of_good")
        .when(want == "accept", "missed")
        .when((want == "reject") & (got == "accepted"), "false_accept")
        .when((want == "reject") & (got == "manual_review"), "review_of_bad")
        .when(want == "reject", "true_reject")
        .otherwise(F.when(got == "manual_review", "true_review").otherwise("wrong_review")),
    )


def match_metrics(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and false-match rate, of all cases or by columns."""
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    good, wrong, accepts = n("true_accept"), n("wrong_family", "false_accept"), n("true_accept", "wrong_family", "review_of_good", "missed")
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        good.alias("n_good"),
        wrong.alias("n_wrong"),
        (good / F.nullif(good + wrong, F.lit(0))).alias("precision"),
        (good / F.nullif(accepts, F.lit(0))).alias("recall"),
        (wrong / F.count(F.lit(1))).alias("false_match_rate"),
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per field of correctness flags: accuracy in both runs, and the cases that improved and regressed."""
    stacked = lambda df, name: df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", name))
    both = stacked(a, "was").join(stacked(b, "is"), [key, "field"])
    flag = lambda c: F.sum(c.cast("long"))
    return both.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), flag(F.col("was")).alias("n_was"), flag(F.col("is")).alias("n_is"), flag(~F.col("was") & F.col("is")).alias("improved"), flag(F.col("was") & ~F.col("is")).alias("regressed")
    )


#: A sketch of a group's values says where a percentile lies, off by one in so many ranks; buffers hold about as many values.
RANK_ACCURACY = 10_000
#: The share of a group's rows on each side of a percentile whose values are put in order.
RANK_MARGIN = 0.001


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """A row per group that has values, with its exact percentiles by name: interpolated between the two values next to their
    place, as SQL's percentile_cont; nulls do not count.

    Sketches bound each percentile from both sides, the rows below, within and above the bounds are counted, and of the part
    that holds the percentile's ranks the distinct values are put in order. A sketch that is off makes that part larger, not
    the result another one.
    """
    rows = df.where(F.col(value).isNotNull()).select((F.struct(*by) if by else F.struct(F.lit(0))).alias("key"), F.col(value).cast("double").alias("v"))
    bounds = [min(max(share + d, 0.0), 1.0) for share in shares.values() for d in (-RANK_MARGIN, RANK_MARGIN)]
    few = rows.select("key").distinct().limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS
    sent = lambda groups: F.broadcast(groups) if few else groups
    sketches = sent(rows.groupBy("key").agg(F.percentile_approx("v", bounds, RANK_ACCURACY).alias("bounds")))
    low, high = (lambda i: F.col("bounds")[2 * i]), (lambda i: F.col("bounds")[2 * i + 1])
    n_in = [F.count_if(c).alias(f"{name}{i}") for i in range(len(shares)) for name, c in (("below", F.col("v") < low(i)), ("upto", F.col("v") <= high(i)))]
    counts = rows.join(sketches, "key").groupBy("key", "bounds").agg(F.count(F.lit(1)).alias("n"), *n_in)

    wanted = []  # per percentile, where its ranks (from 0) lie: its name, its place, the parts and the rows before them
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(share) * (F.col("n") - 1)
        part = lambda rank: F.when(rank < F.col(f"below{i}"), 0).when(rank < F.col(f"upto{i}"), 1).otherwise(2)  # noqa: E731, B023
        first = part(F.floor(at))
        before = F.when(first == 0, F.lit(0)).when(first == 1, F.col(f"below{i}")).otherwise(F.col(f"upto{i}"))
        wanted.append(F.struct(F.lit(name).alias("name"), at.alias("at"), first.alias("first"), part(F.ceil(at)).alias("last"), before.alias("before")).alias(f"s{i}"))
    places = sent(counts.select("key", "bounds", *wanted))
    inside = [F.when(F.when(F.col("v") < low(i), 0).when(F.col("v") <= high(i), 1).otherwise(2).between(F.col(f"s{i}.first"), F.col(f"s{i}.last")), F.col(f"s{i}")) for i in range(len(shares))]
    near = rows.join(places, "key").where(F.coalesce(*inside).isNotNull())
    values = near.select("key", "v", F.explode(F.array_compact(F.array(*inside))).alias("s")).groupBy("key", "s", "v").agg(F.count(F.lit(1)).alias("n"))

    upto = F.col("s.before") + F.sum("n").over(Window.partitionBy("key", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    value_at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    at = F.col("s.at")
    found = values.withColumn("upto", upto).groupBy("key", "s").agg(value_at(F.floor(at)).alias("a"), value_at(F.ceil(at)).alias("b"))
    exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(at) - at) * F.col("a") + (at - F.floor(at)) * F.col("b"))
    return found.groupBy("key").agg(*[F.max(F.when(F.col("s.name") == name, exact)).alias(name) for name in shares]).select(*[F.col("key")[c].alias(c) for c in by], *shares)


def service_metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, errors, error rate, mean and exact percentile latency of (kind, latency) rows."""
    totals = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        (F.count_if(F.col("kind") == "error") / F.count(F.lit(1))).alias("error_rate"),
        F.avg("latency").alias("mean_latency"),
    )
    found = percentiles(events, "latency", {"p50": 0.5, "p95": 0.95}, by)
    same = F.lit(True)
    for c in by:
        same &= totals[c].eqNullSafe(found[c])
    return totals.join(found, same, "left").select(*[totals[c] for c in by], "requests", "errors", "error_rate", "mean_latency", "p50", "p95")


def shopper_sessions(answers: DataFrame, user: str = "user", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, requests, clarifies, continues, first_clarify, last_continue, is_completed): answers
    (user, ts, action) that follow each other within the gap are a session. It is completed if a tracker was reached after
    a question. A grouping by session windows; batch or stream. Rows without a user or time belong to no session."""
    at = lambda action: F.when(F.col("action") == action, F.col(ts))
    rows = answers.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, F.session_window(ts, gap).alias("s"))
    found = rows.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("action") == "clarify").alias("clarifies"),
        F.count_if(F.col("action") == "continue").alias("continues"),
        F.min(at("clarify")).alias("first_clarify"),
        F.min(at("continue")).alias("first_continue"),
        F.max(at("continue")).alias("last_continue"),
    )
    return found.select(
        user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests", "clarifies", "continues", "first_clarify", "last_continue",
        F.coalesce(F.col("last_continue") > F.col("first_clarify"), F.lit(False)).alias("is_completed"),
        (F.col("first_continue").isNotNull() & F.coalesce(F.col("first_continue") < F.col("first_clarify"), F.lit(True))).alias("is_direct"),
    )


def completion_metrics(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions, those asked back, those that went on after it, their rate, and the share that reached a tracker at once."""
    asked = F.count_if(F.col("clarifies") > 0)
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        asked.alias("asked"),
        F.count_if("is_completed").alias("completed"),
        (F.count_if("is_completed") / F.nullif(asked, F.lit(0))).alias("completion_rate"),
        (F.count_if("is_direct") / F.count(F.lit(1))).alias("direct_rate"),
    )


#: The fields of a query's evaluation in the order of its failure tags, and how far numbers may be off.
QUERY_FIELDS = ("product_text", "price", "promotion_type", "required_quantity", "package_size")
PRICE_SLACK = 0.011


def _same_text(want: Column, got: Column) -> Column:
    plain = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return plain(want).eqNullSafe(plain(got))


def _names_product(want: Column, got: Column) -> Column:
    """At least half of the expected words of three letters and more stand in the text (without such words: the whole)."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    w, g = plain(want), plain(got)
    words = F.filter(F.split(w, " "), lambda x: F.length(x) >= 3)
    hits = F.size(F.filter(words, lambda x: F.contains(g, x)))
    loose = F.when(F.size(words) == 0, F.contains(g, w) | F.contains(w, g)).otherwise(hits >= F.greatest(F.lit(1), F.floor((F.size(words) + 1) / 2)))
    return F.when((w == "") & (g == ""), True).when((w == "") | (g == ""), False).otherwise(loose)


def score_queries(cases: DataFrame) -> DataFrame:
    """Adds a flag for each of QUERY_FIELDS, tracker_ok, behavior_ok, safe_ok, confident_wrong and the tags of what failed.

    cases: labels (an array of the fields that are labelled), expected and actual structs of the fields, expected_tracker,
    tracker, candidates, expected_behavior, behavior, expected_safe, is_safe. Fields without a label are right. A label of
    no tracker fails only if the answer goes on with one; where a question or refusal is expected, the one candidate counts.
    """
    want, got = (lambda f: F.col(f"expected.{f}")), (lambda f: F.col(f"actual.{f}"))
    near = (want("price").isNull() & got("price").isNull()) | F.coalesce(F.abs(want("price") - got("price")) < PRICE_SLACK, F.lit(False))
    size_want, size_got = (F.nullif(F.lower(F.trim(c("package_size"))), F.lit("")) for c in (want, got))
    rules = {
        "product_text": _names_product(want("product_text"), got("product_text")),
        "price": near,
        "promotion_type": _same_text(want("promotion_type"), got("promotion_type")),
        "required_quantity": want("required_quantity").eqNullSafe(got("required_quantity")),
        "package_size": (size_want.isNull() & size_got.isNull()) | F.coalesce(F.contains(size_got, size_want) | F.contains(size_want, size_got), F.lit(False)),
    }
    rows = cases.withColumns({f"{f}_ok": ~F.coalesce(F.array_contains("labels", f), F.lit(False)) | rules[f] for f in QUERY_FIELDS})
    tracker, expected = F.col("tracker"), F.col("expected_tracker")
    only = tracker.isNull() & F.col("expected_behavior").isin("clarify", "invalid") & (F.size("candidates") == 1) & F.coalesce(F.get("candidates", 0) == expected, F.lit(False))
    safe = F.coalesce("is_safe", F.lit(False))
    priced_wrong = ~F.col("price_ok") & want("price").isNotNull()
    rows = rows.withColumns(
        {
            "tracker_ok": F.when(expected.isNull(), ~((F.col("behavior") == "continue") & tracker.isNotNull())).otherwise(F.coalesce(tracker == expected, F.lit(False)) | only),
            "behavior_ok": F.col("behavior").eqNullSafe(F.col("expected_behavior")),
            "safe_ok": safe == F.coalesce("expected_safe", F.lit(False)),
            "confident_wrong": safe & ((expected.isNotNull() & ~tracker.eqNullSafe(expected)) | ~F.coalesce("expected_safe", F.lit(False)) | priced_wrong),
        }
    )
    tags = [F.when(~F.col(f"{f}_ok"), f) for f in (*QUERY_FIELDS, "tracker", "behavior")]
    tags += [F.when(~F.col("safe_ok"), "safe_resolution"), F.when(F.col("confident_wrong"), "confident_wrong")]
    return rows.withColumn("tags", F.array_compact(F.array(*tags)))


def query_eval_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(measure, name, n, n_hit, share): of each field, tracker, behavior and safety the cases that are right; of each failure
    tag the cases that have it; and all cases without any. Every case is unpivoted into its measures and combined before
    the shuffle. Tags that no case has are left out."""
    one = lambda measure, name, hit: F.struct(F.lit(measure).alias("measure"), F.lit(name).alias("name"), hit.alias("hit"))
    right = [one("accuracy", f, F.col(f"{f}_ok")) for f in (*QUERY_FIELDS, "tracker", "behavior", "safe")] + [one("passed", "all", F.size("tags") == 0)]
    failed = F.transform("tags", lambda t: F.struct(F.lit("failure").alias("measure"), t.alias("name"), F.lit(True).alias("hit")))
    long = scored.select(*by, F.explode(F.concat(F.array(*right), failed)).alias("m")).select(*by, "m.*")
    counted = long.groupBy(*by, "measure", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"))
    return counted.withColumn("share", F.when(F.col("measure") != "failure", F.col("n_hit") / F.col("n")))


def clarify_loops(turns: DataFrame, session: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Turns with a digest of their fields, and whether the session has shown the same before."""
    digest = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256), 1, 16)
    seen = Window.partitionBy(session, "digest").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("digest", digest).withColumn("is_loop", F.count(F.lit(1)).over(seen) >= 1)
