"""Query evaluation, sessions, latency sketches and the voter table on small cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.operators import quality
from priceloom.streaming import flows

EXPECTED = "struct<product_text: string, price: double, promotion_type: string, required_quantity: int, package_size: string>"


def test_each_field_has_its_rule(spark):
    every = list(quality.QUERY_FIELDS)
    right = ("red oats", 2.0, "bogo", 2, "12 oz")
    rows = [  # labels, expected, actual, expected tracker, tracker, candidates, expected behavior, behavior, expected safe, safe, and the tags
        (every, right, ("Big RED  oats", 2.01, "BOGO ", 2, "a 12 oz box"), "f", "f", ["f"], "continue", "continue", True, True, []),
        (every, right, ("oat", 2.02, "sale", 3, "16 oz"), "f", "f", ["f"], "continue", "continue", True, True, ["product_text", "price", "promotion_type", "required_quantity", "package_size", "confident_wrong"]),
        ([], right, ("oat", None, None, None, None), "f", "g", ["g"], "continue", "continue", True, True, ["tracker", "price_unlabelled"]),
        (every, (None, None, None, None, None), ("", None, "", None, " "), None, None, [], "clarify", "clarify", False, False, []),
        (every, (None, None, None, None, None), (None, None, None, None, None), None, "f", ["f"], "clarify", "continue", False, True, ["tracker", "behavior", "safe_resolution", "confident_wrong"]),
        (every, right, right, "f", None, ["f"], "clarify", "clarify", False, False, []),
        (every, right, right, "f", None, ["f", "g"], "clarify", "clarify", False, False, ["tracker"]),
        (every, right, right, "f", None, ["f"], "continue", "clarify", True, False, ["tracker", "behavior", "safe_resolution"]),
    ]
    rows[2] = (*rows[2][:-1], ["tracker", "confident_wrong"])
    schema = f"labels array<string>, expected {EXPECTED}, actual {EXPECTED}, expected_tracker string, tracker string, candidates array<string>, expected_behavior string, behavior string, expected_safe boolean, is_safe boolean, want array<string>"
    scored = quality.score_queries(spark.createDataFrame(rows, schema))
    for r in scored.collect():
        assert r["tags"] == r["want"], r
    got = {(r["measure"], r["name"]): (r["n"], r["n_hit"], r["share"]) for r in quality.query_eval_metrics(scored).collect()}
    assert got[("accuracy", "tracker")] == (8, 4, 0.5) and got[("failure", "confident_wrong")] == (3, 3, None) and got[("passed", "all")] == (8, 3, 0.375)
    assert quality.query_eval_metrics(scored.limit(0)).count() == 0


def test_sessions_join_a_question_with_what_follows(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(0), "clarify"), ("a", at(20), "clarify"), ("a", at(45), "continue"), ("a", at(200), "continue"), ("a", at(210), "clarify"), ("b", at(0), "clarify"), ("b", at(50), "continue"), (None, at(0), "clarify"), ("c", None, "clarify")]
    sessions = quality.shopper_sessions(spark.createDataFrame(rows, "user string, ts timestamp, action string"))
    got = sorted((r["user"], r["requests"], r["is_completed"], r["is_direct"]) for r in sessions.collect())
    assert got == [("a", 2, False, True), ("a", 3, True, False), ("b", 1, False, False), ("b", 1, False, True)]
    total = quality.completion_metrics(sessions).collect()[0]
    assert (total["sessions"], total["asked"], total["completed"], total["direct_rate"]) == (4, 3, 1, 0.5)


def test_the_latency_sketch_is_off_by_few_ranks(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(3, 1) for _ in range(60_000)]
    rows = spark.createDataFrame([(v, "ok") for v in values], "latency double, kind string").repartition(7)
    got = quality.service_metrics(rows).collect()[0]
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        rank = sum(v <= got[name] for v in values)
        assert abs(rank - share * len(values)) <= len(values) / quality.RANK_ACCURACY + 1


@pytest.mark.parametrize("accuracy, margin, sent", [(quality.RANK_ACCURACY, quality.RANK_MARGIN, 50_000), (5, 0.0, 0)])
def test_percentiles_are_exact_however_rough_the_sketch(spark, monkeypatch, accuracy, margin, sent):
    monkeypatch.setattr(quality, "DIMENSION_ROWS", sent)
    monkeypatch.setattr(quality, "RANK_ACCURACY", accuracy)
    monkeypatch.setattr(quality, "RANK_MARGIN", margin)
    rng = random.Random(2)
    groups = {"many": [rng.lognormvariate(3, 1) for _ in range(40_001)], "ties": [float(rng.randrange(3)) for _ in range(30_000)], None: [4.0, 1.0], "one": [7.0], "none": []}
    rows = [(k, v, "ok") for k, vs in groups.items() for v in vs] + [("none", None, "error"), ("many", None, "ok")]
    rng.shuffle(rows)
    got = {r["k"]: r for r in quality.service_metrics(spark.createDataFrame(rows, "k string, latency double, kind string").repartition(5), ["k"]).collect()}
    assert set(got) == set(groups)
    assert (got["none"]["requests"], got["none"]["errors"], got["none"]["p50"], got["none"]["p95"]) == (1, 1, None, None)
    for k, values in groups.items():
        for name, share in (("p50", 0.5), ("p95", 0.95)) if values else ():
            assert got[k][name] == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_voters_count_once_across_batches_and_reruns(spark, tmp_path):
    root, day = str(tmp_path / "votes"), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [
        [("x", "u", day(0)), ("x", "u", day(1)), ("x", "v", day(0)), ("y", "u", day(0)), (None, "u", day(0)), ("x", None, day(0))],
        [("x", "u", day(5)), ("x", "w", day(5)), ("y", "u", day(40))],
        [],
        [("x", "v", day(31)), ("x", "u", day(12)), ("z", "u", day(12))],
    ]
    merge = flows.voter_merge(root, 30)
    frames = [spark.createDataFrame(b, "item string, user string, ts timestamp") for b in batches]
    want = {"x": 3, "y": 1}
    merge(frames[0], 0)
    merge(frames[1], 1)
    merge(frames[1], 1)  # after a failure
    merge(frames[2], 2)
    # y's voter comes again after 40 days, beyond the time to live.
    assert {r["item"]: r["votes"] for r in flows.voter_tally(spark, root).collect()} == {"x": 3, "y": 2}
    for _ in range(2):
        merge(frames[3], 3)
    assert {r["item"]: r["votes"] for r in flows.voter_tally(spark, root).collect()} == want | {"x": 4, "y": 2, "z": 1}
    plan = spark.read.schema(flows.VOTERS).parquet(f"{root}/voters").where(F.col("day") >= F.lit("2024-01-12").cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
