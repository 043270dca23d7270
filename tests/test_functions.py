"""Unit prices, labels, the gate, and sources on inline rows."""

import pytest
from pyspark.sql import functions as F

from priceloom.functions import labels, text, units
from priceloom.operators import compare, matching, querylog, setops, shortlist, votes
from priceloom.sources import files

OFFER = "promo_text string, price_basis string, advertised_price string, split_product_text string, raw_offer_text string, package_text string, package_size_min string, package_size_max string, package_unit string, rule string, baseline double"


def unit(spark, **values):
    names = [c.strip().split()[0] for c in OFFER.split(",")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], OFFER)
    return units.with_unit_price(row).first()["unit_price"]


@pytest.mark.parametrize(
    ("row", "price"),
    [
        ({"promo_text": "2 for $5", "advertised_price": "$5", "price_basis": "each"}, 2.5),
        ({"promo_text": "3/$10", "advertised_price": "10", "price_basis": "multi_buy"}, 3.33),
        ({"promo_text": "BUY 2 GET 3 FREE", "advertised_price": "5.49", "price_basis": "buy_x_get_y"}, 2.2),
        ({"promo_text": "BOGO", "advertised_price": "$", "price_basis": "bogo", "baseline": 4.0}, 2.0),
        ({"promo_text": "BOGO", "advertised_price": None, "price_basis": "each", "baseline": 4.0}, None),
        ({"promo_text": "Member Price: $1.25 ea", "advertised_price": "5.00"}, 1.25),
        ({"promo_text": "", "advertised_price": "9.99", "price_basis": "per_lb", "rule": "per_lb", "raw_offer_text": "9.99 lb"}, 9.99),
        ({"advertised_price": "6.00", "package_text": "3 lb bag of 2 lb", "rule": "strawberries_per_lb"}, 2.0),
        ({"advertised_price": "4.50", "package_text": "18 ct", "rule": "per_dozen"}, 3.0),
        ({"advertised_price": "4.50", "package_size_min": "18", "rule": "per_dozen"}, 3.0),
        ({"advertised_price": "10.00", "rule": "per_cup"}, 2.5),
        ({"advertised_price": "4.00", "package_text": "32 oz", "rule": "per_16oz"}, 2.0),
        ({"advertised_price": "7.99", "package_text": "12 pack", "rule": "pack_total"}, 7.99),
        ({"advertised_price": "10.00", "package_text": "5 ct", "price_basis": "per_pack"}, 2.0),
    ],
)
def test_unit_price(spark, row, price):
    assert unit(spark, **row) == (pytest.approx(price, abs=0.005) if price is not None else None)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("sign", "target", "want"),
    [("SALMON PER LB", "oz", (1.0, "lb", "high")), ("MANDARINS 3 LBS", "bag", (1.0, "bag", "high")), ("2 X 16 OZ", "oz", (32.0, "oz", "high")), ("12/5.3 OZ", "cup", (12.0, "each", "high")), ("30 BARS 1.42 OUNCE EA", "bar", (30.0, "bar", "high")), ("24 CT EGGS", "egg", (24.0, "egg", "medium")), ("PLAIN", "oz", (1.0, "oz", "low")), ("PLAIN", None, None)],
)
def test_package(spark, sign, target, want):
    got = one(spark, units.package(F.lit(sign), F.lit(target).cast("string")))
    assert (tuple(got) if got else None) == want


def test_prices_and_text(spark):
    assert [one(spark, text.parse_price(F.lit(x))) for x in ("$3.99", "", "$", "-", "x", "4")] == [3.99, None, None, None, None, 4.0]
    assert [one(spark, text.lowest_dollar_amount(F.lit(x))) for x in ("was $5 now $3.50", "about 7", "none")] == [3.5, 7.0, 0.0]
    shelf = lambda promo: one(spark, text.is_everyday_shelf(F.lit(""), F.lit(""), F.lit(promo), F.lit(None).cast("string")))
    assert shelf("Every Day") and shelf("Everyday Price 2.99") and not shelf("2/$4 Member Price Every Day")


def test_phrases(spark):
    df = spark.createDataFrame([("f", ["large eggs", "12 ct"], [])], "family string, include array<string>, exclude array<string>")
    row = matching.compile_phrases(df).first()
    assert row["exclude_pattern"] is None
    hits = [one(spark, F.lit(t).rlike(row["include_pattern"])) for t in ("large party size eggs", "large brown eggs", "large eggshell", "box 12 ct", "large organic eggs")]
    assert hits == [True, False, False, True, False]
    ranged = spark.createDataFrame([("Chips", ["dip 5–13 oz", ""], [])], "name string, include array<string>, exclude array<string>")
    pattern = matching.compile_phrases(ranged, name="name").first()["include_pattern"]
    assert [one(spark, F.lit(t).rlike(pattern)) for t in ("dip 5 - 13 oz", "dip 5-13 oz", "my chips", "dip 5 oz")] == [True, True, True, False]


def test_winner_and_label(spark):
    won = lambda g, w: one(spark, compare.winner(F.lit(g), F.lit(w)))
    assert won(1.0, 1.02)["winner"] == "tie" and won(1.0, 2.0)["winner"] == "grocer" and won(3.0, 2.0)["winner"] == "warehouse"
    label = lambda p: one(spark, labels.historical_label(F.lit(p), F.lit(2.0), F.lit(3.0), F.lit(5)))
    assert [label(p) for p in (1.5, 2.0, 2.05, 2.5, 3.5)] == ["all-time low", "tied all-time low", "within 5% of all-time low", "historically good but not near low", "not special historically"]


def test_gate(spark):
    rules = matching.RULES
    rule = ("fruit", ["ripe"], ["frozen"], ["fruit"], ["candy"], ["lb"], [], [], [], [], [("size", [], [r"\d+ lb"])], 0.6)
    rows = [("ripe plums", "2 lb", ["fruit"], "lb", True, "high", rule), ("frozen plums", "2 lb", ["fruit"], "lb", True, "high", rule), ("plum candy", "2 lb", ["candy"], "lb", True, "high", rule), ("plums", "", ["fruit"], None, True, "high", rule), ("anything", "", None, None, False, "low", None)]
    df = spark.createDataFrame(rows, f"text string, package_text string, types array<string>, unit_hint string, priced boolean, keyword_confidence string, rules {rules}")
    assert [r["base_decision"] for r in matching.eligibility(df).collect()] == ["accepted", "rejected", "rejected", "manual_review", "accepted"]


def test_setops(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in setops.upsert(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, None, "y"), (3, "c", None)}
    with pytest.raises(ValueError, match="ids changed"):
        setops.assert_same_ids(old, new, "k")
    with pytest.raises(ValueError, match="unknown ids"):
        setops.select_targets(old, "k", ids=new)


def test_sources(spark, tmp_path):
    offers = tmp_path / "offers.csv"
    offers.write_text(",".join(files.OFFER_STRINGS) + "\n" + ",".join(["1", " VONS "] + [""] * 20) + "\n" + ",".join(["2", "other"] + [""] * 20) + "\n")
    rows = files.read_offers(spark, str(offers), "vons").collect()
    assert [r["split_item_id"] for r in rows] == ["1"] and rows[0]["region"] is None
    snapshots = tmp_path / "w"
    snapshots.mkdir()
    (snapshots / "2024-01-02_bay.csv").write_text("itemNumber,sellPrice,timestamp,itemSign,inventoryStatus\n7,$3.50,2024-01-03T10:00:00Z,EGGS,in\n8,0,,X,in\n,4,,Y,in\n")
    (snapshots / "2024-01-02_nowhere.csv").write_text("itemNumber,sellPrice,timestamp,itemSign,inventoryStatus\n9,1,,Z,in\n")
    got = files.read_warehouse_prices(spark, str(snapshots), spark.createDataFrame([("bay", "Bay")], "slug string, region string")).collect()
    assert [(r["item"], r["price"], str(r["date"]), r["region"], r["date_mismatch"]) for r in got] == [("7", 3.5, "2024-01-03", "Bay", True)]
    files.write_report(spark.createDataFrame([], "a int, b int"), ["b"], str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns in (["b"], [])
    with pytest.raises(ValueError, match="no transcript"):
        files.read_transcripts(spark.createDataFrame([(1,)], "n int"))


def test_gate_scores(spark):
    """Confidence by hand: start, positive words, intent or type, list, price, attributes."""
    base = ("dip", ["onion", "ranch"], [], ["dip", "chips"], [], [], [], [], [], [], [], None)
    need = (*base[:10], [("package_size", ["8 oz"], [])], 0.9)
    asked = (*base[:9], ["family size"], [], None)
    rows = [
        ("onion ranch dip", "", ["dip"], True, "high", base, 1.0, "accepted", None),
        ("onion chips", "", ["chips"], True, "medium", base, 0.78, "accepted", None),
        ("plain chips", "", ["chips"], True, "medium", base, 0.6, "manual_review", "insufficient_information"),
        ("onion dip or chips", "", ["dip"], True, "high", base, 0.88, "manual_review", "insufficient_information"),
        ("onion dip", "", ["dip"], False, "high", base, 0.73, "accepted", None),
        ("onion dip", "8 oz", ["dip"], True, "low", need, 0.73, "manual_review", "insufficient_information"),
        ("onion dip", "", ["dip"], True, "high", need, 1.0, "manual_review", "missing_package_size"),
        ("onion dip, cans or bottles", "", ["dip"], True, "high", base, 0.88, "manual_review", "ambiguous_product_variant"),
        ("onion dip", "", ["dip"], True, "high", asked, 1.0, "manual_review", "insufficient_information"),
        ("onion soap", "", ["soap"], True, "high", base, 0.93, "rejected", "explicit_attribute_conflict"),
        ("anything", "", [], True, "low", None, 0.45, "accepted", None),
    ]
    df = spark.createDataFrame([(i, *r[:5], r[5]) for i, r in enumerate(rows)], f"i int, text string, package_text string, types array<string>, priced boolean, keyword_confidence string, rules {matching.RULES}")
    got = matching.eligibility(df.withColumn("unit_hint", F.lit(None).cast("string"))).orderBy("i").collect()
    assert [(r["confidence"], r["base_decision"], r["reason_code"]) for r in got] == [r[6:] for r in rows]


def test_large_catalogs_go_in_blocks_and_tokens_may_be_any_letters(spark):
    catalog = spark.createDataFrame([(f"f{i}", rf"\bw{i}\b", None, f"w{i}") for i in range(9)] + [("c", r"\bcafé\b", r"\bw3\b", "café")], "family string, include_pattern string, exclude_pattern string, token string")
    offers = spark.createDataFrame([(0, "w1 café"), (1, "w3 café w8"), (2, "none")], "row_seq int, text string")
    want = {(0, "f1"), (0, "c"), (1, "f3"), (1, "f8")}
    for found in (matching.match_offers(offers, catalog, block=3), matching.match_offers(offers, catalog), matching.match_by_token(offers, catalog)):
        assert {(r["row_seq"], r["family"]) for r in found.collect()} == want


def test_aliases_of_any_length(spark):
    aliases = spark.createDataFrame([("honey nut oat cereal", "a", True, False), ("oat", "b", False, False)], "alias string, family string, is_primary boolean, is_generic boolean")
    log = spark.createDataFrame([(1, "some honey-nut oat cereal, please"), (2, "oat")], "query_id int, q string")
    assert {(r["query_id"], r["family"]) for r in querylog.alias_hits(log, aliases, "query_id", "q").collect()} == {(1, "a"), (2, "b")}


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 50), (61, 60), (60, 61)]
    got = querylog.family_components(spark.createDataFrame(edges, "a long, b long"), lambda df: files.stored(df, "edges"))
    assert {tuple(r) for r in got.collect()} == {(i, 1) for i in range(1, 41)} | {(50, 50), (60, 60), (61, 60)}


def test_votes_count_by_the_status_when_cast_and_once_over_batches(spark):
    items = spark.createDataFrame([("a", "pending", 5), ("b", "approved", 2)], "item string, status string, votes long")
    kinds = "event_id int, ts int, kind string, item string, raw_text string, user string, merge_into string"
    one_ = [(1, 1, "vote", "a", None, "u", None), (2, 2, "approve", "a", None, None, None), (3, 3, "vote", "a", None, "u", None), (4, 4, "suggest", None, " A ", "v", None), (5, 5, "suggest", None, "New  one", "w", None), (6, 6, "reject", "a", None, None, None), (7, 7, "vote", "a", None, "x", None), (8, 8, "merge", "a", None, None, "b")]
    after, voters = votes.vote_batch(items, spark.createDataFrame(one_, kinds))
    assert {tuple(r) for r in after.collect()} == {("a", "merged", 7), ("b", "approved", 3), ("new one", "pending", 0)}
    two = [(9, 9, "approve", "a", None, None, None), (10, 10, "vote", "a", None, "u", None), (11, 11, "vote", "a", None, "y", None)]
    assert {tuple(r) for r in votes.apply_vote_events(after, spark.createDataFrame(two, kinds), voters).collect()} >= {("a", "approved", 8)}


def test_report_orders(spark):
    from priceloom.operators import content

    rows = spark.sql("SELECT * FROM VALUES (1, 'page', 'a', 1, 1), (2, 'may bleed', 'b', 2, 1), (3, 'may bleed', 'a', 9, 2), (4, CAST(NULL AS STRING), 'a', 0, 1) AS t(id, note, feed, page, offer_index)")
    assert [r["id"] for r in rows.orderBy(*content.crop_override_order()).collect()] == [3, 2, 4, 1]
    rows = spark.sql("SELECT * FROM VALUES (1, 1, 9, 'a'), (2, 3, 5, 'b'), (3, 3, 5, 'a'), (4, 3, 7, 'z') AS t(id, priority, views, query)")
    assert [r["id"] for r in rows.orderBy(*content.mention_order()).collect()] == [4, 3, 2, 1]


def test_shares_below_the_baseline_round_as_in_sql(spark):
    """Shares within some units of the last place of a tie, x.x5 and x.5, against DuckDB's round."""
    import duckdb

    rows = [(i, "a name", b * (1 - (n + 0.5) / 1000), float(b)) for i, (b, n) in enumerate((b, n) for b in range(900, 1000, 9) for n in range(-200, 500))]
    offers = spark.createDataFrame(rows, "i int, name string, price double, baseline double").selectExpr("*", "CAST(NULL AS DOUBLE) AS effective_price", "baseline AS warehouse_unit_price", "CAST(NULL AS ARRAY<STRING>) AS caveats", "1.0D AS split_confidence")
    got = [(r["baseline_pct"], r["warehouse_pct"]) for r in shortlist.shortlist_facts(offers).orderBy("i").collect()]
    x = [(b - p) / b * 100 for _, _, p, b in rows]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 1) FROM (SELECT unnest($1) AS x, generate_subscripts($1, 1) AS i) ORDER BY i", [x]).fetchall()]
    assert got == [(w, w) for w in want]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "bigint"])
def test_votes_equal_a_loop_over_the_events_of_many_days(spark, kind):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(0, 9 * 86_400, 7_000)]), rng.choice(["vote", "vote", "vote", "suggest", "approve", "reject", "merge"]), rng.choice("abcd"), rng.choice(["u", "v", "w", "x", None]), rng.choice("abcd")) for i in range(300)]
    known = {"a": "approved", "b": "rejected"}
    status, voters = dict(known), set()
    day = lambda t: t if t is None or kind != "date" else t // 86_400
    for i, ts, what, item, user, into in sorted(rows, key=lambda r: (r[1] is not None, day(r[1]) or 0, r[0])):
        if what in ("vote", "suggest") and user and status.get(item) == "approved":
            voters.add((item, user))
        if what == "suggest":
            status.setdefault(item, "pending")
        if what == "merge" and status.get(into) == "approved":
            voters.add((into, f"merge:{item}"))
        if what in ("approve", "reject", "merge") and item in status:
            status[item] = {"approve": "approved", "reject": "rejected", "merge": "merged"}[what]
    events = spark.createDataFrame([(i, ts, what, item, item.upper(), user, into) for i, ts, what, item, user, into in rows], "event_id int, ts bigint, kind string, item string, raw_text string, user string, merge_into string")
    events = events.withColumn("ts", F.col("ts") if kind == "bigint" else F.timestamp_seconds("ts").cast(kind))
    after, new = votes.vote_batch(spark.createDataFrame([(k, v, 0) for k, v in known.items()], "item string, status string, votes long"), events)
    assert {(r["item"], r["user"]) for r in new.collect()} == voters
    assert {tuple(r) for r in after.collect()} == {(k, v, sum(x == k for x, _ in voters)) for k, v in status.items()}


def test_a_popular_item_is_no_join_of_its_votes_with_its_changes(spark):
    """200,000 votes and 200,000 changes of one item: a sort takes seconds, 20,000,000,000 pairs many minutes."""
    import threading

    kinds = F.element_at(F.array(*map(F.lit, ["approve", "vote", "reject", "vote"])), (F.col("id") % 4 + 1).cast("int"))
    events = spark.range(400_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), kinds.alias("kind"), F.lit("a").alias("item"), F.lit("a").alias("raw_text"), F.col("id").cast("string").alias("user"), F.lit(None).cast("string").alias("merge_into"))
    items = spark.createDataFrame([("a", "pending", 0)], "item string, status string, votes long")
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert [tuple(r) for r in votes.apply_vote_events(items, events).collect()] == [("a", "rejected", 100_000)]
    finally:
        stop.cancel()


def test_texts_that_are_read_once_give_the_same_unit_prices(spark):
    texts = ["2 for $5", "Buy 2 Get 3 Free", "BOGO", "Member Price: $1.25 ea", "5 ct pack", "3 lb bag of 2 lb", "18 ct", "one dozen", "6-pack 5.3 oz", "large pack", None]
    rules = ["per_lb", "strawberries_per_lb", "per_dozen", "per_cup", "per_16oz", "per_bar", "pack_total", None]
    rows = [(t, b, p, "a name", None, "32 oz", s, None, None, r, 4.0) for t in texts for b in ("bogo", "multi_buy", "per_pack", "per_lb", None) for p in ("$", "5.49", "20") for s in ("12", None) for r in rules]
    offers = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {OFFER}")
    kept = []
    once = units.with_unit_price(offers, store=lambda df: kept.append(df.count()) or df)
    each = units.with_unit_price(offers)
    assert kept == [len(texts)] and once.columns == each.columns
    prices = [r["unit_price"] for r in each.orderBy("i").collect()]
    assert [r["unit_price"] for r in once.orderBy("i").collect()] == prices
    assert len(set(prices)) > 20
