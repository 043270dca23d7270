"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from priceloom import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("datetime", "string", "str")):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v)[:10] if hasattr(v, "year") else v)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str) if s.dtype == object else s.round(6)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-9, atol=1e-9)


def test_accept_over_time_folds_like_a_loop(spark):
    rows = [r.asDict() for r in QUERIES["accept_over_time"](spark, DATA).collect()]
    from pyspark.sql import functions as F

    from priceloom.operators import matching
    from priceloom.queries import offers

    gated = offers._gated(spark, DATA)
    ranked = matching.rank_candidates(gated, ["feed", "week", "family"], F.col("lowest"), usable=offers._usable()).select("feed", "family", "week", "candidate_rank", "price", "unit_price", "confidence", "base_decision", "exempt").collect()
    series = {}
    for r in ranked:
        series.setdefault((r["feed"], r["family"]), {}).setdefault(r["week"], []).append(r)
    want = {}
    for key, weeks in series.items():
        low = prior = None
        for week in sorted(weeks):
            chosen = None
            for c in sorted(weeks[week], key=lambda c: c["candidate_rank"]):
                sure = c["confidence"] >= 0.85 or c["exempt"]
                price = c["price"]
                new_low = price is not None and low is not None and price < low
                jump = price is not None and prior is not None and prior > 0 and abs(price - prior) / prior * 100 >= 40
                if c["base_decision"] == "accepted" and (sure or not (new_low or jump)):
                    chosen = c
                    break
            prior = chosen["unit_price"] if chosen else None
            low = prior if low is None else low if prior is None else min(low, prior)
            want[(*key, week)] = (chosen["candidate_rank"] if chosen else None, prior)
    assert {(r["feed"], r["family"], r["week"]): (r["accepted_rank"], r["unit_price"]) for r in rows} == want


def test_package_siblings_equal_a_plain_search(spark, duck):
    got = {r["node"]: r["component"] for r in QUERIES["package_siblings"](spark, DATA).collect()}
    edges = duck.execute("SELECT DISTINCT l_partkey, o_custkey + 1000000000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {x: root(x) for x in list(parent)}


def test_parse_queries_reads_the_whole_text(spark, tmp_path):
    text = "x " * 60 + "at Safeway"
    spark.createDataFrame([(1, 1, "user", text)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["parse_queries"](spark, str(tmp_path)).collect()[0]["retailer"] == "safeway"


@pytest.mark.parametrize("name", ["missed_deal_report", "missed_deals"])
def test_missed_deals_try_patterns_once_for_offers_that_say_the_same(spark, tmp_path, monkeypatch, name):
    """Three times the line items, with keys that leave their prices as they are, give no more rows to match and the same deals."""
    from pyspark.sql import functions as F

    from priceloom.operators import matching

    tried, match = [], matching.match_offers
    monkeypatch.setattr(matching, "match_offers", lambda rows, *a, **k: (tried.append(rows.count()), match(rows, *a, **k))[1])
    for t in ("region", "nation", "supplier", "part"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    copies = spark.read.parquet(f"{DATA}/lineitem.parquet").crossJoin(spark.range(3)).withColumn("l_orderkey", F.col("l_orderkey") + F.col("id") * 7_000_000)
    copies.drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    one = QUERIES[name](spark, DATA).collect()
    first, tried[:] = list(tried), []
    three = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(one) > 100
    assert sorted(map(str, three)) == sorted(map(str, one))
    assert tried == first
