"""The weekly jobs end to end on inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from priceloom.operators import matching
from priceloom.plans import weekly
from priceloom.sources.files import OFFER_STRINGS


def test_weekly_prices_and_deals(spark):
    weeks = [dt.date(2024, 1, 3) + dt.timedelta(7 * i) for i in range(4)]
    rows = [
        {"week_start": weeks[0], "split_product_text": "Ripe Plums", "advertised_price": "4.00", "promo_text": "2 for $5"},
        {"week_start": weeks[0], "split_product_text": "Plum jam", "advertised_price": "1.00"},
        {"week_start": weeks[1], "split_product_text": "Plums", "advertised_price": "3.00", "promo_text": "Everyday Price"},
        {"week_start": weeks[2], "split_product_text": "Plums", "advertised_price": "9.00"},
        {"week_start": weeks[3], "split_product_text": "Plums", "advertised_price": "2.00"},
    ]
    names = [c for c in OFFER_STRINGS if c != "week_start"]
    data = [("vons", i, r["week_start"], *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    offers = spark.createDataFrame(data, "feed string, row_seq int, week_start date, " + ", ".join(f"{n} string" for n in names))
    catalog = spark.createDataFrame([("plums", ["plums"], ["jam"], ["ripe"], None, 5.0, False)], "family string, include array<string>, exclude array<string>, prefer array<string>, rule string, baseline double, lowest boolean")
    rules = matching.RULES
    compiled = matching.compile_phrases(catalog).withColumn("rules", F.lit(None).cast(rules))
    manifest = spark.createDataFrame([("vons", w) for w in weeks], "feed string, week_start date")
    got = weekly.weekly_prices(offers, compiled, manifest)
    assert {r["week"]: r["price"] for r in got.collect()} == {weeks[0]: 2.5, weeks[1]: None, weeks[2]: None, weeks[3]: 2.0}
    current = got.where(F.col("week") == weeks[3]).select("feed", "family", "week", F.lit(2.0).alias("current_price"))
    deal = weekly.deal_analysis(got, current).first()
    assert deal["all_time_low"] == 2.5 and deal["n_obs"] == 1 and deal["bucket"] == "insufficient history"
