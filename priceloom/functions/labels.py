"""Verdicts, scores and labels as ordered choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRONG = ["all-time low", "near all-time low", "strong sale"]


def historical_label(current: Column, low: Column, median: Column, weeks: Column) -> Column:
    """Below, at (0.5 %) or within 5 % of the low, good against the median, or nothing special."""
    eps = F.greatest(low * 0.005, F.lit(0.001))
    return (
        F.when(low.isNull() | (weeks < 2), "insufficient history")
        .when(current < low - eps, "all-time low")
        .when(F.abs(current - low) <= eps, "tied all-time low")
        .when(current <= low * 1.05, "within 5% of all-time low")
        .when(current < median * 0.97, "historically good but not near low")
        .otherwise("not special historically")
    )


def summary_section(review: Column, label: Column, pct: Column, comparable: Column, positive_is_warehouse: bool = True) -> Column:
    """The report section. pct is against the warehouse; its sign is a parameter since producers differ."""
    p = pct if positive_is_warehouse else -pct
    usable = F.coalesce(comparable & p.isNotNull(), F.lit(False))
    return (
        F.when(review, "manual_review")
        .when(label.isin("all-time low", "tied all-time low"), "all_time_low")
        .when(label == "within 5% of all-time low", "near_all_time_low")
        .when(usable & (p <= 0), "parity")
        .when(usable & (p > 15), "warehouse_wins")
        .when(label == "historically good but not near low", "good_buy")
        .when((label == "not special historically") & p.isNull(), "manual_review")
        .when(label == "not special historically", "warehouse_wins")
        .otherwise("good_buy")
    )


def deal_score(bucket: Column, pct: Column, track_warehouse: Column, popularity: Column, clarity: Column, match_low: Column, uncertain: Column, friday: Column) -> Column:
    """Additive score of a watchlist deal; pct positive where the grocer is cheaper."""
    wins = F.when(pct >= 20, 5).when(pct >= 5, 3).when(pct >= -5, 2).otherwise(0)
    history = F.when(bucket == "all-time low", 5).when(bucket == "near all-time low", 4).when(bucket == "strong sale", 3).when(bucket == "normal sale", 1).otherwise(0)
    return (
        F.when(track_warehouse, wins).otherwise(0)
        + history
        + popularity
        + clarity
        + F.when((pct >= -5) & (pct < 5), 1).otherwise(0)
        - F.when(uncertain, 2).otherwise(0)
        - F.when(match_low, 2).otherwise(0)
        - F.when(track_warehouse & (pct < -5), 4).otherwise(0)
        + F.when(friday, 3).otherwise(0)
    )


def deal_bucket(bucket: Column, pct: Column, track_warehouse: Column) -> Column:
    strong = bucket.isin(*_STRONG)
    tracked = track_warehouse & pct.isNotNull()
    return (
        F.when(tracked & (pct >= 5), "clear win")
        .when(tracked & (pct >= -5), "on par")
        .when(~tracked & strong, "historically strong")
        .when(tracked & (pct < -5), "not a win")
        .when(strong, "historically strong")
        .otherwise("skip")
    )


def content_score(brand: Column, popular: Column, pct: Column, usable: Column, near: Column, strength: Column, friday: Column, seasonal: Column, hook: Column) -> Column:
    """Eight capped parts, 100 at most."""
    scale = lambda c: F.when(c == "strong", 1.0).when(c == "moderate", 0.6).when(c == "weak", 0.3).otherwise(0.0)
    win = F.when(pct > 0, F.when(usable, F.least(F.lit(22.0), pct / 25 * 22)).otherwise(F.least(F.lit(6.0), pct / 25 * 6))).otherwise(0.0)
    parts = [F.when(brand, 15).otherwise(6), F.when(popular, 12).otherwise(2), F.round(win), F.when(near, 12).otherwise(0), F.round(scale(strength) * 15), F.when(friday, 6).otherwise(0), F.when(seasonal, 8).otherwise(0), F.round(scale(hook) * 10)]
    return F.least(F.lit(100), sum(p.cast("int") for p in parts))


def verdict(bucket: Column, n: Column, unit_price: Column, comparable: Column) -> Column:
    """Verdict of an offer against its history: gates first, then too little (0-1), early (2-3) and full history."""
    return (
        F.when(unit_price.isNull() | (unit_price <= 0), "invalid_offer")
        .when(~comparable, "not_comparable")
        .when(n <= 1, "insufficient_data")
        .when(n <= 3, "limited_data")
        .otherwise(F.regexp_replace(bucket, "[ -]", "_"))
    )


def buy_wait(on_sale: Column, discount: Column, vs_warehouse: Column, preview: Column, meaningful: int = 15, good: int = 5, lost: int = 25) -> Column:
    """Headline of a product card; vs_warehouse is the percentage above the warehouse."""
    return (
        F.when(preview & (discount >= meaningful), "strong preview deal")
        .when(preview & (discount >= good), "good preview deal")
        .when(~preview & on_sale & (discount >= meaningful), "great week to buy")
        .when(~preview & on_sale & (discount >= good), "good deal this week")
        .when(vs_warehouse <= 0, "grocer wins")
        .when(vs_warehouse > lost, "warehouse wins")
        .when(vs_warehouse.isNotNull(), "close enough")
        .when(~on_sale & ~preview, "wait for a sale")
        .otherwise("regular price")
    )


def script_safety(usable: Column, proxy: Column, pct: Column, gap: Column, manual: Column, strength: Column) -> Column:
    """How a shortlist item may be used in a script; pct is how much cheaper than the warehouse it is."""
    direct, near = usable & ~gap & pct.isNotNull(), proxy & ~gap
    return (
        F.when(manual, "manual verification")
        .when(direct & (pct >= 20), "lead-worthy")
        .when(direct & (pct >= 8), "strong supporting mention")
        .when(direct, "quick mention")
        .when(near & (pct > 0), "strong supporting mention")
        .when(F.lower(strength) == "strong", "strong supporting mention")
        .otherwise("quick mention")
    )


def can_say_cheaper(usable: Column, gap: Column, pct: Column) -> Column:
    return F.coalesce(usable & ~gap & (pct >= 8), F.lit(False))


def script_line(store: Column, warehouse_price: Column, gap: Column, pct: Column, proxy: Column, friday: Column, warehouse: str = "Warehouse") -> Column:
    """A line for the script: the percentage, rounded half to even, or the other angle; then what qualifies it."""
    compared = warehouse_price.isNotNull() & ~gap
    # The output texts.
    percent = F.bround(pct, 0).cast("long").cast("string")
    line = (
        F.when(~compared, F.lit(f"Good ad price, but no {warehouse} comparison available."))
        .when(pct >= 8, F.concat(store, F.lit(" is about "), percent, F.lit(f"% cheaper than {warehouse} on this.")))
        .otherwise(F.concat(F.lit(f"{warehouse} is similar or a little cheaper, but "), store, F.lit(" wins if you want variety or smaller quantity.")))
    )
    directional = F.when(proxy & compared, " This is a directional comparison, not exact.").otherwise("")
    return F.concat(line, directional, F.when(friday, " (Friday-only, not valid all week.)").otherwise(""))


def listed(items: Column) -> Column:
    """"a", "a and b" or "a, b, and c" of an array; nulls and empty texts are left out."""
    some = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(some)
    head = F.array_join(F.slice(some, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 2, F.array_join(some, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(some, -1)))


def price_words(price: Column) -> Column:
    return F.when(price.isNull(), "on sale").when(price == F.floor(price), F.concat(F.lit("$"), price.cast("long").cast("string"))).otherwise(F.format_string("$%.2f", price.cast("double")))


def shortlist_blurb(name: Column, price: Column, product_lines: Column, family_size: Column, accepted: Column, app_label: Column, week: str = "this week") -> Column:
    """The offer in a sentence. Family-size boxes are named line by line, but only where the gate accepted the offer."""
    said = price_words(price)
    named = family_size & (F.size(product_lines) > 0) & accepted
    # The output texts.
    boxes = F.concat(listed(product_lines), F.lit(" family-size boxes are "), said, F.lit(f" {week}, the app labels it as "), app_label, F.lit(", but those are the actual eligible items."))
    return F.when(named, boxes).otherwise(F.concat(name, F.lit(" are "), said, F.lit(f" {week}.")))
