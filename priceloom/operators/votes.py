"""Votes, suggestions and finds from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from priceloom.functions.dims import dimension


def first_votes(events: DataFrame, item: str = "item", user: str = "user") -> DataFrame:
    """One vote per item and user, the earliest."""
    order = Window.partitionBy(item, user).orderBy("ts", "event_id")
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def vote_totals(items: DataFrame, events: DataFrame, item: str = "item", user: str = "user") -> DataFrame:
    """Votes per item, zeros kept. Pairs are made distinct first, so a popular item combines before it shuffles."""
    votes = events.select(item, user).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("votes"))
    return items.join(votes, item, "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))


def poll_shares(totals: DataFrame, poll: str) -> DataFrame:
    """Options with their poll's total and their share."""
    every = Window.partitionBy(poll)
    return totals.withColumn("poll_total", F.sum("votes").over(every)).withColumn("share", F.when(F.col("poll_total") > 0, F.col("votes") / F.col("poll_total")))


def rank_votes(items: DataFrame) -> DataFrame:
    """Votes, then the earliest approval and creation (missing ones last), then id."""
    order = [F.col("votes").desc(), F.col("approved_at").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("item")]
    # Equal counts stand together, so a rank is the items with more votes and the place among those with as many.
    counts = items.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("votes", F.coalesce(F.sum("n").over(Window.orderBy(F.col("votes").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("votes").orderBy(*order))
    return items.join(dimension(before), "votes").withColumn("vote_rank", (F.col("before") + place).cast("int")).drop("before")


def live_finds(finds: DataFrame, now: Column, n: int = 50) -> DataFrame:
    """The n newest approved finds that have not expired."""
    return finds.where((F.col("status") == "approved") & (F.col("expires_at") > now)).orderBy(F.col("created_at").desc(), F.col("id")).limit(n)


#: Fixed value: the day of events without a time, before all others.
NO_DAY = -(2**40)


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def _day(events: DataFrame) -> Column:
    """A number that grows with ts by one a day; one for all where ts is neither a time nor a date."""
    kind = events.schema["ts"].dataType
    days = F.floor(F.unix_seconds("ts") / 86400) if isinstance(kind, TimestampType) else F.unix_date(F.to_date("ts")) if isinstance(kind, TimestampNTZType | DateType) else F.lit(0)
    return F.coalesce(days.cast("long"), F.lit(NO_DAY))


def vote_batch(items: DataFrame, events: DataFrame, voters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (item, status, votes) and the new voters (item, user) after a batch of events (event_id, ts, kind, item, raw_text,
    user, merge_into).

    A vote counts if its item is approved when it is cast, once per user over all batches; voters holds those counted
    before. A suggestion of an approved name votes for it, of another known name does nothing, of a new name adds a
    pending item. Approve, reject and merge change the status from then on, if the item exists; a merge gives its target
    one vote if that is approved then. Votes without a user and suggestions of blank names do nothing.

    A vote takes the status that its item's changes have left, in the order of time. Items are cut into days, each of which
    begins with the status that the days before have left; so a popular item is no single group, and the work is a sort.
    """
    at = F.struct("ts", "event_id")
    named = events.withColumn("item", F.when(F.col("kind") == "suggest", normalized_name(F.col("raw_text"))).otherwise(F.col("item"))).where("item IS NOT NULL AND item <> ''").withColumns({"at": at, "day": _day(events)})
    first = F.lit(None).cast(named.schema["at"].dataType)
    known = items.select("item", first.alias("since"), F.col("status").alias("begun"))
    fresh = named.where("kind = 'suggest'").join(items.select("item"), "item", "left_anti").groupBy("item").agg(F.min("at").alias("since")).withColumn("begun", F.lit("pending"))
    begun = known.unionByName(fresh)
    states = {"approve": "approved", "reject": "rejected", "merge": "merged"}
    kind, none = F.col("kind"), F.lit(None).cast("string")
    step = lambda item, user, status: F.struct(item.alias("item"), user.alias("user"), status.alias("status"))
    changed = F.when(kind.isin(*states), step(F.col("item"), none, F.coalesce(*[F.when(kind == k, v) for k, v in states.items()])))
    direct = F.when(kind.isin("vote", "suggest") & F.col("user").isNotNull(), step(F.col("item"), F.col("user"), none))
    merged = F.when((kind == "merge") & F.col("merge_into").isNotNull(), step(F.col("merge_into"), F.concat(F.lit("merge:"), F.col("item")), none))
    steps = named.select("day", "at", F.explode(F.array_compact(F.array(changed, direct, merged))).alias("s")).select("s.*", "day", "at")
    steps = steps.join(begun, "item").where("since IS NULL OR at > since")
    days = steps.groupBy("item", "begun", "day").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("left"))
    before = F.last("left", ignorenulls=True).over(Window.partitionBy("item").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    starts = days.select("item", "day", first.alias("at"), none.alias("user"), F.coalesce(before, "begun").alias("status"))
    # At one time a vote comes before a change.
    in_order = Window.partitionBy("item", "day").orderBy(F.col("at").asc_nulls_first(), F.col("status").isNotNull())
    cast = starts.unionByName(steps.select("item", "day", "at", "user", "status")).withColumn("held", F.last("status", ignorenulls=True).over(in_order))
    new = cast.where("user IS NOT NULL AND held = 'approved'").select("item", "user").distinct()
    new = new.join(voters.select("item", "user"), ["item", "user"], "left_anti") if voters is not None else new
    ends = days.groupBy("item").agg(F.max_by("left", F.when(F.col("left").isNotNull(), F.col("day"))).alias("end"))
    last = begun.join(ends, "item", "left").select("item", F.coalesce("end", "begun").alias("status"))
    added = new.groupBy("item").agg(F.count(F.lit(1)).alias("added"))
    votes = F.coalesce(F.col("votes").cast("long"), F.lit(0)) + F.coalesce("added", F.lit(0))
    return last.join(items.select("item", "votes"), "item", "left").join(added, "item", "left").select("item", "status", votes.alias("votes")), new


def apply_vote_events(items: DataFrame, events: DataFrame, voters: DataFrame | None = None) -> DataFrame:
    """The items of vote_batch."""
    return vote_batch(items, events, voters)[0]


#: Days that a find stays after it is approved.
FIND_DAYS = 3


def apply_find_events(finds: DataFrame, events: DataFrame, days: int = FIND_DAYS) -> DataFrame:
    """Finds (id, status, expires_at, votes) after events (event_id, ts, kind, id, voter), with the reports added.

    The last approval or rejection gives the status; every approval restarts the time to live, a rejection leaves it. Each
    voter counts once for a find; votes without a voter and events of unknown finds do nothing. Voters are made distinct
    first and events combine before they shuffle, so a popular find is no burden.
    """
    at = F.struct("ts", "event_id")
    decided = F.col("kind").isin("approve", "reject")
    sums = events.groupBy("id").agg(
        F.max_by("kind", F.when(decided, at)).alias("_last"), F.max(F.when(F.col("kind") == "approve", F.col("ts"))).alias("_approved"), F.count_if(F.col("kind") == "report").alias("reports")
    )
    voters = events.where("kind = 'vote' AND voter IS NOT NULL").select("id", "voter").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("_votes"))
    rows = finds.join(sums, "id", "left").join(voters, "id", "left")
    status = F.when(F.col("_last") == "approve", "approved").when(F.col("_last") == "reject", "rejected").otherwise(F.col("status"))
    none = F.lit(0).cast("long")
    return rows.select(
        "id",
        status.alias("status"),
        F.coalesce(F.col("_approved") + F.make_dt_interval(F.lit(days)), "expires_at").alias("expires_at"),
        (F.coalesce(F.col("votes").cast("long"), none) + F.coalesce("_votes", none)).alias("votes"),
        F.coalesce("reports", none).alias("reports"),
    )
