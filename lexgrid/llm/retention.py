"""Cohort retention over a versioned start: what was known at each of several cuts of the arrival time.

A user's start is the time of the earliest opening event that is known. As events arrive late, it is a function of arrival: the
running minimum of event times by arrival makes a timeline of versions, each valid from the arrival that set it up to the one
that lowers it. An as-of join takes of each user the version that holds at a state's cut; the user's events known by then fall
into weeks since that start, and cells of state, segment, cohort week and period are summed.

DataFrame functions only. A task sorts one user's distinct arrivals of one hour, and of its days and of a day's hours only those
that lower the minimum so far; events of users with a share of 1/PIECES of all or more are met with their start in pieces. Sums
are made before each shuffle. The driver gets one number, the count of events; at most PIECES users are broadcast.

Defined cases: equal events (in all columns) count once; events without a time or user are left out; one without an arrival is
known to a cut of None only. Of a user's rows in the table of segments the one updated last holds (ties: the smallest segment);
without one, or with null, the segment is ''. A value that is null, infinite or not a number counts 0. An empty table gives no
cells. Times may have a zone or none; they are compared to the microsecond as they read in the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.common import Workspace

HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 7 * 86_400_000_000
#: After every arrival; and what a cut of None is.
NEVER, ALL = 2**62, 2**62 + 1
PIECES = 1024


def micros(at: Column) -> Column:
    """Microseconds since 1970 as the clock reads."""
    seconds = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(at)).cast("long") * DAY + F.hour(at).cast("long") * HOUR + F.minute(at).cast("long") * 60_000_000 + seconds


def floor_div(a: Column, b: int) -> Column:
    """a / b rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def events(clicks: DataFrame, user: str, at: str, arrives: str, kind: str, opening: str, value: str) -> DataFrame:
    """(u, t, a, opens, cents, r): distinct events, r being a hash of the whole row."""
    rows = clicks.where(F.col(at).isNotNull() & F.col(user).isNotNull()).distinct()
    v = F.col(value).cast("double")
    cents = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), 0).otherwise(F.floor(v * 100 + 0.5)).cast("long")
    return rows.select(
        F.col(user).alias("u"), micros(F.col(at)).alias("t"), F.coalesce(micros(F.col(arrives)), F.lit(NEVER)).alias("a"),
        F.coalesce(F.col(kind) == opening, F.lit(False)).alias("opens"), cents.alias("cents"), F.xxhash64(*[F.col(f"`{c}`") for c in clicks.columns]).alias("r"),
    )


def lowering(rows: DataFrame, keys: list[str], grain: int, into: str) -> DataFrame:
    """The rows (keys, a, t) whose t is below that of all rows of the same keys that arrive in an earlier grain; `into` is the grain."""
    placed = rows.withColumn(into, floor_div(F.col("a"), grain))
    least = placed.groupBy(*keys, into).agg(F.min("t").alias("least"))
    before = F.min("least").over(W.partitionBy(*keys).orderBy(into).rowsBetween(W.unboundedPreceding, -1))
    lower = least.withColumn("before", before).where("before IS NULL OR least < before").drop("least")
    return placed.join(lower, [*keys, into]).where("before IS NULL OR t < before").drop("before")


def timeline(found: DataFrame) -> DataFrame:
    """(u, start, known_from, known_to): the versions of each user's start; one holds at cuts c with known_from < c <= known_to."""
    opening = found.where("opens").groupBy("u", "a").agg(F.min("t").alias("t"))
    rows = lowering(lowering(opening, ["u"], DAY, "day"), ["u", "day"], HOUR, "hour")
    before = F.min("t").over(W.partitionBy("u", "day", "hour").orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    set_ = rows.withColumn("before", before).where("before IS NULL OR t < before")
    until = F.lead("a").over(W.partitionBy("u").orderBy("a"))
    return set_.select("u", F.col("t").alias("start"), F.col("a").alias("known_from"), F.coalesce(until, F.lit(ALL)).alias("known_to"))


def as_of(versions: DataFrame, cuts: Sequence[str | None]) -> DataFrame:
    """(state, cut, u, start, cohort, moved): each state's version of each user's start. A cut is a time, or None for all that ever arrives."""
    at = [F.lit(ALL) if c is None else micros(F.lit(c).cast("timestamp_ntz")) for c in cuts]
    states = F.array(*[F.struct(F.lit(i).alias("state"), c.cast("long").alias("cut")) for i, c in enumerate(at)])
    holds = F.filter(states, lambda s: (F.col("known_from") < s["cut"]) & (s["cut"] <= F.col("known_to")))
    picked = versions.select("u", "start", F.explode(holds).alias("s")).select("u", F.struct("s.state", "s.cut", "start", floor_div(floor_div(F.col("start"), DAY), 7).alias("cohort")).alias("x"))
    by_user = picked.groupBy("u").agg(F.collect_list("x").alias("xs"), (F.min("x.cohort") != F.max("x.cohort")).alias("moved"))  # a row a state
    return by_user.select("u", "moved", F.explode("xs").alias("x")).select("x.*", "u", "moved")


def segments(clients: DataFrame, user: str, segment: str, updated: str) -> DataFrame:
    """(u, segment): one row a user."""
    at = F.coalesce(micros(F.col(updated)), F.lit(-NEVER))
    newest = clients.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("u"), at.alias("at")).agg(F.min(F.coalesce(segment, F.lit(""))).alias("segment"))
    return newest.groupBy("u").agg(F.max_by("segment", "at").alias("segment"))


def retention(
    clicks: DataFrame, clients: DataFrame, cuts: Sequence[str | None], *, user: str = "client_id", at: str = "ts", arrives: str = "arrived_at", kind: str = "kind",
    opening: str = "error", value: str = "value", segment: str = "source", updated: str = "updated_at",
) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents): a row a nonempty cell.

    State i knows the events that arrive before cuts[i]. cohort: weeks from 1970 to the start's day; period: weeks from the start
    to the event. moved: users whose cohort differs between states.
    """
    space = Workspace(clicks.sparkSession)
    found = space.keep(events(clicks, user, at, arrives, kind, opening, value))
    least = max(1, -(-found.count() // PIECES))
    many = F.broadcast(found.groupBy("u").count().where(F.col("count") >= least).select("u", F.expr(f"count div {least}").alias("pieces")))  # PIECES rows at most
    starts = as_of(timeline(found), cuts).join(segments(clients, user, segment, updated), "u", "left").fillna("", ["segment"])
    starts = starts.join(many, "u", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    dealt = found.select("u", "t", "a", "cents", "r").join(many, "u", "left").withColumn("piece", F.pmod("r", F.coalesce("pieces", F.lit(1)))).drop("pieces", "r")
    met = dealt.join(starts, ["u", "piece"]).where((F.col("a") < F.col("cut")) & (F.col("t") >= F.col("start")))
    seen = met.groupBy("state", "segment", "cohort", floor_div(F.col("t") - F.col("start"), WEEK).alias("period"), "u", "moved").agg(F.sum("cents").alias("cents"))
    return seen.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(F.crc32(F.col("u").cast("string").cast("binary"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents")
    )
