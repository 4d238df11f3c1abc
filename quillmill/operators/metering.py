"""Usage under daily caps: admission, counts, quota views and burst windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caps:
    """Calls a day per user, all users, and for the auxiliary operations; bursts per window."""

    user: int = 5
    anonymous: int = 2
    user_aux: int = 50
    anonymous_aux: int = 30
    total: int = 800
    total_aux: int = 400
    burst: int = 12
    burst_seconds: int = 60


def operation(header: Column) -> Column:
    """``aux`` for an interview or a chat, else ``persona``."""
    return F.when(F.lower(F.trim(F.coalesce(header, F.lit("")))).isin("interview", "chat"), "aux").otherwise("persona")


def cap_of(op: Column, anonymous: Column, caps: Caps) -> Column:
    return F.when(op == "aux", F.when(anonymous, caps.anonymous_aux).otherwise(caps.user_aux)).otherwise(F.when(anonymous, caps.anonymous).otherwise(caps.user))


def usage_daily(events: DataFrame, ts: str = "ts", user: str = "user", op: str = "op") -> DataFrame:
    """day, user, op, n: the usage counter as an aggregate of the event log."""
    return events.groupBy(F.to_date(ts).alias("day"), user, op).agg(F.count("*").alias("n"))


def admission(events: DataFrame, caps: Caps, ts: str = "ts", user: str = "user", op: str = "op", event_id: str = "event_id", anonymous: Column | None = None, failed: Column | None = None) -> DataFrame:
    """events with day, admitted and reason (null, ``global``, ``aux_global`` or ``user``).

    Calls are taken in order of (ts, event_id). A call is refused if the day's admitted
    calls are at the global cap, else if it is auxiliary and those are at theirs, else
    if the user's own are at the user's cap. A call that is let in but then ``failed``
    is given back before the next one, so it counts for nobody. Only limited row
    numbers are computed, so no task holds a day's whole log: calls beyond the caps
    only need to be compared with the call that filled them.
    """
    anonymous = F.lit(False) if anonymous is None else anonymous
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    at = F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i"))
    rows = events.withColumns({"day": F.to_date(ts), "_at": at, "_cap": cap_of(F.col(op), anonymous, caps), "_failed": failed})
    slim = rows.where("not _failed").select("day", user, op, "_at", "_cap")
    order = lambda *keys: Window.partitionBy(*keys).orderBy("_at")
    most = max(caps.user, caps.anonymous, caps.user_aux, caps.anonymous_aux)
    own = slim.withColumn("_r", F.row_number().over(order("day", user, op))).where(F.col("_r") <= most).where("_r <= _cap")
    aux = own.where(F.col(op) == "aux").withColumn("_r", F.row_number().over(order("day"))).where(F.col("_r") <= caps.total_aux)
    both = own.where(F.col(op) != "aux").unionByName(aux)
    let_in = both.withColumn("_n", F.row_number().over(order("day"))).where(F.col("_n") <= caps.total).select("day", "_at", F.col(op).alias("_op"), "_n", F.col(user).alias("_user"), "_cap")
    full = let_in.groupBy("day").agg(
        F.max(F.when(F.col("_n") == caps.total, F.col("_at"))).alias("_full"),
        F.when(F.count(F.when(F.col("_op") == "aux", 1)) >= caps.total_aux, F.max(F.when(F.col("_op") == "aux", F.col("_at")))).alias("_aux_full"),
    )
    own_full = let_in.groupBy(F.col("day").alias("_day"), "_user", "_op").agg(F.when(F.count("*") >= F.max("_cap"), F.max("_at")).alias("_own_full"))
    out = rows.join(let_in.select("day", "_at", F.lit(True).alias("_in")), ["day", "_at"], "left").join(full, "day", "left")
    after = lambda c: F.coalesce(F.col("_at") > F.col(c), F.lit(False))
    shared = F.when(after("_full"), "global").when((F.col(op) == "aux") & after("_aux_full"), "aux_global")
    kept = out.where("not _failed").withColumn("reason", F.when(F.coalesce("_in", F.lit(False)), F.lit(None)).otherwise(F.coalesce(shared, F.lit("user"))))
    same = F.col("day").eqNullSafe(F.col("_day")) & F.col(user).eqNullSafe(F.col("_user")) & F.col(op).eqNullSafe(F.col("_op"))
    lost = out.where("_failed").join(own_full, same, "left").drop("_day", "_user", "_op").withColumn("reason", F.coalesce(shared, F.when(after("_own_full"), "user")))
    done = kept.unionByName(lost.drop("_own_full"))
    return done.withColumn("admitted", F.col("reason").isNull()).select(*events.columns, "day", "admitted", "reason")


def quota_message(user: Column, remaining: Column, limit: Column, resets_at: Column | None = None) -> Column:
    """A line on what is left today; only the name where the quota is not known."""
    tail = F.lit("") if resets_at is None else F.coalesce(F.concat(F.lit(" Resets "), F.nullif(resets_at, F.lit("")), F.lit(".")), F.lit(""))
    who = F.concat(F.lit("Signed in as "), F.coalesce(user, F.lit("you")), F.lit("."))
    return F.coalesce(F.concat(who, F.lit(" "), remaining.cast("string"), F.lit(" of "), limit.cast("string"), F.lit(" personas left today."), tail), who)


def quota_view(usage: DataFrame, caps: Caps, user: str = "user", op: str = "op") -> DataFrame:
    """day, user, used, cap, remaining, aux_used, aux_cap, aux_remaining, resets_at from usage_daily's rows."""
    used = F.sum(F.when(F.col(op) != "aux", F.col("n")).otherwise(0))
    aux = F.sum(F.when(F.col(op) == "aux", F.col("n")).otherwise(0))
    per = usage.groupBy("day", user).agg(used.alias("used"), aux.alias("aux_used"))
    left = lambda c, cap: F.greatest(F.lit(cap) - F.col(c), F.lit(0))
    return per.select("day", user, "used", F.lit(caps.user).alias("cap"), left("used", caps.user).alias("remaining"), "aux_used", F.lit(caps.user_aux).alias("aux_cap"), left("aux_used", caps.user_aux).alias("aux_remaining"), F.date_add("day", 1).cast("timestamp").alias("resets_at"))


def burst_windows(events: DataFrame, caps: Caps, ts: str = "ts", user: str = "user") -> DataFrame:
    """user, window_start, n, limited: tumbling windows, our reading of a limit of so many calls per period."""
    per = events.groupBy(F.col(user), F.window(ts, f"{caps.burst_seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return per.select(user, F.col("w.start").alias("window_start"), "n", (F.col("n") > caps.burst).alias("limited"))


def anonymous_id(address: Column, salt: str) -> Column:
    """The first 8 bytes of a salted SHA-256, in hex."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), address), 256), 1, 16)


def request_status(model: Column, method: Column, size: Column, allowed: list[str], stream: bool = True, most: int = 6 << 20) -> Column:
    """Why a request is refused before it is charged; null if it is not."""
    methods = ["generateContent", *(["streamGenerateContent"] if stream else [])]
    return F.when(~model.isin(allowed), "model").when(~method.isin(methods), "method").when(size > most, "size")


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429, 500, 502, 503, 504) | (status >= 500)


def backoff_seconds(attempt: Column, retry_after: Column | None = None, most: float = 20.0) -> Column:
    """Doubling from one second; a server's Retry-After (a number that is not negative) raises it; ``most`` at last."""
    own = F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    if retry_after is None:
        return own
    told = retry_after.try_cast("double")
    return F.when(told >= 0, F.least(F.greatest(own, told), F.lit(most))).otherwise(own)
