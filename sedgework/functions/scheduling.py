"""Scheduling policy as column expressions: backoff, deadlines, next states, admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import HANDOFF_DELAY, MAX_ATTEMPTS, MAX_HANDOFFS, RECOVERY_DELAY


def backoff(base: Column, failures: Column) -> Column:
    return F.least(F.lit(300.0), base * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6))))


def request_backoff(attempt: Column) -> Column:
    return F.least(F.lit(40.0), 5 * F.pow(F.lit(2.0), attempt - 1))


def route_wait(failures: Column) -> Column:
    return F.when(failures >= 3, F.least(F.lit(300.0), F.lit(30.0) * failures)).otherwise(0.0)


def retry_after(header: Column, now_us: Column) -> Column:
    """Seconds to wait: a number, an HTTP date, or 60."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), (F.unix_micros(date) - now_us) / 1e6, F.lit(60.0)))


def request_deadline(host_limit: Column, route: Column) -> Column:
    return F.struct(F.greatest(host_limit, route).alias("deadline"), F.when(host_limit >= route, "rate-limit").otherwise("route").alias("label"))


def next_state(outcome: Column, partial: Column, attempt: Column, handoffs: Column, permanent: Column, most: int = MAX_ATTEMPTS) -> Column:
    """(state, attempt, handoffs) after a run; state null where nothing follows."""
    s = lambda state, a, h: F.struct(F.lit(state).cast("string").alias("state"), a.cast("int").alias("attempt"), h.cast("int").alias("handoffs"))
    return (
        F.when(outcome.isin("success", "cancelled"), s(None, attempt, handoffs))
        .when(outcome == "deferred", s("DEFERRED_ROUTE", attempt, handoffs))
        .when(partial & ~permanent & (handoffs < MAX_HANDOFFS), s("HANDOFF_READY", attempt, handoffs + 1))
        .when(permanent | (attempt >= most), s("PERMANENTLY_FAILED", attempt, handoffs))
        .otherwise(s("RECOVERY_READY", attempt + 1, F.lit(0)))
    )


def next_job(
    outcome: Column, partial: Column, attempt: Column, handoffs: Column, permanent: Column, failures: Column, until: Column, now: Column,
    reason: Column, retry_class: Column | None = None, rate_limited: Column | None = None, most: int = MAX_ATTEMPTS,
) -> Column:
    """``next_state`` with what the next run needs: (state, attempt, handoffs, failures, not_before, reason).

    Times are seconds.  ``until`` is the latest deadline that hosts and routes gave (null: none) and is never
    undercut.  A deferral is no failure: it waits 0.05 s at least, under its retry class if it has one.  A hand-off
    waits HANDOFF_DELAY, a recovery RECOVERY_DELAY doubled with each failure in a row; what failed for good waits for nothing.
    """
    limited = F.coalesce(rate_limited, F.lit(False)) if rate_limited is not None else F.lit(False)
    n = next_state(outcome, partial, attempt, handoffs, permanent, most)
    deferred = n["state"].startswith("DEFERRED")
    state = F.when(deferred, F.coalesce(retry_class if retry_class is not None else F.lit(None), F.when(limited, "DEFERRED_RATE_LIMIT"), n["state"])).otherwise(n["state"])
    count = (F.coalesce(failures, F.lit(0)) + 1).cast("int")
    wait = F.when(deferred, 0.05).when(n["state"] == "HANDOFF_READY", HANDOFF_DELAY).otherwise(backoff(F.lit(RECOVERY_DELAY), count))
    not_before = F.when(n["state"] == "PERMANENTLY_FAILED", 0.0).otherwise(F.greatest(until.cast("double"), now + wait))
    why = F.coalesce(reason, F.when(deferred, "Admission deferred").otherwise("Transfer did not complete"))
    goes_on = n["state"].isNotNull()
    return F.struct(
        state.alias("state"), n["attempt"].alias("attempt"), n["handoffs"].alias("handoffs"),
        F.when(goes_on & ~deferred, count).otherwise(F.coalesce(failures, F.lit(0))).cast("int").alias("failures"),
        F.when(goes_on, not_before).alias("not_before"), F.when(goes_on, why).alias("reason"),
    )


def attempt_guard(attempt: Column, most: int = MAX_ATTEMPTS) -> Column:
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(most), attempt)).alias("attempt"), F.when(attempt.between(1, most), "DOWNLOADING").otherwise("PERMANENTLY_FAILED").alias("status"))


def admission(not_before: Column, now: Column, kind: Column, attempt: Column) -> Column:
    """A deferred outcome with its deadline and class, at the same attempt, or CONNECTING."""
    wait = F.coalesce(not_before > now, F.lit(False))
    return F.struct(F.when(wait, "DEFERRED").otherwise("CONNECTING").alias("state"), F.when(wait, not_before).alias("not_before"), F.when(wait, kind).alias("kind"), attempt.alias("attempt"))


def slot(kind: Column, rank: Column) -> Column:
    """Place of the rank-th job of a kind in the cycle primary, primary, handoff, primary, recovery."""
    k = rank - 1
    return F.when(kind == "primary", F.floor(k / 3) * 5 + F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (k % 3 + 1).cast("int"))).when(kind == "handoff", k * 5 + 2).otherwise(k * 5 + 4).cast("long")


def distributed_admission(failed: Column, completed: Column, verified: Column, reservable: Column, claimable: Column, target: Column, broken: Column) -> Column:
    """(action, delay in seconds): what a worker does with a document of a shared run."""
    a = lambda action, delay: F.struct(F.lit(action).alias("action"), F.lit(delay).alias("delay"))
    return (
        F.when(broken, a("wait", 20)).when(failed, a("stop", 0)).when(completed & verified, a("reuse", 0)).when(completed, a("invalidate", 0))
        .when(~reservable, a("wait", 1)).when(~claimable & target, a("stop", 0)).when(~claimable, a("wait", 5)).otherwise(a("run", 0))
    )
