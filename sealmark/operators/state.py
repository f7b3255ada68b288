"""State of a claim, derived from rows each time and never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.operators.latest import latest
from sealmark.schema import EXITS, TERMINAL


def stale_reason(parts: list[tuple[str, Column, Column]]) -> Column:
    """Name of the first part whose value then and now differ; null if none does."""
    out = None
    for name, then, now in parts:
        moved = ~then.eqNullSafe(now)
        out = F.when(moved, name) if out is None else out.when(moved, name)
    return out if out is not None else F.lit(None).cast("string")


def claim_state(retracted: Column, signed: Column, exit_code: Column, repo_signed: Column, stale: Column) -> Column:
    """Precedence: retracted; signed for as it stands; open (never tried, or failed); what cannot be checked, unless signed
    for the whole repository; other exits by name; answered but stale; answered."""
    other = F.create_map(*(F.lit(x) for kv in EXITS.items() for x in kv))
    return (
        F.when(retracted, "RETRACTED")
        .when(signed, "RISK_ACCEPTED")
        .when(exit_code.isNull() | (exit_code == 1), "OPEN")
        .when((exit_code == 4) & repo_signed, "RISK_ACCEPTED")
        .when(exit_code != 0, F.coalesce(F.try_element_at(other, exit_code), F.lit("UNKNOWN_EXIT")))
        .when(stale.isNotNull(), "STALE")
        .otherwise("ANSWERED")
    )


def states(claims: DataFrame, attempts: DataFrame, signed: DataFrame, retracted: DataFrame, current: DataFrame | None = None, repo_signed: DataFrame | None = None) -> DataFrame:
    """``claims`` with ``state`` and ``reason``.

    ``attempts`` has claim_id, id, exit_code, subject_digest; ``retracted`` and ``repo_signed`` name claims; ``current``
    is (claim_id, digest), what a claim's answer depends on now. ``signed`` has claim_id, id and key, what each signature
    was given for: only the newest one of a claim counts, and only while its key is what is current. A null key covers nothing.
    """
    last = latest(attempts.select("claim_id", "id", "exit_code", "subject_digest"), "claim_id").withColumnRenamed("id", "attempt_id")
    flag = lambda d, n: d.select("claim_id").distinct().withColumn(n, F.lit(True))
    out = claims.withColumnRenamed("id", "claim_id").join(last, "claim_id", "left")
    newest = latest(signed.select("claim_id", "id", F.col("key").cast("string").alias("_key")), "claim_id").drop("id")
    out = out.join(newest, "claim_id", "left")
    for rows, name in ((retracted, "_r"), (repo_signed if repo_signed is not None else signed.limit(0), "_p")):
        out = out.join(flag(rows, name), "claim_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    covered = F.lit(False)
    if current is None:
        reason = F.lit(None).cast("string")
    else:
        out = out.join(current.select("claim_id", F.col("digest").alias("_now")), "claim_id", "left")
        reason = F.when(F.col("_now").isNotNull(), stale_reason([("subject", F.col("subject_digest").cast("string"), F.col("_now").cast("string"))]))
        covered = F.coalesce(F.col("_key") == F.col("_now").cast("string"), F.lit(False))
    state = claim_state(F.col("_r"), covered, F.col("exit_code"), F.col("_p"), reason)
    return out.withColumns({"state": state, "reason": F.when(state == "STALE", reason)}).drop("_key", "_r", "_p", "_now").withColumnRenamed("claim_id", "id")


def escalates(open_same_kind: Column, age_days: Column, distinct_fails: Column, most_open: Column, most_days: Column, most_fails: Column) -> Column:
    """Why a claim that only reports blocks after all; null if it does not. Bounds are exceeded strictly; the first wins."""
    return F.when(open_same_kind > most_open, "open").when(age_days > most_days, "age").when(distinct_fails > most_fails, "repeat")


def blocks_and_reports(open_claims: DataFrame, gate: Column, why: Column) -> DataFrame:
    """Each open claim under ``block``, ``report`` or, if it reports and escalates, both."""
    sides = F.when(gate == "ship", F.array(F.lit("block"))).when(why.isNotNull(), F.array(F.lit("block"), F.lit("report"))).otherwise(F.array(F.lit("report")))
    return open_claims.withColumn("escalation", why).withColumn("side", F.explode(sides))


def action(state: Column) -> Column:
    """What is to be done next."""
    return F.when(state.isin(*TERMINAL), "none").when(state == "OPEN", "fix").when(state == "STALE", "check").when(state == "UNSUPPORTED", "sign").otherwise("rerun")


def waiting(with_state: DataFrame) -> DataFrame:
    return with_state.filter(~F.col("state").isin(*TERMINAL)).withColumn("action", action(F.col("state")))


def orphans(claims: DataFrame, seen: DataFrame, healthy: DataFrame, detector: str) -> DataFrame:
    """Claims that their detector did not raise again, if that detector ran well."""
    return claims.join(seen.select("id").distinct(), "id", "left_anti").join(healthy.select(detector).distinct(), detector, "left_semi")


def task_report(with_state: DataFrame, gate: Column, why: Column) -> DataFrame:
    """Every claim with ``blocks`` and ``reports``: what waits blocks if its kind gates or it escalates, and is reported if its kind does not gate."""
    waits = ~F.col("state").isin(*TERMINAL)
    return with_state.withColumns({"blocks": waits & ((gate == "ship") | why.isNotNull()), "reports": waits & (gate != "ship")})


def carried_state(retracted: Column, state: Column) -> Column:
    """State for a report on history: retraction is known from the ledger alone; what cannot be derived is the empty string."""
    return F.when(retracted, "RETRACTED").otherwise(F.coalesce(state, F.lit("")))


def may_ship(with_state: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, blocked, ok) by task: a task ships if nothing waits."""
    waits = F.count_if(~F.col("state").isin(*TERMINAL))
    return with_state.groupBy(task).agg(waits.alias("blocked"), (waits == 0).alias("ok"))
