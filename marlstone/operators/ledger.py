"""A ledger of batch jobs: state changes, and a guard before a new job is made."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Job states and spend bounds in dollars.
TERMINAL = ["JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"]
ACTIVE = ["JOB_STATE_PENDING", "JOB_STATE_RUNNING", "JOB_STATE_QUEUED", "JOB_STATE_UPDATING", "JOB_STATE_CANCELLING"]
RESERVE, SOFT_STOP, HARD_BLOCK = Decimal("0.50"), Decimal("7.50"), Decimal("10.00")

SCHEMA = "run_id string, job_name string, state string, estimated_cost decimal(18,6), created_at timestamp, updated_at timestamp"


def with_state(ledger: DataFrame, job_name: str, state: str | None, moment) -> DataFrame:
    """The ledger with a job's new state; a state that is not known is kept as UNKNOWN, which blocks new jobs. A job that does not stand there exactly once is an error."""
    if ledger.where(F.col("job_name") == job_name).limit(2).count() != 1:
        raise ValueError(f"job {job_name} must stand in the ledger exactly once")
    known = state if state in TERMINAL + ACTIVE else "UNKNOWN"
    hit = F.col("job_name").eqNullSafe(F.lit(job_name))
    return ledger.withColumn("state", F.when(hit, F.lit(known)).otherwise(F.col("state"))).withColumn("updated_at", F.when(hit, F.lit(moment)).otherwise(F.col("updated_at")))


def guard(ledger: DataFrame, estimate: DataFrame, spent: str, allow_soft_stop: bool = False) -> DataFrame:
    """(state, created_at) of jobs and one row (cost) to one row (latest_state, projected, verdict).

    A latest job that has not ended blocks; then the cost so far, a reserve and the estimate are held
    against the hard bound and, unless it is waived, the soft one. An empty ledger blocks nothing.
    """
    order = F.struct(F.col("created_at"), F.col("job_name"))
    latest = ledger.agg(F.count("*").alias("jobs"), F.max_by("state", order).alias("state"))
    known = F.when(F.col("state").isin(TERMINAL + ACTIVE), F.col("state")).otherwise("UNKNOWN")
    money = "decimal(18,6)"
    projected = (F.lit(spent).cast(money) + F.lit(RESERVE).cast(money) + F.col("cost").cast(money)).cast(money)
    rows = estimate.select("cost").crossJoin(F.broadcast(latest)).select(F.when(F.col("jobs") > 0, known).alias("latest_state"), projected.alias("projected"))
    soft = F.lit(not allow_soft_stop) & (F.col("projected") >= F.lit(SOFT_STOP))
    verdict = F.when(F.col("latest_state").isNotNull() & ~F.coalesce(F.col("latest_state").isin(TERMINAL), F.lit(False)), "blocked by the latest job")
    return rows.withColumn("verdict", verdict.when(F.col("projected") >= F.lit(HARD_BLOCK), "hard block").when(soft, "soft stop").otherwise("allowed"))


def with_job(ledger: DataFrame, run_id: str, job_name: str, estimate: DataFrame, spent: str, moment) -> DataFrame:
    """The ledger with a new pending job; an error where the guard does not allow it."""
    found = guard(ledger, estimate, spent).first()
    if found["verdict"] != "allowed":
        raise ValueError(found["verdict"])
    new = estimate.select(F.lit(run_id).alias("run_id"), F.lit(job_name).alias("job_name"), F.lit("JOB_STATE_PENDING").alias("state"), F.col("cost").cast("decimal(18,6)").alias("estimated_cost"), F.lit(moment).alias("created_at"), F.lit(moment).alias("updated_at"))
    return ledger.unionByName(new)
