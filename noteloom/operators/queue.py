"""The work queue as snapshots: jobs (kind, target_id, state, attempts, next_after, last_error, created_at), keyed by (kind, target_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS, BASE_DELAY, FACTOR, MOST_DELAY = 3, 2.0, 4.0, 300.0
KEYS = ["kind", "target_id"]
SCHEMA = "kind string, target_id string, state string, attempts int, next_after double, last_error string, created_at double"


def backoff(attempts: Column) -> Column:
    return F.least(F.lit(MOST_DELAY), F.lit(BASE_DELAY) * F.pow(F.lit(FACTOR), F.greatest(F.lit(0), attempts - 1)))


def enqueue(jobs: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """wanted (kind, target_id) as pending jobs, whatever their state was; created_at stays."""
    old = jobs.select(*KEYS, F.col("created_at").alias("__old"))
    new = wanted.select(*KEYS).distinct().join(old, KEYS, "left").select(*KEYS, F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(now).alias("next_after"), F.lit(None).cast("string").alias("last_error"), F.coalesce("__old", F.lit(now)).alias("created_at"))
    return jobs.join(wanted.select(*KEYS), KEYS, "left_anti").unionByName(new)


def claimable(jobs: DataFrame, kind: str, limit: int, now: float) -> DataFrame:
    return jobs.filter((F.col("kind") == kind) & (F.col("state") == "pending") & (F.col("next_after") <= now)).orderBy("next_after", "created_at", "target_id").limit(limit)


def mark_running(jobs: DataFrame, claimed: DataFrame) -> DataFrame:
    hit = claimed.select(*KEYS).withColumn("__hit", F.lit(True))
    return jobs.join(hit, KEYS, "left").withColumn("state", F.when(F.col("__hit"), F.lit("running")).otherwise(F.col("state"))).drop("__hit")


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select(*KEYS), KEYS, "left_anti").select(*jobs.columns)


def failed(jobs: DataFrame, failures: DataFrame, now: float) -> DataFrame:
    """failures (kind, target_id, transient, error): a transient one waits the first delay and is not counted; else the attempt counts, and the last one is final."""
    hit = failures.groupBy(*KEYS).agg(F.bool_and("transient").alias("__t"), F.max("error").alias("__e"))
    out = jobs.join(hit, KEYS, "left")
    struck = F.col("__t").isNotNull()
    attempts = F.when(struck & ~F.col("__t"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    over = struck & ~F.col("__t") & (F.col("attempts") + 1 >= MOST_ATTEMPTS)
    delay = F.when(F.col("__t"), backoff(F.lit(1))).otherwise(backoff(F.col("attempts") + 1))
    return out.select(
        *KEYS,
        F.when(over, "failed").when(struck, "pending").otherwise(F.col("state")).alias("state"),
        attempts.alias("attempts"),
        F.when(struck & ~over, F.lit(now) + delay).otherwise(F.col("next_after")).alias("next_after"),
        F.when(struck, F.col("__e")).otherwise(F.col("last_error")).alias("last_error"),
        "created_at",
    )


def retry_failed(jobs: DataFrame, now: float) -> DataFrame:
    f = F.col("state") == "failed"
    return jobs.withColumns({"attempts": F.when(f, 0).otherwise(F.col("attempts")), "next_after": F.when(f, now).otherwise(F.col("next_after")), "last_error": F.when(~f, F.col("last_error")), "state": F.when(f, "pending").otherwise(F.col("state"))})


def reclaim(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "failed")))


def next_due(jobs: DataFrame, now: float) -> DataFrame:
    """(seconds): until the next pending job, between 1 and 60; 5 if there is none."""
    wait = F.min(F.when(F.col("state") == "pending", F.col("next_after"))) - now
    return jobs.agg(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(60.0), wait)), F.lit(5.0)).alias("seconds"))


def folded(attempts: DataFrame) -> DataFrame:
    """State of each job after its attempts (kind, target_id, seq, at, outcome: success, permanent or transient), in order of seq."""
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(0.0).alias("next_after"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x["outcome"] == "permanent", acc["attempts"] + 1).otherwise(acc["attempts"])
        over = (x["outcome"] == "permanent") & (n >= MOST_ATTEMPTS)
        delay = F.when(x["outcome"] == "permanent", backoff(n)).otherwise(backoff(F.lit(1)))
        live = F.struct(F.when(over, "failed").otherwise("pending").alias("state"), n.alias("attempts"), F.when(over, acc["next_after"]).otherwise(x["at"] + delay).alias("next_after"))
        done = F.struct(F.lit("done").alias("state"), acc["attempts"].alias("attempts"), acc["next_after"].alias("next_after"))
        return F.when(acc["state"].isin("done", "failed"), acc).when(x["outcome"] == "success", done).otherwise(live)

    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", "outcome")))
    return attempts.groupBy(*KEYS).agg(F.aggregate(ordered, start, step).alias("x")).select(*KEYS, "x.*")
