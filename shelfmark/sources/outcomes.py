"""Request logs to outcomes and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed_values import LOW_BUDGET, MAX_ATTEMPTS, WAIT_BUFFER_SECONDS

TERMINAL = ["ok", "not_modified", "not_found", "auth_error"]


def outcome(status: Column, body: Column) -> Column:
    limited = F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("rate limit"))
    return (
        F.when(status == 304, "not_modified")
        .when(status == 404, "not_found")
        .when(status.isin(401, 403) & limited, "rate_limited")
        .when(status.isin(401, 403), "auth_error")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(status >= 400, "http_error")
        .when(status.isNull(), "http_error")
        .otherwise("ok")
    )


def final_outcomes(attempts: DataFrame, request: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcome each request ends with: its first terminal attempt, else its last allowed one.

    ``attempts`` has ``attempt`` (from 1) and ``outcome``.  Plain aggregates, so a
    request that fills the log is combined before the shuffle.
    """
    allowed = F.col("attempt") <= max_attempts
    ends = allowed & F.col("outcome").isin(TERMINAL)
    per_request = attempts.groupBy(*request).agg(
        F.min(F.when(ends, F.struct("attempt", "outcome"))).alias("first_end"),
        F.max(F.when(allowed, F.struct("attempt", "outcome"))).alias("last"),
    )
    end = F.coalesce("first_end", "last")
    return per_request.select(
        *request, end.getField("outcome").alias("outcome"), end.getField("attempt").alias("n_attempts")
    )


def final_attempts(responses: DataFrame, request: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Of the attempts (``_attempt``, ``outcome``) of each request the row it ends with, without ``_attempt``.

    That is the first terminal attempt, else the last allowed one; a success stands before
    other ends of the same attempt, and equal ones give the largest row.
    """
    allowed = F.col("_attempt") <= max_attempts
    ends = allowed & F.col("outcome").isin(TERMINAL)
    rest = [c for c in responses.columns if c not in request]
    row = F.struct(*rest)
    place = F.struct(
        ends,
        F.when(ends, -F.col("_attempt")).otherwise(F.when(allowed, F.col("_attempt")).otherwise(F.lit(0))),
        F.col("outcome") == "ok",
        row,
    )
    best = responses.groupBy(*request).agg(F.max_by(row, place).alias("_row"))
    return best.select(*request, "_row.*").drop("_attempt").select(*[c for c in responses.columns if c != "_attempt"])


def rate_budget(log: DataFrame) -> DataFrame:
    """Seconds a caller should have waited after each response (``remaining``, ``reset``, ``at`` epochs)."""
    gap = F.greatest(F.col("reset") - F.col("at"), F.lit(0))
    low = (F.col("remaining") < LOW_BUDGET) & F.col("reset").isNotNull()
    wait = F.when(low & (gap > 0), gap + WAIT_BUFFER_SECONDS).otherwise(F.lit(0))
    return log.withColumn("wait_seconds", wait)
