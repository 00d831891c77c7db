"""Sessions: sliding counts, admission, user and global statistics, expiry. Input: (user_id, ts, cost, entities)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Settings

HOUR = 3_600_000_000


def hourly_requests(requests: DataFrame) -> DataFrame:
    """requests with n_last_hour: the user's requests in (ts - 1 h, ts], itself and its ties included."""
    frame = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-(HOUR - 1), 0)
    return requests.withColumn("n_last_hour", F.count("*").over(frame))


def admission(requests: DataFrame, limit: int = Settings.requests_per_hour) -> DataFrame:
    """requests with n_before (earlier requests of the last hour) and whether the limit admits it."""
    frame = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-(HOUR - 1), -1)
    return requests.withColumn("n_before", F.count("*").over(frame)).withColumn("admitted", F.col("n_before") < limit)


def user_stats(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Totals of each user; the last hour counts back from now, or from the latest request of all."""
    if now is None:
        now = requests.agg(F.max("ts")).scalar()
    recent = F.unix_micros("ts") > F.unix_micros(now) - HOUR
    return requests.groupBy("user_id").agg(
        F.count("*").alias("total_requests"), F.sum("cost").alias("total_cost"), F.sum("entities").alias("total_entities"),
        F.count(F.when(recent, 1)).alias("last_hour"), F.min("ts").alias("first_request"), F.max("ts").alias("last_request"),
    )


def global_stats(requests: DataFrame) -> DataFrame:
    """One row: users, totals and averages, 0 where there is nothing to divide by."""
    return requests.agg(
        F.countDistinct("user_id").alias("users"), F.count("*").alias("requests"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities")
    ).select(
        "*",
        F.coalesce(F.try_divide("requests", "users"), F.lit(0.0)).alias("requests_per_user"),
        F.coalesce(F.try_divide("cost", "requests"), F.lit(0.0)).alias("cost_per_request"),
    )


def expired_users(requests: DataFrame, now: Column, days: float = Settings.session_days) -> DataFrame:
    """Users whose last request lies more than `days` before now."""
    return requests.groupBy("user_id").agg(F.max("ts").alias("last_request")).where(F.unix_micros("last_request") < F.unix_micros(now) - int(days * 24 * HOUR))


def evict(requests: DataFrame, now: Column, days: float = Settings.session_days) -> DataFrame:
    """The requests of users that have not expired."""
    return requests.join(expired_users(requests, now, days).select("user_id"), "user_id", "left_anti")
