"""Registered queries over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as se
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


R = f"WITH {fx.REQUEST_SQL}"
US = "epoch_us(ts)"


@query("hourly_requests", f"{R} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {US} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_last_hour FROM req")
def hourly(spark, sf_dir):
    return se.hourly_requests(fx.requests(spark, sf_dir)).select("event_id", "user_id", "n_last_hour")


@query(
    "admission_check",
    f"{R}, c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {US} RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS n_before FROM req) SELECT *, n_before < 5 AS admitted FROM c",
)
def admission(spark, sf_dir):
    return se.admission(fx.requests(spark, sf_dir)).select("event_id", "user_id", "n_before", "admitted")


@query(
    "user_stats",
    f"""{R}, m AS (SELECT max(ts) AS now FROM req) SELECT user_id, count(*) AS total_requests, round(sum(cost), 9) AS total_cost, CAST(sum(entities) AS BIGINT) AS total_entities,
    count(*) FILTER (WHERE {US} > epoch_us(m.now) - 3600000000) AS last_hour, min({US}) AS first_request, max({US}) AS last_request FROM req, m GROUP BY user_id""",
)
def users(spark, sf_dir):
    stats = se.user_stats(fx.requests(spark, sf_dir))
    return stats.withColumns({"total_cost": F.round("total_cost", 9), "first_request": F.unix_micros("first_request"), "last_request": F.unix_micros("last_request")})


@query(
    "global_stats",
    f"{R} SELECT count(DISTINCT user_id) AS users, count(*) AS requests, round(sum(cost), 6) AS cost, CAST(sum(entities) AS BIGINT) AS entities, count(*)::DOUBLE / count(DISTINCT user_id) AS requests_per_user, round(sum(cost) / count(*), 9) AS cost_per_request FROM req",
)
def everyone(spark, sf_dir):
    return se.global_stats(fx.requests(spark, sf_dir)).withColumns({"cost": F.round("cost", 6), "cost_per_request": F.round("cost_per_request", 9)})



#: The driver's users are all active within a week of the end, so the registered queries expire them after half a day.
DAYS = 0.5
CUT = f"(SELECT epoch_us(max(ts)) FROM req) - {int(DAYS * 86_400_000_000)}"


@query("ttl_eviction", f"{R}, u AS (SELECT user_id, max({US}) AS last_request FROM req GROUP BY 1) SELECT * FROM u WHERE last_request < {CUT}")
def eviction(spark, sf_dir):
    r = fx.requests(spark, sf_dir)
    return se.expired_users(r, r.agg(F.max("ts")).scalar(), DAYS).withColumn("last_request", F.unix_micros("last_request"))


@query("kept_sessions", f"{R}, u AS (SELECT user_id FROM req GROUP BY 1 HAVING max({US}) < {CUT}) SELECT event_id, user_id FROM req WHERE user_id NOT IN (SELECT user_id FROM u)")
def kept_sessions(spark, sf_dir):
    r = fx.requests(spark, sf_dir)
    return se.evict(r, r.agg(F.max("ts")).scalar(), DAYS).select("event_id", "user_id")


@query(
    "cost_projection",
    f"{R}, c AS (SELECT avg(cost) AS cost FROM req WHERE cost > 0) SELECT round(cost, 9) AS per_paper, round(cost * 1000, 6) AS per_thousand, round(cost * 10000, 5) AS per_ten_thousand, round(cost * 1000000, 3) AS per_million FROM c",
)
def projection(spark, sf_dir):
    c = fx.requests(spark, sf_dir).where("cost > 0").agg(F.avg("cost").alias("cost"))
    x = F.col("cost")
    return c.select(F.round(x, 9).alias("per_paper"), F.round(x * 1000, 6).alias("per_thousand"), F.round(x * 10000, 5).alias("per_ten_thousand"), F.round(x * 1000000, 3).alias("per_million"))


@query("cost_tier", f"{R} SELECT CASE WHEN cost < 0.02::DOUBLE THEN 'low' WHEN cost < 0.05::DOUBLE THEN 'medium' ELSE 'high' END AS tier, count(*) AS n FROM req GROUP BY 1")
def tiers(spark, sf_dir):
    cost = F.col("cost")
    tier = F.when(cost < 0.02, F.lit("low")).when(cost < 0.05, F.lit("medium")).otherwise(F.lit("high"))
    return fx.requests(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
