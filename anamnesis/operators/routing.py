"""Choosing providers, and what they have cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def estimated_cost(query: Column, per_input: Column, per_output: Column) -> Column:
    t = token_estimate(query)
    return t * per_input + t * per_output


def satisfies(required: Column, vision: Column, functions: Column) -> Column:
    """Whether a model has all required capabilities; an unknown one is never had."""
    return F.forall(F.coalesce(required, F.array().cast("array<string>")), lambda c: F.when(c == "vision", vision).when(c == "function_calling", functions).otherwise(False))


def route(requests: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, provider, model, estimated_cost, is_local of the cheapest model for its quality.

    requests(request_id, query, required, budget, preferred, sensitive); models(place, provider, is_local, enabled, model,
    cost_in, cost_out, quality, vision, functions). The preferred provider's best goes before others; ties by place. The
    models are a configuration of a few rows and are broadcast only below Spark's own size limit.
    """
    every = requests.join(models.where("enabled"), F.col("is_local") | ~F.coalesce(F.col("sensitive"), F.lit(False)))
    cost = estimated_cost(F.col("query"), F.col("cost_in"), F.col("cost_out"))
    good = every.withColumn("estimated_cost", cost).where(satisfies(F.col("required"), F.col("vision"), F.col("functions"))).where(F.col("budget").isNull() | (F.col("estimated_cost") <= F.col("budget")))
    scored = good.withColumn("score", F.col("estimated_cost") / F.when(F.col("quality") > 0, F.col("quality")).otherwise(0.01))
    order = Window.partitionBy("request_id").orderBy(F.desc(F.coalesce(F.col("provider") == F.col("preferred"), F.lit(False))), "score", "place")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("request_id", "provider", "model", "estimated_cost", "is_local")


def usage(log: DataFrame, period: str) -> DataFrame:
    """provider, period, n_requests, cost, last_used of log(provider, ts, cost)."""
    return log.groupBy("provider", F.date_trunc(period, "ts").alias("period")).agg(F.count(F.lit(1)).alias("n_requests"), F.sum("cost").alias("cost"), F.max("ts").alias("last_used"))


def spent(log: DataFrame, at: Column) -> DataFrame:
    """provider, today, this_month, last_used of log(provider, ts, cost), as of a time."""
    same = lambda period: F.sum(F.when(F.date_trunc(period, "ts") == F.date_trunc(period, at), F.col("cost")))
    return log.groupBy("provider").agg(F.coalesce(same("day"), F.lit(0.0)).alias("today"), F.coalesce(same("month"), F.lit(0.0)).alias("this_month"), F.max("ts").alias("last_used"))


def model_providers(models: DataFrame) -> DataFrame:
    """model, provider: who is asked for a model that several have, the first in place. models(place, provider, model)."""
    return models.groupBy("model").agg(F.min_by("provider", "place").alias("provider"))


def with_provider(models: DataFrame, provider: DataFrame) -> DataFrame:
    """models with those of a provider (one or more rows of it) put in place of what it had, after all others."""
    rest = models.join(provider.select("provider").distinct(), "provider", "left_anti").select(*models.columns)
    last = F.coalesce(F.lit(rest.agg(F.max("place")).first()[0]), F.lit(-1))
    return rest.unionByName(provider.withColumn("place", (F.col("place") + last + 1).cast(dict(models.dtypes)["place"])).select(*models.columns))


def without_provider(models: DataFrame, name: str) -> DataFrame:
    return models.where(F.col("provider") != name)


def fallback_chain(models: DataFrame) -> DataFrame:
    """provider, place of enabled providers, local ones first, then as they come."""
    one = models.where("enabled").groupBy("provider").agg(F.min("place").alias("first"), F.max("is_local").alias("is_local"))
    return one.select("provider", F.row_number().over(Window.orderBy(F.desc("is_local"), "first")).alias("place"))


def within_budget(spent: Column, limit: Column, more: Column | None = None) -> Column:
    """Below the limit, or, with a further cost, not above it."""
    return spent < limit if more is None else spent + more <= limit


def nearest_rank(rows: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """group, percent, value: the value at index round(p / 100 (n - 1)), halves away from zero."""
    order = Window.partitionBy(group).orderBy(value)
    placed = rows.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(order) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n"))
    wanted = placed.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    return wanted.where(F.col("at") == F.floor(F.col("percent") * (F.col("n") - 1) / 100.0 + 0.5)).select(group, "percent", F.col(value).alias("value"))


def limited(requests: DataFrame, per_second: int) -> DataFrame:
    """Requests within a rate of so many in each second, by time. requests(ts, event_id)."""
    order = Window.partitionBy(F.date_trunc("second", "ts")).orderBy("ts", "event_id")
    return requests.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_second).drop("_n")
