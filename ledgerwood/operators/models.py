"""Ranking of measured models for the roles they can play, and the choice among those that are installed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_name
from ..functions.values import piecewise

# Quality by billions of parameters, the roles' budgets in seconds and weights of quality, bonuses of the registry.
QUALITY = [(1.0, 15.0), (3.0, 40.0), (7.0, 65.0), (14.0, 85.0), (32.0, 95.0), (70.0, 100.0)]
UNKNOWN_QUALITY = 35.0
ROLES = {"llm": (0.45, 90.0), "drafting": (0.75, 200.0)}
DRAFTING_LIMIT, EMBEDDING_BUDGET = 600.0, 2.0
GENERATION_BONUS, EMBEDDING_BONUS = 4.0, 10.0


def quality(billions: Column) -> Column:
    return F.when(billions.isNull() | (billions <= 0), UNKNOWN_QUALITY).otherwise(piecewise(billions, QUALITY))


def speed(seconds: Column, budget: Column) -> Column:
    """All points to a quarter of the budget, 55 at the budget, few beyond it."""
    inside = 100.0 - (seconds - budget * 0.25) / (budget * 0.75) * 45.0
    over = F.when(seconds <= 2 * budget, 40.0).when(seconds <= 4 * budget, 20.0).otherwise(5.0)
    return F.when(seconds.isNull(), 0.0).when(seconds <= budget * 0.25, 100.0).when(seconds <= budget, inside).otherwise(over)


def recommended(probes: DataFrame, width: int) -> DataFrame:
    """(host, role, name, eligible, score, refused, place): every probe of a host (host, name, role, billions, seconds, timed_out, error,
    valid_output, dimensions, in_registry), those that pass the gates first, then by score and name."""
    role, seconds = F.col("role"), F.col("seconds")
    embeds = role == "embedding"
    budget = F.when(embeds, EMBEDDING_BUDGET).when(role == "drafting", ROLES["drafting"][1]).otherwise(ROLES["llm"][1])
    refused = (
        F.when(~embeds & F.col("timed_out"), "timed out").when(F.col("error").isNotNull(), "error").when(~embeds & ~F.coalesce("valid_output", F.lit(True)), "invalid output")
        .when(embeds & F.col("dimensions").isNull(), "no vectors").when(embeds & (F.col("dimensions") != width), "other width").when(~embeds & seconds.isNull(), "not measured")
        .when((role == "drafting") & (seconds > DRAFTING_LIMIT), "over the limit")
    )
    weight = F.when(role == "drafting", ROLES["drafting"][0]).otherwise(ROLES["llm"][0])
    bonus = F.when(F.col("in_registry"), F.when(embeds, EMBEDDING_BONUS).otherwise(GENERATION_BONUS)).otherwise(0.0)
    points = F.when(embeds, speed(F.coalesce(seconds, F.lit(0.0)), budget)).otherwise(weight * quality(F.col("billions")) + (1 - weight) * speed(seconds, budget)) + bonus
    scored = probes.withColumn("refused", refused).withColumn("eligible", F.col("refused").isNull()).withColumn("score", F.when(F.col("eligible"), F.round(points, 6)).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("host", "role").orderBy(F.desc("eligible"), F.desc("score"), "name"))
    return scored.select("host", "role", "name", "eligible", "score", "refused", place.alias("place"))


def selected(hosts: DataFrame, registry: DataFrame, installed: DataFrame) -> DataFrame:
    """(host, role, name, why): the model configured if it is installed, else the best that the registry recommends for the host's profile.

    ``hosts`` is (host, role, profile, configured), ``registry`` (role, name, min_profile, preference), of fixed size, ``installed`` (host, name).
    Names are compared without quantisation and with their tag.
    """
    there = installed.select("host", model_name(F.col("name")).alias("key")).distinct()
    own = hosts.withColumn("key", model_name(F.col("configured"))).join(there.withColumn("has", F.lit(True)), ["host", "key"], "left")
    fits = hosts.select("host", "role", "profile").join(F.broadcast(registry), "role").where(F.col("min_profile") <= F.col("profile")).withColumn("key", model_name(F.col("name")))
    best = fits.join(there, ["host", "key"]).groupBy("host", "role").agg(F.min_by("name", F.struct("preference", "name")).alias("best"))
    met = own.join(best, ["host", "role"], "left")
    why = F.when(F.col("has"), "configured").when(F.col("best").isNotNull(), "recommended").otherwise("none")
    return met.select("host", "role", F.when(F.col("has"), F.col("configured")).otherwise(F.col("best")).alias("name"), why.alias("why"))
