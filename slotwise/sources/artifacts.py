"""Checks of supplied tables before they are used: each gives the problems it finds, one row each, and an empty result is fit for use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.geo import coordinate

# The states of an entry and of an attempt, and the profiles of a route.
REPORTING, ATTEMPTS, PROFILES = ("reporting", "failed", "missing"), ("success", "failed"), ("night", "am", "pm")


def _problems(rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """(key, problem) of every row and check that fails; a check that is null fails."""
    found = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))
    return rows.select(key.cast("string").alias("key"), found.alias("problem"))


def coverage_problems(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows that are missing, unknown or repeated against a registry with a column facility."""
    counts = rows.groupBy(F.col(key).alias("facility")).count()
    met = registry.select("facility", F.lit(True).alias("known")).join(counts, "facility", "full_outer")
    return _problems(met, F.col("facility"), {"unknown": F.col("known"), "missing": F.col("count").isNotNull(), "repeated": F.coalesce("count", F.lit(1)) == 1})


def latest_problems(entries: DataFrame, registry: DataFrame, generated: Column) -> DataFrame:
    """Problems of a table of latest entries (facility, success, attempt, state) that was made at ``generated``."""
    s, a = F.col("success"), F.col("attempt")
    expected = F.when(F.coalesce(a["state"] == "failed", F.lit(False)), "failed").when(s.isNotNull(), "reporting").otherwise("missing")
    checks = {
        "state": F.col("state").isin(*REPORTING) & (F.col("state") == expected),
        "observation": s.isNull() | ((s["batch"] <= s["at"]) & (s["at"] <= generated) & s["value"].isNotNull()),
        "attempt": a.isNull() | (a["state"].isin(*ATTEMPTS) & (a["batch"] <= generated)),
        "reporting without an attempt": (F.col("state") != "reporting") | (a["state"] == "success"),
    }
    return _problems(entries, F.col("facility"), checks).unionByName(coverage_problems(entries, registry, "facility"))


def model_problems(models: DataFrame) -> DataFrame:
    """Problems of usual models: a supported one has ordered quartiles and a distribution of as many values as samples, others have none."""
    ok = F.col("state") == "supported"
    n = F.aggregate("distribution", F.lit(0).cast("bigint"), lambda x, d: x + d["n"])
    checks = {
        "hour": F.col("local_hour").between(0, 23),
        "support": (F.col("days") <= F.col("eligible_days")) & (F.col("observed_slots") >= 0) & F.col("coverage").isNotNull(),
        "quartiles": F.when(ok, (F.col("low") <= F.col("median")) & (F.col("median") <= F.col("high"))).otherwise(F.col("median").isNull() & F.col("low").isNull() & F.col("high").isNull()),
        "distribution": F.when(ok, n == F.col("samples")).otherwise(F.col("distribution").isNull()),
    }
    return _problems(models, F.concat_ws("|", "facility", "local_date", "local_hour"), checks)


def route_problems(routes: DataFrame, registry: DataFrame) -> DataFrame:
    """Problems of a route table (origin, slug, seconds by profile): every profile, no negative time, each pair once, known places."""
    rows = routes.join(registry.select(F.col("facility").alias("slug"), F.lit(True).alias("known")), "slug", "left")
    keys = F.array_sort(F.map_keys("seconds"))
    repeated = rows.groupBy("origin", "slug").count().where("count > 1").select(F.concat_ws("|", "origin", "slug").alias("key"), F.lit("repeated").alias("problem"))
    checks = {"profiles": keys == F.array_sort(F.array(*[F.lit(p) for p in PROFILES])), "seconds": F.forall(F.map_values("seconds"), lambda x: x >= 0), "unknown": F.col("known")}
    return _problems(rows, F.concat_ws("|", "origin", "slug"), checks).unionByName(repeated)


def place_problems(registry: DataFrame) -> DataFrame:
    """Problems of places (facility, latitude, longitude): a name, and coordinates within their limits."""
    return _problems(registry, F.col("facility"), {"name": F.trim("facility") != "", "coordinates": coordinate(F.col("latitude"), 90) & coordinate(F.col("longitude"), 180)})


def require(problems: DataFrame) -> None:
    """Raise an error that names the first problems, if there are any."""
    first = problems.orderBy("key", "problem").limit(5).collect()
    if first:
        raise ValueError("not fit for use: " + "; ".join(f"{r.key}: {r.problem}" for r in first))


def route_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(origin, slug, seconds) of a JSON file {"routes": [{"origin", "slug", "seconds": {profile: seconds}}]}."""
    rows = spark.read.schema("routes array<struct<origin:string,slug:string,seconds:map<string,int>>>").json(path, multiLine=True)
    return rows.select(F.explode("routes").alias("r")).select("r.*")
