"""Pairing records of two tables by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.skew import hottest, salted_join
from reelspark.session import materialize


def nearest_in_time(probes: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """Rows (probe_id, target_id, distance) of each probe's nearest target of the same entity.

    ``probes`` has (probe_id, entity, time), ``targets`` (target_id, entity, time), with
    whole-number times in one unit; ``tolerance`` is in that unit and inclusive. Equal
    distances go to the smaller target_id. Times fall into buckets as wide as the
    tolerance; a probe meets the targets of its own bucket and, of the adjacent ones, only
    the closest: the last target of the bucket before and the first of the bucket after.
    Probes and targets shrink to distinct times first, so what meets in a bucket is bounded
    by its width, not by the number of rows; the rows come back over the distinct times,
    hot ones over salted tasks.

    Probes without a target within the tolerance give no row. Rows with a null entity or
    time, or a null target_id, do not count; a repeated (probe_id, entity, time) counts
    once; a null probe_id is kept. Other columns are ignored.
    """
    width = max(int(tolerance), 1)
    bucket = F.expr(f"(time - pmod(time, {width}L)) div {width}L")
    probe_rows = probes.select("probe_id", "entity", F.col("time").cast("bigint").alias("time")).where("entity is not null and time is not null").distinct()
    times = probe_rows.groupBy("entity", "time").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    points = (
        targets.select("target_id", "entity", F.col("time").cast("bigint").alias("time"))
        .where("target_id is not null and entity is not null and time is not null")
        .groupBy("entity", "time")
        .agg(F.min("target_id").alias("target_id"))
        .withColumn("bucket", bucket)
    )
    point = F.struct("time", "target_id")
    edges = points.groupBy("entity", "bucket").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    edges = edges.select(
        "entity",
        F.explode(
            F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("p")), F.struct((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("p")))
        ).alias("e"),
    ).select("entity", "e.bucket", F.col("e.p.time").alias("at"), F.col("e.p.target_id").alias("target_id"))
    near = points.select("entity", "bucket", F.col("time").alias("at"), "target_id").unionByName(edges)
    distance = F.abs(F.col("time") - F.col("at"))
    best = (
        times.join(near, ["entity", "bucket"])
        .where(distance <= tolerance)
        .groupBy("entity", "time")
        .agg(F.min(F.struct(distance.alias("distance"), F.col("target_id"))).alias("b"), F.max("n").alias("n"))
        .select("entity", "time", F.concat_ws(":", F.col("time").cast("string"), "entity").alias("at"), "b.target_id", "b.distance", "n")
    )
    best = materialize(best)
    rows = probe_rows.withColumn("at", F.concat_ws(":", F.col("time").cast("string"), "entity")).select("probe_id", "at")
    back = salted_join(rows, best.select("at", "target_id", "distance"), ["at"], "at", hottest(best, "at", "n"))
    return back.select("probe_id", "target_id", "distance")
