"""Queries on similarity clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.cluster import ClusterConfig, exact_clusters, similar_clusters, typical_members
from reelspark.session import table

CONFIG = ClusterConfig(dim=48, cosine=0.9)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of keyframes with practically the same picture."""
    found = similar_clusters(table(spark, sf_dir, "keyframe_vectors"), "keyframe_uid", "embedding", CONFIG)
    pairs = exact_clusters(found, CONFIG)
    return pairs.where("uid <> cluster_uid").select("cluster_uid", F.col("uid").alias("keyframe_uid"))


def p7_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every such group with its size and its three most typical members."""
    found = similar_clusters(table(spark, sf_dir, "keyframe_vectors"), "keyframe_uid", "embedding", CONFIG)
    rows = typical_members(found, 3, exact_clusters(found, CONFIG))
    return rows.select("cluster_uid", "size", F.col("uid").alias("keyframe_uid"), "place", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p7_found": p7_found, "p7_typical": p7_typical}

_GROUPS = """
WITH v AS (
  SELECT keyframe_uid AS uid, min(list_transform(e, lambda x: (x / l)::FLOAT)) AS u FROM (
    SELECT keyframe_uid, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM keyframe_vectors
    WHERE keyframe_uid IS NOT NULL AND len(embedding) = 48 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ) WHERE l > 0 AND isfinite(l) GROUP BY 1
), near AS (
  SELECT a.uid AS uid, b.uid AS other FROM v a, v b WHERE list_cosine_similarity(a.u::DOUBLE[], b.u::DOUBLE[]) >= 0.9 - 1e-7::DOUBLE
), reach AS (SELECT uid, list(other ORDER BY other) AS others FROM near GROUP BY 1
), clique AS (
  -- Everybody near a member is near exactly the same ones.
  SELECT n.uid, any_value(r.others)[1] AS cluster_uid, len(any_value(r.others)) AS size
  FROM near n JOIN reach r ON r.uid = n.uid JOIN reach o ON o.uid = n.other GROUP BY n.uid HAVING bool_and(o.others = r.others) AND count(*) > 1
)
"""

ORACLES = {
    "p7_found": f"{_GROUPS} SELECT cluster_uid, uid AS keyframe_uid FROM clique WHERE uid <> cluster_uid",
    "p7_typical": f"""{_GROUPS}, part AS (SELECT cluster_uid, i, avg(x) AS x FROM (SELECT cluster_uid, unnest(u)::DOUBLE AS x, unnest(range(1, 49)) AS i FROM clique JOIN v USING (uid)) GROUP BY ALL
), centre AS (SELECT cluster_uid, list(x ORDER BY i) AS c FROM part GROUP BY 1
), m AS (
  SELECT cluster_uid, size, uid, round(list_dot_product(u::DOUBLE[], c) / sqrt(list_dot_product(c, c)), 9) AS cosine FROM clique JOIN v USING (uid) JOIN centre USING (cluster_uid)
), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_uid ORDER BY cosine DESC, uid) AS place FROM m)
SELECT cluster_uid, CAST(size AS BIGINT) AS size, uid AS keyframe_uid, place, round(cosine, 6) AS cosine FROM r WHERE place <= 3""",
}
