"""Inputs derived from the generic star tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clips that one task makes the points of: about 670,000 rows.
CLIPS = 250

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

SQL = {
    "fx_label_ref": """
SELECT n.n_nationkey AS gloss_id, n.n_name AS label, n.n_regionkey AS cat_id, r.r_name AS category
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "fx_labels": """
SELECT concat('clip_', lpad(cast(o.o_orderkey AS varchar(20)), 7, '0'), '_', lower(n.n_name), '.npz') AS file,
  c.c_nationkey AS gloss, n.n_regionkey AS cat, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS occluded
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "fx_predictions": """
SELECT p.clip_id, p.model, p.gloss_gt, g.n_regionkey AS cat_gt, p.gloss_pred, h.n_regionkey AS cat_pred, p.occluded, p.gloss_prob, p.cat_prob
FROM (SELECT o.o_orderkey AS clip_id, CASE WHEN o.o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS model, c.c_nationkey AS gloss_gt,
   CASE WHEN o.o_orderkey % 10 < 6 THEN c.c_nationkey ELSE cast((c.c_nationkey + o.o_custkey) % 25 AS int) END AS gloss_pred,
   CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS occluded,
   cast(300 + (o.o_orderkey * 7919) % 700 AS double) / cast(1000 AS double) AS gloss_prob,
   cast(400 + (o.o_orderkey * 6007) % 600 AS double) / cast(1000 AS double) AS cat_prob
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) p
JOIN {nation} g ON p.gloss_gt = g.n_nationkey JOIN {nation} h ON p.gloss_pred = h.n_nationkey""",
    "fx_track": """
SELECT user_id AS clip_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS frame_idx,
  event_id, value AS x, value / cast(2 AS double) AS y, event_type <> 'error' AS visible
FROM {events}""",
    "fx_vec_frames": """
SELECT cast(floor(vec_id / cast(20 AS double)) AS bigint) AS clip_id, cast(vec_id % 20 AS int) AS frame_idx, embedding AS x, label AS gloss
FROM {embeddings}""",
    "fx_holistic": """
SELECT clip_id, frame_idx, kp,
  CASE WHEN kp >= 67 THEN fx WHEN kp >= 25 THEN hx + cast((kp - 25) % 21 AS double) / cast(500 AS double) ELSE cast(20 + kp AS double) / cast(100 AS double) END AS x,
  CASE WHEN kp >= 67 THEN fy WHEN kp >= 25 THEN hy + cast((kp - 25) % 7 AS double) / cast(500 AS double) ELSE cast(10 + 3 * kp AS double) / cast(100 AS double) END AS y,
  (clip_id * 31 + frame_idx * 17 + kp * 7) % 23 <> 0 AS visible,
  cast(frame_idx * 33 + (frame_idx * frame_idx) % 5 AS bigint) AS t_ms
FROM (
 SELECT s.s_suppkey AS clip_id, f.frame_idx, k.kp,
  CASE WHEN s.s_suppkey % 3 = 0 AND k.kp < 46 THEN cast(20 AS double) / cast(100 AS double) + cast(frame_idx AS double) / cast(20 + s.s_suppkey % 30 AS double) * cast(3 AS double) / cast(10 AS double) ELSE cast(10 AS double) / cast(100 AS double) END AS hx,
  CASE WHEN s.s_suppkey % 3 = 0 AND k.kp < 46 THEN cast(90 AS double) / cast(100 AS double) - cast(frame_idx AS double) / cast(20 + s.s_suppkey % 30 AS double) * cast(4 AS double) / cast(10 AS double) ELSE cast(95 AS double) / cast(100 AS double) END AS hy,
  cast(CASE k.kp - 67 WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 45 WHEN 4 THEN 55 WHEN 5 THEN 45 WHEN 6 THEN 55 WHEN 7 THEN 50 WHEN 8 THEN 50 WHEN 9 THEN 38 ELSE 62 END AS double) / cast(100 AS double) AS fx,
  cast(CASE k.kp - 67 WHEN 0 THEN 50 WHEN 1 THEN 42 WHEN 2 THEN 42 WHEN 3 THEN 42 WHEN 4 THEN 42 WHEN 5 THEN 60 WHEN 6 THEN 60 WHEN 7 THEN 30 WHEN 8 THEN 72 ELSE 50 END AS double) / cast(100 AS double) AS fy
 FROM {supplier} s
 CROSS JOIN (SELECT DISTINCT cast(l_quantity AS int) - 1 AS frame_idx FROM {lineitem}) f
 CROSS JOIN (SELECT DISTINCT cast(p_partkey AS int) AS kp FROM {part} WHERE p_partkey < 78) k
 WHERE f.frame_idx < 20 + s.s_suppkey % 30) h""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs as a DataFrame.

    The points of all clips come from a small table, a file of one task, so clips are dealt out before they
    grow. The few frame numbers and keypoints that they meet are broadcast (the hint on a table holds for what
    is made of it): else the planner broadcasts the clips, and one task makes all points.
    """
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    if name == "fx_holistic":
        clips = used["supplier"].select("s_suppkey")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(clips.count() / CLIPS))
        used = {t: F.broadcast(df) for t, df in used.items()} | {"supplier": clips.repartition(parts, "s_suppkey")}
    return spark.sql(SQL[name], **used)


def duck(*names: str) -> str:
    """``name AS MATERIALIZED (...)`` for a WITH clause in DuckDB: an input is made once however often it is read."""
    return ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'[{}]', '', SQL[n])})" for n in names)
