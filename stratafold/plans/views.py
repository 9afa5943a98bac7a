"""Drillhole views over the star-schema test tables. The texts run in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

VIEWS = {
    "collars": "SELECT s_suppkey AS hole_id, CAST((s_suppkey % 10) * 100 AS DOUBLE) AS collar_x, CAST(FLOOR(s_suppkey / 10) * 100 AS DOUBLE) AS collar_y, CAST(0 AS DOUBLE) AS collar_z, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS azimuth, CAST(-90 + (s_suppkey % 30) AS DOUBLE) AS dip, CAST(100 AS DOUBLE) AS final_depth FROM supplier",
    "surveys": "SELECT c.hole_id, CAST(k.n * 25 AS DOUBLE) AS measured_depth, CAST((c.azimuth + k.n) % 360 AS DOUBLE) AS azimuth, CAST(c.dip + k.n * 0.5 AS DOUBLE) AS dip FROM collars c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k",
    "fractures": "SELECT l_suppkey AS hole_id, l_orderkey * 10 + l_linenumber AS obs_id, l_quantity * 2 AS depth, CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN NULL ELSE l_extendedprice - FLOOR(l_extendedprice / 360) * 360 END AS dip_direction, CAST(l_discount * 900 AS DOUBLE) AS dip, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS set_id FROM lineitem",
    "domain_intervals": "SELECT c.hole_id, CAST(d.f AS DOUBLE) AS from_depth, CAST(d.t AS DOUBLE) AS to_depth, d.domain_id FROM collars c CROSS JOIN (SELECT 0 AS f, 40 AS t, 1 AS domain_id UNION ALL SELECT 40, 70, 2 UNION ALL SELECT 70, 100, 3) d WHERE c.hole_id % 7 <> 0",
    "intervals_raw": "SELECT o_orderkey AS record_id, o_custkey % 100 + 1 AS hole_id, CAST(o_orderkey % 90 AS DOUBLE) AS from_depth, CAST(o_orderkey % 90 + 1 + o_orderkey % 20 AS DOUBLE) AS to_depth, o_totalprice AS value FROM orders",
    "scalar_samples": "SELECT event_id AS sample_id, user_id AS hole_id, CAST(event_id % 90 AS DOUBLE) AS from_depth, CAST(event_id % 90 + 2 AS DOUBLE) AS to_depth, event_type AS parameter_name, value FROM events",
    "discs": "SELECT p_partkey AS ordinal, CAST((p_partkey * 37) % 1000 AS DOUBLE) / 10 AS cx, CAST((p_partkey * 101) % 1000 AS DOUBLE) / 10 AS cy, CAST((p_partkey * 211) % 1000 AS DOUBLE) / 10 AS cz, CAST(p_size AS DOUBLE) / 10 AS radius, CAST((p_partkey * 13) % 360 AS DOUBLE) AS dip_direction, CAST((p_partkey * 7) % 91 AS DOUBLE) AS dip, CAST(p_partkey % 3 + 1 AS INT) AS set_id FROM part",
}


class Views:
    """The tables and views of one data folder, each as a lazy DataFrame by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            used = [t for t in (*VIEWS, *TABLES) if f"FROM {t}" in text]
            for t in used:
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            return self.spark.sql(text, **{t: getattr(self, t) for t in used})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """SQL text for DuckDB in which the views are common tables."""
    head = ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
