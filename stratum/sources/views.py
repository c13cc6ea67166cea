"""Domain tables derived from the driver's tables: slides, points, pixels, cells, shapes.

Each view is one SELECT in the part of SQL that Spark and DuckDB share, so both engines see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Width and height of the synthetic slides, and of the synthetic images.
SLIDE, IMAGE = 1600, 32

VIEWS: dict[str, str] = {
    "manifest": """
        SELECT 'demo' AS project, CAST(n_regionkey AS BIGINT) AS grp, n_name AS sample,
               CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS layer,
               CASE n_nationkey % 5 WHEN 0 THEN 'HE' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' ELSE 'P4' END AS type
        FROM nation""",
    "slides": """
        SELECT grp, layer, 1200 + 50 * layer + 30 * grp AS height, 1000 + 80 * layer + 20 * grp AS width FROM manifest""",
    "transforms": """
        SELECT grp, layer, step, 0.05e0 * (layer + 1) * (step + 1) AS theta, 0.02e0 * (layer + 1) - 0.01e0 * step AS tx,
               0.01e0 * (layer + 1) + 0.005e0 * step AS ty, 0.02e0 * layer AS sx, -0.01e0 * layer AS sy,
               CASE WHEN layer % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS fx, 1.0e0 AS fy
        FROM manifest CROSS JOIN (SELECT CAST(0 AS BIGINT) AS step UNION ALL SELECT CAST(1 AS BIGINT)) s""",
    "points": """
        SELECT CAST(o_orderkey % 5 AS BIGINT) AS grp, CAST(floor(o_orderkey / 5) AS BIGINT) % 5 AS layer,
               CAST(floor(o_orderkey / 25) AS BIGINT) AS kpt_id,
               CAST((o_orderkey * 7919) % 1600 AS DOUBLE) + (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0e0 AS x,
               CAST((o_orderkey * 104729) % 1600 AS DOUBLE) + (CAST(round(o_totalprice * 100) AS BIGINT) % 997) / 997.0e0 AS y,
               CAST(round(o_totalprice * 100) AS BIGINT) % 100003 / 100003.0e0 AS score
        FROM orders""",
    "pairs": """
        SELECT f.grp AS grp, f.layer AS layer_f, CAST(1 AS BIGINT) AS zdist, f.kpt_id AS kpt_id, f.x AS xf, f.y AS yf, m.x AS xm, m.y AS ym,
               f.kpt_id % 3 <> 0 AS is_match
        FROM points f JOIN points m ON f.grp = m.grp AND f.kpt_id = m.kpt_id AND m.layer = f.layer + 1""",
    "pixels": """
        SELECT image_id, channel, y, x, v FROM (
          SELECT CAST(floor(o_orderkey / 1024) AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS channel, CAST(floor(o_orderkey / 32) AS BIGINT) % 32 AS y,
                 CAST(o_orderkey % 32 AS BIGINT) AS x, CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS DOUBLE) AS v FROM orders
          UNION ALL
          SELECT CAST(floor(o_orderkey / 1024) AS BIGINT), CAST(1 AS BIGINT), CAST(floor(o_orderkey / 32) AS BIGINT) % 32,
                 CAST(o_orderkey % 32 AS BIGINT), CAST((o_custkey * 37) % 256 AS DOUBLE) FROM orders) p
        WHERE image_id < (SELECT floor((max(o_orderkey) + 1) / 1024) FROM orders)""",
    "cells": """
        SELECT CAST(c_custkey % 3 AS BIGINT) AS grp, c_custkey AS cell_id,
               CAST((c_custkey * 7919) % 997 AS DOUBLE) + (CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 1009) / 1009.0e0 AS x,
               CAST((c_custkey * 104729) % 991 AS DOUBLE) + (CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 1013) / 1013.0e0 AS y,
               c_mktsegment AS label
        FROM customer""",
    "targets": """
        SELECT CAST(p_partkey % 3 AS BIGINT) AS grp, p_partkey AS cell_id,
               CAST((p_partkey * 6007) % 997 AS DOUBLE) + (CAST(round(p_retailprice * 100) AS BIGINT) % 1019) / 1019.0e0 AS x,
               CAST((p_partkey * 3571) % 991 AS DOUBLE) + (CAST(round(p_retailprice * 100) AS BIGINT) % 1021) / 1021.0e0 AS y,
               p_brand AS label
        FROM part""",
    "shapes": """
        SELECT CAST(s_suppkey % 3 AS BIGINT) AS grp, s_suppkey AS shape_id,
               CAST((s_suppkey * 131) % 900 AS DOUBLE) + 40.25e0 AS cx, CAST((s_suppkey * 577) % 900 AS DOUBLE) + 40.75e0 AS cy,
               20.0e0 + s_suppkey % 23 AS rx, 15.0e0 + s_suppkey % 31 AS ry
        FROM supplier""",
    "descriptors": """
        SELECT CAST(vec_id % 2 AS BIGINT) AS image, CAST(floor(vec_id / 2) AS BIGINT) AS id, embedding AS features, CAST(label AS BIGINT) AS label FROM embeddings""",
    "signal": """
        SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, value AS v FROM events""",
    "angles": """
        SELECT grp, layer, CAST((grp * 3 + layer) % 8 AS BIGINT) AS step, 45.0e0 * ((grp * 3 + layer) % 8) AS angle,
               CASE WHEN (grp + layer) % 3 = 0 THEN 1 ELSE 0 END AS flip_x, CASE WHEN (grp + layer) % 4 = 1 THEN 1 ELSE 0 END AS flip_y
        FROM manifest""",
    "boxes": """
        SELECT grp, shape_id AS box_id, cx - 3 * rx AS x0, cy - 3 * ry AS y0, cx + 3 * rx AS x1, cy + 3 * ry AS y1, rx * ry + shape_id / 1000.0e0 AS score FROM shapes""",
    "scores": """
        SELECT CAST(floor(p_partkey / 1600) AS BIGINT) AS pair, CAST(floor(p_partkey % 1600 / 40) AS BIGINT) AS i, p_partkey % 40 AS j,
               (CAST(round(p_retailprice * 100) AS BIGINT) * 31 + p_partkey * 7919) % 100003 / 100003.0e0 AS score
        FROM part""",
    "blocks16": """
        SELECT image + 2 * CAST(floor(id / 16) AS BIGINT) AS image_id, CAST(floor(id % 16 / 4) AS BIGINT) AS y, id % 4 AS x, features FROM descriptors""",
    "blocks100": """
        SELECT image + 2 * CAST(floor(id / 100) AS BIGINT) AS image_id, CAST(floor(id % 100 / 10) AS BIGINT) AS y, id % 10 AS x, features FROM descriptors""",
    "field": """
        SELECT image_id, y AS i, x AS j, (v - 128) / 512.0e0 AS gx, (256 - v) / 1024.0e0 AS gy FROM pixels WHERE channel = 1""",
    "masks": """
        SELECT image_id, y, x, CASE WHEN v > 96 THEN 1 ELSE 0 END AS v FROM pixels WHERE channel = 0""",
    "visitors": """
        SELECT CAST(c_custkey % (SELECT max(image_id) + 1 FROM pixels) AS BIGINT) AS image_id, c_custkey, c_mktsegment FROM customer""",
    "markers": """
        SELECT p_partkey AS cell_id, (p_partkey * 7919) % 101 / 100.0e0 AS m1, (p_partkey * 104729) % 103 / 102.0e0 AS m2,
               (p_partkey * 1299709) % 107 / 106.0e0 AS m3, p_brand AS label
        FROM part""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def _needs(sql: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in names if n in words]


def with_views(sql: str) -> str:
    """The DuckDB query, with the views it uses as common table expressions."""
    wanted: dict[str, str] = {}

    def add(text: str) -> None:
        for name in _needs(text, VIEWS):
            if name not in wanted:
                add(VIEWS[name])
                wanted[name] = VIEWS[name]

    add(sql)
    parts = [f"{n} AS ({q})" for n, q in wanted.items()]
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, rest[9:].lstrip() if recursive else rest])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Views:
    """The domain tables over one folder of driver tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                used = [n for n in _needs(text, (*VIEWS, *TABLES)) if n != name]
                for n in used:
                    text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
                used = [n for n in used if f"{{{n}}}" in text]
                self._known[name] = self.spark.sql(text, **{n: getattr(self, n) for n in used})
        return self._known[name]


class Book:
    """Registers queries and their SQL. A query takes Views; the SQL may name any view."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                self.sql[name] = with_views(sql)
            return f

        return add
