"""Queries of spatial joins and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import web_mercator
from ..operators import graph, panel, spatial
from ..operators.near import Near
from ..sources import tables
from .register import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
RADIUS = 0.03
#: Districts: unit squares cut into quarters, as rings.
_BOXES = [("south_west", -1.0, -1.0, 0.0, 0.0), ("south_east", 0.001, -1.0, 1.0, 0.0), ("north_west", -1.0, 0.001, 0.0, 1.0), ("centre", -0.1, -0.1, 0.1, 0.1)]
_P = "p AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_B = "b(district_id, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in _BOXES) + ")"
_IN = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
_E = f"{_P}, e AS (SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON a.point_id <> b.point_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {RADIUS * RADIUS!r}::DOUBLE)"


def _districts(spark):
    rows = [(n, f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))") for n, a, b, c, d in _BOXES]
    return spark.createDataFrame(rows, "district_id string, wkt string").select("district_id", spatial.parse_polygon(F.col("wkt")).alias("ring"))


def _located(spark, d):
    return spatial.points_in_polygons(tables.points(spark, d), _districts(spark), 0.25)


def _near(s):
    """Points by square; None where rows share an id, as such a point has several places."""
    n = s.agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("ids")).first()
    return Near(s, RADIUS, "point_id") if n["n"] == n["ids"] else None


def _graph(spark, d):
    s = tables.points(spark, d)
    return s.select(F.col("point_id").alias("node")), _near(s) or graph.undirected(spatial.neighbours_within(s, RADIUS, "point_id"))


@query(f"WITH {_P}, {_B} SELECT point_id, x, y, district_id FROM p JOIN b ON {_IN}")
def point_in_district(spark, d):
    return _located(spark, d)


@query(f"WITH {_P}, {_B} SELECT district_id, (point_id % 24)::BIGINT AS timestamp, count(point_id) AS crowd FROM p JOIN b ON {_IN} GROUP BY ALL")
def crowd_series(spark, d):
    return panel.crowd_series(_located(spark, d).withColumn("timestamp", F.col("point_id") % 24), ("district_id", "timestamp"))


@query(f"WITH {_E} SELECT a, b FROM e")
def adjacency_radius(spark, d):
    s = tables.points(spark, d)
    near = _near(s)
    return near.neighbours().select(F.col("node").alias("a"), F.explode("neighbours").alias("b")) if near else spatial.neighbours_within(s, RADIUS, "point_id")


@query(f"WITH {_E} SELECT point_id, coalesce(array_to_string(list_sort(list(b) FILTER (b IS NOT NULL)), ','), '') AS neighbours FROM p LEFT JOIN e ON a = point_id GROUP BY 1")
def adjacency_lists(spark, d):
    s = tables.points(spark, d)
    near = _near(s)
    if near:
        lists = near.neighbours().select(F.col("node").alias("point_id"), F.array_join("neighbours", ",").alias("neighbours"))
        placeless = s.join(near.placed.select(F.col("node").alias("point_id")), "point_id", "left_anti")
        return lists.unionByName(placeless.select("point_id", F.lit("").alias("neighbours")))
    return spatial.adjacency_lists(s, spatial.neighbours_within(s, RADIUS, "point_id"), "point_id").withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH {_B} SELECT m.district_id AS a, n.district_id AS b FROM b m JOIN b n ON m.district_id <> n.district_id AND m.x0 <= n.x1 AND n.x0 <= m.x1 AND m.y0 <= n.y1 AND n.y0 <= m.y1")
def adjacency_polygons(spark, d):
    return spatial.polygon_neighbours(_districts(spark), 0.5, "district_id")


@query("SELECT vec_id AS point_id, radians(embedding[1]::DOUBLE * 10) * 6378137 AS x, ln(tan(pi() / 4 + radians(embedding[2]::DOUBLE * 10) / 2)) * 6378137 AS y FROM embeddings")
def web_mercator_points(spark, d):
    x, y = web_mercator(F.col("x") * 10, F.col("y") * 10)
    return tables.points(spark, d).select("point_id", x.alias("x"), y.alias("y"))


@query(f"WITH {_E} SELECT point_id AS node, count(b) AS degree, count(b) / (count(*) FILTER (true) * 0 + (SELECT count(*) FROM p) - 1)::DOUBLE AS degree_centrality FROM p LEFT JOIN e ON a = point_id GROUP BY 1")
def degree(spark, d):
    return graph.degree(*_graph(spark, d))


@query(f"""WITH {_E}, t AS (SELECT x.a AS node, count(*) AS t FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY 1), g AS (SELECT a AS node, count(*) AS d FROM e GROUP BY 1)
SELECT point_id AS node, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM p LEFT JOIN g ON g.node = point_id LEFT JOIN t ON t.node = point_id""")
def clustering(spark, d):
    return graph.clustering(*_graph(spark, d))


@query(f"""WITH RECURSIVE {_E}, r(node, reach) AS (SELECT point_id, point_id FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def graph_components(spark, d):
    return graph.components(*_graph(spark, d))


@query()
def pagerank(spark, d):
    return graph.pagerank(*_graph(spark, d))


#: Rounds that SQL unrolls.
_ROUNDS = 12
_D = "dg AS (SELECT point_id AS node, count(b) AS d, (SELECT count(*) FROM p)::DOUBLE AS n FROM p LEFT JOIN e ON a = point_id GROUP BY 1)"
_RANKS = ", ".join(
    f"""r{k} AS (SELECT dg.node, d, n, 0.85 * coalesce(got, 0) + (0.85 * (SELECT coalesce(sum(x) FILTER (d = 0), 0) FROM r{k - 1}) + 0.15) / n AS x
FROM dg LEFT JOIN (SELECT b AS node, sum(x / d) AS got FROM e JOIN r{k - 1} ON r{k - 1}.node = a GROUP BY 1) USING (node))"""
    for k in range(1, _ROUNDS + 1)
)


@query(f"WITH {_E}, {_D}, r0 AS (SELECT node, d, n, 1 / n AS x FROM dg), {_RANKS} SELECT node, x AS pagerank FROM r{_ROUNDS}")
def pagerank_rounds(spark, d):
    return graph.pagerank(*_graph(spark, d), tol=0.0, rounds=_ROUNDS)


_REACHED = "r(node, reach) AS (SELECT point_id, point_id FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach), c AS (SELECT node, min(reach) AS part FROM r GROUP BY 1)"
_VECTORS = ", ".join(f"v{k} AS (SELECT v{k - 1}.node, x + coalesce(got, 0) AS x FROM v{k - 1} LEFT JOIN (SELECT a AS node, sum(x) AS got FROM e JOIN v{k - 1} ON v{k - 1}.node = b GROUP BY 1) USING (node))" for k in range(1, _ROUNDS + 1))


@query(f"""WITH RECURSIVE {_E}, {_REACHED}, v0 AS (SELECT node, 1::DOUBLE AS x FROM c WHERE part = (SELECT part FROM c GROUP BY part ORDER BY count(*) DESC, part LIMIT 1)), {_VECTORS}
SELECT c.node, coalesce(x / sqrt((SELECT sum(x * x) FROM v{_ROUNDS})), 0) AS eigenvector FROM c LEFT JOIN v{_ROUNDS} USING (node)""")
def eigenvector_rounds(spark, d):
    return graph.eigenvector(*_graph(spark, d), tol=0.0, rounds=_ROUNDS)


#: Levels of searches from all nodes, with numbers of shortest paths; no distance here is beyond the last.
_LEVELS = ", ".join(
    ["l0 AS MATERIALIZED (SELECT point_id AS s, point_id AS v, 0 AS k, 1::DOUBLE AS n FROM p)"]
    + [
        f"""l{k} AS MATERIALIZED (SELECT s, b AS v, {k} AS k, sum(n) AS n FROM l{k - 1} JOIN e ON a = v
WHERE NOT EXISTS (FROM l{k - 1} y WHERE y.s = l{k - 1}.s AND y.v = b)""" + (f" AND NOT EXISTS (FROM l{k - 2} z WHERE z.s = l{k - 1}.s AND z.v = b)" if k > 1 else "") + " GROUP BY ALL)"
        for k in range(1, 41)
    ]
    + [f"w AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(41))})"]
)


@query(f"""WITH {_E}, {_LEVELS}, c AS (SELECT s AS node, count(*) - 1 AS m, sum(k) AS far FROM w GROUP BY 1)
SELECT node, CASE WHEN far > 0 THEN m / far::DOUBLE * m / ((SELECT count(*) FROM c) - 1)::DOUBLE ELSE 0 END AS closeness FROM c""")
def closeness(spark, d):
    return graph.closeness_betweenness(*_graph(spark, d), between=False)


@query(f"""WITH {_E}, {_LEVELS},
through AS (SELECT x.v AS node, sum(x.n * y.n / z.n) AS n FROM w x JOIN w y ON y.s = x.v JOIN w z ON z.s = x.s AND z.v = y.v AND z.k = x.k + y.k WHERE x.k > 0 AND y.k > 0 GROUP BY 1)
SELECT point_id AS node, coalesce(n, 0) / (((SELECT count(*) FROM p) - 1) * ((SELECT count(*) FROM p) - 2))::DOUBLE AS betweenness FROM p LEFT JOIN through ON node = point_id""")
def betweenness(spark, d):
    return graph.closeness_betweenness(*_graph(spark, d)).select("node", "betweenness")


@query()
def eigenvector(spark, d):
    return graph.eigenvector(*_graph(spark, d))


@query()
def node_features(spark, d):
    return graph.node_features(*_graph(spark, d), "station_id")
