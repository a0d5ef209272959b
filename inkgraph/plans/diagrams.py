"""Queries over diagrams that are written from the rows of a table, so that SQL can say what every parser, gate and score
must find in them: each row's key decides which elements its markup has."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..functions.markup import report_columns, with_report, with_scene
from ..operators import coreset, curate, funnel, graphs, materialize, nearby, scoring
from ..sources import runs
from ..sources.tables import first_passing, shared_root, spread, table, written
from .catalog import _KEYS, _greedy, profiled, query


def _if(cond: Column, text: str) -> Column:
    return F.when(cond, text).otherwise("")


def parts(spark, d) -> DataFrame:
    """The rows that diagrams are written from, dealt over the tasks before their markup is, so that little is moved."""
    return spread(table(spark, d, "part"), "p_partkey")


def drawings(spark, d) -> DataFrame:
    """(k, svg): boxes by k % 4, a text unless k % 3 = 0, and by other remainders a script, a link, embedded data, no view box,
    no markup at all, or a very long text."""
    k, n = F.col("p_partkey"), 1 + F.col("p_partkey") % 4
    box = lambda i: F.concat(F.lit('<rect x="'), i * 100, F.lit('.0" y="10" width="60.0" height="40.50" fill="red"/>'))
    label = F.when(k % 17 == 2, F.repeat(F.lit("x"), F.lit(20_001))).otherwise(F.col("p_name"))
    svg = F.concat(
        F.when(k % 6 == 0, '<svg xmlns="http://www.w3.org/2000/svg">').otherwise('<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 300 200.5">'),
        F.array_join(F.transform(F.sequence(F.lit(0), n - 1), box), "\n"),
        F.when(k % 3 != 0, F.concat(F.lit('<text x="5" y="12"> '), label, F.lit(" </text>"))).otherwise(""),
        _if(k % 7 == 0, "<script>1</script>"), _if(k % 5 == 0, '<a href="http://x"/>'), _if(k % 11 == 0, '<path d="M0 0L1 1" style="url(data:base64,AA)"/>'), F.lit("</svg>"),
    )
    return parts(spark, d).select(k.alias("k"), F.when(k % 13 != 1, svg).alias("svg"))


_DRAWN = """
WITH r AS (SELECT p_partkey AS k, 1 + p_partkey % 4 AS n, p_partkey % 3 <> 0 AS t, p_partkey % 7 = 0 AS s, p_partkey % 5 = 0 AS a, p_partkey % 11 = 0 AS p, p_partkey % 6 = 0 AS v, p_partkey % 17 = 2 AS wide,
                  CASE WHEN p_partkey % 17 = 2 THEN repeat('x', 20001) ELSE p_name END AS label FROM part),
m AS (
  SELECT *, 1 + n + t::INT + s::INT + a::INT + p::INT AS n_elements, n + t::INT + p::INT AS n_drawable,
         list_filter([CASE WHEN s THEN 'forbidden tag: script' END, CASE WHEN a THEN 'external href: http://x' END, CASE WHEN p THEN 'embedded base64 resource' END, CASE WHEN n + t::INT + p::INT < 2 THEN 'too few drawable elements: ' || (n + t::INT + p::INT) END], lambda x: x IS NOT NULL) AS errors,
         CASE WHEN v THEN '<svg height="512" viewBox="0 0 512 512" width="512" xmlns="http://www.w3.org/2000/svg">' ELSE '<svg height="200.5" viewBox="0 0 300 200.5" width="300" xmlns="http://www.w3.org/2000/svg">' END
         || array_to_string(list_transform(range(n), lambda i: '<rect fill="red" height="40.5" width="60" x="' || (i * 100) || '" y="10" />'), '')
         || CASE WHEN t THEN '<text x="5" y="12">' || label || '</text>' ELSE '' END || CASE WHEN s THEN '<script>1</script>' ELSE '' END || CASE WHEN a THEN '<a href="http://x" />' ELSE '' END
         || CASE WHEN p THEN '<path d="M0 0L1 1" style="url(data:base64,AA)" />' ELSE '' END || '</svg>' AS normalized FROM r),
f AS (SELECT *, 0.25 * n_elements + 0.2 + 0.15 * 2 * p::INT + 0.15 * sqrt(CASE WHEN t THEN length(label) ELSE 0 END::DOUBLE) + 0.1 AS difficulty FROM m WHERE k % 13 <> 1)
"""


def reported(spark, d) -> DataFrame:
    return with_report(drawings(spark, d).filter("svg is not null"))


@query(_DRAWN + "SELECT k, len(errors) = 0 AS ok, true AS parse_ok, n_elements::INTEGER AS n_elements, n_drawable::INTEGER AS n_drawable, array_to_string(errors, '; ') AS errors, CASE WHEN a THEN 'unexpected tag: a' ELSE '' END AS warnings FROM f")
def markup_report(spark, d):
    r = F.col("report")
    return reported(spark, d).select("k", r["ok"].alias("ok"), r["parse_ok"].alias("parse_ok"), r["n_elements"].alias("n_elements"), r["n_drawable"].alias("n_drawable"), F.array_join(r["errors"], "; ").alias("errors"), F.array_join(r["warnings"], "; ").alias("warnings"))


@query(_DRAWN + "SELECT k, length(normalized)::INTEGER AS n_chars, sha256(normalized) AS sha256, left(normalized, 300) AS head FROM f")
def canonical_form(spark, d):
    return reported(spark, d).select("k", F.length("report.normalized").alias("n_chars"), "report.sha256", native.cut(F.col("report.normalized"), 300).alias("head"))


@query(_DRAWN + """SELECT k, n::DOUBLE AS b, p::INT::DOUBLE AS c, t::INT::DOUBLE AS t, round(n::DOUBLE / (n + p::INT), 9) AS clean, round(ln(1e0 + n + p::INT + t::INT), 9) AS ec, n_elements::DOUBLE AS n_elements, 1e0 AS max_depth, 1e0 AS n_colors,
       (CASE WHEN t THEN length(label) ELSE 0 END)::DOUBLE AS text_chars, 2e0 * p::INT AS path_segments, round(CASE WHEN v THEN 1e0 ELSE 300 / 200.5::DOUBLE END, 4) AS aspect_ratio, round(difficulty, 9) AS difficulty FROM f""")
def markup_features(spark, d):
    rows = reported(spark, d)
    c = report_columns(F.col("report"))
    feats = {k: c[f"feat_{k}"] for k in ("n_elements", "max_depth", "n_colors", "text_chars", "path_segments")}
    return rows.select("k", c["vfig_B"].alias("b"), c["vfig_C"].alias("c"), c["vfig_T"].alias("t"), F.round(c["vfig_clean"], 9).alias("clean"), F.round(c["vfig_ec"], 9).alias("ec"), *(v.alias(k) for k, v in feats.items()), F.round(c["feat_aspect_ratio"], 4).alias("aspect_ratio"), F.round(c["difficulty"], 9).alias("difficulty"))


@query(_DRAWN + "SELECT 'f' || k || '.svg' AS id, sha256(normalized) AS sha256 FROM f WHERE k % 29 = 3")
def test_hash_build(spark, d):
    return materialize.test_hashes(named(spark, d).filter("row_pos % 29 = 3"))


def named(spark, d) -> DataFrame:
    return drawings(spark, d).select(F.col("k").alias("row_pos"), F.concat(F.lit("f"), "k", F.lit(".svg")).alias("filename"), "svg")


_SCANNED = _DRAWN + """,
j AS (SELECT r.k, f.normalized, f.errors, CASE WHEN r.k % 13 = 1 THEN 'no_svg' WHEN r.wide AND r.t THEN 'too_long' END AS early, f.normalized IN (SELECT normalized FROM f WHERE k % 29 = 3) AS leaked FROM r LEFT JOIN f USING (k)),
w AS (SELECT *, coalesce(early, CASE WHEN len(errors) > 0 THEN 'validate' WHEN leaked THEN 'test_leak' END) AS reason FROM j),
z AS (SELECT w.k, coalesce(reason, CASE WHEN w.k > o.first THEN 'exact_dup' END) AS reject_reason, w.normalized, w.errors FROM w LEFT JOIN (SELECT normalized, min(k) AS first FROM w WHERE reason IS NULL GROUP BY 1) o USING (normalized))
"""


def scanned(spark, d) -> DataFrame:
    rows = named(spark, d)
    return curate.scan(rows, materialize.test_hashes(rows.filter("row_pos % 29 = 3")).select("sha256"))


@query(_SCANNED + "SELECT k AS row_pos, reject_reason FROM z")
def scan_reasons(spark, d):
    return scanned(spark, d).select("row_pos", "reject_reason")


@query(_SCANNED + "SELECT k AS pool_idx, 'f' || k AS id, sha256(z.normalized) AS sha256, CASE WHEN r.t THEN 'labeled' ELSE 'other' END AS bucket, round(f.difficulty, 9) AS difficulty FROM z JOIN r USING (k) JOIN f USING (k) WHERE reject_reason IS NULL")
def scan_pool(spark, d):
    return curate.pool(scanned(spark, d)).select("pool_idx", "id", "sha256", "bucket", F.round("difficulty", 9).alias("difficulty"))


@query(_SCANNED + "SELECT 'scan' AS stage, k::VARCHAR AS row_id, reject_reason AS error_type, CASE WHEN reject_reason IN ('no_svg', 'too_long') THEN '' ELSE array_to_string(errors, '; ') END AS message FROM z WHERE reject_reason IS NOT NULL")
def error_log(spark, d):
    return curate.error_rows(scanned(spark, d), "scan").drop("sha256")


@query(_DRAWN + """, c AS (SELECT * FROM (SELECT * FROM r ORDER BY k LIMIT 150) JOIN f USING (k) WHERE f.n_drawable >= 2 AND length(f.normalized) <= 15000 ORDER BY k LIMIT 40)
SELECT k AS row_pos, CASE WHEN t THEN 'labeled' ELSE 'other' END AS bucket, n_drawable::INTEGER AS n_drawable FROM c""")
def preview(spark, d):
    return materialize.preview(named(spark, d), 40, 150, max_chars=15_000).select("row_pos", "bucket", "report.n_drawable")


@query(_SCANNED + """, a AS (SELECT k, CASE WHEN k % 4 = 0 THEN k // 4 + 1 END AS place FROM f),
o AS (SELECT *, lpad(coalesce(place, 1000000000)::VARCHAR, 12, '0') || CASE WHEN place IS NULL THEN md5('42:' || k) ELSE '' END || lpad(k::VARCHAR, 19, '0') AS ord FROM a JOIN f USING (k) WHERE len(f.errors) = 0 ORDER BY ord LIMIT 120)
SELECT 'broad_f' || k AS id, sha256(normalized) AS sha256, CASE WHEN t THEN 'labeled' ELSE 'other' END AS bucket, n_drawable::INTEGER AS n_drawable, n_elements::INTEGER AS n_elements, CASE WHEN place IS NULL THEN 'unknown' ELSE 'medoid' END AS selection_reason, k AS cluster_pool_idx, 'svgs/broad_f' || k || '.svg' AS svg_path, 'pngs/broad_f' || k || '.png' AS image_path FROM o""")
def train_manifest(spark, d):
    pool = drawings(spark, d).filter("svg is not null").select(F.col("k").alias("pool_idx"), F.concat(F.lit("f"), "k").alias("id"), "svg")
    picks = pool.filter("pool_idx % 4 = 0").select("pool_idx", F.lit("medoid").alias("reason"), F.expr("pool_idx div 4 + 1").alias("place"))
    return materialize.materialized(pool, picks, 120)[0]


_KINDS = """WITH r AS (SELECT p_partkey AS k, p_name, p_partkey % 4 AS m, CASE WHEN p_partkey % 19 = 0 THEN 205 ELSE 1 + p_partkey % 3 END AS rects, p_partkey % 2 AS circles, (p_partkey % 3 = 1)::INT AS ellipses, p_partkey % 4 AS lines,
  (p_partkey % 5 = 0)::INT AS polylines, (p_partkey % 7 = 0)::INT AS polygons, 1 - p_partkey % 2 AS paths, (p_partkey % 3 = 0)::INT AS markers FROM part),
n AS (SELECT *, 2 + m + rects + circles + ellipses + lines + polylines + polygons + paths + 2 * markers AS n FROM r)
"""


def kinds(spark, d) -> DataFrame:
    """(k, svg): every kind of shape in numbers that k gives, inside k % 4 groups, with 1 to 7 colors; k % 19 = 0 has 205 boxes."""
    k = F.col("p_partkey")
    rects = F.when(k % 19 == 0, 205).otherwise(1 + k % 3).cast("int")
    boxes = F.transform(F.sequence(F.lit(1), rects), lambda i: F.concat(F.lit('<rect width="1" height="1" fill="#c0'), ((i - 1) % (1 + k % 5)).cast("int"), F.lit('"/>')))
    path = F.concat(F.lit('<path d="M0 0'), F.repeat(F.lit("L1 1"), (k % 6).cast("int")), F.lit('"/>'))
    svg = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 400 100">'), _if(k % 3 == 0, '<defs><marker id="a"/></defs>'), F.repeat(F.lit("<g>"), (k % 4).cast("int")), F.array_join(boxes, ""),
        _if(k % 2 == 1, '<circle r="2" fill="none" stroke="blue"/>'), _if(k % 3 == 1, "<ellipse/>"), F.repeat(F.lit('<line stroke="blue"/>'), (k % 4).cast("int")), _if(k % 5 == 0, "<polyline/>"), _if(k % 7 == 0, '<polygon fill="transparent"/>'),
        F.when(k % 2 == 0, path).otherwise(""), F.lit("<text> "), "p_name", F.lit(" </text>"), F.repeat(F.lit("</g>"), (k % 4).cast("int")), F.lit("</svg>"),
    )
    return parts(spark, d).select(k.alias("k"), svg.alias("svg"))


@query(_KINDS + """SELECT k, paths::DOUBLE AS n_path, rects::DOUBLE AS n_rect, circles::DOUBLE AS n_circle, ellipses::DOUBLE AS n_ellipse, lines::DOUBLE AS n_line, polylines::DOUBLE AS n_polyline, polygons::DOUBLE AS n_polygon, 1e0 AS n_text, m::DOUBLE AS n_g, n::DOUBLE AS n_elements,
greatest(m + 1, 2 * markers)::DOUBLE AS max_depth, (least(rects, 1 + k % 5) + (circles + lines > 0)::INT)::DOUBLE AS n_colors, length(trim(p_name))::DOUBLE AS text_chars, (CASE WHEN paths = 1 THEN 1 + k % 6 ELSE 0 END)::DOUBLE AS path_segments, 4e0 AS aspect_ratio, m::DOUBLE AS n_groups, markers::DOUBLE AS n_markers,
(rects + circles + ellipses)::INTEGER AS b, (lines + polylines)::INTEGER AS k_group, (paths + polygons)::INTEGER AS c, 1 AS t, CASE WHEN n > 200 THEN 'too many elements: ' || n ELSE '' END AS errors FROM n""")
def all_features(spark, d):
    r = with_report(kinds(spark, d))
    names = [f.name for f in r.schema["report"].dataType["features"].dataType]
    g = F.col("report.groups")
    return r.select("k", *(F.col(f"report.features.{n}").alias(n) for n in names), g["B"].alias("b"), g["K"].alias("k_group"), g["C"].alias("c"), g["T"].alias("t"), F.array_join("report.errors", "; ").alias("errors"))


@query(_SCANNED + "SELECT error_type, count(*) AS n FROM (SELECT reject_reason AS error_type FROM z WHERE reject_reason IS NOT NULL) GROUP BY 1")
def reason_histogram(spark, d):
    return funnel.histogram(curate.error_rows(scanned(spark, d), "scan"), "error_type")


# --- scene graphs in markup ----------------------------------------------------------------------------------------


def scenes(spark, d) -> DataFrame:
    """(k, svg): three boxes with data attributes and the edges between them; by k % 3 only the boxes' geometry and texts."""
    k = F.col("p_partkey")
    x = lambda i: k % 50 + 200 * i
    box = lambda i: F.concat(F.lit(f'<rect data-entity-id="n{i}" data-entity-type="node" data-label="'), "p_name", F.lit(f' {i}" x="'), x(i), F.lit('" y="20" width="80" height="40"/>'))
    edge = lambda a, b, kind: F.concat(F.lit(f'<line data-edge="n{a}>n{b}:{kind}:'), "p_brand", F.lit('" x1="0" y1="0" x2="1" y2="1"/>'))
    plain = lambda i: F.concat(F.lit('<text x="'), x(i) + 40, F.lit('" y="40">'), "p_name", F.lit(f' {i}</text><rect x="'), x(i), F.lit('" y="20" width="80" height="40"/>'))
    line = lambda a, b: F.concat(F.lit('<line x1="'), x(a) + 80, F.lit('" y1="40" x2="'), x(b), F.lit('" y2="40"/>'))
    carried, drawn = F.concat(*(box(i) for i in range(3)), edge(0, 1, ""), edge(1, 2, "flow")), F.concat(*(plain(i) for i in range(3)), line(0, 1), line(1, 2))
    body = F.when(k % 3 == 0, drawn).otherwise(carried)
    return parts(spark, d).select(k.alias("k"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" data-grammar="workflow">'), body, F.lit("</svg>")).alias("svg"))


_ENTITIES = """
WITH e AS (SELECT p_partkey AS k, unnest(range(3)) AS i, p_name, p_brand, p_partkey % 50 + 200 * unnest(range(3)) AS x FROM part)
"""


@query(_ENTITIES + """SELECT k, 'n' || i AS id, 'node' AS type, p_name || ' ' || i AS label, [x, 20, 80, 40]::DOUBLE[]::VARCHAR AS bbox FROM e WHERE k % 3 <> 0
UNION ALL SELECT k, 't' || (2 * i), 'node', p_name || ' ' || i, [x + 40, 28, 60, 20]::DOUBLE[]::VARCHAR FROM e WHERE k % 3 = 0
UNION ALL SELECT k, 'b' || (2 * i + 1), 'box', p_name || ' ' || i, [x, 20, 80, 40]::DOUBLE[]::VARCHAR FROM e WHERE k % 3 = 0""")
def scene_entities(spark, d):
    rows = with_scene(scenes(spark, d)).select("k", F.explode("scene.entities").alias("e"))
    box = F.concat(F.lit("["), F.array_join(F.transform("e.bbox", lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.select("k", "e.id", "e.type", "e.label", box.alias("bbox"))


@query("""SELECT p_partkey AS k, 'n0' AS src, 'n1' AS dst, 'edge' AS type, p_brand AS label FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'n1', 'n2', 'flow', p_brand FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'b1', 'b3', 'edge', '' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'b3', 'b5', 'edge', '' FROM part WHERE p_partkey % 3 = 0""")
def scene_relations(spark, d):
    whole = with_scene(scenes(spark, d)).select("k", graphs.from_json(F.to_json(F.col("scene").dropFields("error"))).alias("scene"))  # there and back as JSON
    return whole.select("k", F.explode("scene.relations").alias("r")).select("k", "r.src", "r.dst", "r.type", "r.label")


@query("""SELECT p_partkey AS k, e.id, e.box FROM part, (SELECT unnest([{'id': 'c', 'box': [p_partkey % 50 - 5, 15, 10, 10]::DOUBLE[]::VARCHAR}, {'id': 't', 'box': '[3.0, 18.0, 40.0, 16.0]'}, {'id': 'x', 'box': NULL}, {'id': 'p', 'box': NULL}, {'id': 'd', 'box': '[0.0, 0.0, 7.0, 0.0]'}]) AS e)""")
def entity_boxes(spark, d):
    """Boxes of a circle, a text, a box with a bad number, a path, and a box without a place or height."""
    body = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><circle data-entity-id="c" r="5" cy="20" cx="'), F.col("p_partkey") % 50, F.lit('"/><text data-entity-id="t" x="3" y="30">a</text><rect data-entity-id="x" x="bad"/><path data-entity-id="p"/><rect data-entity-id="d" width="7"/></svg>'))
    rows = with_scene(parts(spark, d).select(F.col("p_partkey").alias("k"), body.alias("svg"))).select("k", F.explode("scene.entities").alias("e"))
    box = F.concat(F.lit("["), F.array_join(F.transform("e.bbox", lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.select("k", "e.id", box.alias("box"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 1 THEN round(((p_partkey % 3 <> 0)::INT + ((p_partkey + 1) % 3 <> 0)::INT + ((p_partkey + 2) % 3 <> 0)::INT) / 3e0, 9) ELSE ((p_partkey + 2) % 3 <> 0)::INT::DOUBLE END AS spatial FROM part")
def spatial_branches(spark, d):
    """Gold drawings of both grammars against predictions that lack one of three relations: recall of relations in geometry,
    paths of linking relations in workflows."""
    k = F.col("p_partkey")
    boxes = F.concat(*(F.concat(F.lit(f'<rect data-entity-id="n{i}" data-entity-type="node" data-label="'), "p_name", F.lit(f' {i}"/>')) for i in range(3)))
    edges = [F.lit(f'<line data-edge="n{a}>n{b}:{kind}:"/>') for a, b, kind in ((0, 1, "parallel"), (1, 2, "touches"), (0, 2, "edge"))]
    whole = lambda parts: F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" data-grammar="'), F.when(k % 2 == 1, "geometry").otherwise("workflow"), F.lit('">'), boxes, *parts, F.lit("</svg>"))
    rows = parts(spark, d).select(k.alias("graph"), whole(edges).alias("g"), whole([F.when((k + i) % 3 != 0, e).otherwise("") for i, e in enumerate(edges)]).alias("p"))
    both = written(with_scene(with_scene(rows, "g", "gold"), "p", "predicted"), "spatial")
    return graphs.spatial(both).select(F.col("graph").alias("k"), F.round("spatial", 9).alias("spatial"))


# --- evaluation end to end -----------------------------------------------------------------------------------------


def gold_and_predictions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold rows of three nodes in a chain (by k % 3 inline, in a sidecar, or in the markup only), predictions that are right,
    lack an edge, have another label, or are no markup (k % 4), and the sidecars. Each k % 5 = 0 is predicted twice."""
    k = F.col("p_partkey")
    node = lambda i, label: F.concat(F.lit(f'<rect data-entity-id="n{i}" data-entity-type="node" data-label="'), label, F.lit(f'" x="{i}" y="0" width="9" height="9"/>'))
    first, last = F.lit('<line data-edge="n0>n1:edge:"/>'), F.lit('<line data-edge="n1>n2:edge:"/>')
    wrap = lambda *c: F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), *c, F.lit("</svg>"))
    names = [F.col("p_name"), F.lit("B"), F.lit("C")]
    nodes = [node(i, c) for i, c in enumerate(names)]
    svg = wrap(*nodes, first, last)
    entity = F.array(*(F.struct(F.lit(f"n{i}").alias("id"), F.lit("node").alias("type"), c.alias("label")) for i, c in enumerate(names)))
    edges = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit("edge").alias("type")) for a, b in (("n0", "n1"), ("n1", "n2"))))
    graph = F.to_json(F.struct(F.lit("workflow").alias("grammar"), entity.alias("entities"), edges.alias("relations")))
    part = parts(spark, d).select("p_name", k.alias("id"), k.alias("pos"), F.when(k % 2 == 0, "id").otherwise("ood").alias("split"), svg.alias("svg"), graph.alias("graph"),
        F.when(k % 4 == 0, svg).when(k % 4 == 1, wrap(*nodes, first)).when(k % 4 == 2, wrap(nodes[0], nodes[1], node(2, F.lit("X")), first, last)).otherwise("no markup").alias("pred"))
    way = F.col("id") % 3
    path = F.concat(F.lit("s/"), "id", F.lit(".json"))
    gold = part.select("id", "pos", "split", F.when(way != 1, F.col("svg")).alias("svg"), F.when(way == 0, F.col("graph")).alias("scene_graph"), F.when(way == 1, path).alias("scene_graph_path"))
    sides = part.filter(way == 1).select(path.alias("path"), graphs.from_json(F.col("graph")).alias("scene"))
    again = part.filter("id % 5 = 0").select("id", F.lit(-1).cast("long").alias("pos"), F.lit("earlier").alias("pred_text"))
    return gold, part.filter("id % 10 <> 7").select("id", "pos", F.col("pred").alias("pred_text")).unionByName(again), sides


_SCORES = """
WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'id' ELSE 'ood' END AS split, p_partkey % 4 <> 3 AS parse_ok, (p_partkey % 4 <> 3)::INT::DOUBLE AS validity, CASE p_partkey % 4 WHEN 3 THEN 0 WHEN 1 THEN 4 ELSE 5 END AS n_drawable, CASE WHEN p_partkey % 3 <> 1 THEN true END AS gold_ok,
                  round([1, 1, 2e0 / 3, 0][p_partkey % 4 + 1], 9) AS entity_f1, round([1, 2e0 / 3, 0.5, 0][p_partkey % 4 + 1], 9) AS relation_f1, round([1, 1e0 / 3, 1e0 / 3, 0][p_partkey % 4 + 1], 9) AS spatial FROM part WHERE p_partkey % 10 <> 7)
"""


def scored(spark, d, split: str = "all") -> DataFrame:
    gold, predictions, sides = gold_and_predictions(spark, d)
    s = scoring.score(gold, predictions, split, sides)
    return s.withColumns({m: F.round(m, 9) for m in scoring.METRICS})


@query(_SCORES + "SELECT id, parse_ok, validity, n_drawable::INTEGER AS n_drawable, gold_ok, entity_f1, relation_f1, spatial FROM s")
def score_examples(spark, d):
    return scored(spark, d).drop("errors")


@query(_SCORES + "SELECT count(*) AS n, round(avg(validity), 6) AS validity, round(avg(entity_f1), 6) AS entity_f1, round(avg(relation_f1), 6) AS relation_f1, round(avg(spatial), 6) AS spatial FROM s WHERE split = 'id'")
def eval_report(spark, d):
    a = scoring.aggregate(scored(spark, d, "id"))
    return a.select("n", *(F.round(m, 6).alias(m) for m in scoring.METRICS))


@query("SELECT 'gold_recovery' AS stage, false AS ok, 'entity_f1, relation_f1, spatial' AS detail")
def recovery_gate(spark, d):
    return scoring.recovery_gate(scored(spark, d))


@query("SELECT 'gold_recovery' AS stage, true AS ok, '' AS detail")
def recovery_gate_passes(spark, d):
    gold, _, sides = gold_and_predictions(spark, d)
    full = gold.filter("svg is not null")
    return scoring.recovery_gate(scoring.score(gold, full.select("id", "pos", F.col("svg").alias("pred_text")), "all", sides))


@query(_SCORES + """, c AS (SELECT round(avg(validity), 6) AS v, round(avg(entity_f1), 6) AS e, round(avg(relation_f1), 6) AS r, round(avg(spatial), 6) AS s FROM s WHERE id % 3 = 0),
h AS (SELECT round(avg(validity), 6) AS v, round(avg(entity_f1), 6) AS e, round(avg(relation_f1), 6) AS r, round(avg(spatial), 6) AS s FROM s WHERE id % 3 = 1), b AS (SELECT round(avg(validity), 6) AS v, round(avg(entity_f1), 6) AS e, round(avg(relation_f1), 6) AS r, round(avg(spatial), 6) AS s FROM s WHERE id % 3 = 2)
SELECT c.v AS correct_validity, c.e AS correct_entity_f1, c.r AS correct_relation_f1, c.s AS correct_spatial, h.v AS shuffled_validity, h.e AS shuffled_entity_f1, h.r AS shuffled_relation_f1, h.s AS shuffled_spatial, b.v AS blank_validity, b.e AS blank_entity_f1, b.r AS blank_relation_f1, b.s AS blank_spatial, abs(c.r - h.r) < 0.05 AS warning FROM c, h, b""")
def three_controls(spark, d):
    rows = scored(spark, d)
    mean = lambda k: scoring.aggregate(rows.filter(F.col("id") % 3 == k)).select(*(F.round(m, 6).alias(m) for m in scoring.METRICS))
    return scoring.controls({"correct": mean(0), "shuffled": mean(1), "blank": mean(2)})


@query("""WITH l AS (SELECT user_id AS run, list(value ORDER BY event_id) FILTER (event_id % 2 = 0) AS a, list(value ORDER BY event_id) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1),
n AS (SELECT *, least(len(a), len(b)) AS n FROM l) SELECT run, (i - 1)::INTEGER AS step, round(a[i] - b[i], 9) AS gap FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0)""")
def checkpoint_gaps(spark, d):
    half = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("event_id") % 2 == k, F.struct("event_id", "value")))), lambda s: s["value"])
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(half(0).alias("id_structure"), half(1).alias("ood_structure"))
    return scoring.checkpoint_gaps(runs).withColumn("gap", F.round("gap", 9))


@query("SELECT p_partkey AS k, 2 AS n, 'user,assistant' AS roles, 'img/' || p_partkey AS image, sha256('Reconstruct the diagram as a single canonical SVG. Use viewBox=\"0 0 512 512\". Output only SVG markup.') AS prompt_sha, p_name AS answer FROM part")
def train_messages(spark, d):
    m = scoring.messages(F.concat(F.lit("img/"), "p_partkey"), F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), m.alias("m"))
    return rows.select("k", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.col("m")[0]["content"][0]["image"].alias("image"), F.sha2(F.col("m")[0]["content"][1]["text"], 256).alias("prompt_sha"), F.col("m")[1]["content"][0]["text"].alias("answer"))


@query("""WITH v AS (SELECT doc_id AS pool_idx, embedding IS NULL AS missing, coalesce(embedding::DOUBLE[], [0e0 FOR i IN range(64)]) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT pool_idx, missing, len(v)::INTEGER AS dim, round(list_sum(v), 6) AS total FROM v""")
def vectors_or_zeros(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("pool_idx"), F.col("embedding").cast("array<double>").alias("v"))
    rows = coreset.with_vectors(pool_of(spark, d).select("pool_idx"), vectors, 64)
    return rows.select("pool_idx", "missing", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH v AS (SELECT embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id), n AS (SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS m FROM v)
SELECT 'vectors' AS stage, n > 0 AND m <= 100 AS ok, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN m > 100 THEN 'more than 100 missing' END], lambda x: x IS NOT NULL), ', ') AS detail FROM n""")
def missing_vectors_gate(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("pool_idx"), F.col("embedding").cast("array<double>").alias("v"))
    return coreset.vectors_gate(coreset.with_vectors(pool_of(spark, d).select("pool_idx"), vectors, 64), 64, 100)


@query("""SELECT doc_id, sha256(CASE WHEN doc_id % 16 = 3 THEN text || '!' ELSE text END) AS sha256, CASE WHEN doc_id % 16 < 8 AND doc_id % 16 <> 3 THEN 'first' ELSE 'second' END AS run FROM documents""")
def resumed_hashes(spark, d):
    """A run that stopped half way and is taken up after part 3 has changed: half of the parts are not computed again."""
    docs, part, folder = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id") % 16, f"{shared_root(spark)}/resumed-{uuid.uuid4().hex}"
    step = lambda name: lambda rows: rows.select("doc_id", native.sha256(F.col("text")).alias("sha256"), F.lit(name).alias("run"))
    runs.resumed(docs.filter(part < 8), part, step("first"), folder)
    return runs.resumed(docs.withColumn("text", F.when(part == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), part, step("second"), folder)


@query("SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def pinned_documents(spark, d):
    """The documents as they were pinned, after others were added to their folder."""
    folder = f"{shared_root(spark)}/pinned-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    docs.write.parquet(f"{folder}/data")
    runs.pin(spark, f"{folder}/data", f"{folder}/pin")
    docs.withColumn("doc_id", -F.col("doc_id") - 1).write.mode("append").parquet(f"{folder}/data")
    return runs.pinned(spark, f"{folder}/pin")


@query("""WITH r AS (SELECT CASE WHEN length(coalesce(text, '')) > 8000 THEN 'too_long' WHEN coalesce(text, '') = '' THEN 'no_text' WHEN source IS NULL THEN 'no_source' END AS why FROM documents)
SELECT * FROM (SELECT coalesce(why, 'kept') AS counter, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'scanned', count(*) FROM r) WHERE n > 0""")
def counted_reasons(spark, d):
    """The counters of a pass that writes its rows, which are observed and not counted again."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), "source")
    why = F.when(F.col("n") > 8000, "too_long").when(F.col("n") == 0, "no_text").when(F.col("source").isNull(), "no_source")
    watched, seen = runs.counted(docs.withColumn("why", why), "why", ("too_long", "no_text", "no_source"))
    written(watched, "counted")
    return spark.createDataFrame([(k, int(n)) for k, n in seen.get.items() if n], "counter string, n long")


@query("""WITH s AS (SELECT doc_id, length(text) AS w, length(text) - length(replace(text, 'e', '')) AS h FROM documents), f AS (SELECT *, least(448e0 / w, 448e0 / h) AS scale FROM s WHERE w > 0 AND h > 0),
r AS (SELECT doc_id, greatest(1, round_even(w * scale, 0)::INTEGER) AS width, greatest(1, round_even(h * scale, 0)::INTEGER) AS height FROM f)
SELECT s.doc_id, width, height, (448 - width) // 2 AS left_edge, (448 - height) // 2 AS top_edge FROM s LEFT JOIN r USING (doc_id)""")
def letterboxed(spark, d):
    """Documents as pictures as wide as they have characters and as high as they have e's, in squares of 448."""
    n = F.length("text")
    box = native.letterbox(n, n - F.length(F.replace("text", F.lit("e"), F.lit(""))), 448)
    return table(spark, d, "documents").select("doc_id", box.alias("b")).select("doc_id", "b.width", "b.height", F.col("b.left").alias("left_edge"), F.col("b.top").alias("top_edge"))


@query(_DRAWN + "SELECT k, length(normalized)::INTEGER AS svg_len, (n_elements > 2) AS drawn FROM f WHERE n_drawable >= 2 ORDER BY k LIMIT 8")
def data_preview(spark, d):
    """The first eight rows of the training data, as a run looks at them before it starts."""
    drawn = lambda rows: with_report(rows).filter("report.n_drawable >= 2").select("k", F.length("report.normalized").alias("svg_len"), (F.col("report.n_elements") > 2).alias("drawn"))
    return first_passing(drawings(spark, d).filter("svg is not null"), "k", 8, drawn)


# --- geometry over given rows ----------------------------------------------------------------------------------------

# A vector as a shape: its first numbers are a place and a size, its label is the drawing, vec_id the order of drawing.
_SHAPES = """WITH s AS (SELECT label AS doc, vec_id AS pos, vec_id % 3 AS kind, round(400 * embedding[1]::DOUBLE, 3) AS x, round(400 * embedding[2]::DOUBLE, 3) AS y, round(100 * abs(embedding[3]::DOUBLE), 3) AS w, round(100 * abs(embedding[4]::DOUBLE), 3) AS h FROM embeddings),
b AS (SELECT doc, pos, x, y, w, h, x + w / 2 AS mx, y + h / 2 AS my FROM s WHERE kind = 0), t AS (SELECT doc, pos, x, y, 't' || pos AS label FROM s WHERE kind = 1), l AS (SELECT doc, pos, x, y, x + w AS x2, y + h AS y2 FROM s WHERE kind = 2)
"""


def shapes(spark, d) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("at"), *(F.round(400 * e(k), 3).alias(c) for k, c in enumerate("xy")), *(F.round(100 * F.abs(e(k)), 3).alias(c) for k, c in ((2, "width"), (3, "height"))))
    return rows.withColumn("kind", F.col("at") % 3)


@query(_SHAPES + """SELECT b.pos AS box, coalesce((SELECT arg_min(label, ((t.x - mx) * (t.x - mx) + (t.y - my) * (t.y - my), t.pos)) FROM t WHERE t.doc = b.doc AND t.pos < b.pos AND (t.x - mx) * (t.x - mx) + (t.y - my) * (t.y - my) < 6400), '') AS label FROM b""")
def box_labels(spark, d):
    s = shapes(spark, d)
    texts = s.filter("kind = 1").select("doc", "at", "x", "y", F.concat(F.lit("t"), "at").alias("label"))
    return nearby.labelled(s.filter("kind = 0").withColumn("box", F.col("at")), texts).select("box", "label")


@query(_SHAPES + """SELECT line, src, dst FROM (SELECT l.pos AS line, (SELECT arg_min(b.pos, ((l.x - mx) * (l.x - mx) + (l.y - my) * (l.y - my), b.pos)) FROM b WHERE b.doc = l.doc) AS src,
(SELECT arg_min(b.pos, ((x2 - mx) * (x2 - mx) + (y2 - my) * (y2 - my), b.pos)) FROM b WHERE b.doc = l.doc) AS dst FROM l) WHERE src <> dst""")
def line_edges(spark, d):
    s = shapes(spark, d)
    lines = s.filter("kind = 2").select("doc", F.col("at").alias("line"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    return nearby.connected(lines, s.filter("kind = 0").withColumn("box", F.col("at"))).select("line", "src", "dst")


# --- selection end to end ------------------------------------------------------------------------------------------


def pool_of(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("pool_idx"), native.sha256(F.coalesce("text", F.lit(""))).alias("sha256"), native.average_hash_key(F.coalesce("text", F.lit(""))).alias("phash"), F.when(F.col("doc_id") % 3 == 0, "labeled").when(F.col("doc_id") % 3 == 1, "workflow_like").otherwise("other").alias("bucket"))


@query("SELECT doc_id AS pool_idx, len(embedding)::INTEGER AS dim FROM documents JOIN embeddings ON vec_id = doc_id")
def pool_vectors(spark, d):
    return materialize.aligned(pool_of(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "pool_idx")).select("pool_idx", F.size("embedding").alias("dim"))


@query("WITH b AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM embeddings) AS m, (SELECT count(*) FROM (SELECT doc_id FROM documents) x FULL JOIN embeddings ON vec_id = doc_id WHERE doc_id IS NULL OR vec_id IS NULL) AS odd) SELECT 'align' AS stage, n > 0 AND n = m AND odd = 0 AS ok, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty pool' END, CASE WHEN n <> m THEN 'rows' END, CASE WHEN odd > 0 THEN 'keys' END], lambda x: x IS NOT NULL), ', ') AS detail FROM b")
def alignment_gate(spark, d):
    return materialize.aligned_gate(pool_of(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "pool_idx"))


@query("SELECT doc_id AS pool_idx, 'index' AS way FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'hash' FROM documents WHERE sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 10 = 0)")
def pool_selected(spark, d):
    pool = pool_of(spark, d)
    by_index = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("pool_idx"), F.lit(None).cast("string").alias("sha256"))
    by_hash = pool.filter("pool_idx % 10 = 0").select(F.lit(None).cast("long").alias("pool_idx"), "sha256")
    return materialize.selected(pool, by_index).select("pool_idx", F.lit("index").alias("way")).unionByName(materialize.selected(pool, by_hash).select("pool_idx", F.lit("hash").alias("way")))


@query("""WITH p AS (SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS phash, CASE WHEN doc_id % 10 = 0 THEN doc_id // 10 + 1 END AS rank FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY rank IS NULL, rank, CASE WHEN rank IS NULL THEN md5('42:' || doc_id) END, doc_id) AS ord FROM p),
u AS (SELECT doc_id, rank, row_number() OVER (ORDER BY ord) AS place FROM o WHERE ord = (SELECT min(ord) FROM o x WHERE x.phash = o.phash))
SELECT doc_id AS pool_idx, CASE WHEN rank IS NULL THEN 'backfill' ELSE 'medoid' END AS reason, place::INTEGER AS place FROM u WHERE place <= 150""")
def dedup_backfill(spark, d):
    pool = pool_of(spark, d)
    picks = pool.filter("pool_idx % 10 = 0").select("pool_idx", F.lit("medoid").alias("reason"), F.expr("pool_idx div 10 + 1").alias("rank"))
    return materialize.backfilled(pool, picks, 150, threshold=0)


@query(_KEYS + f""", r AS (SELECT doc_id, key, CASE WHEN doc_id % 10 = 0 THEN doc_id // 10 + 1 END AS rank FROM k),
s AS (SELECT *, row_number() OVER (ORDER BY rank IS NULL, rank, CASE WHEN rank IS NULL THEN md5('42:' || doc_id) END, doc_id) AS pos FROM r),
f AS (SELECT key, min(pos) AS pos FROM s GROUP BY key), {_greedy('f', 'left(key, 4)')}
SELECT doc_id AS pool_idx, CASE WHEN rank IS NULL THEN 'backfill' ELSE 'medoid' END AS reason, row_number() OVER (ORDER BY s.pos)::INTEGER AS place FROM s JOIN f USING (key, pos) JOIN g USING (key) WHERE keeps QUALIFY place <= 150""")
def dedup_backfill_near(spark, d):
    pool = profiled(spark, d).select(F.col("doc_id").alias("pool_idx"), F.col("key").alias("phash"))
    picks = pool.filter("pool_idx % 10 = 0").select("pool_idx", F.lit("medoid").alias("reason"), F.expr("pool_idx div 10 + 1").alias("rank"))
    return materialize.backfilled(pool, picks, 150)


@query("WITH a AS (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100), b AS (SELECT doc_id FROM documents WHERE doc_id % 25 = 0) SELECT doc_id AS pool_idx, doc_id % 25 = 0 AS selected FROM (FROM a UNION FROM b)")
def pool_subsample(spark, d):
    pool = pool_of(spark, d)
    return materialize.subsample(pool, pool.filter("pool_idx % 25 = 0"), 100)


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END AS b FROM documents WHERE doc_id % 7 = 2), f AS (SELECT min(doc_id) AS doc_id, b FROM p GROUP BY b)
SELECT doc_id AS pool_idx, row_number() OVER (ORDER BY coalesce(f.b, 5), doc_id)::INTEGER AS place FROM p LEFT JOIN f USING (doc_id) QUALIFY place <= 12""")
def thumbnails(spark, d):
    return materialize.thumbnails(pool_of(spark, d).filter("pool_idx % 7 = 2"))


@query("""WITH g AS (SELECT 'test_hashes' AS stage, (SELECT count(*) FROM benchmark) AS n, 400 AS least UNION ALL SELECT 'scan', (SELECT count(*) FROM documents), 100 UNION ALL SELECT 'select', (SELECT count(*) FROM labels), 40 UNION ALL SELECT 'empty', 0, 1),
c AS (SELECT stage, n > 0 AND n >= least AS ok, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n < least THEN 'fewer than ' || least END], lambda x: x IS NOT NULL), ', ') AS detail FROM g)
SELECT * FROM c UNION ALL SELECT 'all', bool_and(ok), array_to_string(list_sort(list(stage) FILTER (NOT ok)), ', ') FROM c""")
def stage_gates(spark, d):
    checks = {"test_hashes": (table(spark, d, "benchmark"), 400), "scan": (table(spark, d, "documents"), 100), "select": (table(spark, d, "labels"), 40), "empty": (table(spark, d, "labels").filter("false"), 1)}
    return materialize.run_gates(spark, {k: materialize.least_rows(k, rows, n) for k, (rows, n) in checks.items()})
