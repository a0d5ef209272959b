"""Synthetic diagrams with gold scene graphs: rows of a range, each drawn from its own seeded generator."""

from __future__ import annotations

import json
import random
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import canonical, parse
from ..sources.tables import by_value

by_value(__name__)

# What a drawing is made of.
LABELS = ("Start", "Ingest", "Validate", "Transform", "Branch", "Merge", "Store", "Notify", "End", "Review", "Compute", "Filter")
PATTERNS = ("chain", "single_branch", "single_merge")
DECISIONS = ("Branch", "Validate", "Filter")
RELATIONS = ("left_of", "above", "contains_circle")
# How each kind of shape is drawn.
STYLES = {
    "node": {"rx": 6, "fill": "#bfdbfe", "stroke": "#1e3a8a", "stroke_width": 2},
    "decision": {"rx": 6, "fill": "#fde68a", "stroke": "#1e3a8a", "stroke_width": 2},
    "caption": {"text_anchor": "middle", "font_size": 14, "font_family": "Arial"},
    "edge": {"stroke": "#111827", "stroke_width": 2, "marker_end": "url(#arrow)"},
    "group": {"fill": "none", "stroke": "#9ca3af", "stroke_dasharray": "6 4"},
    "marker": {"id": "arrow", "markerWidth": 10, "markerHeight": 10, "refX": 8, "refY": 3, "orient": "auto"},
    "tip": {"d": "M0,0 L8,3 L0,6 Z", "fill": "#111827"},
    "point": {"r": 4, "fill": "#111827"},
    "name": {"font_size": 16, "font_family": "Arial"},
    "segment": {"stroke": "#1d4ed8", "stroke_width": 2},
    "circle": {"r": 36, "fill": "none", "stroke": "#dc2626", "stroke_width": 2},
}


def _tag(name: str, text: str | None = None, **attrs) -> str:
    body = " ".join(f"{k.replace('_', '-')}={quoteattr(str(v))}" for k, v in attrs.items())
    return f"<{name} {body}/>" if text is None else f"<{name} {body}>{escape(text)}</{name}>"


def _around(name: str, inner: str, **attrs) -> str:
    return f"{_tag(name, **attrs)[:-2].rstrip()}>{inner}</{name}>"


def _entity(key: str, kind: str, label: str, x: float, y: float, w: float, h: float) -> dict:
    return {"id": key, "type": kind, "label": label, "bbox": [x, y, w, h], "attrs": {}}


def _document(grammar: str, scene: dict, drawn: list[str]) -> str:
    desc = escape(json.dumps(scene, separators=(",", ":")))
    text = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 512 512" data-grammar="{grammar}"><desc data-scenegraph="1">{desc}</desc>{"".join(drawn)}</svg>'
    root, why = parse(text)
    if root is None:
        raise ValueError(why)
    return canonical(root)


def _layout(pattern: str, n: int) -> tuple[list[tuple[float, float]], list[tuple[int, int]]]:
    """Places of the nodes and the edges between them."""
    tail = [(360 + 50 * (i - 3), 240.0) for i in range(3, n)]
    if pattern == "chain":
        return [(60 + i * 400 / max(n - 1, 1), 220.0) for i in range(n)], [(i, i + 1) for i in range(n - 1)]
    if pattern == "single_branch":
        return [(80, 240), (220, 140), (220, 340), *tail], [(0, 1), (0, 2), *((2 - i % 2, i) for i in range(3, n))]
    if pattern == "single_merge":
        return [(80, 140), (80, 340), (240, 240), *tail], [(0, 2), (1, 2), *((i - 1, i) for i in range(3, n))]
    more = [(420, 120 + 40 * i) for i in range(5, n)]
    return [(60, 240), (180, 120), (180, 360), (320, 240), (420, 240), *more], [(0, 1), (0, 2), (1, 3), (2, 3), *((3, i) for i in range(4, n))]


def workflow(idx: int, split: str, seed: int) -> dict:
    rng, ood = random.Random(seed + idx * 17), split == "ood"
    n = rng.randint(7, 9) if ood else rng.randint(3, 6)
    pattern = "branch_merge" if ood else rng.choice(PATTERNS)
    labels = rng.sample(LABELS, n)
    places, edges = _layout(pattern, n)
    ents, drawn = [], [_around("defs", _around("marker", _tag("path", **STYLES["tip"]), **STYLES["marker"]))]
    if ood:
        drawn.append(_around("g", _tag("rect", x=140, y=80, width=120, height=320, **STYLES["group"]), data_entity_id="grp0", data_entity_type="group", data_label="cluster"))
    for k, (label, (x, y)) in enumerate(zip(labels, places, strict=True)):
        kind = "decision" if label in DECISIONS else "node"
        ents.append(_entity(f"n{k}", kind, label, x - 50.0, y - 20.0, 100.0, 40.0))
        drawn.append(_tag("rect", data_entity_id=f"n{k}", data_entity_type=kind, data_label=label, x=f"{x - 50.0:.1f}", y=f"{y - 20.0:.1f}", width=100.0, height=40.0, **STYLES[kind]))
        drawn.append(_tag("text", label, data_entity_id=f"n{k}_t", data_entity_type="label", data_label=label, x=f"{x:.1f}", y=f"{y + 5:.1f}", **STYLES["caption"]))
    rels = [{"src": f"n{a}", "dst": f"n{b}", "type": "edge", "label": ""} for a, b in edges]
    drawn += [_tag("line", data_edge=f"n{a}>n{b}:edge:", x1=f"{places[a][0]:.1f}", y1=f"{places[a][1]:.1f}", x2=f"{places[b][0]:.1f}", y2=f"{places[b][1]:.1f}", **STYLES["edge"]) for a, b in edges]
    if ood:
        ents.append(_entity("grp0", "group", "cluster", 140, 80, 120, 320))
    scene = {"grammar": "workflow", "entities": ents, "relations": rels, "meta": {"pattern": pattern, "split": split, "idx": idx}}
    return {"id": f"wf_{split}_{idx:04d}", "split": split, "grammar": "workflow", "pattern": pattern, "scene_graph": json.dumps(scene), "svg": _document("workflow", scene, drawn)}


def geometry(idx: int, split: str, seed: int) -> dict:
    rng = random.Random(seed + 1000 + idx * 13)
    shift = lambda r: rng.randint(-r, r)
    a, b = (120 + shift(20), 360), (380 + shift(20), 360)
    c = (250 + shift(30), 140 + shift(20))
    points = {"A": a, "B": b, "C": c}
    chosen = list(RELATIONS) if split == "ood" else [rng.choice(RELATIONS)]
    ents, rels, drawn = [], [], []
    for name, (x, y) in points.items():
        ents.append(_entity(f"p{name}", "point", name, x - 4, y - 4, 8, 8))
        drawn.append(_tag("circle", data_entity_id=f"p{name}", data_entity_type="point", data_label=name, cx=x, cy=y, **STYLES["point"]))
        drawn.append(_tag("text", name, data_entity_id=f"p{name}_t", data_entity_type="label", data_label=name, x=x + 8, y=y - 8, **STYLES["name"]))
    for s, t in ("AB", "BC", "CA"):
        (x1, y1), (x2, y2) = points[s], points[t]
        ents.append(_entity(f"s{s}{t}", "segment", s + t, min(x1, x2), min(y1, y2), abs(x2 - x1), abs(y2 - y1)))
        rels += [{"src": f"p{p}", "dst": f"s{s}{t}", "type": "incident", "label": ""} for p in (s, t)]
        drawn.append(_tag("line", data_entity_id=f"s{s}{t}", data_entity_type="segment", data_label=s + t, data_edge=f"p{s}>p{t}:connects:", x1=x1, y1=y1, x2=x2, y2=y2, **STYLES["segment"]))
    ends = {"left_of": ("pA", "pB", "left_of"), "above": ("pC", "pA", "above"), "contains_circle": ("circ0", "pC", "contains")}
    rels += [dict(zip(("src", "dst", "type"), ends[k], strict=True), label="") for k in chosen]
    if "contains_circle" in chosen:
        ents.append(_entity("circ0", "circle", "ω", c[0] - 36, c[1] - 36, 72, 72))
        drawn.append(_tag("circle", data_entity_id="circ0", data_entity_type="circle", data_label="ω", cx=c[0], cy=c[1], **STYLES["circle"]))
    scene = {"grammar": "geometry", "entities": ents, "relations": rels, "meta": {"split": split, "idx": idx, "relations": chosen}}
    return {"id": f"geo_{split}_{idx:04d}", "split": split, "grammar": "geometry", "pattern": "+".join(chosen), "scene_graph": json.dumps(scene), "svg": _document("geometry", scene, drawn)}


def corpus(spark: SparkSession, train: int = 2000, id_n: int = 250, ood: int = 250, seed: int = 42) -> DataFrame:
    """(id, split, grammar, pattern, scene_graph, svg): per split the first half workflows, the rest geometry, one counter."""
    parts = None
    for split, n in (("train", train), ("id", id_n), ("ood", ood)):
        one = spark.range(n).select(F.lit(split).alias("split"), F.col("id").alias("idx"), (F.col("id") < n // 2).alias("flow"))
        parts = one if parts is None else parts.unionByName(one)

    @F.udf("struct<id:string,split:string,grammar:string,pattern:string,scene_graph:string,svg:string>", useArrow=True)
    def draw(split, idx, flow):
        return (workflow if flow else geometry)(int(idx), split, seed)

    return parts.select(draw.asNondeterministic()("split", "idx", "flow").alias("e")).select("e.*")
