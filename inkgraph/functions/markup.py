"""Markup functions that need a parser: plain Python per text, offered to Spark as Arrow-batched struct columns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import by_value

by_value(__name__)

# Fixed values of the canonical profile.
FORBIDDEN = ("script", "foreignObject", "image", "animate", "animateTransform", "animateMotion", "set", "audio", "video")
DRAWABLE = ("rect", "circle", "ellipse", "line", "polyline", "polygon", "path", "text")
ALLOWED = (*DRAWABLE, "svg", "g", "defs", "marker", "title", "desc", "tspan", "clipPath")
NUMERIC = ("x", "y", "cx", "cy", "r", "rx", "ry", "x1", "y1", "x2", "y2", "width", "height", "stroke-width")
GROUPS = {"B": ("rect", "circle", "ellipse"), "K": ("line", "polyline"), "C": ("path", "polygon"), "T": ("text",)}
FEATURE_TAGS = ("path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text", "g")
VIEW_BOX, NAMESPACE = "0 0 512 512", "http://www.w3.org/2000/svg"
COLORS = {
    "aliceblue": "#f0f8ff", "antiquewhite": "#faebd7", "aqua": "#00ffff", "aquamarine": "#7fffd4", "azure": "#f0ffff", "beige": "#f5f5dc", "bisque": "#ffe4c4", "black": "#000000", "blue": "#0000ff",
    "brown": "#a52a2a", "cyan": "#00ffff", "darkgray": "#a9a9a9", "darkgrey": "#a9a9a9", "dimgray": "#696969", "dimgrey": "#696969", "gray": "#808080", "grey": "#808080", "green": "#008000", "inherit": "none",
    "lightgray": "#d3d3d3", "lightgrey": "#d3d3d3", "lime": "#00ff00", "magenta": "#ff00ff", "maroon": "#800000", "navy": "#000080", "orange": "#ffa500", "pink": "#ffc0cb", "purple": "#800080", "red": "#ff0000",
    "silver": "#c0c0c0", "transparent": "none", "white": "#ffffff", "yellow": "#ffff00",
}
FONTS = {
    "freesans": "DejaVu Sans", "free sans": "DejaVu Sans", "freeserif": "DejaVu Serif", "freemono": "DejaVu Sans Mono", "helvetica": "DejaVu Sans", "arial": "DejaVu Sans", "sans-serif": "DejaVu Sans",
    "times": "DejaVu Serif", "times new roman": "DejaVu Serif", "courier": "DejaVu Sans Mono", "courier new": "DejaVu Sans Mono", "monospace": "DejaVu Sans Mono",
}


def local(name) -> str:
    return str(name).rpartition("}")[2]


def parse(text: str | None, root_tag: str = "svg", strict_href: bool = False) -> tuple[ElementTree.Element | None, str | None]:
    """The root with plain tag names and without namespaced attributes, or None and why.

    strict_href keeps the local name of namespaced href attributes, so that the reference rule sees them."""
    try:
        root = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError) as e:
        return None, f"parse error: {e}"
    for node in root.iter():
        node.tag = local(node.tag)
        for k in [k for k in node.attrib if k.startswith("{")]:
            v = node.attrib.pop(k)
            if strict_href and local(k) == "href":
                node.attrib["href"] = v
    return (root, None) if root.tag == root_tag else (None, f"root is {root.tag}")


def number(text: str) -> str:
    """Canonical form of a numeric attribute: an integer within 1e-6, else three places without trailing zeros."""
    try:
        x = float(text)
    except ValueError:
        return text
    if x != x:
        return text
    return str(round(x)) if abs(x - round(x)) < 1e-6 else f"{x:.3f}".rstrip("0").rstrip(".")


def length(text: str) -> float | None:
    found = re.fullmatch(r"([\d.]+)\s*(?:pt|px|cm|mm|in|em|ex|pc|%)?", text.strip(), re.I)
    try:
        return float(found[1] if found else text)
    except ValueError:
        return None


def canonical(root: ElementTree.Element) -> str:
    """The normalized serialization: default namespace, one size, numbers and attribute order fixed, blanks dropped."""
    box = (root.get("viewBox") or VIEW_BOX).split()
    root.attrib.setdefault("xmlns", NAMESPACE)
    if len(box) == 4:
        w, h = (number(str(length(b) or 512.0)) for b in box[2:])
        root.attrib |= {"viewBox": f"{box[0]} {box[1]} {w} {h}", "width": w, "height": h}
    else:
        root.attrib |= {"viewBox": VIEW_BOX, "width": "512", "height": "512"}
    for node in root.iter():
        fixed = {k: number(v) if k in NUMERIC else v for k, v in sorted(node.attrib.items())}
        node.attrib.clear()
        node.attrib.update(fixed)
        node.text, node.tail = ((t or "").strip() or None for t in (node.text, node.tail))
    return re.sub(r">\s+<", "><", ElementTree.tostring(root, encoding="unicode"))


def shape(root: ElementTree.Element) -> dict[str, float]:
    """Structural counts of a tree: elements by tag, depth, colors, text, path segments, groups, markers, aspect."""
    out = dict.fromkeys([*(f"n_{t}" for t in FEATURE_TAGS), "n_elements", "max_depth", "text_chars", "path_segments", "n_groups", "n_markers"], 0.0)
    colors, todo = set(), [(root, 0)]
    while todo:
        node, depth = todo.pop()
        todo += [(c, depth + 1) for c in node]
        out["n_elements"] += 1
        out["max_depth"] = max(out["max_depth"], depth)
        if node.tag in FEATURE_TAGS:
            out[f"n_{node.tag}"] += 1
        out["n_groups"] += node.tag == "g"
        out["n_markers"] += node.tag == "marker"
        if node.tag == "path" and node.get("d"):
            out["path_segments"] += max(1, len(re.findall("[MLHVCSQTAZmlhvcsqtaz]", node.get("d"))))
        if node.tag == "text":
            out["text_chars"] += len((node.text or "").strip())
        colors |= {c for c in (node.get("fill"), node.get("stroke")) if c and c not in ("none", "transparent")}
    out["n_colors"], out["aspect_ratio"] = float(len(colors)), aspect(root)
    return out


def aspect(root: ElementTree.Element) -> float:
    def ratio(w: str, h: str) -> float | None:
        try:
            return float(w) / float(h) if float(h) > 0 else None
        except ValueError:
            return None

    box = re.split(r"[\s,]+", (root.get("viewBox") or root.get("viewbox") or "").strip())
    found = ratio(box[2], box[3]) if len(box) >= 4 else None
    if found is None:
        found = ratio(*(re.sub(r"[^\d.]", "", root.get(k) or "1") or "1" for k in ("width", "height")))
    return 1.0 if found is None else found


Parsed = tuple[ElementTree.Element | None, str | None]


def inspect(text: str | None, max_elements: int = 200, min_drawable: int = 2, strict_href: bool = False, parsed: Parsed | None = None, counted: bool = True) -> dict:
    """The whole report on one text: errors, warnings, counts, canonical form, its sha256, groups and features. parsed: what
    parse() gives for this text, where it has been called already. Groups and features are left out unless counted."""
    root, why = parsed or parse(text, strict_href=strict_href)
    out = {"parse_ok": root is not None, "errors": [], "warnings": [], "n_elements": 0, "n_drawable": 0, "normalized": None, "sha256": None, "groups": None, "features": None}
    if root is None:
        return out | {"errors": [why], "ok": False}
    nodes = list(root.iter())
    out["n_elements"], out["n_drawable"] = len(nodes), sum(n.tag in DRAWABLE for n in nodes)
    for n in nodes:
        if n.tag in FORBIDDEN:
            out["errors"].append(f"forbidden tag: {n.tag}")
        elif n.tag not in ALLOWED:
            out["warnings"].append(f"unexpected tag: {n.tag}")
        for k, v in n.attrib.items():
            if k.endswith("href") and v and not v.startswith("#"):
                out["errors"].append(f"external href: {v[:40]}")
            if "base64," in v:
                out["errors"].append("embedded base64 resource")
    if out["n_drawable"] < min_drawable:
        out["errors"].append(f"too few drawable elements: {out['n_drawable']}")
    if len(nodes) > max_elements:
        out["errors"].append(f"too many elements: {len(nodes)}")
    if counted:
        out["groups"] = {g: sum(n.tag in tags for n in nodes) for g, tags in GROUPS.items()}
        out["features"] = shape(root)
    try:
        out["normalized"] = canonical(root)
        out["sha256"] = hashlib.sha256(out["normalized"].encode("utf-8")).hexdigest()
    except (OverflowError, ValueError) as e:
        out["errors"].append(f"normalize failed: {e}")
    return out | {"ok": not out["errors"]}


def render_ready(text: str) -> str:
    """Named colors and font families that a renderer may not know, rewritten; others stay."""
    def known(table: dict[str, str]):
        def swap(m: re.Match) -> str:
            found = table.get(m["value"].strip(" \t\r\n'\"").lower())
            return f'{m["name"]}="{found}"' if found else m[0]

        return swap

    for names, table in (("fill|stroke", COLORS), ("font-family", FONTS)):
        text = re.sub(rf"(?i)(?P<name>{names})\s*=\s*(?P<q>[\"'])(?P<value>.*?)(?P=q)", known(table), text)
    return text


def _bbox(n: ElementTree.Element) -> list[float] | None:
    at = lambda *names: [float(n.get(k, 0)) for k in names]
    try:
        if n.tag == "rect":
            return at("x", "y", "width", "height")
        if n.tag == "circle":
            cx, cy, r = at("cx", "cy", "r")
            return [cx - r, cy - r, 2 * r, 2 * r]
        if n.tag == "text":
            x, y = at("x", "y")
            return [x, y - 12, 40.0, 16.0]
    except ValueError:
        pass
    return None


def _scene(grammar: str, entities: list[dict], relations: list[dict], meta: dict | None = None) -> dict:
    return {"grammar": grammar, "entities": entities, "relations": relations, "meta": {k: v if isinstance(v, str) else json.dumps(v) for k, v in (meta or {}).items()}}


def embedded_scene(text: str | None, parsed: Parsed | None = None) -> dict | None:
    """The scene graph that a text carries: its JSON description first, else its data attributes; None if it has none."""
    root, _ = parsed or parse(text)
    if root is None:
        return None
    for n in root.iter("desc"):
        if n.get("data-scenegraph") == "1" and n.text:
            try:
                g = json.loads(n.text)
            except json.JSONDecodeError:
                continue
            ents = [{"id": e["id"], "type": e["type"], "label": e.get("label", ""), "bbox": e.get("bbox"), "attrs": {k: str(v) for k, v in e.get("attrs", {}).items()}} for e in g.get("entities", [])]
            rels = [{"src": r["src"], "dst": r["dst"], "type": r["type"], "label": r.get("label", "")} for r in g.get("relations", [])]
            return _scene(g["grammar"], ents, rels, g.get("meta"))
    ents, rels = [], []
    for n in root.iter():
        if key := n.get("data-entity-id"):
            ents.append({"id": key, "type": n.get("data-entity-type", n.tag), "label": n.get("data-label", (n.text or "").strip()), "bbox": _bbox(n), "attrs": {}})
        if edge := re.match(r"([^>]+)>([^:]+):([^:]*):(.*)", n.get("data-edge", "")):
            rels.append({"src": edge[1], "dst": edge[2], "type": edge[3] or "edge", "label": edge[4]})
    return _scene(root.get("data-grammar", "workflow"), ents, rels) if ents or rels else None


def guessed_scene(text: str | None, radius: float = 80.0, parsed: Parsed | None = None) -> dict:
    """A workflow graph read from geometry alone: texts and boxes are entities, lines join the nearest boxes.

    A box takes the nearest text before it within the radius; the first wins a tie. Bad numbers raise ValueError."""
    root, _ = parsed or parse(text)
    ents, boxes, texts, rels = [], [], [], []
    value = lambda n, k: float(n.get(k, 0))
    for n in root.iter() if root is not None else ():
        if n.tag == "text" and (label := (n.text or "").strip()):
            x, y = value(n, "x"), value(n, "y")
            ents.append({"id": f"t{len(ents)}", "type": "node", "label": label, "bbox": [x, y - 12, 60.0, 20.0], "attrs": {}})
            texts.append((x, y, label))
        elif n.tag == "rect":
            x, y, w, h = (value(n, k) for k in ("x", "y", "width", "height"))
            cx, cy = x + w / 2, y + h / 2
            away, label = min((((tx - cx) ** 2 + (ty - cy) ** 2, label) for tx, ty, label in texts), key=lambda p: p[0], default=(radius**2, ""))
            ents.append({"id": f"b{len(ents)}", "type": "box", "label": label if away < radius**2 else "", "bbox": [x, y, w, h], "attrs": {}})
            boxes.append((cx, cy, ents[-1]["id"]))
    for n in root.iter("line") if root is not None else ():
        ends = [min(boxes, key=lambda b: (b[0] - value(n, f"x{k}")) ** 2 + (b[1] - value(n, f"y{k}")) ** 2, default=(0, 0, None))[2] for k in (1, 2)]  # noqa: B023
        if all(ends) and ends[0] != ends[1]:
            rels.append({"src": ends[0], "dst": ends[1], "type": "edge", "label": ""})
    return _scene("workflow", ents, rels)


def scene_of(text: str | None, parsed: Parsed | None = None) -> dict:
    """Embedded, else guessed, with `error` set instead of an exception for texts with bad numbers or fields."""
    parsed = parsed or parse(text)
    try:
        return (embedded_scene(text, parsed) or guessed_scene(text, parsed=parsed)) | {"error": None}
    except (ValueError, KeyError, TypeError) as e:
        return _scene("workflow", [], []) | {"error": f"{type(e).__name__}: {e}"[:500]}


REPORT = (
    "struct<ok:boolean,parse_ok:boolean,errors:array<string>,warnings:array<string>,n_elements:int,n_drawable:int,normalized:string,sha256:string,"
    "groups:struct<B:int,K:int,C:int,T:int>,features:struct<" + ",".join(f"{k}:double" for k in [*(f"n_{t}" for t in FEATURE_TAGS), "n_elements", "max_depth", "n_colors", "text_chars", "path_segments", "aspect_ratio", "n_groups", "n_markers"]) + ">>"
)
SCENE = "struct<grammar:string,entities:array<struct<id:string,type:string,label:string,bbox:array<double>,attrs:map<string,string>>>,relations:array<struct<src:string,dst:string,type:string,label:string>>,meta:map<string,string>,error:string>"


JUDGED = ("ok", "parse_ok", "n_drawable", "errors")
#: What scores read of a predicted scene.
MATCHED = "struct<entities:array<struct<id:string,type:string,label:string>>,relations:array<struct<src:string,dst:string,type:string>>>"


def judge(predicted: str, markup: str | None, gold: str | None) -> dict:
    """What scoring reads of a prediction: its scene, the report on its markup, and whether the gold markup parses, with one
    parse of each text."""
    parsed = parse(predicted)
    scene = scene_of(predicted, parsed)
    report = inspect(markup, parsed=parsed if markup == predicted else None, counted=False)
    return {"predicted": scene, "own": {k: report[k] for k in JUDGED}, "gold_ok": None if gold is None else parse(gold)[0] is not None}


def with_judgement(rows: DataFrame, predicted: str, markup: str, gold: str) -> DataFrame:
    """rows with `predicted` (what scores read of it), `own` and `gold_ok` of judge(), by one function over each batch."""
    @F.udf(f"struct<predicted:{MATCHED},own:struct<ok:boolean,parse_ok:boolean,n_drawable:int,errors:array<string>>,gold_ok:boolean>", useArrow=True)
    def run(p, m, g):
        return judge(p, m, g)

    return rows.withColumn("_judged", run.asNondeterministic()(predicted, markup, gold)).select(*rows.columns, "_judged.*")


def with_report(rows: DataFrame, text: str = "svg", **limits) -> DataFrame:
    """rows with `report`. The function is marked nondeterministic so that a later filter does not run it twice."""
    @F.udf(REPORT, useArrow=True)
    def run(x):
        return inspect(x, **limits)

    return rows.withColumn("report", run.asNondeterministic()(F.col(text)))


def with_scene(rows: DataFrame, text: str = "svg", col: str = "scene") -> DataFrame:
    @F.udf(SCENE, useArrow=True)
    def run(x):
        return scene_of(x)

    return rows.withColumn(col, run.asNondeterministic()(F.col(text)))


def with_render(rows: DataFrame, renderer: Callable[[str], bytes | None], text: str = "normalized") -> DataFrame:
    """rows with `png` and `render_ok` from a renderer given by the caller; one that fails gives null and false."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for x in df[text]:
                try:
                    out.append(renderer(render_ready(x)))
                except Exception:  # noqa: BLE001  a renderer may fail in any way; the row says so
                    out.append(None)
            yield df.assign(png=out, render_ok=[x is not None for x in out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["png binary", "render_ok boolean"])
    return rows.mapInPandas(run, schema)


def average_hash_bits(pixels: list[float]) -> str:
    """64 grey values to a bit string: 1 where a value reaches the mean."""
    mean = sum(pixels) / len(pixels)
    return "".join("1" if p >= mean else "0" for p in pixels)


def report_columns(report: Column) -> dict[str, Column]:
    """The pool's columns from a report: groups, shape metrics, features and difficulty."""
    from .native import difficulty, shape_metrics

    g, f = report["groups"], report["features"]
    m = shape_metrics(g["B"], g["K"], g["C"], g["T"])
    out = {f"vfig_{k}": g[k].cast("double") for k in "BKCT"} | {"vfig_N": m["n"].cast("double")} | {f"vfig_{k}": m[k] for k in ("clean", "pd", "ec")}
    names = [*(f"n_{t}" for t in FEATURE_TAGS), "n_elements", "max_depth", "n_colors", "text_chars", "path_segments", "aspect_ratio", "n_groups", "n_markers"]
    hard = difficulty(*(f[k] for k in ("n_elements", "max_depth", "path_segments", "text_chars", "n_groups", "n_colors", "n_markers")))
    return out | {f"feat_{k}": f[k].cast("float").cast("double") for k in names} | {"feat_difficulty": hard.cast("float").cast("double"), "difficulty": hard}
