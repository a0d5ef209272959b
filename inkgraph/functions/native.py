"""Scalar functions as column expressions: they stay inside generated code and reach DuckDB-checked queries unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_blob(text: Column, tag: str = "svg") -> Column:
    """The first element of a tag in any case, up to its first closing tag; without one, all from its opening; else null."""
    return F.coalesce(F.regexp_substr(text, F.lit(rf"(?is)<{tag}\b.*?</{tag}>")), F.regexp_substr(text, F.lit(rf"(?is)<{tag}\b.*")))


def blob_or_raw(text: Column, tag: str = "svg") -> Column:
    return F.coalesce(F.nullif(element_blob(text, tag), F.lit("")), text)


def dimension(text: Column) -> Column:
    """A length with or without a unit as a number, null if it is none."""
    number = F.regexp_extract(F.trim(text), r"(?i)^([0-9.]+)\s*(pt|px|cm|mm|in|em|ex|pc|%)?$", 1)
    plain = F.regexp_extract(F.trim(text), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.nullif(plain, F.lit("")).try_cast("double"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def shape_metrics(b: Column, k: Column, c: Column, t: Column) -> dict[str, Column]:
    """Element groups (basic, connector, complex, text) to count, clean share, path share and log complexity."""
    n = b + k + c
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0))
    return {"n": n, "clean": share(b + k), "pd": share(c), "ec": F.log1p((n + t).cast("double"))}


def code_reason(parsed: Column, n: Column, clean: Column, c: Column, min_clean: float = 0.40, max_complex: int = 50) -> Column:
    """The first failing rule of the code filter, null if it passes."""
    return F.when(~parsed, "vfig_parse").when(n == 0, "vfig_no_geometry").when(clean < min_clean, "vfig_low_clean").when(c > max_complex, "vfig_too_many_complex")


def count_of(text: Column, piece: str) -> Column:
    """Occurrences of a plain piece in lower-cased text (so <line also counts <linearGradient)."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def bucket(text: Column, rect: str = "<rect", line: tuple[str, ...] = ("<line", "<polyline"), path: str = "<path", label: str = "<text") -> Column:
    """The structural bucket by substring counts; the first that fits."""
    n_line = sum((count_of(text, x) for x in line[1:]), count_of(text, line[0]))
    n_rect, n_path, n_text = count_of(text, rect), count_of(text, path), count_of(text, label)
    workflow = (n_rect >= 2) & (n_text >= 1) & (n_line >= 1)
    geometry = (n_line >= 3) & (n_text <= 3) & (n_path <= 2)
    return F.when(workflow, "workflow_like").when(geometry, "geometry_like").when(n_text >= 1, "labeled").otherwise("other")


def path_segments(d: Column) -> Column:
    return F.when(F.coalesce(F.length(d), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(d, F.lit("[MLHVCSQTAZmlhvcsqtaz]"))))


def aspect(view_box: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Width by height of a view box, else of the attributes, else 1."""
    parts = F.split(F.trim(view_box), r"[\s,]+")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    boxed = F.when(at(4) > 0, at(3) / at(4))
    if width is None or height is None:
        return F.coalesce(boxed, F.lit(1.0))
    digits = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.coalesce(c, F.lit("1")), r"[^\d.]", ""), F.lit("")), F.lit("1")).try_cast("double")
    return F.coalesce(boxed, F.when(digits(height) > 0, digits(width) / digits(height)), F.lit(1.0))


def difficulty(n_elements, max_depth, path_segments, text_chars, n_groups, n_colors, n_markers) -> Column:
    return 0.25 * n_elements + 0.20 * max_depth + 0.15 * path_segments + 0.15 * F.sqrt(text_chars.cast("double")) + 0.10 * n_groups + 0.10 * n_colors + 0.05 * n_markers


def mean_bits(pixels: Column) -> Column:
    """A digit per grey value: 1 if it is the mean of all or above, else 0."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    # through arrays of one element, so that neither the values nor their sum are computed again for each digit
    bound = F.transform(F.array(pixels), lambda p: F.struct(p.alias("p"), total(p).alias("total"), F.size(p).alias("n")))
    digits = F.transform(bound, lambda s: F.array_join(F.transform(s["p"], lambda x: F.when(x.cast("double") * s["n"] >= s["total"], "1").otherwise("0")), ""))
    return F.element_at(digits, 1)


def hex_key(bits: Column, digits: int = 16) -> Column:
    """A bit string of at most 64 bits as a hex key, in which keys of near bit strings are near."""
    return F.lpad(F.lower(F.conv(bits, 2, 16)), digits, "0")


def letter_cells(text: Column, letters: str, rows: int) -> Column:
    """A text as a grid of grey values: how often each letter stands in each of its equal stretches."""
    n = F.length(text)
    edge = lambda k: F.floor(n * k / rows).cast("int")
    parts = F.array(*(F.substring(text, edge(k) + 1, edge(k + 1) - edge(k)) for k in range(rows)))
    marks = F.array(*map(F.lit, letters))
    # counted in bytes, which a text knows without being read
    times = lambda p, c: ((F.octet_length(p) - F.octet_length(F.replace(p, c, F.lit("")))) / F.octet_length(c)).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.transform(marks, lambda c: times(p, c))))


def letterbox(width: Column, height: Column, edge: int) -> Column:
    """(width, height, left, top) of an image scaled into a square of this edge and centred; halves go to even numbers, as the
    renderer rounds them, and no side is under one. Null for sides that are not positive."""
    scale = F.least(F.lit(float(edge)) / width, F.lit(float(edge)) / height)
    side = lambda n: F.greatest(F.lit(1), F.bround(n * scale, 0).cast("int"))
    placed = lambda n: F.floor((F.lit(edge) - side(n)) / 2).cast("int")
    return F.when((width > 0) & (height > 0), F.struct(side(width).alias("width"), side(height).alias("height"), placed(width).alias("left"), placed(height).alias("top")))


def png_size(content: Column) -> Column:
    """(width, height) from a PNG's first bytes; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    is_png = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(is_png & (F.length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def average_hash_key(bits: Column) -> Column:
    """Key of a bit string: the first 16 hex digits of its sha256, so keys are near only if the bits are equal."""
    return F.substring(F.sha2(bits, 256), 1, 16)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex keys of equal length up to 16 digits; 999 if null, empty or of other lengths."""
    as_long = lambda x: F.conv(x, 16, -10).cast("long")
    usable = a.isNotNull() & b.isNotNull() & (F.length(a) > 0) & (F.length(a) == F.length(b))
    return F.when(usable, F.bit_count(as_long(a).bitwiseXOR(as_long(b)))).otherwise(F.lit(999)).cast("int")


def derived_id(filename: Column, prefix: str = "") -> Column:
    return F.substring(F.concat(F.lit(prefix), F.replace(filename, F.lit(".svg"), F.lit(""))), 1, 64)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def match_key(kind: Column, label: Column) -> Column:
    return F.struct(F.coalesce(kind, F.lit("?")).alias("type"), F.lower(strip(F.coalesce(label, F.lit("")))).alias("label"))


def edge_fields(edge: Column) -> dict[str, Column]:
    """src>dst:type:label, type `edge` if empty; nulls if it does not parse."""
    rx = r"^([^>]+)>([^:]+):([^:]*):(.*)"
    part = lambda i: F.when(edge.rlike(rx), F.regexp_extract(edge, rx, i))
    return {"src": part(1), "dst": part(2), "type": F.when(edge.rlike(rx), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("edge"))), "label": part(4)}


TRIPLET = r"^\(?\s*([^\t,|()]+?)\s*[\t,|]\s*([^\t,|()]*?)\s*[\t,|]\s*([^\t,|()\s]+)"


def triplets(text: Column) -> Column:
    """Lines `a<tab>label<tab>b`, `(a, label, b)` or with pipes as an array of (src, label, dst); blanks and # skipped."""
    lines = F.filter(F.split(text, r"\R"), lambda x: (F.length(F.trim(x)) > 0) & ~F.startswith(F.trim(x), F.lit("#")) & F.rlike(F.trim(x), F.lit(TRIPLET)))
    field = lambda x, i: F.regexp_extract(F.trim(x), TRIPLET, i)
    return F.transform(lines, lambda x: F.struct(field(x, 1).alias("src"), field(x, 2).alias("label"), field(x, 3).alias("dst")))


def relative_path(root: Column, rel: Column) -> Column:
    return F.concat_ws("/", root, rel)


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
