"""Column-level helpers: names, labels, unit conversion, shape ratios. All JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of file names
WELL_SITE = r"(?i)^([A-P]\d{2})_s(\d+)_w\d+"
FIELD_STEM = r"^(.+?)_w\d+"
BLOCK_INDEX = r"_(Z)(\d+)(Y)(\d+)(X)(\d+)"


def finite(v: Column) -> Column:
    """NULL for NaN and the infinities, the value otherwise."""
    v = v.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def well_of(name: Column) -> Column:
    return F.upper(F.regexp_extract(name, WELL_SITE, 1))


def site_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, WELL_SITE, 2), F.lit("")).cast("long")


def field_key(name: Column) -> Column:
    """Part before the wavelength token, else the file stem."""
    return F.coalesce(F.nullif(F.regexp_extract(name, FIELD_STEM, 1), F.lit("")), file_stem(name))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def channel_path(well: Column, site: Column, index: Column) -> Column:
    """`{well}_s{site}_w{index}.tif`."""
    return F.concat(well, F.lit("_s"), site.cast("string"), F.lit("_w"), index.cast("string"), F.lit(".tif"))


def is_control(compound: Column, control: str = "DMSO") -> Column:
    return F.coalesce(F.lower(compound) == control.lower(), F.lit(False))


def first_match(name: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Label of the first rule whose substring occurs in `name` (rule order = priority)."""
    out = F.lit(other)
    for token, label in reversed(rules):
        out = F.when(F.contains(name, F.lit(token)), F.lit(label)).otherwise(out)
    return out


def prefix_split(name: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """(matching prefix, rest of the name with one leading separator removed)."""
    head = F.lit(None).cast("string")
    rest = name
    for p in reversed(prefixes):
        hit = F.startswith(name, F.lit(p))
        head = F.when(hit, F.lit(p)).otherwise(head)
        rest = F.when(hit, F.regexp_replace(F.substring(name, F.lit(len(p) + 1), F.length(name)), "^_", "")).otherwise(rest)
    return head, rest


def to_pixels(um: Column, size: float) -> Column:
    """Whole pixel containing a coordinate (truncation)."""
    return (um / F.lit(size)).cast("int")


def to_pixels_half_even(um: Column, size: float) -> Column:
    return F.bround(um / F.lit(size)).cast("int")


def to_microns(px: Column, size: float) -> Column:
    return px * F.lit(size)


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def circularity(area: Column, perimeter: Column, capped: bool = True) -> Column:
    raw = F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(F.lit(0.0))
    return F.least(raw, F.lit(1.0)) if capped else raw


def equivalent_diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / F.pi())


def log2_fold_change(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.log2((a + eps) / (b + eps))


def neg_log10(p: Column, eps: float = 1e-100) -> Column:
    return -F.log10(p + eps)


def closed_perimeter(points: Column) -> Column:
    """Length of a closed polygon given as array<struct<x,y>>; 4 points or fewer count as 0."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    steps = F.zip_with(points, nxt, lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))
    return F.when(F.size(points) > 4, F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)).otherwise(F.lit(0.0))


def pack_id(block: Column, label: Column) -> Column:
    """One 64-bit id from a block number and a label local to it."""
    return F.shiftleft(block.cast("long"), 32).bitwiseOR(label.cast("long"))


def stopwatch_seconds(hours: Column, minutes: Column) -> Column:
    """Spreadsheet times whose hour field holds minutes and minute field holds seconds."""
    return hours * 60 + minutes


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def grid_values(lo: float, hi: float, step: float) -> Column:
    """lo, lo+step, ..., hi as an array, rounded to 3 decimals."""
    n = int(round((hi - lo) / step)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(lo) + i * step, 3))


def grow_box(lo: Column, hi: Column, by: int, size: Column) -> tuple[Column, Column]:
    """Box side widened by `by` and clamped to [0, size]."""
    return F.greatest(lo - by, F.lit(0)), F.least(hi + by, size)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
