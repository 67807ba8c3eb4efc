"""Column functions over number arrays, probabilities, file names and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.schema import LAYOUT, META


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed once a row however often it is used later.

    The optimizer copies the expression of an array or struct into every use of its items; it
    can't look through the generator that stands here. The columns are computed below it: Spark
    compiles projections with lambdas, but interprets the whole expression of a generator with one.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.explode_outer(F.array(F.struct(*[F.col(f"_made_{n}").alias(n) for n in columns])))
    df = df.select(*keep, *[c.alias(f"_made_{n}") for n, c in columns.items()])
    return df.select(*keep, made.alias("_once")).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])


def double(col: Column) -> Column:
    return col.cast("array<double>")


def slice_group(col: Column, group: str, coord: str = "both", layout=LAYOUT) -> Column:
    """Coordinates of one keypoint group of a flat (x1, y1, x2, y2, ...) frame: ``x``, ``y`` or ``both``."""
    first, end = layout.groups[group]
    part = F.slice(col, 2 * first + 1, 2 * (end - first))
    if coord == "both":
        return part
    odd = 0 if coord == "x" else 1
    return F.filter(part, lambda v, i: i % 2 == odd)


def pad_or_trim(col: Column, n: Column | int, pad: Column | None = None) -> Column:
    """The first ``n`` items, or as many with padding (zero by default)."""
    n = F.lit(n) if isinstance(n, int) else n
    pad = F.lit(0.0) if pad is None else pad
    return F.slice(F.concat(col, F.array_repeat(pad, n.cast("int"))), 1, n)


def length_mask(length: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < length)


def any_visible(mask: Column) -> Column:
    return F.exists(mask, lambda v: v)


def clip_unit(col: Column) -> Column:
    """Values clamped to [0, 1]."""
    return F.transform(col, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def in_unit(v: Column) -> Column:
    """Within [0, 1]; NaN is not (Spark orders NaN above all numbers)."""
    return ~F.isnan(v) & (v >= 0) & (v <= 1)


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def gloss_text(file: Column) -> Column:
    """``clip_0089_how are you.npz`` -> ``how are you``."""
    return F.lower(F.trim(F.replace(F.element_at(F.split(file, "_", 3), -1), F.lit(".npz"), F.lit(""))))


def slugify(col: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(col)), "[-/]", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"\s+", "_"), "[^a-z0-9_]", "")
    low = F.regexp_replace(F.regexp_replace(low, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(low, F.lit("")), F.lit("uncategorized"))


def point_in_ellipse(px: Column, py: Column, cx: Column, cy: Column, ax: Column, by: Column) -> Column:
    """Inclusive; false where an axis is not positive."""
    unit = ((px - cx) / F.when(ax > 0, ax)) ** 2 + ((py - cy) / F.when(by > 0, by)) ** 2
    return F.coalesce(unit <= 1, F.lit(False))


def rounded(v: Column, digits: int) -> Column:
    """``v`` to ``digits`` places, halves of the scaled number away from zero, as SQL's ``round`` on doubles.

    Spark's own ``round`` decides by the shortest decimal of ``v``: 0.301 / 2 * 100 is 15.049999999999999 and gives 15.0,
    but ten times that is 150.5 as a double and gives 15.1 here.
    """
    return F.round(v * 10**digits) / 10**digits


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, v: a + v)


def log_softmax(col: Column) -> Column:
    top = F.array_max(col)
    base = F.log(total(F.transform(col, lambda v: F.exp(v - top)))) + top
    return F.transform(col, lambda v: v - base)


def softmax(col: Column) -> Column:
    return F.transform(log_softmax(col), F.exp)


def argmax(col: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def top_k(probs: Column, k: int) -> Column:
    """The ``k`` best as structs (id, prob), best first, ties to the smaller id."""
    ordered = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.cast("int").alias("id"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: F.struct(s["id"].alias("id"), (-s["neg"]).alias("prob")))


def entropy(probs: Column) -> Column:
    """Of the listed probabilities as they are, without normalising."""
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.log(p + 1e-10))


def parse_meta(meta: Column) -> Column:
    """The meta JSON as a struct; null where it is no JSON object."""
    kind = F.try_parse_json(meta)
    return F.when(F.startswith(F.schema_of_variant(kind), F.lit("OBJECT")), F.from_json(meta, META))


def hash_unit(key: Column, seed: int) -> Column:
    """A portable pseudo-random integer below 2**32 for a key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
