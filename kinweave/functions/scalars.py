"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def to_fixed(x: Column, digits: int, even: bool = False) -> Column:
    """x from 0 to 8, rounded by its exact binary value; Spark's round goes by the shortest decimal that names it.

    Values halfway between two go up, as toFixed does it; with even to the even one, as printf does it.
    """
    unit = 1 << 59
    exact = (x * F.lit(float(unit))).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)") + F.lit(unit // 2).cast("decimal(20,0)")
    rest = F.pmod(exact, F.lit(unit).cast("decimal(20,0)"))
    whole = ((exact - rest) / F.lit(unit).cast("decimal(20,0)")).cast("double")
    if even:
        whole = F.when((rest == 0) & (whole % 2 == 1), whole - 1).otherwise(whole)
    return whole / F.lit(float(10**digits))


def pad4(n: Column) -> Column:
    """At least four digits; longer numbers stay whole."""
    return F.format_string("%04d", n.cast("long"))


def face_id(photo: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The photo and the box's centre on a grid of 8 pixels."""
    cx = round_half_up((x + w / 2) / 8) * 8
    cy = round_half_up((y + h / 2) / 8) * 8
    zero = F.lit(0)
    return F.concat(photo, F.lit("_"), pad4(F.greatest(zero, cx)), F.lit("x"), pad4(F.greatest(zero, cy)))


def photo_of_face(face: Column) -> Column:
    return F.regexp_replace(face, r"_\d+x\d+$", "")


def sequence_of(name: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """The number in a photo's name, or null."""
    found = F.regexp_extract(name, cfg.photo_pattern, 1)
    return F.when(found != "", found.cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 16-digit hashes; 64 if one is null or the lengths differ."""
    bits = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    return F.coalesce(F.when(F.length(a) == F.length(b), bits), F.lit(64)).cast("int")


def average_hash(values: Column) -> Column:
    """16 hexadecimal digits: a bit per value, the first highest, set where the value is the mean or more."""
    size = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def nibble(i: Column) -> Column:
        return F.lower(F.conv(F.array_join(F.transform(F.slice(values, i * 4 + 1, 4), lambda x: F.when(x.cast("double") >= total / size, F.lit("1")).otherwise(F.lit("0"))), ""), 2, 16))

    return F.when(size == 64, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), nibble), ""))


def face_quality(width: Column, score: Column, frontality: Column, sharpness: Column, centrality: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Weighted sum in [0, 1]; an unknown sharpness (below 0) counts half."""
    sharp = F.when(sharpness < 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), sharpness / cfg.sharpness_saturation))
    total = cfg.weight_size * F.least(F.lit(1.0), width / cfg.size_saturation) + cfg.weight_detection * score + cfg.weight_frontality * frontality + cfg.weight_sharpness * sharp + cfg.weight_centrality * centrality
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def centrality(distance: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), distance / cfg.similarity))


def frontality(eyes_and_nose: Column) -> Column:
    """How far a face looks ahead, from a struct of the centres lx, ly, rx, ry (eyes) and nx, ny (nose).

    Unequal distances from the nose to the eyes and a slope between the eyes lower it; a half where it can't be told.
    """
    p = eyes_and_nose
    apart = F.hypot(p.rx - p.lx, p.ry - p.ly)
    yaw = F.abs(F.hypot(p.nx - p.lx, p.ny - p.ly) - F.hypot(p.nx - p.rx, p.ny - p.ry)) / apart
    roll = F.abs(F.atan2(p.ry - p.ly, p.rx - p.lx)) / F.lit(math.pi / 6)
    return F.when(apart > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.8 * yaw - 0.4 * roll))).otherwise(F.lit(0.5))


def sharpness(values: Column, width: Column) -> Column:
    """The standard deviation of the 4-neighbour Laplacian over the rows of a grey image; at the border, a pixel's missing neighbour is the pixel itself.

    Null for fewer than two pixels or a width that doesn't divide them.
    """
    n = F.size(values)

    def pixel(i: Column, step: Column, inside: Column) -> Column:
        return F.element_at(values, (F.when(inside, i + step).otherwise(i) + 1).cast("int")).cast("double")

    def response(i: Column) -> Column:
        col = F.pmod(i, width)
        around = pixel(i, -width, i >= width) + pixel(i, width, i + width < n) + pixel(i, F.lit(-1), col > 0) + pixel(i, F.lit(1), col + 1 < width)
        return around - 4 * pixel(i, F.lit(0), F.lit(True))

    # one pass: what a lambda refers to is worked out again for each of its elements
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), response), none, lambda t, x: F.struct((t["s"] + x).alias("s"), (t["q"] + x * x).alias("q")), lambda t: t["q"] - t["s"] * t["s"] / n)
    return F.when((n >= 2) & (width > 0) & (n % width == 0), F.sqrt(F.greatest(sums, F.lit(0.0)) / (n - 1)))


def colour(r: Column, g: Column, b: Column) -> Column:
    return F.when(r.isNull() | g.isNull() | b.isNull(), F.lit("#e5dcd1")).otherwise(F.format_string("#%02x%02x%02x", r, g, b))


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def display_name(name: Column, number: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Guest "), F.coalesce(number.cast("string"), F.lit("?"))))


def overlap_coefficient(both: Column, size_a: Column, size_b: Column) -> Column:
    return both / F.least(size_a, size_b)


def person_id(n: Column) -> Column:
    return F.format_string("p-%04d", n)


def escape_html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def format_bytes(n: Column) -> Column:
    """Bytes as they are, kB and MB with one decimal, GB with two."""
    big = [(1 << 20, 1 << 10, "%.1f KB"), (1 << 30, 1 << 20, "%.1f MB")]
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for below, unit, form in big:
        out = out.when(n < below, F.format_string(form, n / unit))
    return out.otherwise(F.format_string("%.2f GB", n / (1 << 30)))


def format_duration(ms: Column) -> Column:
    """Seconds; minutes and seconds; or hours and minutes."""
    s = round_half_up(ms / 1000)
    m = F.floor(s / 60)
    short = F.concat(m.cast("string"), F.lit("m "), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"), F.lit("s"))
    long = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0"), F.lit("m"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, short).otherwise(long)


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def projected_seconds(n: Column, seconds: Column, workers: int) -> Column:
    return n * seconds / workers


def grid_column(position: Column, columns: int) -> Column:
    """The column of a row at a position from 1 on."""
    return F.pmod(position - 1, F.lit(columns)).cast("int")


def route_param(path: Column, prefix: str) -> Column:
    """The decoded last part of `/prefix/:id`, or null."""
    found = F.regexp_extract(path, rf"^/{prefix}/([^/]+)$", 1)
    return F.when(found != "", F.url_decode(found))


def image_path(kind: str, ident: Column, suffix: str = "webp") -> Column:
    return F.concat(F.lit(f"images/{kind}/"), ident, F.lit(f".{suffix}"))
