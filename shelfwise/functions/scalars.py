"""Scalar functions as pure Column expressions: dates, text, geometry, bits, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
WEEK_MS = 7 * 24 * 3600 * 1000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Dates. Seconds are naive wall-clock time read as UTC; the session's time zone is UTC.
def stamp(seconds: Column) -> Column:
    return F.timestamp_seconds(_c(seconds))


def civil(seconds: Column) -> Column:
    """struct(year, month, day) of seconds, before 1970 too."""
    t = stamp(seconds)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"))


def seconds_of(year: Column, month: Column, day: Column, hour: Column = None, minute: Column = None, second: Column = None) -> Column:
    """Seconds of a civil time; months beyond 12 roll over into later years."""
    zero = F.lit(0)
    months = _c(year) * 12 + _c(month) - 1
    start = F.add_months(F.make_date(F.lit(1970), F.lit(1), F.lit(1)), (months - 1970 * 12).cast("int"))
    days = F.datediff(start, F.lit("1970-01-01").cast("date")) + _c(day) - 1
    return days.cast("long") * 86400 + (hour if hour is not None else zero) * 3600 + (minute if minute is not None else zero) * 60 + (second if second is not None else zero)


def date_text(seconds: Column) -> Column:
    return F.date_format(stamp(seconds), "yyyy-MM-dd")


def plausible_taken(seconds: Column, now: Column, mtime_ms: Column) -> Column:
    """The capture time, or the file's time where it is missing, before 1970 or more than a day ahead."""
    return F.when(_c(seconds).between(F.lit(0), now + 86400), _c(seconds)).otherwise(F.floor(_c(mtime_ms) / 1000))


def exif_seconds(text: Column) -> Column:
    """Seconds of ``YYYY:MM:DD HH:MM:SS``; null for zero parts or nonsense."""
    return F.unix_timestamp(F.try_to_timestamp(_c(text), F.lit("yyyy:MM:dd HH:mm:ss")))


def period(seconds: Column, unit: str) -> Column:
    return F.date_trunc(unit, stamp(seconds))


def year_in_zone(seconds: Column, zone: str) -> Column:
    return F.coalesce(F.year(F.from_utc_timestamp(stamp(seconds), zone)), F.lit(1970))


# Text.
def folded(text: Column) -> Column:
    return F.lower(_c(text))


def has_text(hay: Column, needle: str) -> Column:
    """Plain substring; nothing in the needle is special."""
    return F.contains(_c(hay), F.lit(needle))


def caption(text: Column) -> Column:
    """White space collapsed; null where nothing is left."""
    flat = F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))
    return F.nullif(flat, F.lit(""))


def shortest(number: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(_c(number).cast("string"), r"\.0$", "")


def focal_text(mm: Column) -> Column:
    return F.concat(F.round(_c(mm)).cast("long").cast("string"), F.lit("mm"))


def aperture_text(f: Column) -> Column:
    return F.concat(F.lit("f/"), shortest(f))


def iso_text(iso: Column) -> Column:
    return F.concat(F.lit("iso"), _c(iso).cast("string"))


def hex_key(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(_c(key))), 16, "0")


def path_key(path: Column) -> Column:
    """Orders a folder before what lies in it."""
    return F.translate(F.lower(_c(path)), "/\\", "\x01\x01")


def alias(given: Column, name: Column) -> Column:
    """Trimmed, at most 255 characters, null where empty or the name itself."""
    cut = F.substring(F.trim(_c(given)), 1, 255)
    return F.nullif(F.nullif(cut, F.lit("")), _c(name))


def valid_name(name: Column) -> Column:
    return F.nullif(F.trim(_c(name)), F.lit(""))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


def within(path: Column, root: Column) -> Column:
    """Whether a path is the root or lies below it, by whole components."""
    return (_c(path) == _c(root)) | F.startswith(_c(path), F.concat(F.regexp_replace(_c(root), "/+$", ""), F.lit("/")))


# Places.
def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return _c(degrees) + F.coalesce(_c(minutes), F.lit(0.0)) / 60 + F.coalesce(_c(seconds), F.lit(0.0)) / 3600


def valid_gps(lat: Column, lon: Column) -> Column:
    """Within range and not the exact origin."""
    return F.coalesce(F.abs(_c(lat)) <= 90, F.lit(False)) & F.coalesce(F.abs(_c(lon)) <= 180, F.lit(False)) & ~((_c(lat) == 0) & (_c(lon) == 0))


# Pictures and rectangles.
def oriented(width: Column, height: Column, orientation: Column) -> Column:
    turned = _c(orientation).between(5, 8)
    return F.struct(F.when(turned, _c(height)).otherwise(_c(width)).alias("width"), F.when(turned, _c(width)).otherwise(_c(height)).alias("height"))


def crop_parts(packed: Column) -> Column:
    """left, top, right, bottom in 1/65535 of the frame; a null crop is the whole frame."""
    part = lambda k: F.when(_c(packed).isNull(), F.lit(0 if k > 1 else 65535)).otherwise(F.shiftrightunsigned(_c(packed), 16 * k).bitwiseAND(F.lit(65535)))
    return F.struct(part(3).alias("left"), part(2).alias("top"), part(1).alias("right"), part(0).alias("bottom"))


def crop_pack(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    up = lambda x, k: F.shiftleft(_c(x).cast("long"), k)
    return up(left, 48).bitwiseOR(up(top, 32)).bitwiseOR(up(right, 16)).bitwiseOR(_c(bottom).cast("long"))


def edited_dims(width: Column, height: Column, turns: Column, packed: Column) -> Column:
    """Size after quarter turns and a crop, at least one pixel a side."""
    odd = _c(turns) % 2 == 1
    w, h = F.when(odd, _c(height)).otherwise(_c(width)), F.when(odd, _c(width)).otherwise(_c(height))
    c = crop_parts(packed)
    side = lambda n, a, b: F.greatest(F.round(n * (c[b] - c[a]) / 65535.0).cast("int"), F.lit(1))
    return F.struct(side(w, "left", "right").alias("width"), side(h, "top", "bottom").alias("height"))


def aspect(width: Column, height: Column) -> Column:
    return F.when((_c(width) == 0) | (_c(height) == 0), F.lit(1.0)).otherwise(_c(width) / _c(height))


def rect64(text: Column) -> Column:
    """``rect64(hex)`` as fractions left, top, right, bottom; null where malformed or empty."""
    digits = F.lpad(F.regexp_extract(_c(text), r"(?i)^rect64\(([0-9a-f]{1,16})\)$", 1), 16, "0")
    part = lambda k: F.conv(F.substring(digits, 4 * k + 1, 4), 16, 10).cast("double") / 65535.0
    good = F.regexp_like(_c(text), F.lit(r"(?i)^rect64\([0-9a-f]{1,16}\)$")) & (part(2) > part(0)) & (part(3) > part(1))
    return F.when(good, F.struct(part(0).alias("left"), part(1).alias("top"), part(2).alias("right"), part(3).alias("bottom")))


def _inside(a: Column, b: Column) -> Column:
    x, y = (a["left"] + a["right"]) / 2, (a["top"] + a["bottom"]) / 2
    return x.between(b["left"], b["right"]) & y.between(b["top"], b["bottom"])


def same_face(a: Column, b: Column) -> Column:
    """The centre of either rectangle lies in the other."""
    return _inside(a, b) | _inside(b, a)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union has no area."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), zero)
    h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), zero)
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, zero).otherwise(w * h / union)


def map_rect(rect: Column, turns: Column, packed: Column) -> Column:
    """A rectangle turned with its picture and re-framed to the crop; null where its centre is cropped away."""
    t = _c(turns) % 4
    l, u, r, b = rect["left"], rect["top"], rect["right"], rect["bottom"]
    pick = lambda a0, a1, a2, a3: F.when(t == 0, a0).when(t == 1, a1).when(t == 2, a2).otherwise(a3)
    left, top, right, bottom = pick(l, 1 - b, 1 - r, u), pick(u, l, 1 - b, 1 - r), pick(r, 1 - u, 1 - l, b), pick(b, r, 1 - u, 1 - l)
    c = crop_parts(packed)
    cl, ct, cr, cb = (c[k] / 65535.0 for k in ("left", "top", "right", "bottom"))
    x, y = (left + right) / 2, (top + bottom) / 2
    clip = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    out = F.struct(clip((left - cl) / (cr - cl)).alias("left"), clip((top - ct) / (cb - ct)).alias("top"), clip((right - cl) / (cr - cl)).alias("right"), clip((bottom - ct) / (cb - ct)).alias("bottom"))
    return F.when(x.between(cl, cr) & y.between(ct, cb), out)


def starred(rating: Column) -> Column:
    return F.coalesce(_c(rating), F.lit(0)) >= 1


def plausible_duration(ms: Column) -> Column:
    return F.when((_c(ms) > 0) & (_c(ms) <= WEEK_MS), _c(ms))


# Keys.
def fingerprint(path: Column, size: Column, mtime_ms: Column) -> Column:
    return F.xxhash64(_c(path), _c(size), _c(mtime_ms))


def thumb_key(mark: Column, turns: Column, packed: Column) -> Column:
    return F.when((_c(turns) == 0) & _c(packed).isNull(), _c(mark)).otherwise(F.xxhash64(_c(mark), _c(turns), _c(packed)))


def content_hash(content: Column) -> Column:
    return F.md5(_c(content))


# Vectors.
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sign_bits(v: Column) -> Column:
    """64 bits, the first component highest: set where a component is above zero."""
    return F.aggregate(F.transform(F.slice(_c(v), 1, 64), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def dhash(luma: Column) -> Column:
    """64 bits of an 8 by 9 array of rows: set where a cell is brighter than the one to its right."""
    rows = F.flatten(F.transform(_c(luma), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.get(r, i) > F.get(r, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long"))))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equal-length arrays after each gives up its own mean."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    ma, mb = mean(_c(a)), mean(_c(b))
    diff = F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.aggregate(diff, F.struct(F.lit(0.0).alias("s"), ma.alias("a"), mb.alias("b")), lambda s, p: F.struct((s["s"] + F.abs((p["x"] - s["a"]) - (p["y"] - s["b"]))).alias("s"), s["a"].alias("a"), s["b"].alias("b")))["s"] / F.size(_c(a))


def matches_anything(bits: Column, distance: int) -> Column:
    """Hashes so empty or so full that they pair with whatever comes."""
    ones = F.bit_count(_c(bits))
    return (2 * ones <= distance) | (2 * (64 - ones) <= distance)
