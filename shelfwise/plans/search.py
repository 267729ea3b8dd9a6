"""The search language: text to a small tree, and the tree to one boolean Column.

Terms that stand side by side must all hold, ``OR`` starts another alternative. Evaluation is two-valued: a fact that a
row lacks makes its term false and the term's negation true, so every leaf is coalesced.
"""

from __future__ import annotations

import calendar
import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

WORD_FIELDS = {"camera", "lens", "tag", "person", "album", "folder"}
FACTS = {"is": {"starred", "edited", "video", "photo", "duplicate", "portrait", "landscape", "square"}, "has": {"gps", "face", "tag", "caption", "album", "person"}}
#: measure: (whole units of one typed number, whether a bare number is meant exactly, units that must be typed)
KB = 1024.0
MEASURES = {"size": (1.0, False, {"kb": KB, "mb": KB**2, "gb": KB**3}), "iso": (1.0, True, {}), "aperture": (100.0, True, {}), "focal": (1.0, True, {}), "mp": (1e6, False, {})}
FAR_M, NEAR_M = 20_100_000, 1000
LEAF_TABLES = {"person": "people", "album": "albums", "faces": "faces", "has:face": "faces", "has:person": "people", "has:album": "albums"}


@dataclass(frozen=True)
class Term:
    """``kind`` with its values; ``parts`` holds what a negation turns round."""

    kind: str
    value: tuple = ()
    parts: tuple = ()


@dataclass(frozen=True)
class Query:
    alternatives: tuple = ()

    def needs(self) -> set[str]:
        """The side tables that evaluation reads."""

        def of(t: Term) -> set[str]:
            if t.kind == "not":
                return set().union(*map(of, t.parts)) if t.parts else set()
            key = f"{t.kind}:{t.value[0]}" if t.kind in FACTS else t.kind
            return {LEAF_TABLES[key]} if key in LEAF_TABLES else set()

        return set().union(*[of(t) for a in self.alternatives for t in a]) if self.alternatives else set()


def _tokens(raw: str) -> list[tuple[str, int | None]]:
    """Pieces between white space outside quotes, with where their first quote stood."""
    out, text, quote, inside = [], "", None, False
    for c in [*raw, None]:
        if c == '"':
            quote = len(text) if quote is None else quote
            inside = not inside
        elif c is None or (c.isspace() and not inside):
            if text:
                out.append((text, quote))
            text, quote = "", None
        else:
            text += c
    return out


def _period(value: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?", value)
    if not m:
        return None
    year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    days = (datetime(1970, 1, 1, tzinfo=timezone.utc) - datetime(1, 1, 1, tzinfo=timezone.utc)).days
    try:
        start = datetime(year or 4, month, day, tzinfo=timezone.utc)
    except ValueError:
        return None
    if not year:
        return None
    if m[3]:
        end_days = (start - datetime(1, 1, 1, tzinfo=timezone.utc)).days + 1
    else:
        span = calendar.monthrange(year, month)[1] if m[2] else 365 + calendar.isleap(year)
        end_days = (start - datetime(1, 1, 1, tzinfo=timezone.utc)).days + span
    return int(start.timestamp()), (end_days - days) * 86400


def _on(value: str) -> Term | None:
    m = re.fullmatch(r"([0-9]{2})-([0-9]{2})", value)
    if not m or not 1 <= int(m[1]) <= 12 or not 1 <= int(m[2]) <= calendar.monthrange(2000, int(m[1]))[1]:
        return None
    return Term("on", (int(m[1]), int(m[2])))


def _near(value: str) -> Term | None:
    m = re.fullmatch(r"(-?[0-9]*\.?[0-9]*),(-?[0-9]*\.?[0-9]*)(?:,([0-9]*\.?[0-9]*)(km|m))?", value)
    try:
        lat, lon = float(m[1]), float(m[2])
        radius = round(float(m[3]) * (1000 if m[4] == "km" else 1)) if m[3] is not None else NEAR_M
    except (TypeError, ValueError):
        return None
    return Term("near", (round(lat * 1e7), round(lon * 1e7), radius)) if abs(lat) <= 90 and abs(lon) <= 180 and 0 < radius <= FAR_M else None


def _number(measure: str, value: str) -> Term | None:
    scale, exact, units = MEASURES[measure]
    m = re.fullmatch(r"(<=|>=|<|>|)([0-9]*)(?:\.([0-9]*))?" + (f"({'|'.join(units)})" if units else "()"), value)
    if not m or not (m[2] or m[3]):
        return None
    scale = units.get(m[4], scale)
    at = float(f"{m[2] or 0}.{m[3] or 0}") * scale
    if at > 1e15:
        return None
    low, high = math.floor(at), math.ceil(at)
    if m[1]:
        bounds = {">": (low + 1, None), ">=": (high, None), "<": (None, high - 1), "<=": (None, low)}[m[1]]
    elif exact:
        whole = math.floor(at + 0.5)
        bounds = (whole, whole)
    else:  # what rounds to the number at the digits typed
        half = scale / 10 ** len(m[3] or "") / 2
        bounds = (math.ceil(at - half), math.ceil(at + half) - 1)
    return Term(measure, bounds)


def _prefixed(prefix: str, value: str) -> list[Term] | None:
    """Terms of ``prefix:value``; an empty list drops the piece, None means that it is no prefix at all."""
    low = value.lower()
    if prefix in WORD_FIELDS:
        return [Term(prefix, (w,)) for w in low.split()]
    if prefix in ("from", "to"):
        span = _period(value)
        return [Term(prefix, (span[0] if prefix == "from" else span[1],))] if span else []
    if prefix in FACTS:
        return [Term(prefix, (low,))] if low in FACTS[prefix] else []
    one = {"on": _on, "near": lambda v: _near(v.lower()), "faces": lambda v: Term("faces", (int(v.rstrip("+")), v.endswith("+"))) if re.fullmatch(r"[0-9]{1,9}\+?", v) else None}.get(prefix)
    if one is None and prefix in MEASURES:
        one = lambda v: _number(prefix, v.lower())
    if one is None:
        return None
    term = one(value)
    return [term] if term else []


def _terms(text: str, quote: int | None) -> list[Term]:
    """Terms of one piece; several where a prefix's value has several words."""
    bare = text if quote is None else text[:quote]
    if bare.startswith("-"):
        inner = _terms(text[1:], None if quote is None else quote - 1) if len(text) > 1 else []
        return [Term("not", (), tuple(inner))] if inner else []
    head, colon, _ = bare.partition(":")
    if colon:
        found = _prefixed(head.lower(), text[len(head) + 1 :])
        if found is not None:
            return found
    if quote is None and text.lower() in ("video", "photo"):
        return [Term("is", (text.lower(),))]
    return [Term("any", (text.lower(),))]


def parse(raw: str) -> Query:
    """A query that is blank, or of dangling pieces only, has no alternatives and finds nothing."""
    groups: list[list[Term]] = [[]]
    for text, quote in _tokens(raw):
        if quote is None and text == "OR":
            groups.append([])
        elif not (quote is None and text == "AND"):
            groups[-1] += [t for t in _terms(text, quote) if t not in groups[-1]]
    return Query(tuple(tuple(g) for g in groups if g))


@dataclass
class Fields:
    """Where a row's facts are. Text columns are folded here; a missing column is a fact that no row has."""

    any: list[Column] = field(default_factory=list)
    words: dict[str, Column] = field(default_factory=dict)
    facts: dict[str, Column] = field(default_factory=dict)
    numbers: dict[str, Column] = field(default_factory=dict)
    taken: Column | None = None
    gps: tuple[Column, Column] | None = None
    faces: Column | None = None


def _leaf(t: Term, f: Fields) -> Column:
    no = F.lit(False)
    if t.kind == "any":
        return reduce(lambda a, b: a | b, [F.coalesce(S.has_text(F.lower(c), t.value[0]), no) for c in f.any], no)
    if t.kind in WORD_FIELDS:
        return S.has_text(F.lower(f.words[t.kind]), t.value[0]) if t.kind in f.words else no
    if t.kind in ("from", "to", "on") and f.taken is None:
        return no
    if t.kind == "from":
        return f.taken >= t.value[0]
    if t.kind == "to":
        return f.taken < t.value[0]
    if t.kind == "on":
        at = S.stamp(f.taken)
        return (F.month(at) == t.value[0]) & (F.dayofmonth(at) == t.value[1])
    if t.kind == "near":
        return S.distance_km(f.gps[0], f.gps[1], F.lit(t.value[0] / 1e7), F.lit(t.value[1] / 1e7)) * 1000 <= t.value[2] if f.gps else no
    if t.kind == "faces" or (t.kind, t.value) == ("has", ("face",)):
        least, more = t.value if t.kind == "faces" else (1, True)
        n = F.coalesce(f.faces, F.lit(0)) if f.faces is not None else F.lit(0)
        return (n >= least) if more else (n == least)
    if t.kind in MEASURES:
        if t.kind not in f.numbers:
            return no
        n, (low, high) = F.round(f.numbers[t.kind].cast("double") * (100 if t.kind == "aperture" else 1)).cast("long"), t.value
        return (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else n.isNotNull())
    return f.facts.get(t.value[0] if t.kind == "is" else f"has_{t.value[0]}", no)


def _holds(t: Term, f: Fields) -> Column:
    if t.kind == "not":
        return ~reduce(lambda a, b: a & b, [_holds(p, f) for p in t.parts])
    return F.coalesce(_leaf(t, f), F.lit(False))


def compile_query(query: Query | str, fields: Fields) -> Column:
    query = parse(query) if isinstance(query, str) else query
    whole = [reduce(lambda a, b: a & b, [_holds(t, fields) for t in alternative]) for alternative in query.alternatives]
    return reduce(lambda a, b: a | b, whole, F.lit(False))


def shape_facts(width: Column, height: Column) -> dict[str, Column]:
    known = (width > 0) & (height > 0)
    return {"portrait": known & (width < height), "landscape": known & (width > height), "square": known & (width == height)}
