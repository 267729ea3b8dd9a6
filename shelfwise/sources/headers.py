"""Facts from the heads of picture and video files, read in Arrow batches. A file that cannot be read has null facts.

Of pictures only the first 256 KiB are looked at. Formats: JPEG (size, Exif, IPTC), PNG, GIF, BMP, WebP (all three kinds),
TIFF, and MP4/MOV containers, whose index may lie anywhere: it is sought box by box. :func:`file_facts` opens the paths
themselves and reads nothing else of them; :func:`with_facts` takes contents that are there already.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 256 * 1024
INDEX_MOST = 64 << 20
WEEK_MS = 7 * 24 * 3600 * 1000
#: Seconds between the epochs of 1904 (containers) and 1970.
MAC_EPOCH = 2082844800
FACTS = (
    "width int, height int, orientation int, taken_at long, make string, model string, lens string, focal_mm double, aperture double, exposure_s double, iso long, "
    "gps_lat double, gps_lon double, duration_ms long, iptc_keywords array<string>, iptc_caption string"
)
NAMES = [x.split()[0] for x in FACTS.split(", ")]
# TIFF tag numbers.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure_s", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal_mm", 0xA434: "lens"}
DATES = {0x9003: 0, 0x9004: 1, 0x0132: 2}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _text(raw: bytes) -> str | None:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None


def _seconds(text: str | None) -> int | None:
    """Naive time read as UTC; zero parts or nonsense are no time."""
    try:
        return int(datetime.strptime(text or "", "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


class Tiff:
    """The directories of an Exif block."""

    def __init__(self, raw: bytes):
        self.raw, self.order = raw, "<" if raw[:2] == b"II" else ">"

    def directory(self, at: int) -> dict[int, list | bytes]:
        out: dict = {}
        if not 8 <= at <= len(self.raw) - 2:
            return out
        for k in range(struct.unpack_from(self.order + "H", self.raw, at)[0]):
            e = at + 2 + 12 * k
            if e + 12 > len(self.raw):
                break
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.raw, e)
            size = SIZES.get(kind, 0) * n
            where = e + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.raw, e + 8)[0]
            if not size or where + size > len(self.raw):
                continue
            body = self.raw[where : where + size]
            if kind in (2, 7, 1):
                out[tag] = body
            elif kind in (5, 10):
                v = struct.unpack(f"{self.order}{2 * n}{'I' if kind == 5 else 'i'}", body)
                out[tag] = [a / b if b else None for a, b in zip(v[::2], v[1::2], strict=True)]
            else:
                out[tag] = list(struct.unpack(f"{self.order}{n}{({3: 'H', 4: 'I', 9: 'i'})[kind]}", body))
        return out

    def facts(self) -> dict:
        if len(self.raw) < 8:
            return {}
        main = self.directory(struct.unpack_from(self.order + "I", self.raw, 4)[0])
        sub = lambda tag: self.directory(main[tag][0]) if isinstance(main.get(tag), list) and main[tag] else {}
        every, gps, out = main | sub(0x8769), sub(0x8825), {}
        for tag, name in TAGS.items():
            v = every.get(tag)
            value = _text(v) if isinstance(v, bytes) else v[0] if v else None
            if name in ("make", "model", "lens"):
                value = value if isinstance(value, str) else None
            elif isinstance(value, str) or (name == "iso" and not (value or 0) > 0):
                value = None
            out[name] = value
        dates = {k: _seconds(_text(every[t])) for t, k in DATES.items() if isinstance(every.get(t), bytes)}
        out["taken_at"] = next((dates[k] for k in sorted(dates) if dates[k] is not None), None)
        out |= self.place(gps)
        if 0x0100 in main and 0x0101 in main:
            out |= {"width": main[0x0100][0], "height": main[0x0101][0]}
        return out

    @staticmethod
    def place(gps: dict) -> dict:
        """Both hemispheres must be named; out of range, and exactly the origin, are no place."""

        def degrees(ref: int, value: int, plus: bytes, minus: bytes) -> float | None:
            side, v = gps.get(ref), gps.get(value)
            if not isinstance(side, bytes) or side[:1] not in (plus, minus) or not isinstance(v, list) or not v or v[0] is None:
                return None
            d = v[0] + (v[1] or 0 if len(v) > 1 else 0) / 60 + (v[2] or 0 if len(v) > 2 else 0) / 3600
            return -d if side[:1] == minus else d

        lat, lon = degrees(1, 2, b"N", b"S"), degrees(3, 4, b"E", b"W")
        good = lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and (lat, lon) != (0, 0)
        return {"gps_lat": lat, "gps_lon": lon} if good else {}


def _iptc(raw: bytes) -> dict:
    """Keywords and the first caption that is not empty of a Photoshop resource block."""
    out: dict = {"iptc_keywords": [], "iptc_caption": None}
    at = raw.find(b"8BIM\x04\x04")
    if at < 0:
        return out
    name = raw[at + 6] if at + 6 < len(raw) else 0
    body = at + 6 + (name + 2 & ~1 if name else 2)
    size = int.from_bytes(raw[body : body + 4], "big")
    data, p = raw[body + 4 : body + 4 + size], 0
    while p + 5 <= len(data) and data[p] == 0x1C:
        n = int.from_bytes(data[p + 3 : p + 5], "big")
        text = data[p + 5 : p + 5 + n].decode("utf-8", "replace").strip()
        if data[p + 1] == 2 and data[p + 2] == 25 and text:
            out["iptc_keywords"].append(text)
        elif data[p + 1] == 2 and data[p + 2] == 120 and text and out["iptc_caption"] is None:
            out["iptc_caption"] = text
        p += 5 + n
    return out


def _jpeg(raw: bytes) -> dict:
    out, at = {}, 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        mark, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            out = {**Tiff(body[6:]).facts(), **{k: v for k, v in out.items() if v is not None}}
            out.pop("width", None), out.pop("height", None)
        elif mark == 0xED:
            out |= _iptc(body)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if len(body) >= 5:
                out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            break
        elif mark == 0xDA:
            break
        at += 2 + size
    return out


def _boxes(raw: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        size, kind, head = int.from_bytes(raw[lo : lo + 4], "big"), raw[lo + 4 : lo + 8], 8
        if size == 1:
            size, head = int.from_bytes(raw[lo + 8 : lo + 16], "big"), 16
        end = hi if size == 0 else lo + size
        if end < lo + head:
            return
        yield kind, lo + head, min(end, hi)
        lo = end


def _container(raw: bytes) -> dict:
    out: dict = {}
    for kind, lo, hi in _boxes(raw, 0, len(raw)):
        if kind != b"moov":
            continue
        for k, a, b in _boxes(raw, lo, hi):
            if k == b"mvhd" and b - a >= 20:
                wide = raw[a] == 1
                born, _, scale, length = struct.unpack_from(">QQIQ" if wide else ">IIII", raw, a + 4)
                ms = length * 1000 // scale if scale else 0
                out["duration_ms"] = ms if 0 < ms <= WEEK_MS else None
                out["taken_at"] = born - MAC_EPOCH if born > MAC_EPOCH else None
            elif k == b"trak":
                for t, c, d in _boxes(raw, a, b):
                    at = c + (88 if raw[c] == 1 else 76)
                    if t == b"tkhd" and at + 8 <= d:
                        w, h = (x >> 16 for x in struct.unpack_from(">II", raw, at))
                        turned = struct.unpack_from(">i", raw, at - 36)[0] == 0
                        if w and h and "width" not in out:
                            out["width"], out["height"] = (h, w) if turned else (w, h)
    return out


def facts_of(raw: bytes | None) -> dict:
    """All facts of one file's head, or of a whole container; an empty dict where nothing can be read."""
    raw = bytes(raw or b"")
    raw = raw if raw[4:8] == b"ftyp" else raw[:HEAD]
    try:
        if raw[:2] == b"\xff\xd8":
            return _jpeg(raw)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", raw[16:24])
        elif raw[:4] == b"GIF8":
            w, h = struct.unpack("<HH", raw[6:10])
        elif raw[:2] == b"BM":
            w, h = struct.unpack("<ii", raw[18:26])
            h = abs(h)
        elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and raw[12:16] == b"VP8X":
            w, h = int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
        elif raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8L":
            bits = int.from_bytes(raw[21:25], "little")
            w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8 ":
            w, h = (x & 0x3FFF for x in struct.unpack("<HH", raw[26:30]))
        elif raw[:4] in (b"II*\0", b"MM\0*"):
            return Tiff(raw).facts()
        elif raw[4:8] == b"ftyp":
            return _container(raw)
        else:
            return {}
        return {"width": w, "height": h}
    except (struct.error, IndexError, ValueError, OverflowError):
        return {}


def seek_index(file, size: int) -> bytes:
    """A container's first and index boxes, found by the boxes' lengths; empty where there is no index of bearable size."""
    at, first = 0, b""
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        length, kind = int.from_bytes(head[:4], "big"), head[4:8]
        length = int.from_bytes(head[8:16], "big") if length == 1 else size - at if length == 0 else length
        if length < 8:
            break
        if kind in (b"ftyp", b"moov") and length <= INDEX_MOST:
            file.seek(at)
            body = file.read(length)
            if kind == b"moov":
                return first + body
            first = body
        at += length
    return b""


def facts_at(path: str) -> dict:
    """The facts of the file at a path or address that Arrow's file systems know."""
    from pyarrow import fs

    try:
        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        with system.open_input_file(inner) as file:
            head = file.read(HEAD)
            return facts_of(seek_index(file, file.size()) if head[4:8] == b"ftyp" else head)
    except (OSError, ValueError):
        return {}


def file_facts(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` plus the facts of the files at ``path``, of which only heads and indexes are read."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", " + FACTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [facts_at(p) if p else {} for p in pdf[path]]
            yield pdf.assign(**{n: pd.Series([r.get(n) for r in rows], dtype=object, index=pdf.index) for n in NAMES})

    return files.mapInPandas(run, schema)


def with_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without their content, plus the facts of their heads."""
    kept = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept) + ", " + FACTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [facts_of(x) for x in pdf.pop("__head")]
            yield pdf.assign(**{n: pd.Series([r.get(n) for r in rows], dtype=object, index=pdf.index) for n in NAMES})

    container = F.substring(content, 5, 4) == F.lit(b"ftyp")
    return files.select(*kept, F.when(container, F.col(content)).otherwise(F.substring(content, 1, HEAD)).alias("__head")).mapInPandas(run, schema)


def described(files: DataFrame, mtime_ms: str = "mtime_ms") -> DataFrame:
    """Facts with the capture time falling back to the file's own, rounded down to seconds. Paths are opened where there is no content."""
    return (with_facts(files) if "content" in files.columns else file_facts(files)).withColumn("taken_at", F.coalesce("taken_at", F.floor(F.col(mtime_ms) / 1000)))
