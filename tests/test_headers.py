import struct

from shelfwise.sources import headers


def exif():
    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + value

    make, date = b"Canon\0", b"2019:06:01 10:00:00\0"
    base = 8
    main = 2 + 12 * 4 + 4
    sub_at = base + main
    sub = 2 + 12 * 3 + 4
    gps_at = sub_at + sub
    gps = 2 + 12 * 4 + 4
    heap = gps_at + gps
    spots, blob = {}, b""
    for k, raw in {"make": make, "date": date, "f": struct.pack("<II", 18, 10), "lat": struct.pack("<6I", 48, 1, 30, 1, 0, 1), "lon": struct.pack("<6I", 11, 1, 0, 1, 0, 1)}.items():
        spots[k] = struct.pack("<I", heap + len(blob))
        blob += raw
    short = lambda v: struct.pack("<HH", v, 0)
    out = b"II*\0" + struct.pack("<I", base)
    out += struct.pack("<H", 4) + entry(0x010F, 2, len(make), spots["make"]) + entry(0x0112, 3, 1, short(6)) + entry(0x8769, 4, 1, struct.pack("<I", sub_at)) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    out += struct.pack("<H", 3) + entry(0x829D, 5, 1, spots["f"]) + entry(0x8827, 3, 1, short(400)) + entry(0x9003, 2, len(date), spots["date"]) + b"\0" * 4
    out += struct.pack("<H", 4) + entry(1, 2, 2, b"N\0\0\0") + entry(2, 5, 3, spots["lat"]) + entry(3, 2, 2, b"W\0\0\0") + entry(4, 5, 3, spots["lon"]) + b"\0" * 4
    return out + blob


def jpeg():
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    iim = b"".join(b"\x1c\x02" + bytes([k]) + struct.pack(">H", len(v)) + v for k, v in ((25, b"Lake"), (25, b"Dog"), (120, b" "), (120, b"A day")))
    photoshop = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(iim)) + iim
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + exif()) + seg(0xED, photoshop) + seg(0xC0, b"\x08" + struct.pack(">HH", 300, 400) + b"\3")


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def movie():
    mvhd = b"\0\0\0\0" + struct.pack(">IIII", headers.MAC_EPOCH + 1000, 0, 600, 1500) + b"\0" * 80
    matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    tkhd = b"\0" * 40 + matrix + struct.pack(">II", 640 << 16, 360 << 16)
    return box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd)))


def test_jpeg():
    f = headers.facts_of(jpeg())
    assert (f["width"], f["height"], f["orientation"], f["make"], f["iso"], f["aperture"]) == (400, 300, 6, "Canon", 400, 1.8)
    assert f["taken_at"] == 1559383200 and f["gps_lat"] == 48.5 and f["gps_lon"] == -11
    assert f["iptc_keywords"] == ["Lake", "Dog"] and f["iptc_caption"] == "A day"


def test_other_formats_and_broken_files():
    assert headers.facts_of(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)) == {"width": 7, "height": 9}
    assert headers.facts_of(b"GIF89a" + struct.pack("<HH", 3, 4)) == {"width": 3, "height": 4}
    m = headers.facts_of(movie())
    assert (m["width"], m["height"], m["duration_ms"], m["taken_at"]) == (640, 360, 2500, 1000)
    for raw in (None, b"", b"\xff\xd8", jpeg()[:60], movie()[:30], b"\x89PNG\r\n\x1a\n", b"II*\0", b"nonsense"):
        headers.facts_of(raw)
    for cut in range(0, len(jpeg()), 7):
        headers.facts_of(jpeg()[:cut])
        headers.facts_of(movie()[:cut])


def test_files_in_batches(spark):
    df = spark.createDataFrame([("a", 5999, bytearray(jpeg())), ("b", 5999, bytearray(b"x")), ("c", 1, None)], "path string, mtime_ms long, content binary")
    rows = {r.path: r for r in headers.described(df).collect()}
    assert rows["a"].make == "Canon" and rows["a"].iptc_keywords == ["Lake", "Dog"] and rows["a"].taken_at == 1559383200
    assert rows["b"].width is None and rows["b"].taken_at == 5 and rows["c"].taken_at == 0


def test_index_behind_the_media(spark, tmp_path):
    """Cameras write the index last; it is found in contents and by seeking in files, beyond 32-bit box lengths too."""
    m = movie()
    head, index = m[:12], m[12:]
    long = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 400_000) + b"\0" * 400_000
    raw = {"last.mov": head + box(b"mdat", b"\0" * 700_000) + index, "long.mp4": head + long + index, "none.mp4": head + long, "cut.mp4": (head + long + index)[:-40], "first.mp4": m}
    for name, body in raw.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.path.rsplit("/", 1)[1]: r for r in headers.file_facts(spark.createDataFrame([(f"file://{tmp_path}/{n}", 1) for n in [*raw, "missing.mp4"]], "path string, mtime_ms long")).collect()}
    assert len(rows) == len(raw) + 1
    for name in ("last.mov", "long.mp4", "first.mp4"):
        assert (rows[name].width, rows[name].height, rows[name].duration_ms, rows[name].taken_at) == (640, 360, 2500, 1000)
    assert rows["none.mp4"].width is None and rows["missing.mp4"].width is None
    assert headers.facts_of(raw["last.mov"])["duration_ms"] == 2500
    lossless = b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + ((299) | (199 << 14)).to_bytes(4, "little")
    assert headers.facts_of(lossless) == {"width": 300, "height": 200}
    assert headers.facts_of(b"RIFF" + b"\0" * 4 + b"WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 120, 80)) == {"width": 120, "height": 80}
