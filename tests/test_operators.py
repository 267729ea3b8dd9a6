from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.model import SCHEMAS, Catalog
from shelfwise.operators import cdc, ordering, people, resolve, tags, views
from shelfwise.plans import search
from shelfwise.sources import media
from shelfwise.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_large_inputs_get_the_same_positions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 613).alias("k"))
    small = ordering.with_position(df, [F.asc("k"), F.asc("id")])
    large = ordering.with_position(df.repartition(7), [F.asc("k"), F.asc("id")], small=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_natural_names_sort_by_number(spark):
    names = ["img_2", "img_007", "img_10", "photo.jpg", "photo1.jpg", "photob.jpg"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r.n for r in df.orderBy(ordering.natural_key(F.col("n"))).collect()] == names
    assert one(spark, ordering.natural_key(F.lit("a7")) == ordering.natural_key(F.lit("A007")))


def test_dates(spark):
    assert one(spark, S.seconds_of(F.lit(2019), F.lit(13), F.lit(1))) == int(datetime(2020, 1, 1).timestamp() - datetime(1970, 1, 1).timestamp())
    assert tuple(one(spark, S.civil(F.lit(-1)))) == (1969, 12, 31)
    assert one(spark, S.exif_seconds(F.lit("0000:00:00 00:00:00"))) is None
    assert one(spark, S.plausible_taken(F.lit(-5), F.lit(1000), F.lit(-1500))) == -2


def test_rectangles(spark):
    r = one(spark, S.rect64(F.lit("rect64(3f845bcb59418507)")))
    assert r.left == pytest.approx(0x3F84 / 65535) and r.bottom == pytest.approx(0x8507 / 65535)
    assert one(spark, S.rect64(F.lit("rect64(1)"))) is None and one(spark, S.rect64(F.lit("rect65(1)"))) is None
    box = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("left", "top", "right", "bottom"), v, strict=True)])
    assert one(spark, S.overlap(box(0.0, 0.0, 0.5, 0.5), box(0.25, 0.0, 0.75, 0.5))) == pytest.approx(1 / 3)
    t = one(spark, S.map_rect(box(0.1, 0.2, 0.3, 0.4), F.lit(1), F.lit(None).cast("long")))
    assert (t.left, t.top, t.right, t.bottom) == pytest.approx((0.6, 0.1, 0.8, 0.3))


def test_vectors(spark):
    v = [float(x) for x in np.random.default_rng(1).standard_normal(64)]
    bits = one(spark, S.sign_bits(F.array(*map(F.lit, v))))
    assert bits & (2**64 - 1) == int("".join("1" if x > 0 else "0" for x in v), 2)
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, S.mean_difference(F.array(F.lit(1), F.lit(3)), F.array(F.lit(11), F.lit(13)))) == 0


@pytest.mark.parametrize(
    "text,found",
    [
        ("", ""), ("   ", ""), ("OR", ""), ("AND OR", ""), ("lake", "ab"), ("LAKE bell", "a"), ("lake AND bell", "a"), ("lake OR bell", "abc"), ("lake OR", "ab"), ('"lake bell"', "a"), ("lake and", "b"),
        ("-lake", "cd"), ("-", ""), ('"-lake"', ""), ("camera:", ""), ("camera:canon", "a"), ('camera:"canon eos"', "a"), ('-camera:"canon eos"', "bcd"), ("video", "b"), ('"video"', "d"), ("is:starred", "a"), ("is:st", ""),
        ("-is:starred", "bcd"), ("from:2019", "ab"), ("to:2019", "bc"), ("from:2019-1", ""), ("from:2019-02-30", ""), ("on:02-29", ""), ("on:06-01", "b"), ("on:02-30", ""), ("faces:2", "a"), ("faces:1+", "ab"), ("has:face", "ab"), ("faces:+2", ""),
        ("near:48,11", "a"), ("near:48,11,500km", "ab"), ("near:48,", ""), ("near:nan,1", ""), ("size:>1kb", "bc"), ("size:1kb", "a"), ("size:10", ""), ("iso:400", "a"), ("iso:>", ""), ("aperture:<2", "a"), ("aperture:1.8", "a"), ("unknown:word", "d"), ("50%", "d"),
    ],
)
def test_search(spark, text, found):
    def at(*v):
        return int((datetime(*v) - datetime(1970, 1, 1)).total_seconds())

    rows = [
        ("a", "Lake bell", "Canon EOS", True, 0, at(2020, 1, 2), 2, 48.001, 11.001, 1024, 400, 1.8), ("b", "lake and sea", None, False, 1, at(2019, 6, 1), 1, 46.0, 9.0, 2000, None, 4.0),
        ("c", "bell", None, None, 0, at(2018, 12, 31), None, None, None, 5000, None, None), ("d", "unknown:word 50% video", None, None, 0, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, t string, cam string, star boolean, kind int, taken long, faces int, lat double, lon double, size long, iso long, f double")
    fields = search.Fields(
        any=[F.col("t")], words={"camera": F.col("cam")}, facts={"starred": F.col("star"), "video": F.col("kind") == 1, "photo": F.col("kind") == 0}, taken=F.col("taken"), gps=(F.col("lat"), F.col("lon")), faces=F.col("faces"),
        numbers={"size": F.col("size"), "iso": F.col("iso"), "aperture": F.col("f")},
    )
    got = "".join(sorted(r.id for r in df.filter(search.compile_query(text, fields)).collect()))
    assert got == found


def test_search_needs():
    assert search.parse("lake -person:ann album:x").needs() == {"people", "albums"}
    assert search.parse("lake").needs() == set()


def test_tag_rules_stay_flat(spark):
    rules = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", None)], "tag string, target string")
    assert {tuple(r) for r in tags.rename(rules, "c", "d").collect()} == {("a", "d"), ("b", "d"), ("c", "d")}
    assert {tuple(r) for r in tags.hide(rules, "c").collect()} == {("a", None), ("b", None), ("d", None), ("c", None)}


def test_tag_changes_count_only_real_ones(spark):
    user = spark.createDataFrame([(1, "x", False)], "item_id long, tag string, added boolean")
    file = spark.createDataFrame([(1, "x"), (2, "x")], "item_id long, tag string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    after, n = tags.change(user, file, ids, "x", True)
    assert n == 2 and {tuple(r) for r in after.collect()} == {(3, "x", True)}
    after, n = tags.change(after, file, ids, "x", False)
    assert n == 3 and {tuple(r) for r in after.collect()} == {(1, "x", False), (2, "x", False)}


def test_empty_root_guard(spark):
    known = spark.createDataFrame([("/l/a", 1, 5, 5, False, 2)], "path string, id long, size long, mtime_ms long, missing boolean, exif_version int")
    seen = spark.createDataFrame([], "path string, size long, mtime_ms long")
    assert [r.status for r in cdc.diff(seen, known, 2).collect()] == ["kept"]
    seen = spark.createDataFrame([("/l/b", 1, 1)], "path string, size long, mtime_ms long")
    assert {r.path: r.status for r in cdc.diff(seen, known, 2).collect()} == {"/l/a": "marked_missing", "/l/b": "added"}


def test_moves_are_never_guessed(spark):
    old = spark.createDataFrame([(1, "k", "a", True), (2, "k", "b", True), (3, "m", "c", True), (4, "n", "d", False)], "id long, h string, name string, gone boolean")
    new = spark.createDataFrame([(11, "k", "a"), (12, "k", "z"), (13, "m", "q"), (14, "m", "r"), (15, "n", "d")], "id long, h string, name string")
    assert sorted(map(tuple, resolve.moved(new, old, ["h"]).collect())) == [(11, 1), (12, 2)]


def test_lookalike_joins_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 30, dtype=np.int64)
    rows = []
    for k, h in enumerate(base.tolist()):
        for j in range(4):
            x = h & (2**64 - 1)
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                x ^= 1 << b
            rows.append((k * 4 + j, x - 2**64 if x >= 2**63 else x))
    rows += [(900, 0), (901, 1), (902, -1)]
    df = spark.createDataFrame(rows, "id long, h long")
    for d in (3, 7):
        good = [(i, h & (2**64 - 1)) for i, h in rows if 2 * bin(h & (2**64 - 1)).count("1") > d and 2 * (64 - bin(h & (2**64 - 1)).count("1")) > d]
        label = {i: i for i, _ in good}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for i, a in good:
            for j, b in good:
                if i < j and bin(a ^ b).count("1") <= d:
                    p, q = find(i), find(j)
                    label[max(p, q)] = min(p, q)
        sizes = {}
        for i, _ in good:
            sizes[find(i)] = sizes.get(find(i), 0) + 1
        want = sorted((i, find(i)) for i, _ in good if sizes[find(i)] > 1)
        assert sorted(map(tuple, resolve.lookalike_groups(df, "id", "h", d).collect())) == want
        far = F.abs(F.col("a_id") - F.col("b_id")) >= 0
        assert sorted(map(tuple, resolve.lookalike_groups(df, "id", "h", d, far).collect())) == want


def test_lookalike_pairs_hold_rows_of_one_hash(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 12, dtype=np.int64).tolist()
    rows = [(k, base[k % 12] ^ (1 << (k % 5) if k % 3 else 0)) for k in range(48)] + [(98, None), (99, None)]
    df = spark.createDataFrame(rows, "id long, h long")
    gap = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    want = sorted((i, j, gap(x, y)) for i, x in rows for j, y in rows if i < j and x is not None and y is not None and gap(x, y) <= 7)
    assert [p for p in want if p[2] == 0] and [p for p in want if p[2] > 0]
    assert sorted(map(tuple, resolve.lookalike_pairs(df, "id", "h", 7).collect())) == want
    odd = (F.col("a_id") + F.col("b_id")) % 2 == 1
    assert sorted(map(tuple, resolve.lookalike_pairs(df, "id", "h", 7, odd).collect())) == [p for p in want if (p[0] + p[1]) % 2]


def _far_rows(linked):
    """Hashes with copies; where ``linked``, most are near one hash, else few have a look-alike at distance 18."""
    rng = np.random.default_rng(8)
    h = rng.integers(-(2**63), 2**63, 1300, dtype=np.int64)
    if linked:
        h[1:900] = [h[0] ^ np.int64(sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 9)), replace=False))) for _ in range(899)]
    h = np.concatenate([h, h[::40], h[::40], h[-1:].repeat(9)])
    ids = rng.permutation(len(h)) * 3
    gap = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64))
    pairs = [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), int(gap[i, j])) for i, j in zip(*np.nonzero(gap <= 18)) if i < j]
    return list(zip(ids.tolist(), h.tolist())), sorted(pairs)


@pytest.mark.parametrize("linked", [True, False])
def test_far_lookalikes_are_compared_in_blocks(spark, monkeypatch, linked):
    """Where bands select little, no candidates are joined; blocks find every pair and group, copies too."""
    monkeypatch.setattr(resolve, "lookalike_candidates", lambda *_: pytest.fail("candidates are near all pairs"))
    monkeypatch.setattr(resolve, "BLOCK", 200)
    monkeypatch.setattr(resolve, "FOREST_BLOCK", 400)
    rows, want = _far_rows(linked)
    df = spark.createDataFrame(rows, "id long, h long").repartition(3)
    assert sorted(map(tuple, resolve.lookalike_pairs(df, "id", "h", 18).collect())) == want
    odd = (F.col("a_id") + F.col("b_id")) % 2 == 1
    assert sorted(map(tuple, resolve.lookalike_pairs(df, "id", "h", 18, odd).collect())) == [p for p in want if (p[0] + p[1]) % 2]
    least = {i: i for p in want for i in p[:2]}
    while any(least[a] != least[b] for a, b, _ in want):
        for a, b, _ in want:
            least[a] = least[b] = min(least[a], least[b])
    assert len(set(least.values())) > 1
    assert sorted(map(tuple, resolve.lookalike_groups(df, "id", "h", 18).collect())) == sorted(least.items())
    assert sorted(map(tuple, resolve.lookalike_groups(df, "id", "h", 18, F.col("a_id") >= 0).collect())) == sorted(least.items())


def test_copies_spread_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 100)
    rows = spark.range(1000).select(F.lit(5).cast("long").alias("h"), F.col("id").alias("name"))
    dealt, tiles = resolve._all_blocks(rows, 1000)
    sizes = [r["count"] for r in dealt.groupBy("tile").count().collect()]
    assert len(sizes) == tiles == 55 and max(sizes) < 400


def test_tiles_are_listed_some_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(resolve, "HELD", 7)
    monkeypatch.setattr(resolve, "STRIP", (2, 5))
    rows, want = _far_rows(True)
    rows = rows[:60] + rows[-9:]
    want = [p for p in want if {p[0], p[1]} <= {i for i, _ in rows}]
    tile = pd.DataFrame(rows, columns=["name", "h"])
    parts = list(resolve._listed(tile, tile, 18, True))
    assert max(map(len, parts)) <= 7 and sorted(map(tuple, pd.concat(parts).to_numpy().tolist())) == want
    a, b = tile[tile["h"] % 2 == 0], tile[tile["h"] % 2 != 0]
    h = {i: x % 2 for i, x in rows}
    assert sorted(map(tuple, pd.concat(list(resolve._listed(a, b, 18, False))).to_numpy().tolist())) == [p for p in want if h[p[0]] != h[p[1]]]


@pytest.mark.parametrize("small", [0, resolve.SMALL_EDGES])
def test_connected_settles_on_long_chains(spark, small):
    chain = [1, *range(300, 1, -1)]  # the smallest node's label must travel the whole way
    edges = [*zip(chain, chain[1:]), (1001, 1000), (1000, 1001), (2000, 2000), (None, 5)]
    got = {r.node: r.label for r in resolve.connected(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert got == {**dict.fromkeys(chain, 1), 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("small", [0, resolve.SMALL_EDGES])
def test_connected_matches_union_find_on_random_ids(spark, small):
    rng = np.random.default_rng(8)
    edges = rng.integers(-400, 400, (300, 2)).tolist()
    label = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            label[max(p, q)] = min(p, q)
    got = resolve.connected(spark.createDataFrame(edges, "a long, b long"), small).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in label)


def test_leader_clusters_follow_id_order(spark):
    v = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    df = spark.createDataFrame([(3, v(20)), (1, v(0)), (2, v(90)), (4, v(80))], "id long, v array<double>")
    assert {r.id: r.cluster for r in resolve.leader_clusters(df, 0.5).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_greedy_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.9), (2, 1, 0.1, 0.0, 1.0, 1.0, 0.8), (3, 1, 5.0, 5.0, 6.0, 6.0, 0.1)], "id long, item_id long, left double, top double, right double, bottom double, score double")
    assert {r.id for r in resolve.suppress(boxes).collect()} == {1, 3}
    assert {tuple(r) for r in resolve.best_fit(boxes.filter("id < 3"), boxes.filter("id < 3")).collect()} == {(1, 1), (2, 2)}


def test_people_merge_and_names(spark):
    faces = spark.createDataFrame([(1, 7, False), (2, 7, False), (3, 8, True)], "id long, person_id long, confirmed boolean")
    rejected = spark.createDataFrame([(2, 8)], "face_id long, person_id long")
    links = spark.createDataFrame([("c", 7)], "contact string, person_id long")
    who = spark.createDataFrame([(7, None), (8, "Ann")], "id long, name string")
    out = people.merge(faces, rejected, links, who, 7, 8)
    assert {tuple(r) for r in out["detected_faces"].collect()} == {(1, 8, True), (2, None, False), (3, 8, True)}
    assert out["person_contacts"].first().person_id == 8 and out["people"].count() == 1
    contacts = spark.createDataFrame([("x", "ANN"), ("c", "Ann")], "hash string, name string")
    assert {tuple(r) for r in people.link_by_name(contacts, links, who).collect()} == {("c", 7), ("x", 8)}


def test_sidecar(spark):
    text = "junk\n[Contacts2]\nab=Ann\n[IMG.jpg]\nStar=yes\nfaces=rect64(3f845bcb59418507),AB;rect64(1),cd;rect64(3f845bcb59418507),ffffffffffffffff\nalbums=X,y\n[b.jpg]\nhidden=no\nstar=no\n[b.jpg]\nhidden=yes"
    rows = media.sidecar_facts(media.sidecar_lines(spark.createDataFrame([(1, text), (2, None)], "folder_id long, text string"))).collect()
    by = {r.file: r for r in rows}
    assert by["img.jpg"].starred and [f.contact for f in by["img.jpg"].faces] == ["ab"] and by["img.jpg"].albums == ["x", "y"]
    assert by["b.jpg"].hidden and not by["b.jpg"].starred


def test_xmp(spark):
    raw = b"\xff\xd8 <x:xmpmeta><dc:subject><rdf:Bag><rdf:li>Lake</rdf:li><rdf:li>a &amp; b</rdf:li></rdf:Bag></dc:subject><dc:description><rdf:Alt><rdf:li xml:lang=\"fr\">lac</rdf:li><rdf:li xml:lang=\"x-default\"> M\xc3\xbcnchen </rdf:li></rdf:Alt></dc:description><x xmp:Rating=\"3\"/></x:xmpmeta> tail"
    df = spark.createDataFrame([(bytearray(raw),)], "content binary").select(media.packet(F.col("content")).alias("p"))
    r = df.select(media.keywords(F.col("p")).alias("k"), media.description(F.col("p")).alias("d"), media.rating(F.col("p")).alias("r")).first()
    assert (r.k, r.d, r.r) == (["Lake", "a & b"], "München", 3)


def test_listing(spark, tmp_path):
    for name in ("a.JPG", "b.mp4", "c.txt", ".hidden/d.jpg", "sub/e.png", "$Recycle.Bin/f.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = media.listing(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.kind) for r in rows} == {("a.JPG", 0), ("b.mp4", 1), ("e.png", 0)}


def test_catalog_publish_and_ids(spark):
    cat = Catalog(spark)
    assert set(SCHEMAS) >= {"items", "folders"}
    seen = cat.version
    cat.commit(people=spark.createDataFrame([(5, "a", False)], SCHEMAS["people"]))
    assert cat.publish(seen, people=cat["people"]) == "superseded" and cat.publish(cat.version, people=cat["people"]) == "published"
    fresh = cat.with_ids("people", spark.createDataFrame([("x",), ("y",)], "name string"), ["name"])
    assert sorted(r.id for r in fresh.collect()) == [6, 7]
    assert sorted(r.id for r in cat.with_ids("people", spark.createDataFrame([("z",)], "name string"), ["name"]).collect()) == [8]


def test_views_of_a_library(spark):
    cat = Catalog(spark)
    base = {k.split()[0]: None for k in SCHEMAS["items"].split(", ")}
    rows = [base | {"id": i, "kind": int(i == 4), "rating": 1 if i == 1 else None, "hidden": i == 5, "missing_since": 1 if i == 6 else None, "taken_at": i, "file_name": f"{i}", "content_hash": bytearray(b"h") if i in (1, 2, 5) else None, "similar_group": 3 if i in (3, 4) else None} for i in range(1, 7)]
    cat.commit(items=spark.createDataFrame([tuple(r[k] for k in base) for r in rows], SCHEMAS["items"]), album_items=spark.createDataFrame([(1, 2, 0), (1, 5, 0)], SCHEMAS["album_items"]))
    ids = lambda *a: sorted(r.id for r in views.view(cat, *a).collect())
    assert ids("all") == [1, 2, 3, 4] and ids("starred") == [1] and ids("videos") == [4] and ids("hidden") == [5]
    assert ids("duplicates") == [1, 2, 3, 4] and ids("copies", "1") == [1, 2] and ids("album", "1") == [2] and ids("album", "x") == []


def test_pending_collapse():
    assert watch.collapse(["/r/a/b"], ["/r/a", "/r/c"], "/r") == ["/r/a", "/r/c"]
    assert watch.collapse([f"/r/{k}" for k in range(8)], ["/r/9"], "/r") == ["/r"]


def test_stream_of_events(spark, tmp_path):
    """A session comes once, when the watermark has passed it, with all its events, those of later files too."""
    src, seen = tmp_path / "in", []
    at = lambda s, k, p: (datetime(2024, 1, 1, 0, s // 60, s % 60), k, p)
    ddl = "ts timestamp, kind string, path string"

    def put(*rows):
        spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(str(src))

    put(at(1, "modify", "/r/a/x.jpg"), at(1, "modify", "/r/a/.picasa.ini"), at(1, "access_read", "/r/b/x.jpg"), at(1, "create", "/r/c/.picasa.ini"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = watch.watch(stream, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    assert not seen
    put(at(2, "modify", "/r/a/y.jpg"), at(5, "modify", "/r/a/z.jpg"))
    q.processAllAvailable()
    put(at(120, "modify", "/r/z/late.jpg"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.dir, r.ini_only, r.n) for r in seen) == [("/r/a", False, 1), ("/r/a", False, 3), ("/r/c", True, 1)]


def test_export_names_against_a_plain_loop(spark):
    from shelfwise.sources import media

    rng = np.random.default_rng(6)
    names = ["a.jpg", "A.JPG", "a (2).jpg", "a (2) (2).jpg", "a (3).JPG", "b", "b (2)", "IMG_1.jpg", "img_1.JPG", "x.y.png", ".jpg", "only.gif"]
    rows = [(k, names[int(rng.integers(len(names) - 1))], 7) for k in range(150)] + [(200, "only.gif", 7), (201, None, 7), (202, "a (1).jpg", 7)]
    taken, want = set(), {201: None}
    for k, own, _ in sorted(r for r in rows if r[1] is not None):
        dot = own.rfind(".")
        head, tail = (own[:dot], own[dot:]) if dot >= 0 else (own, "")
        new, n = own, 1
        while new.lower() in taken:
            n += 1
            new = f"{head} ({n}){tail}"
        taken.add(new.lower())
        want[k] = new
    got = {r.id: r.out_name for r in media.export_names(spark.createDataFrame(rows, "id long, file_name string, out int")).collect()}
    assert got == want


@pytest.mark.parametrize("distance", [1, 3, 7, 12])
def test_lookalike_candidates_are_few_and_complete(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 700)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(1, distance + 2)), replace=False)) for b in base[:200]]
    hashes = sorted({int(b) for b in base} | set(near))
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= distance}
    got = {tuple(r) for r in resolve.lookalike_candidates(df, distance).distinct().collect()}
    assert want <= got
    if distance <= 7:
        assert len(got) - len(want) < 0.01 * len(hashes) ** 2 / 2


def test_positions_by_ranges_agree(spark, monkeypatch):
    from shelfwise.operators import ordering

    rows = spark.range(5000).select("id", (F.col("id") % 37).alias("folder_path"), (F.col("id") * 7919 % 1000).alias("taken_at"), F.col("id").alias("file_name"))
    small = views.placed(rows)
    cut = lambda df: sorted(map(tuple, ordering.sections(df, F.col("taken_at") % 5, "taken_at").select("key", "offset", "count", "oldest").collect()))
    want, runs = sorted((r.id, r.pos) for r in small.collect()), cut(small)
    monkeypatch.setattr(views, "estimated_bytes", lambda df: 1 << 40)
    large = views.placed(rows)
    assert sorted((r.id, r.pos) for r in large.collect()) == want and cut(large) == runs
