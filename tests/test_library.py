"""Changes to a library that queries over the provided tables do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.engine import Engine
from shelfwise.model import Catalog
from shelfwise.operators import library as lib


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_edits_clear_faces(spark):
    items = frame(spark, "id long, edit_turns int, edit_crop long, percep_hash long", (1, 0, None, 5), (2, 1, None, 6), (3, 0, 9, 7))
    faces = frame(spark, "id long, item_id long", (10, 1), (11, 2), (12, 3), (13, None))
    out, left = lib.set_edits(items, frame(spark, "id long, edit_turns int, edit_crop long", (1, 1, None), (2, 1, None), (3, 0, None)), faces)
    assert sorted(map(tuple, out.collect())) == [(1, 1, None, None), (2, 1, None, 6), (3, 0, None, None)]
    assert sorted((r.id for r in left.collect())) == [11, 13]


def test_mirrored_faces_compare_in_order(spark):
    ddl = "item_id long, no int, contact string, rect string"
    stored = frame(spark, ddl, (1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "x"), (3, 0, "c", "z"))
    told = frame(spark, ddl, (1, 5, "a", "x"), (1, 9, "b", "y"), (2, 0, "b", "x"), (4, 0, "c", "z"))
    assert sorted(r.item_id for r in lib.mirror_faces(stored, told).collect()) == [2, 3, 4]


def test_roots(spark):
    roots = frame(spark, "id long, path string, online boolean", (4, "/home/pics", True))
    more, new = lib.add_root(roots, "/data//x/")
    assert new == 5 and sorted(r.path for r in more.collect()) == ["/data/x", "/home/pics"]
    assert lib.add_root(more, "/data/x")[1] == 5 and lib.add_root(roots, "/home/pictures")[1] == 5
    for bad in ("/home/pics/sub", "/home", "/", "/trash/a"):
        with pytest.raises(ValueError):
            lib.add_root(roots, bad, ["/trash"])
    tables = {
        "watched_folders": more, "folders": frame(spark, "id long, watched_id long", (1, 4), (2, 5)), "items": frame(spark, "id long, folder_id long", (7, 1), (8, 2)),
        "item_tags": frame(spark, "item_id long, tag string", (7, "a"), (8, "b")),
    }
    out = lib.remove_root(tables, 4)
    assert {k: [tuple(r) for r in v.collect()] for k, v in out.items()} == {"watched_folders": [(5, "/data/x", True)], "folders": [(2, 5)], "items": [(8, 2)], "item_tags": [(8, "b")]}


def test_settings_and_names(spark):
    none = frame(spark, "key string, value string")
    assert lib.setting(none, "similar_distance") == 7
    for value, want in (("3", 3), ("99", 18), ("-4", 0), ("x", 7), (None, 7)):
        assert lib.setting(lib.put_setting(none, "similar_distance", "1") if value == "again" else frame(spark, "key string, value string", ("similar_distance", value)), "similar_distance") == want
    assert lib.setting(lib.put_setting(lib.put_setting(none, "tile_size", "70"), "tile_size", "80"), "tile_size") == 80
    albums = frame(spark, "id long, name string, picasa_token string", (1, "a", None), (2, "b", "t"))
    token = F.col("picasa_token").isNotNull()
    assert sorted(r.name for r in lib.renamed(albums, 1, " new ", token).collect()) == ["b", "new"]
    for key, name in ((2, "x"), (3, "x"), (1, " ")):
        with pytest.raises(ValueError):
            lib.renamed(albums, key, name, token)


def test_vectors_pack_and_unpack(spark):
    rows = [(1, [1.5, -2.0, float("inf")]), (2, []), (3, None)]
    packed = lib.pack_vectors(frame(spark, "id long, v array<float>", *rows), "v")
    got = {r.id: r.v for r in packed.collect()}
    assert bytes(got[1]) == np.array([1.5, -2.0, np.inf], "<f4").tobytes() and bytes(got[2]) == b"" and got[3] is None
    assert {r.id: r.v for r in lib.unpack_vectors(packed, "v").collect()} == dict(rows)
    assert lib.unpack_vectors(frame(spark, "id long, v binary", (1, bytearray(b"abc"))), "v").first().v is None


def test_carry_over_and_keys(spark):
    ddl = "id long, person_id long, confirmed boolean, ignored boolean"
    old, new = frame(spark, ddl, (1, 5, True, False), (2, None, False, True)), frame(spark, ddl, (11, None, False, False), (12, 6, False, False), (13, None, False, False))
    out = lib.carry_over(old, new, frame(spark, "old_id long, new_id long", (1, 11), (2, 12)))
    assert sorted(map(tuple, out.collect()), key=str) == [(11, 5, True, False), (12, 6, False, True), (13, None, False, False)]
    assert lib.live_keys(frame(spark, "path string, size long", ("a", 1), ("a", 1), ("b", 1)), ["path", "size"]).count() == 2


def test_offline_roots_show_nothing(spark):
    from shelfwise.model import SCHEMAS

    def rows(name, *given):
        return spark.createDataFrame([{**dict.fromkeys(x.split()[0] for x in SCHEMAS[name].split(", ")), **g} for g in given], SCHEMAS[name])

    cat = Catalog(spark)
    cat.commit(
        watched_folders=rows("watched_folders", {"id": 1, "path": "/a", "online": True}, {"id": 2, "path": "/b", "online": False}),
        folders=rows("folders", {"id": 1, "watched_id": 1, "path": "/a"}, {"id": 2, "watched_id": 2, "path": "/b"}),
        items=rows("items", *[{"id": k, "folder_id": k % 2 + 1, "path": f"p{k}", "file_name": f"n{k}", "taken_at": k, "hidden": False, "kind": 0} for k in range(1, 7)]),
    )
    e = Engine(cat)
    assert [r.id for r in e.grid().orderBy("pos").collect()] == [2, 4, 6]
    assert e.grid() is e.grid() and [r.id for r in e.page(1, 1).collect()] == [4]
    cat.commit(watched_folders=rows("watched_folders"))
    assert e.grid().count() == 6
