"""Passes that say what they changed, work that waits for a slot, and a catalog that outlives its driver."""

import pytest
from pyspark.sql import functions as F

from shelfwise.engine import Engine
from shelfwise.model import SCHEMAS, Catalog
from shelfwise.operators import passes
from shelfwise.streaming import watch

HASH = 0x0123456789ABCDEF


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def pictures(spark, *hashes, groups=None):
    ddl = "id long, path string, kind int, thumb_state int, missing_since long, size long, mtime_ms long, edit_turns int, edit_crop long, percep_hash long, similar_group long"
    return frame(spark, ddl, *[(k, f"p{k}", 0, 1, None, 10, 20, 0, None, h, (groups or {}).get(k)) for k, h in enumerate(hashes, 1)])


def groups(items):
    return {r.id: r.similar_group for r in items.collect()}


def test_hashes_only_of_the_picture_that_was_read(spark):
    items = pictures(spark, None, None, HASH)
    left = passes.similar_candidates(items)
    assert sorted(r.id for r in left.collect()) == [1, 2]
    done = left.withColumn("percep_hash", F.lit(7).cast("long")).withColumn("mtime_ms", F.when(F.col("id") == 2, 21).otherwise(F.col("mtime_ms")).cast("long"))
    assert {r.id: r.percep_hash for r in passes.set_hashes(items, done).collect()} == {1: 7, 2: None, 3: HASH}


def test_lookalike_pass_skips_what_it_has_done(spark):
    items = pictures(spark, HASH, HASH ^ 1, ~HASH, None, groups={3: 99})
    out, _, said = passes.lookalike_pass(items, 7)
    assert groups(out) == {1: 1, 2: 1, 3: None, 4: None} and said["changed"] and said["regrouped"]
    again, _, said2 = passes.lookalike_pass(out, 7, said)
    assert again is out and not said2["regrouped"] and not said2["changed"]
    # Groups that lost a member are made again from the same hashes.
    torn = out.withColumn("similar_group", F.when(F.col("id") != 2, F.col("similar_group")))
    mended, _, said3 = passes.lookalike_pass(torn, 7, said)
    assert said3["regrouped"] and said3["changed"] and groups(mended) == groups(out)
    cleared, _, said4 = passes.lookalike_pass(out, 0, said)
    assert said4["changed"] and set(groups(cleared).values()) == {None}


def test_lookalike_pass_keeps_verdicts(spark):
    items = pictures(spark, HASH, HASH ^ 1, HASH ^ 2, HASH)
    # The pair of 1 and 2 cannot be answered yet; 3 is refused; 4 is the same as 1 only.
    answer = F.when((F.col("a_path") == "p1") & (F.col("b_path") == "p2"), F.lit(None).cast("boolean")).otherwise((F.col("a_path") == "p1") & (F.col("b_path") == "p4"))
    out, kept, _ = passes.lookalike_pass(items, 7, answer=answer)
    assert groups(out) == {1: 1, 2: None, 3: None, 4: 1}
    assert kept.count() == 5 and kept.filter("same").count() == 1
    # A kept verdict is not asked again, the missing one is.
    out, kept, _ = passes.lookalike_pass(items, 7, verdicts=kept, answer=F.lit(True))
    assert groups(out) == {1: 1, 2: 1, 3: None, 4: 1} and kept.count() == 6


def test_lookalike_pass_of_nothing(spark):
    empty = pictures(spark, HASH).limit(0)
    out, _, said = passes.lookalike_pass(empty, 7)
    assert out.count() == 0 and not said["changed"]


def test_folders_inherit_once_and_hide_their_items(spark):
    folders = frame(spark, "id long, name string, alias string, hidden boolean", (1, "a", "Trip", False), (2, "b", None, True), (3, "c", None, False), (4, "Trip", None, False), (5, "e", "Mine", False), (6, "f", None, None))
    items = frame(spark, "id long, folder_id long, hidden boolean", (10, 3, False), (11, 4, False), (12, 5, False), (13, None, False))
    moves = frame(spark, "from_id long, to_id long, at long", (2, 3, 1), (1, 3, 2), (1, 4, 1), (2, 5, 1), (9, 6, 1), (6, 6, 1))
    f, i = passes.inherit_folder_flags(folders, items, moves)
    got = {r.id: (r.alias, r.hidden) for r in f.collect()}
    assert got == {1: ("Trip", False), 2: (None, True), 3: (None, True), 4: (None, False), 5: ("Mine", False), 6: (None, False)}
    assert {r.id: r.hidden for r in i.collect()} == {10: True, 11: False, 12: False, 13: False}


def test_reads_of_one_item(spark):
    rect = "left double, top double, right double, bottom double"
    faces = frame(spark, f"item_id long, contact string, {rect}", (1, "x", 0.0, 0.0, 1.0, 1.0), (1, "y", 0.0, 0.0, 1.0, 1.0), (2, "x", 0.0, 0.0, 1.0, 1.0))
    detected = frame(spark, f"id long, item_id long, person_id long, ignored boolean, {rect}", (7, 1, 3, False, 0.0, 0.0, 0.5, 0.5), (8, 1, None, False, 0.0, 0.0, 0.5, 0.5), (9, 1, 3, True, 0.0, 0.0, 0.5, 0.5))
    got = passes.faces_of(1, faces, frame(spark, "hash string, name string", ("x", "Ann")), detected, frame(spark, "id long, name string, ignored boolean", (3, "Bob", False)))
    assert sorted(((r.source, r.id, r.name) for r in got.collect()), key=str) == [("detected", 7, "Bob"), ("detected", 8, None), ("sidecar", None, "Ann"), ("sidecar", None, None)]
    items = pictures(spark, HASH)
    assert [(r.item_id, r.right) for r in passes.face_source(7, detected, items).collect()] == [(1, 0.5)]
    assert passes.one_row(items, 1).count() == 1 and passes.one_row(items, 2).count() == 0
    assert [r.album_id for r in passes.albums_of(frame(spark, "album_id long, item_id long", (4, 1), (4, 1), (5, 2)), 1).collect()] == [4]


def test_slots_run_one_job_a_root():
    s = watch.Slots(cap=2)
    assert s.offer("/r", ["/r/a"], ["/r/a/x", "/r/b"]) == ("walk", ["/r/a"])
    assert s.offer("/r", ["/r/c/d"], ["/r/e"]) is None and s.offer("/r", ["/r/c"]) is None
    assert s.offer("/q", [], ["/q/x", "/q/x"]) == ("sidecars", ["/q/x"])
    assert s.done("/r") == ("walk", ["/r/c"])
    assert s.done("/r") == ("sidecars", ["/r/b", "/r/e"])
    assert s.offer("/r", ["/r/1", "/r/2", "/r/3"], ["/r/4"]) is None and s.done("/r") == ("walk", ["/r"])
    assert s.done("/r") is None and s.done("/q") is None and s.offer("/q") is None


def test_sidecars_and_degraded_roots(spark):
    roots = frame(spark, "id long, path string", (1, "/a"), (2, "/b/"))
    dirs = frame(spark, "dir string", ("/a",), ("/a/x",), ("/a/x",), ("/a/x/y",), ("/ab",), ("/b/z",), ("/a/no/t",), (None,))
    assert sorted(map(tuple, watch.plan_sidecars(dirs, roots, ["/a/no"]).collect())) == [(1, "/a"), (1, "/a/x"), (1, "/a/x/y"), (2, "/b/z")]
    named = roots.select(F.col("path").alias("root"))
    touched = lambda *paths: sorted(r.root for r in watch.degraded_roots(frame(spark, "path string, message string", *[(p, "m") for p in paths]), named).collect())
    assert touched("/a/x/y", "/c") == ["/a"] and touched("/b") == ["/b/"] and touched("/ab") == [] and touched() == [] and touched("/a", None) == ["/a", "/b/"]


def test_durable_catalog_opens_at_its_last_version(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    cat = Catalog(spark, root=root)
    assert cat.version == 0 and cat["settings"].count() == 0
    cat.commit(settings=frame(spark, SCHEMAS["settings"], ("a", "1")), people=cat.with_ids("people", frame(spark, "name string, ignored boolean", ("x", False), ("y", False)), ["name"]).select("id", "name", "ignored"))
    cat.commit(people=cat["people"].limit(0))
    assert cat.publish(1, settings=cat["settings"].limit(0)) == "superseded"
    again = Catalog(spark, root=root)
    assert again.version == 2 and [tuple(r) for r in again["settings"].collect()] == [("a", "1")] and again["people"].count() == 0
    assert [r.id for r in again.with_ids("people", frame(spark, "name string, ignored boolean", ("z", False)), ["name"]).collect()] == [3]
    # A table written without its list is no version.
    frame(spark, SCHEMAS["settings"], ("b", "2")).write.parquet(f"{root}/settings/torn")
    assert Catalog(spark, root=root)["settings"].count() == 1


def test_change_commits_only_changes(spark):
    cat = Catalog(spark)
    cat.commit(settings=frame(spark, SCHEMAS["settings"], ("a", "1")))
    e = Engine(cat)
    assert e.change("settings", cat["settings"].withColumn("changed", F.lit(False))) == 0 and cat.version == 1
    assert e.change("settings", cat["settings"].withColumn("value", F.lit("2")).withColumn("changed", F.lit(True))) == 1
    assert cat.version == 2 and cat["settings"].first().value == "2" and cat["settings"].columns == ["key", "value"]
    with pytest.raises(ValueError):
        e.set_view("nothing")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_and_large_tables_of_edges_connect_alike(spark, kind):
    from shelfwise.operators.resolve import connected

    path = [1, *range(40, 1, -1)]  # the smallest node is at one end, the next ones at the other
    pairs = [*zip(path, path[1:]), (100, 101), (102, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    edges = frame(spark, "a long, b long", *pairs).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    each = [sorted(map(tuple, connected(edges, small).collect())) for small in (0, 1000)]
    assert each[0] == each[1] and len({x for _, x in each[0]}) == 2 and len(each[0]) == 43
    assert connected(edges.limit(0)).count() == 0
