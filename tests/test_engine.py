import pytest

from shelfwise.engine import Engine
from shelfwise.model import SCHEMAS, Catalog


@pytest.fixture(scope="module")
def engine(spark):
    cat = Catalog(spark)
    base = {k.split()[0]: None for k in SCHEMAS["items"].split(", ")}
    make = lambda i, **k: tuple((base | {"id": i, "folder_id": 1 if i < 4 else 2, "kind": 0, "hidden": False, "file_name": f"IMG_{i}.jpg", "taken_at": 1560000000 + i, "size": i * 1024, "width": 400, "height": 300, "mtime_ms": i} | k).values())
    rows = [
        make(1, make="Canon", model="EOS 5D", rating=1, iso=400, aperture=1.8), make(2, caption="At the\n lake", gps_lat=48.0, gps_lon=11.0), make(3, kind=1, edit_turns=1), make(4, hidden=True), make(5, content_hash=bytearray(b"h"), focal_mm=50.2),
        make(6, content_hash=bytearray(b"h"), taken_at=1500000000),
    ]
    cat.commit(
        items=spark.createDataFrame(rows, SCHEMAS["items"]), folders=spark.createDataFrame([(1, 1, None, "/l/Italy", "Italy", "", 0, False, None), (2, 1, None, "/l/b", "b", "", 0, False, "Trip")], SCHEMAS["folders"]),
        item_tags=spark.createDataFrame([(1, "Family"), (2, "Dog")], SCHEMAS["item_tags"]), albums=spark.createDataFrame([(1, "Best of", 0, None, None)], SCHEMAS["albums"]), album_items=spark.createDataFrame([(1, 5, 0)], SCHEMAS["album_items"]),
        people=spark.createDataFrame([(9, "Ann Lee", False)], SCHEMAS["people"]), detected_faces=spark.createDataFrame([(1, 2, 0.0, 0.0, 0.5, 0.5, None, 0.9, None, None, 9, True, False)], SCHEMAS["detected_faces"]),
        faces=spark.createDataFrame([(2, "x", 0.1, 0.1, 0.4, 0.4), (2, "y", 0.8, 0.8, 1.0, 1.0)], SCHEMAS["faces"]),
    )
    return Engine(cat)


@pytest.mark.parametrize(
    "text,ids",
    [("italy", "123"), ("trip", "56"), ("canon -is:starred", ""), ("camera:canon", "1"), ('"at the lake"', "2"), ("tag:dog OR is:duplicate", "256"), ("person:ann", "2"), ("has:album", "5"), ("faces:2", "2"), ("-has:face", "1356"), ("50mm OR f/1.8 OR iso400", "15"), ("is:portrait", "3"), ("near:48,11", "2"), ("2017-07", "6"), ("size:>=5kb", "56"), ("", "")],
)
def test_library_search(engine, text, ids):
    engine.set_view("search", text)
    assert "".join(str(r.id) for r in engine.rows().orderBy("id").collect()) == ids


def test_grid_sections_and_counts(engine):
    engine.set_view("all")
    engine.set_sort("date")
    grid = [r.id for r in engine.grid().orderBy("pos").collect()]
    assert grid == [1, 2, 3, 6, 5]
    assert [(r.key, r.offset, r["count"]) for r in engine.sections().orderBy("offset").collect()] == [("/l/Italy", 0, 3), ("/l/b", 3, 2)]
    engine.set_sort("-size")
    assert [r.id for r in engine.grid().orderBy("pos").collect()] == [1, 2, 3, 5, 6]
    engine.set_sort("name")
    assert [r.id for r in engine.page(1, 2).orderBy("pos").collect()] == [2, 3]
    assert engine.counts() == {"all": 5, "starred": 1, "videos": 1, "hidden": 1, "duplicates": 2}
    with pytest.raises(ValueError):
        engine.set_view("nothing")
