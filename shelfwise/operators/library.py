"""Changes to a library's tables and the small reads beside them.

A change takes tables and a table of what is asked for, and returns the tables as they are then; where a caller counts real
changes, ``changed`` says so row by row. Requests are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_position

#: Child tables and the column that names their item, person or album.
CHILDREN = {"items": [("item_tags", "item_id"), ("item_user_tags", "item_id"), ("faces", "item_id"), ("album_items", "item_id"), ("detected_faces", "item_id")], "albums": [("album_items", "album_id")], "people": [("person_contacts", "person_id"), ("face_rejections", "person_id")], "detected_faces": [("face_rejections", "face_id")]}
#: Settings: default, least and most.
SETTINGS = {"similar_distance": (7, 0, 18), "tile_size": (160, 60, 480), "slideshow_seconds": (4, 1, 60)}


def _asked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``__asked``; a request that comes twice counts once."""
    one = ids.select(F.col(key).alias("__k")).distinct().withColumn("__asked", F.lit(True))
    return rows.join(one, F.col(key) == F.col("__k"), "left").withColumn("__asked", F.coalesce("__asked", F.lit(False))).drop("__k")


def set_hidden(items: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """Items with the flag set on those asked for; ``changed`` where it was another."""
    j = _asked(items, ids)
    changed = F.col("__asked") & (F.col("hidden") != F.lit(on))
    return j.withColumn("changed", changed).withColumn("hidden", F.when(F.col("__asked"), F.lit(on)).otherwise(F.col("hidden"))).drop("__asked")


def set_folder_hidden(folders: DataFrame, items: DataFrame, ids: DataFrame, on: bool = True) -> tuple[DataFrame, DataFrame]:
    """Folders and items after a folder's flag, which covers what is in it, missing or not, and what will be."""
    f = _asked(folders, ids).withColumn("hidden", F.when(F.col("__asked"), F.lit(on)).otherwise(F.col("hidden"))).drop("__asked")
    inside = _asked(items, ids.select(F.col("id").alias("folder_id")), "folder_id")
    return f, inside.withColumn("hidden", F.when(F.col("__asked"), F.lit(on)).otherwise(F.col("hidden"))).drop("__asked")


def set_ratings(items: DataFrame, stars: DataFrame) -> DataFrame:
    """Items with the ratings of ``stars`` (id, rating); of two answers for one item the higher counts."""
    s = stars.groupBy(F.col("id").alias("__k")).agg(F.max("rating").alias("__r"), F.lit(True).alias("__there"))
    j = items.join(s, F.col("id") == F.col("__k"), "left")
    return j.withColumn("rating", F.when(F.col("__there"), F.col("__r")).otherwise(F.col("rating"))).select(*items.columns)


def set_edits(items: DataFrame, edits: DataFrame, detected: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Items with the edits (id, edit_turns, edit_crop). Where one differs, what was read off the old picture goes, faces too."""
    e = edits.select(F.col("id").alias("__k"), F.col("edit_turns").alias("__t"), F.col("edit_crop").alias("__c"), F.lit(True).alias("__there"))
    j = items.join(e, F.col("id") == F.col("__k"), "left")
    other = F.coalesce(F.col("__there"), F.lit(False)) & ~(F.col("__t").eqNullSafe(F.col("edit_turns")) & F.col("__c").eqNullSafe(F.col("edit_crop")))
    j = j.withColumn("__other", other)
    drop = {c: F.when(F.col("__other"), F.lit(None)).otherwise(F.col(c)) for c in ("percep_hash", "similar_group", "face_version", "thumb_state") if c in items.columns}
    out = j.withColumns({"edit_turns": F.when(F.col("__other"), F.col("__t")).otherwise(F.col("edit_turns")), "edit_crop": F.when(F.col("__other"), F.col("__c")).otherwise(F.col("edit_crop")), **drop}).select(*items.columns)
    if detected is None:
        return out, None
    return out, detected.join(j.filter("__other").select(F.col("id").alias("item_id")), "item_id", "left_anti").select(*detected.columns)


def cascade(tables: dict[str, DataFrame], parent: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows ``gone`` (id) of ``parent`` and without what hangs on them, level by level."""
    out = dict(tables)
    if parent in out:
        out[parent] = out[parent].join(gone.select("id"), "id", "left_anti").select(*out[parent].columns)
    for child, column in CHILDREN.get(parent, []):
        if child not in out:
            continue
        lost = out[child].join(gone.select(F.col("id").alias(column)), column, "left_semi")
        if child in CHILDREN:
            out = cascade(out, child, lost.select("id"))
        else:
            out[child] = out[child].join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*out[child].columns)
    return out


# Roots.
def online_items(items: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Items below roots that can be reached."""
    on = folders.join(roots.filter("online").select(F.col("id").alias("watched_id")), "watched_id", "left_semi").select(F.col("id").alias("folder_id"))
    return items.join(on, "folder_id", "left_semi").select(*items.columns)


def root_counts(items: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path, n): visible items of every root, those without any too."""
    shown = items.filter("missing_since is null and not hidden").groupBy("folder_id").agg(F.count("*").alias("c"))
    n = folders.join(shown, folders["id"] == shown["folder_id"]).groupBy("watched_id").agg(F.sum("c").alias("n"))
    return roots.join(n, roots["id"] == n["watched_id"], "left").select("id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def add_root(roots: DataFrame, path: str, excluded: list[str] | None = None) -> tuple[DataFrame, int]:
    """Roots with ``path``, and its id. A path that is there already is found again; one inside another, around one, or excluded is refused."""
    clean = "/" + "/".join(p for p in path.split("/") if p not in ("", "."))
    known = {r.path: r.id for r in roots.select("path", "id").collect()}  # a handful that a person has named
    if clean in known:
        return roots, known[clean]
    within = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    if any(within(clean, x) for x in excluded or []):
        raise ValueError(f"{clean} is excluded")
    if any(within(clean, p) or within(p, clean) for p in known):
        raise ValueError(f"{clean} overlaps a root")
    new = max(known.values(), default=0) + 1
    return roots.unionByName(roots.sparkSession.createDataFrame([(new, clean, True)], "id long, path string, online boolean")), new


def remove_root(tables: dict[str, DataFrame], root: int) -> dict[str, DataFrame]:
    """Tables without a root, its folders, their items and what hangs on those."""
    mine = tables["folders"].filter(F.col("watched_id") == root).select("id")
    gone = tables["items"].join(mine.select(F.col("id").alias("folder_id")), "folder_id", "left_semi").select("id")
    out = cascade(tables, "items", gone)
    out["folders"] = out["folders"].filter(F.col("watched_id") != root)
    out["watched_folders"] = out["watched_folders"].filter(F.col("id") != root)
    return out


# Mirrors of sidecar files.
def mirror_stars(items: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, rating): items whose star differs from their sidecar line (folder_id, file, starred); no line is no star."""
    want = lines.groupBy("folder_id", F.lower("file").alias("__n")).agg(F.max("starred").alias("starred"))
    folders = lines.select("folder_id").distinct()
    j = items.filter("missing_since is null").join(folders, "folder_id", "left_semi").withColumn("__n", F.lower("file_name")).join(want, ["folder_id", "__n"], "left")
    rating = F.when(F.coalesce("starred", F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return j.select("id", rating.alias("rating"), F.col("rating").alias("__old")).filter(~F.col("rating").eqNullSafe(F.col("__old"))).drop("__old")


def mirror_faces(stored: DataFrame, told: DataFrame) -> DataFrame:
    """Item ids whose told faces (item_id, no, contact, rect) are not the stored ones in the same order."""
    each = lambda df, name: df.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "contact", "rect"))), lambda x: F.struct(x["contact"], x["rect"])).alias(name))
    j = each(stored, "old").join(each(told, "new"), "item_id", "full_outer")
    return j.filter(~F.col("old").eqNullSafe(F.col("new"))).select("item_id")


def mirror_albums(members: DataFrame, told: DataFrame) -> DataFrame:
    """(album_id, item_id, change): what to add to and remove from albums that sidecars tell of, each pair once."""
    albums = told.select("album_id").distinct()
    have = members.join(albums, "album_id", "left_semi").select("album_id", "item_id").distinct().withColumn("have", F.lit(True))
    want = told.filter("item_id is not null").select("album_id", "item_id").distinct().withColumn("want", F.lit(True))
    j = have.join(want, ["album_id", "item_id"], "full_outer").filter("have is null or want is null")
    return j.select("album_id", "item_id", F.when(F.col("have").isNull(), "add").otherwise("remove").alias("change"))


def upsert_contacts(contacts: DataFrame, told: DataFrame) -> DataFrame:
    """(hash, name, change) of told contacts (hash, name, at) that are new or named anew; the newest telling counts."""
    new = told.filter("name is not null").groupBy("hash").agg(F.max_by("name", F.struct("at", "name")).alias("name"))
    j = new.join(contacts.select("hash", F.col("name").alias("old"), F.lit(True).alias("there")), "hash", "left")
    return j.filter(F.col("there").isNull() | ~F.col("old").eqNullSafe(F.col("name"))).select("hash", "name", F.when(F.col("there").isNull(), "insert").otherwise("rename").alias("change"))


# Facts.
def backfill(items: DataFrame, facts: DataFrame, version: int) -> DataFrame:
    """Items with facts (id, size, mtime_ms, …) of a newer reader, where file and version still are what was read."""
    names = [c for c in facts.columns if c not in ("id", "size", "mtime_ms")]
    f = facts.select(F.col("id").alias("__k"), F.col("size").alias("__s"), F.col("mtime_ms").alias("__m"), *[F.col(c).alias(f"__f_{c}") for c in names])
    j = items.join(f, (F.col("id") == F.col("__k")) & (F.col("size") == F.col("__s")) & (F.col("mtime_ms") == F.col("__m")) & (F.col("exif_version") < version), "left")
    hit = F.col("__k").isNotNull()
    return j.withColumns({**{c: F.when(hit, F.coalesce(f"__f_{c}", c)).otherwise(F.col(c)) for c in names}, "exif_version": F.when(hit, F.lit(version).cast("long")).otherwise(F.col("exif_version"))}).select(*items.columns)


def set_thumb_state(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with thumbnail results (id, size, mtime_ms, state), only where the file is still the one that was drawn."""
    r = results.groupBy(F.col("id").alias("__k"), F.col("size").alias("__s"), F.col("mtime_ms").alias("__m")).agg(F.max("state").alias("__state"))
    j = items.join(r, (F.col("id") == F.col("__k")) & (F.col("size") == F.col("__s")) & (F.col("mtime_ms") == F.col("__m")), "left")
    return j.withColumn("thumb_state", F.coalesce("__state", "thumb_state")).select(*items.columns)


def differing_facts(rows: DataFrame, group: str, facts: list[str]) -> DataFrame:
    """(group, differing): the facts in which the rows of a group are not all alike; null is a value."""
    seen = [(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in facts]
    n = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(*seen)
    return n.select("group", F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in facts])).alias("differing"))


def carry_over(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """New detections with the person, confirmation and ignoring of the old ones they are paired with (old_id, new_id)."""
    o = old.select(F.col("id").alias("old_id"), F.col("person_id").alias("__p"), F.col("confirmed").alias("__c"), F.col("ignored").alias("__i"))
    j = new.join(pairs.join(o, "old_id").withColumnRenamed("new_id", "__k"), F.col("id") == F.col("__k"), "left")
    return j.withColumns({"person_id": F.coalesce("__p", "person_id"), "confirmed": F.coalesce("__c", "confirmed"), "ignored": F.coalesce("__i", "ignored")}).select(*new.columns)


def face_work(items: DataFrame, version: int) -> DataFrame:
    """Ids of live pictures with a thumbnail that the detector of ``version`` has not seen."""
    return items.filter("missing_since is null and kind = 0 and thumb_state = 1").filter(~F.col("face_version").eqNullSafe(F.lit(version).cast("long"))).select("id")


def progress(items: DataFrame, version: int) -> DataFrame:
    """(done, total) of the live pictures with a thumbnail."""
    return items.filter("missing_since is null and kind = 0 and thumb_state = 1").agg(F.count_if(F.col("face_version").eqNullSafe(F.lit(version).cast("long"))).alias("done"), F.count("*").alias("total"))


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, count: int) -> DataFrame:
    """The next ``count`` rows behind the key ``after`` in ascending order; a scan that need not skip what was shown."""
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            behind = behind | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        rows = rows.filter(behind)
    return rows.orderBy(*order).limit(count)


def live_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct image keys of all rows; cached files under other keys are garbage."""
    return items.select(*keys).distinct()


def folder_names(folders: DataFrame, items: DataFrame, chosen: str = "name") -> DataFrame:
    """Folders with their place in the sidebar: by name, by newest first, or by size; ties by path."""
    n = items.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n"), F.min("taken_at").alias("oldest"))
    j = folders.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = {"name": [F.asc(F.lower("name"))], "date": [F.desc_nulls_last("oldest")], "count": [F.desc("n")]}[chosen]
    return with_position(j, [*head, F.asc("path")], "rank")


def setting(settings: DataFrame, key: str) -> int:
    """A setting within its bounds; its default where it is missing or no number."""
    default, least, most = SETTINGS[key]
    row = settings.filter(F.col("key") == key).select("value").first()
    try:
        return min(max(int(row.value), least), most) if row else default
    except (TypeError, ValueError):
        return default


def put_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    return settings.filter(F.col("key") != key).unionByName(settings.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def renamed(table: DataFrame, key: int, name: str, mirrored: Column | None = None) -> DataFrame:
    """An album or saved search under another name. What is not there, blank, or kept by a sidecar is refused."""
    row = table.filter(F.col("id") == key).select((mirrored if mirrored is not None else F.lit(False)).alias("m")).first()
    if row is None or row.m or not name.strip():
        raise ValueError(f"no change of {key} to {name!r}")
    return table.withColumn("name", F.when(F.col("id") == key, F.lit(name.strip())).otherwise(F.col("name")))


def pack_vectors(rows: DataFrame, column: str) -> DataFrame:
    """A float array as its little-endian bytes, in Arrow batches; null stays null."""
    return _recoded(rows, column, "binary", lambda v: np.asarray(v, "<f4").tobytes())


def unpack_vectors(rows: DataFrame, column: str) -> DataFrame:
    """Bytes as a float array; null where their number is not a multiple of four."""
    return _recoded(rows, column, "array<float>", lambda v: np.frombuffer(v, "<f4") if len(v) % 4 == 0 else None)


def _recoded(rows: DataFrame, column: str, kind: str, change) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in rows.schema)
    to = pa.binary() if kind == "binary" else pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            new = pa.array([None if v is None else change(v) for v in b.column(at).to_pylist()], to)
            yield pa.record_batch([new if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return rows.mapInArrow(run, schema)
