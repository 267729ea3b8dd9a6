"""Passes over a library: hashing and grouping look-alikes, names of folders that moved, and reads of one row or folder.

A pass does what is left to do and says whether anything changed; run again, it finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordering import written
from .resolve import connected, lookalike_groups, lookalike_pairs, set_digest

#: A picture is the one that was read as long as none of these differ.
PICTURE = ["size", "mtime_ms", "edit_turns", "edit_crop"]


def similar_candidates(items: DataFrame) -> DataFrame:
    """Live pictures with a thumbnail and no perceptual hash: id and what the picture was then."""
    return items.filter("missing_since is null and kind = 0 and thumb_state = 1 and percep_hash is null").select("id", *PICTURE)


def set_hashes(items: DataFrame, hashed: DataFrame) -> DataFrame:
    """Items with perceptual hashes (id, the picture's columns, percep_hash), only where the picture is still that one."""
    h = hashed.groupBy("id", *PICTURE).agg(F.max("percep_hash").alias("__h")).toDF("__k", *[f"__{c}" for c in PICTURE], "__h")
    same = F.col("id") == F.col("__k")
    for c in PICTURE:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return items.join(h, same, "left").withColumn("percep_hash", F.coalesce("__h", "percep_hash")).select(*items.columns)


def judged(pairs: DataFrame, verdicts: DataFrame, answer: Column) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs of (a, b, ka, kb), and the verdicts (x, y, same) by picture key with those that were missing.

    ``answer`` is a condition on the pairs' columns; it is asked only where no verdict is kept. A null answer confirms
    nothing and is not kept, so the next pass asks again.
    """
    keyed = pairs.withColumns({"x": F.least("ka", "kb"), "y": F.greatest("ka", "kb")})
    known = keyed.join(verdicts.select("x", "y", F.col("same").alias("__kept")), ["x", "y"], "left")
    asked = written(known.withColumn("__same", F.coalesce(F.col("__kept"), answer)), "judged")
    new = asked.filter("__kept is null and __same is not null").groupBy("x", "y").agg(F.max("__same").alias("same"))
    return asked.filter("__same").select(*pairs.columns), verdicts.select("x", "y", "same").unionByName(new)


def lookalike_pass(items: DataFrame, distance: int, last: dict | None = None, verdicts: DataFrame | None = None, answer: Column | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
    """Items with ``similar_group`` of their look-alikes, the verdicts, and (input, groups, changed, regrouped).

    ``last`` is what the pass before said. While neither the hashes nor the stored groups have another digest, the answer
    is the stored one and nothing is searched. Distance 0 clears all groups. With ``answer``, a condition on ``ka`` and
    ``kb`` (the pictures' keys) and the columns of both rows prefixed ``a_`` and ``b_``, only confirmed pairs count.
    """
    photos = items.filter("missing_since is null and kind = 0 and percep_hash is not null")
    key = S.thumb_key(S.fingerprint(F.col("path"), F.col("size"), F.col("mtime_ms")), F.col("edit_turns"), F.col("edit_crop"))
    photos = photos.withColumn("__key", key)
    stored = items.filter("similar_group is not null").select("id", "similar_group")
    digest = lambda df, c: str(set_digest(df, c).first().digest)
    said = f"{distance}:{digest(photos, ['id', 'percep_hash', '__key'])}"
    have = digest(stored, ["id", "similar_group"])
    if last is not None and (last["input"], last["groups"]) == (said, have):
        return items, verdicts, {"input": said, "groups": have, "changed": False, "regrouped": False}
    if distance == 0:
        groups = stored.limit(0).toDF("key", "group")
    elif answer is None:
        groups = lookalike_groups(photos.select("id", "percep_hash"), "id", "percep_hash", distance)
    else:
        keys = photos.select("id", F.col("__key").alias("k"), *[c for c in items.columns if c != "id"])
        side = lambda p: keys.select(F.col("id").alias(p), F.col("k").alias(f"k{p}"), *[F.col(c).alias(f"{p}_{c}") for c in items.columns if c != "id"])
        pairs = lookalike_pairs(photos.select("id", "percep_hash"), "id", "percep_hash", distance).select("a", "b")
        pairs, verdicts = judged(pairs.join(side("a"), "a").join(side("b"), "b"), verdicts if verdicts is not None else items.sparkSession.createDataFrame([], "x long, y long, same boolean"), answer)
        groups = connected(pairs.select("a", "b")).toDF("key", "group")
    groups = written(groups.select(F.col("key").alias("__k"), F.col("group").alias("__g")), "similar")
    now = digest(groups, ["__k", "__g"])
    out = items.join(groups, F.col("id") == F.col("__k"), "left").withColumn("similar_group", F.col("__g").cast("long")).select(*items.columns)
    return out if now != have else items, verdicts, {"input": said, "groups": now, "changed": now != have, "regrouped": True}


def to_process(items: DataFrame, version_column: str, version: int) -> DataFrame:
    """Live rows that a pass of ``version`` has not been over: a pass that was cut short goes on with these."""
    return items.filter("missing_since is null").filter(~F.col(version_column).eqNullSafe(F.lit(version).cast("long")))


def inherit_folder_flags(folders: DataFrame, items: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders and items after new folders took over the alias and hiding of those their rows came from.

    ``moves`` is (from_id, to_id, at); of several origins the first one with anything to give counts. A folder that has an
    alias or is hidden keeps what it has; an alias that only repeats the new name is not carried. Flags are read as they
    were before all moves. Items of a folder that becomes hidden are hidden.
    """
    came = folders.select(F.col("id").alias("from_id"), F.col("alias").alias("__a"), F.coalesce("hidden", F.lit(False)).alias("__h"))
    to = folders.filter("alias is null and not coalesce(hidden, false)").select(F.col("id").alias("to_id"), F.col("name").alias("__n"))
    given = moves.filter("from_id <> to_id").join(came, "from_id").join(to, "to_id").withColumn("__a", S.alias(F.col("__a"), F.col("__n")))
    given = given.filter("__a is not null or __h").groupBy(F.col("to_id").alias("__k")).agg(F.min_by(F.struct("__a", "__h"), F.struct("at", "from_id")).alias("__f"))
    out = folders.join(given, F.col("id") == F.col("__k"), "left")
    out = out.withColumns({"alias": F.coalesce("alias", "__f.__a"), "hidden": F.coalesce("hidden", F.lit(False)) | F.coalesce("__f.__h", F.lit(False))}).select(*folders.columns)
    covered = given.filter("__f.__h").select(F.col("__k").alias("folder_id"), F.lit(True).alias("__covered"))
    inside = items.join(covered, "folder_id", "left").withColumn("hidden", F.col("hidden") | F.coalesce("__covered", F.lit(False)))
    return out, inside.select(*items.columns)


# Reads.
def one_row(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == key).limit(1)


def albums_of(album_items: DataFrame, item: int) -> DataFrame:
    return album_items.filter(F.col("item_id") == item).select("album_id").distinct()


def folder_rows(items: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder_id, id, name, rating, picasa_hidden) of the live rows of ``folders`` (folder_id): what a mirror compares with."""
    return items.filter("missing_since is null").join(folders.select("folder_id"), "folder_id", "left_semi").select("folder_id", "id", F.lower("file_name").alias("name"), "rating", "picasa_hidden")


def folders_with(items: DataFrame, held: DataFrame) -> DataFrame:
    """Folders with a live row that ``held`` (item_id) names: others need not be mirrored."""
    return items.filter("missing_since is null").join(held.select(F.col("item_id").alias("id")), "id", "left_semi").select("folder_id").distinct()


def faces_of(item: int, faces: DataFrame, contacts: DataFrame, detected: DataFrame, people: DataFrame) -> DataFrame:
    """(source, id, name, left, top, right, bottom) of one item's faces: sidecar rectangles and detections that are not ignored."""
    rect = ["left", "top", "right", "bottom"]
    told = faces.filter(F.col("item_id") == item).join(contacts.select(F.col("hash").alias("contact"), "name"), "contact", "left")
    seen = detected.filter((F.col("item_id") == item) & ~F.col("ignored")).join(people.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    return told.select(F.lit("sidecar").alias("source"), F.lit(None).cast("long").alias("id"), "name", *rect).unionByName(seen.select(F.lit("detected").alias("source"), "id", "name", *rect))


def face_source(face: int, detected: DataFrame, items: DataFrame) -> DataFrame:
    """One detection's rectangle and the key of the picture it lies on."""
    of = detected.filter(F.col("id") == face).select("item_id", "left", "top", "right", "bottom")
    key = S.thumb_key(S.fingerprint(F.col("path"), F.col("size"), F.col("mtime_ms")), F.col("edit_turns"), F.col("edit_crop"))
    return items.select(F.col("id").alias("item_id"), key.alias("key")).join(of, "item_id")


def people_counts(people: DataFrame, detected: DataFrame, items: DataFrame) -> DataFrame:
    """(named, to_name): people with a name, and nameless groups of two visible faces or more that are not ignored."""
    free = people.filter("name is null and not ignored").select(F.col("id").alias("person_id"))
    shown = items.filter("missing_since is null and not hidden").select(F.col("id").alias("item_id"))
    groups = detected.join(free, "person_id", "left_semi").join(shown, "item_id", "left_semi").groupBy("person_id").count().filter("count >= 2")
    return people.agg(F.count("name").alias("named")).crossJoin(groups.agg(F.count("*").alias("to_name")))  # one row each
