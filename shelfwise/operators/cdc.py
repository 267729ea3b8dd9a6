"""Snapshot change detection with guarded soft deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

EXEMPT = "__none__"


def diff(seen: DataFrame, known: DataFrame, version: int, incomplete: list[str] | None = None) -> DataFrame:
    """(path, status, id) of a full outer join of what was seen and what is known.

    Statuses: added, changed, unchanged, enriched (an older reader's facts), marked_missing (first absence), purged
    (second), kept (absent, but below a path that could not be read). When nothing at all was seen while live rows are
    known, the root counts as offline and every known row is kept.
    """
    s = seen.select("path", F.col("size").alias("s_size"), F.col("mtime_ms").alias("s_mtime"), F.lit(True).alias("here"))
    k = known.select("path", "id", "size", "mtime_ms", "missing", "exif_version", F.lit(True).alias("there"))
    blind = F.lit(False)
    for prefix in incomplete or []:
        blind = blind | S.within(F.col("path"), F.lit(prefix))
    any_seen = s.select(F.count("*").alias("n_seen"))
    j = s.join(k, "path", "full_outer").join(F.broadcast(any_seen), F.lit(True))  # one row
    same = (F.col("s_size") == F.col("size")) & (F.col("s_mtime") == F.col("mtime_ms")) & ~F.col("missing")
    status = (
        F.when(F.col("there").isNull(), "added")
        .when(F.col("here").isNull() & ((F.col("n_seen") == 0) | blind), "kept")
        .when(F.col("here").isNull() & F.col("missing"), "purged")
        .when(F.col("here").isNull(), "marked_missing")
        .when(same & (F.col("exif_version") < version), "enriched")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return j.select("path", status.alias("status"), "id", "s_size", "s_mtime", "size", "mtime_ms")


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def apply(items: DataFrame, changes: DataFrame, new_rows: DataFrame, now_ms: int) -> DataFrame:
    """Items after a diff: file facts replaced, derived facts of changed rows cleared, the user's own answers kept."""
    c = changes.filter("id is not null").select(F.col("id").alias("__id"), "status", "s_size", "s_mtime")
    j = items.join(c, items["id"] == c["__id"], "left").filter("status is null or status <> 'purged'")
    changed = F.coalesce(F.col("status") == "changed", F.lit(False))
    back = F.coalesce(F.col("status").isin("changed", "unchanged", "enriched"), F.lit(False))
    derived = [x for x in ("thumb_state", "content_hash", "percep_hash", "similar_group", "face_version") if x in items.columns]
    out = j.withColumns({
        "size": F.when(changed, F.col("s_size")).otherwise(items["size"]), "mtime_ms": F.when(changed, F.col("s_mtime")).otherwise(items["mtime_ms"]),
        "missing_since": F.when(F.col("status") == "marked_missing", F.lit(now_ms).cast("long")).when(back, F.lit(None)).otherwise(items["missing_since"]),
        **{x: F.when(changed, F.lit(None).cast(items.schema[x].dataType)).otherwise(items[x]) for x in derived},
    })
    return out.select(*items.columns).unionByName(new_rows, allowMissingColumns=True)


def apply_moves(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-point moved rows (old_id, path, folder_id, file_name, folder_hidden); what was derived from them stays."""
    m = moves.select(F.col("old_id").alias("__id"), F.col("path").alias("__p"), F.col("folder_id").alias("__f"), F.col("file_name").alias("__n"), F.col("folder_hidden").alias("__h"))
    j = items.join(m, items["id"] == m["__id"], "left")
    hit = F.col("__id").isNotNull()
    return j.withColumns({
        "path": F.coalesce("__p", "path"), "folder_id": F.coalesce("__f", "folder_id"), "file_name": F.coalesce("__n", "file_name"), "missing_since": F.when(hit, F.lit(None)).otherwise(F.col("missing_since")),
        "hidden": F.col("hidden") | F.coalesce("__h", F.lit(False)),
    }).select(*items.columns)


def prune_folders(folders: DataFrame, items: DataFrame) -> DataFrame:
    """Folders that hold items, or hold folders that do, level by level until nothing goes."""
    used = items.select(F.col("folder_id").alias("id")).distinct()
    while True:
        parents = folders.select(F.col("parent_id").alias("id")).filter("id is not null")
        kept = folders.join(used.union(parents).distinct(), "id", "left_semi")
        if kept.count() == folders.count():
            return folders
        folders = kept


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """A folder and everything below it."""
    level = folders.filter(F.col("id") == root)
    out = level
    while not level.isEmpty():
        level = folders.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
        out = out.unionByName(level)
    return out


def breaker(results: DataFrame, least: int = 8) -> bool:
    """Whether a batch of ``least`` rows or more failed altogether, in which case nothing of it is written."""
    r = results.agg(F.count("*").alias("n"), F.count_if("failed").alias("bad")).first()
    return r.n >= least and r.n == r.bad
