"""The incremental path: change events to quiet-period batches, to scan plans, to applied changes.

Batch and stream share the pure parts. The stream groups a directory's events by session windows and hands each session to
``foreachBatch`` once, when the watermark has passed its end. What is applied re-reads the truth. An event that comes later
than the watermark is dropped with its session; the next full scan finds what it changed.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S

PENDING_CAP = 8
SIDECAR_NAMES = [".picasa.ini", "picasa.ini"]


def may_have_changed(kind: Column) -> Column:
    """Events that only read do not count, but a close after writing does."""
    return ~F.startswith(kind, F.lit("access")) | (kind == "access_close_write")


def sessions(events: DataFrame, ts: str, gap_seconds: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, n): runs of events with no pause of ``gap_seconds`` or more."""
    return events.groupBy(*(keys or []), F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(*(keys or []), F.col("w.start").alias("start"), F.col("last"), "n")


def changed_dirs(events: DataFrame, path: str = "path") -> DataFrame:
    """(dir, ini_only): directories of changed paths; whether all that changed there are sidecars."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return events.groupBy(F.regexp_replace(path, r"/[^/]*$", "").alias("dir")).agg(F.every(name.isin(SIDECAR_NAMES)).alias("ini_only"))


def ancestors(path: Column) -> Column:
    """Every proper ancestor of a path, by whole components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def _upwards(path: Column) -> Column:
    """A path and its ancestors, the root of all as the empty string."""
    return F.array_distinct(F.array_append(ancestors(_bare(path)), _bare(path)))


def plan_sidecars(dirs: DataFrame, roots: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(watched_id, dir), each once: directories whose sidecar alone is read again, inside one of ``roots`` (id, path).

    One below another stays, since a sidecar says nothing of the directories below. Of nested roots the outermost is meant.
    """
    inside = F.lit(True)
    for x in excluded or []:
        inside = inside & ~S.within(F.col("dir"), F.lit(x))
    once = dirs.filter(F.col("dir").isNotNull() & inside).select("dir").distinct()
    up = once.select("dir", F.explode(_upwards(F.col("dir"))).alias("__up"))
    found = up.join(roots.select(F.col("id").alias("watched_id"), _bare(F.col("path")).alias("__up")), "__up")
    return found.groupBy("dir").agg(F.min_by("watched_id", F.struct(F.length("__up"), "watched_id")).alias("watched_id")).select("watched_id", "dir")


def plan_scans(dirs: DataFrame, roots: list[str], excluded: list[str] | None = None, column: str = "dir") -> DataFrame:
    """Directories to walk: inside a root, outside exclusions, and none below another.

    An equality join with each directory's own ancestors, so no pair of directories is compared that is not related.
    """
    inside = F.lit(False)
    for r in roots:
        inside = inside | S.within(F.col(column), F.lit(r))
    for x in excluded or []:
        inside = inside & ~S.within(F.col(column), F.lit(x))
    once = dirs.filter(inside).select(column).distinct()
    up = once.select(column, F.explode(ancestors(F.col(column))).alias("__up")).filter(F.col("__up") != F.col(column))
    below = up.join(once.select(F.col(column).alias("__up")), "__up", "left_semi").select(column).distinct()
    return once.join(below, column, "left_anti")


def collapse(pending: list[str], new: list[str], root: str, cap: int = PENDING_CAP) -> list[str]:
    """A root's pending directories after new ones: the shallowest only, the root itself where there are too many."""
    within = lambda p, q: p == q or p.startswith(q.rstrip("/") + "/")
    out: list[str] = []
    for p in sorted({*pending, *new}, key=lambda x: (len(x), x)):
        if not any(within(p, q) for q in out):
            out.append(p)
    return [root] if len(out) > cap else sorted(out)


class Slots:
    """What runs and what waits, root by root: one job at a time each, walks before sidecars.

    Walks that wait are bounded by :func:`collapse`; a walk covers the sidecars below it. Sidecars that wait are bounded by
    the number of folders.
    """

    def __init__(self, cap: int = PENDING_CAP):
        self.cap, self.busy, self.waiting = cap, set(), {}

    def offer(self, root: str, walks: list[str] = (), sidecars: list[str] = ()) -> tuple[str, list[str]] | None:
        """Queue work for ``root``; the job to start now, or None while one runs or nothing is left."""
        walking, reading = self.waiting.get(root, ([], []))
        walking = collapse(walking, list(walks), root, self.cap)
        covered = lambda d: any(d == w or d.startswith(w.rstrip("/") + "/") for w in walking)
        self.waiting[root] = walking, sorted({d for d in [*reading, *sidecars] if not covered(d)})
        return self._next(root)

    def done(self, root: str) -> tuple[str, list[str]] | None:
        """The job of ``root`` has ended, well or not; the next one, if any waits."""
        self.busy.discard(root)
        return self._next(root)

    def _next(self, root: str) -> tuple[str, list[str]] | None:
        walking, reading = self.waiting.get(root, ([], []))
        if root in self.busy or not (walking or reading):
            return None
        self.busy.add(root)
        self.waiting[root] = ([], reading) if walking else ([], [])
        return ("walk", walking) if walking else ("sidecars", reading)


def pending_by_root(dirs: DataFrame, cap: int = PENDING_CAP) -> DataFrame:
    """Streaming (root, dirs) from (root, dir): at most ``cap`` pending directories are kept per root as state."""

    def step(key: tuple, batches, state: GroupState):
        have = list(state.get[0]) if state.exists else []
        for pdf in batches:
            have = collapse(have, pdf["dir"].tolist(), key[0], cap)
        state.update((have,))
        yield pd.DataFrame({"root": [key[0]], "dirs": [have]})

    return dirs.groupBy("root").applyInPandasWithState(step, "root string, dirs array<string>", "dirs array<string>", "update", GroupStateTimeout.NoTimeout)


def degraded_roots(errors: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots that errors (path, message) touch; an error without a path touches all."""
    touched = errors.select(F.explode(F.when(F.col("path").isNull(), F.array(F.lit(None).cast("string"))).otherwise(_upwards(F.col("path")))).alias("__up")).distinct()
    named = roots.withColumn("__up", _bare(F.col("root")))
    everywhere = touched.filter("__up is null").agg(F.count("*").alias("__all"))  # one row
    hit = touched.filter("__up is not null").withColumn("__hit", F.lit(True))
    return named.join(hit, "__up", "left").join(F.broadcast(everywhere)).filter("__hit or __all > 0").select(*roots.columns)


def rescan_interval_s(last_cost_s: float) -> float:
    return max(300.0, 10 * last_cost_s)


def rebuild_after_s(last_cost_s: float) -> float:
    return max(0.25, 4 * last_cost_s)


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, quiet_seconds: int = 2, watermark: str = "10 seconds"):
    """Start a stream of (ts, kind, path) events; directories (session_window, dir, ini_only, n) that have been quiet go to ``apply``, once each session."""
    changed = events.filter(may_have_changed(F.col("kind"))).withWatermark("ts", watermark)
    dirs = changed.groupBy(F.session_window("ts", f"{quiet_seconds} seconds"), F.regexp_replace("path", r"/[^/]*$", "").alias("dir"))
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    batches = dirs.agg(F.every(name.isin(SIDECAR_NAMES)).alias("ini_only"), F.count("*").alias("n"))
    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def quarantine(deaths: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys that killed their worker at least twice."""
    return deaths.groupBy(key).agg(F.count("*").alias("deaths")).filter(F.col("deaths") >= least)


def newest_first(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("n", F.row_number().over(w))
