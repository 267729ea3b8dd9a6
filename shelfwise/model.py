"""Table schemas of a library, the two row predicates, and a versioned catalog of DataFrames."""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a library as DDL. ``rating`` and ``picasa_hidden`` are tri-state: null is "not read yet".
SCHEMAS = {
    "watched_folders": "id long, path string, online boolean",
    "folders": "id long, watched_id long, parent_id long, path string, name string, sort_key string, seen_scan long, hidden boolean, alias string",
    "items": "id long, folder_id long, path string, file_name string, kind int, size long, mtime_ms long, width int, height int, orientation int, taken_at long, "
    "thumb_state int, thumb_error string, missing_since long, rating int, make string, model string, lens string, focal_mm double, aperture double, exposure_s double, "
    "iso long, exif_version long, content_hash binary, edit_turns int, edit_crop long, percep_hash long, similar_group long, hidden boolean, picasa_hidden boolean, "
    "caption string, duration_ms long, gps_lat double, gps_lon double, face_version long",
    "item_tags": "item_id long, tag string",
    "tag_rules": "tag string, target string",
    "item_user_tags": "item_id long, tag string, added boolean",
    "contacts": "hash string, name string",
    "faces": "item_id long, contact string, left double, top double, right double, bottom double",
    "albums": "id long, name string, created_ms long, picasa_token string, picasa_named_at long",
    "album_items": "album_id long, item_id long, added_ms long",
    "people": "id long, name string, ignored boolean",
    "person_contacts": "contact string, person_id long",
    "detected_faces": "id long, item_id long, left double, top double, right double, bottom double, landmarks array<float>, score double, embedding array<float>, "
    "embedding_version long, person_id long, confirmed boolean, ignored boolean",
    "face_rejections": "face_id long, person_id long",
    "saved_searches": "id long, name string, query string, created_ms long",
    "settings": "key string, value string",
}

LISTS = "version long, name string, path string, mark long"


def live(items: DataFrame) -> DataFrame:
    """Rows whose file was there at the last look."""
    return items.filter("missing_since is null")


def visible(items: DataFrame) -> DataFrame:
    """Live rows that nobody hid."""
    return items.filter("missing_since is null and not hidden")


def hidden(items: DataFrame) -> DataFrame:
    return items.filter("missing_since is null and hidden")


class Catalog:
    """The current version of every table. A write replaces tables together, under one lock, and bumps the version.

    Ids are allocated above a high-water mark that never falls, so they are never used again.

    With ``root``, a folder that the cluster shares, a version is durable: its tables are written below it, then the list
    of where they lie, which makes the version. What was written without its list is never read, so a driver that is lost
    while it writes leaves the version before. A catalog opened on the folder has its last version and its marks. Only one
    driver writes at a time; files of old versions stay for readers until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, root: str | None = None):
        self.spark, self.version, self._lock, self.root = spark, 0, threading.Lock(), root and root.rstrip("/")
        self._tables = dict(tables or {})
        self._marks: dict[str, int] = {}
        self._paths: dict[str, str] = {}
        if self.root:
            self._open()

    def _open(self) -> None:
        try:
            lists = self.spark.read.schema(LISTS).parquet(f"{self.root}/_versions")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return  # nothing was ever committed
            raise
        self.version = lists.agg(F.max("version").alias("v")).first().v or 0
        for r in lists.filter(F.col("version") == self.version).collect():  # a row for each table
            if r.path is not None:
                self._paths[r.name] = r.path
                self._tables[r.name] = self.spark.read.parquet(r.path)
            if r.mark is not None:
                self._marks[r.name] = r.mark

    def _replace(self, tables: dict[str, DataFrame]) -> int:
        new = self.version + 1
        if self.root:
            paths = dict(self._paths)
            for name, rows in tables.items():
                paths[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
                rows.write.parquet(paths[name])
            tables = {name: self.spark.read.schema(rows.schema).parquet(paths[name]) for name, rows in tables.items()}
            known = [(new, name, paths.get(name), self._marks.get(name)) for name in sorted({*paths, *self._marks})]
            listed = self.spark.createDataFrame(known, LISTS).coalesce(1)
            listed.write.mode("append").parquet(f"{self.root}/_versions")
            self._paths = paths
        self._tables.update(tables)
        self.version = new
        return new

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self._tables[name]

    def commit(self, **tables: DataFrame) -> int:
        with self._lock:
            return self._replace(tables)

    def publish(self, seen_version: int, **tables: DataFrame) -> str:
        """Compare and swap: a result computed from an older version is discarded."""
        with self._lock:
            if seen_version != self.version:
                return "superseded"
            self._replace(tables)
            return "published"

    def with_ids(self, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """``rows`` with fresh ids in the given order."""
        from .operators.ordering import with_position

        high = self[name].agg(F.max("id").alias("m")).first().m or 0
        mark = max(high, self._marks.get(name, 0))
        out = with_position(rows, [F.col(c) for c in order], "id").withColumn("id", F.col("id") + mark + 1)
        self._marks[name] = mark + rows.count()
        return out
