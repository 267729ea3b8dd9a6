"""The views of a library, their orders and their tallies.

A view is a set of rows; the grid shows it folder by folder, the folder with the newest oldest-row first. All orders are
total: ties fall back to the grid's own order and at last to the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import hidden, visible
from .ordering import estimated_bytes, natural_key, with_position

RECENT = 500
VIEWS = ["all", "starred", "recent", "search", "person", "album", "tag", "duplicates", "copies", "hidden", "videos"]


def with_oldest(rows: DataFrame, folder: str, taken: str, within: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``oldest``: the folder's oldest row, of these rows or of ``within``.

    A folder may be any part of the library, so its minimum is aggregated before the shuffle and joined back.
    """
    least = (within if within is not None else rows).groupBy(F.col(folder).alias("__f")).agg(F.min(taken).alias("oldest"))
    return rows.join(least, F.col(folder).eqNullSafe(F.col("__f")), "left").drop("__f")


def grid_order(folder: str = "folder_path", taken: str = "taken_at", name: str = "file_name", key: str = "id") -> list[Column]:
    return [F.desc("oldest"), F.asc(folder), F.asc(taken), F.asc(name), F.asc(key)]


def order(sort: str, folder: str = "folder_path", taken: str = "taken_at", name: str = "file_name", key: str = "id", size: str = "size", modified: str = "mtime_ms", grouping: str = "folder") -> list[Column]:
    """Order columns of a sort setting; a leading ``-`` reverses everything, ties too. Unknown settings are by date."""
    back, kind = sort.startswith("-"), sort.lstrip("-")
    grid = [("oldest", True), (folder, False), (taken, False), (name, False), (key, False)]
    head = {"size": [(size, True)], "modified": [(modified, True)], "name": [(natural_key(F.col(name)), False)]}.get(kind, [] if grouping == "folder" else [(taken, True)])
    made = []
    for c, down in [*head, *grid]:
        col = F.col(c) if isinstance(c, str) else c
        made.append(col.desc() if down != back else col.asc())
    return made


def placed(rows: DataFrame, sort: str = "date", within: DataFrame | None = None, folder: str = "folder_path", taken: str = "taken_at", **names: str) -> DataFrame:
    """``rows`` with ``oldest`` and ``pos``."""
    grouping = names.pop("grouping", "folder")
    # The optimizer multiplies the sides of the join that follows; the rows themselves say how much there is to order.
    size = estimated_bytes(rows)
    return with_position(with_oldest(rows, folder, taken, within), order(sort, folder, taken, grouping=grouping, **names), size=size)


def recent(rows: DataFrame, taken: str = "taken_at", name: str = "file_name", key: str = "id", n: int = RECENT) -> DataFrame:
    return rows.orderBy(F.desc(taken), F.desc(name), F.desc(key)).limit(n)


def folder_tally(ordered: DataFrame, folder: str, taken: str, size: str, modified: str) -> DataFrame:
    """Per folder: rows, oldest, bytes, newest change, and the place where it is first reached."""
    return ordered.groupBy(folder).agg(F.count("*").alias("count"), F.min(taken).alias("oldest_taken"), F.sum(size).alias("bytes"), F.max(modified).alias("newest_change"), F.min("pos").alias("first_pos"))


def timeline(rows: DataFrame, period: Column, taken: str) -> DataFrame:
    """Sections of the order newest first: per period its offset, count and oldest. Periods, not rows, are ordered."""
    counts = rows.groupBy(period.alias("period")).agg(F.count("*").alias("count"), F.min(taken).alias("oldest"))
    return counts.withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def duplicate_ids(rows: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Ids of rows that share a non-null value of any of ``keys`` with another of these rows."""

    def one(k: str) -> DataFrame:
        shared = rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("__k")).count().filter("count > 1")
        return rows.join(shared, F.col(k) == F.col("__k"), "left_semi").select(key)

    return reduce(lambda a, b: a.unionByName(b), map(one, keys)).distinct()


def copies_of(rows: DataFrame, anchor: int, frozen_hash: str | None = None, key: str = "id", content: str = "content_hash", group: str = "similar_group") -> DataFrame:
    """The anchor, the rows of its content hash (its own while it exists, else the frozen one) and of its look-alike group."""
    own = rows.filter(F.col(key) == anchor).select(F.col(content).alias("h"), F.col(group).alias("g"), F.lit(True).alias("there")).limit(1)
    wanted = rows.sparkSession.range(1).join(own, F.lit(True), "left").select(F.when(F.col("there"), F.col("h")).otherwise(F.lit(frozen_hash)).alias("h"), "g")
    hit = (F.col(key) == anchor) | F.coalesce(F.col(content) == F.col("h"), F.lit(False)) | F.coalesce(F.col(group) == F.col("g"), F.lit(False))
    return rows.join(F.broadcast(wanted), hit, "left_semi")  # one row


def person_items(detected: DataFrame, faces: DataFrame, links: DataFrame, argument: str) -> DataFrame:
    """Item ids of ``p:<person id>`` (confirmed detections and linked contacts) or ``c:<contact>``; else none."""
    kind, _, value = argument.partition(":")
    if kind == "p" and value.isdigit():
        own = detected.filter((F.col("person_id") == int(value)) & F.col("confirmed")).select("item_id")
        linked = faces.join(links.filter(F.col("person_id") == int(value)), "contact", "left_semi").select("item_id")
        return own.union(linked).distinct()
    if kind == "c" and value:
        return faces.filter(F.col("contact") == value).select("item_id").distinct()
    return faces.select("item_id").limit(0)


def view(catalog, name: str, argument=None) -> DataFrame:
    """The rows of a view; an argument that makes no sense gives no rows."""
    from ..operators import tags

    items = visible(catalog["items"])
    none = items.limit(0)
    if name in ("all", "recent"):
        return items if name == "all" else recent(items)
    if name == "starred":
        return items.filter("rating >= 1")
    if name == "videos":
        return items.filter("kind = 1")
    if name == "hidden":
        return hidden(catalog["items"])
    if name == "duplicates":
        return items.join(duplicate_ids(items, ["content_hash", "similar_group"]), "id", "left_semi")
    if name == "copies":
        return copies_of(items, int(argument)) if str(argument).isdigit() else none
    if name == "album":
        member = catalog["album_items"].filter(F.col("album_id") == int(argument)).select(F.col("item_id").alias("id")) if str(argument).isdigit() else None
        return items.join(member, "id", "left_semi") if member is not None else none
    if name == "tag":
        effective = tags.effective(catalog["item_tags"], catalog["item_user_tags"], catalog["tag_rules"])
        return items.join(effective.filter(F.col("tag") == argument).select(F.col("item_id").alias("id")), "id", "left_semi")
    if name == "person":
        ids = person_items(catalog["detected_faces"], catalog["faces"], catalog["person_contacts"], str(argument))
        return items.join(ids.withColumnRenamed("item_id", "id"), "id", "left_semi")
    if name == "search":
        from ..plans.library_search import search_items

        return search_items(catalog, str(argument or ""))
    raise ValueError(f"no view {name!r}; views are {VIEWS}")


def statistics(rows: DataFrame) -> dict[str, DataFrame]:
    """Totals, rows per year newest first, and the ten most frequent makers and lenses with name ties in order."""
    top = lambda c: rows.filter(c.isNotNull()).groupBy(c.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    totals = rows.agg(F.count_if(F.col("kind") == 0).alias("photos"), F.count_if(F.col("kind") == 1).alias("videos"), F.sum("size").alias("bytes"), F.min("taken_at").alias("oldest"), F.max("taken_at").alias("newest"), F.count_if(F.col("make").isNull() & F.col("model").isNull()).alias("no_camera"))
    years = rows.groupBy(F.year(F.timestamp_seconds("taken_at")).alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))
    return {"totals": totals, "years": years, "cameras": top(F.when(F.col("make").isNotNull() | F.col("model").isNotNull(), F.concat_ws(" ", "make", "model"))), "lenses": top(F.col("lens"))}


def histogram(values: DataFrame, column: str, top: float, bins: int = 64) -> DataFrame:
    """(bin, n): how many values lie in each of ``bins`` equal parts of [0, top); what lies above is in the last. Empty bins are left out."""
    at = F.greatest(F.least(F.floor(F.col(column) / top * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return values.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def slideshow(rows: DataFrame, start: int, stride: int, n: int, pos: str = "pos") -> DataFrame:
    """Rows with ``step``, when a walk by ``stride`` (coprime to ``n``) from ``start`` reaches them."""
    back = pow(stride, -1, n)
    return rows.withColumn("step", F.pmod((F.col(pos) - start) * F.lit(back).cast("decimal(38,0)"), F.lit(n)).cast("long"))


def stride_for(n: int) -> int:
    """The coprime of ``n`` nearest the golden section."""
    from math import gcd

    at = max(1, round(n * 0.618))
    return next(s for d in range(n + 1) for s in (at - d, at + d) if s >= 1 and gcd(s, n) == 1)
