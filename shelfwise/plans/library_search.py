"""Search over a whole library: side tables are joined only where the query reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import visible
from ..operators import people, tags, views
from .search import Fields, Query, compile_query, parse, shape_facts


def _names(rows: DataFrame, name: str) -> DataFrame:
    """(id, names): the folded names of each item, sorted and joined by spaces."""
    return rows.groupBy(F.col("item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.lower(name))), " ").alias(name))


def _reads(query: Query, *kinds: str) -> bool:
    def of(t) -> bool:
        return t.kind in kinds or f"{t.kind}:{t.value[0] if t.value else ''}" in kinds or any(map(of, t.parts))

    return any(of(t) for a in query.alternatives for t in a)


def documents(catalog, query: Query) -> tuple[DataFrame, Fields]:
    """Visible items with the facts that the query needs, and where they are."""
    items, needs = visible(catalog["items"]), query.needs()
    folders = catalog["folders"].select(F.col("id").alias("folder_id"), F.col("name").alias("folder_name"), F.col("alias").alias("folder_alias"))
    df = items.join(folders, "folder_id", "left")
    effective = tags.effective(catalog["item_tags"], catalog["item_user_tags"], catalog["tag_rules"])
    df = df.join(_names(effective.withColumnRenamed("tag", "tag_names"), "tag_names"), "id", "left")
    if "albums" in needs:
        a = catalog["album_items"].join(catalog["albums"].select(F.col("id").alias("album_id"), F.col("name").alias("album_names")), "album_id")
        df = df.join(_names(a, "album_names"), "id", "left")
    if "people" in needs:
        named = catalog["people"].filter("name is not null").select(F.col("id").alias("person_id"), F.col("name").alias("people_names"))
        own = catalog["detected_faces"].filter("confirmed").join(named, "person_id").select("item_id", "people_names")
        linked = catalog["faces"].join(catalog["person_contacts"], "contact").join(named, "person_id").select("item_id", "people_names")
        contact = catalog["faces"].join(catalog["contacts"].select(F.col("hash").alias("contact"), F.col("name").alias("people_names")), "contact").select("item_id", "people_names")
        df = df.join(_names(own.unionByName(linked).unionByName(contact), "people_names"), "id", "left")
    if "faces" in needs:
        df = df.join(people.merged_face_counts(catalog["faces"], catalog["detected_faces"]).select(F.col("item_id").alias("id"), F.col("n").alias("face_count")), "id", "left")
    duplicate = F.lit(False)
    if _reads(query, "is:duplicate"):
        df = df.join(views.duplicate_ids(items, ["content_hash", "similar_group"]).withColumn("copied", F.lit(True)), "id", "left")
        duplicate = F.col("copied")
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    size = S.edited_dims(F.col("width"), F.col("height"), F.coalesce("edit_turns", F.lit(0)), F.col("edit_crop"))
    known = (F.col("width") > 0) & (F.col("height") > 0)
    w, h = F.when(known, size["width"]), F.when(known, size["height"])
    camera = F.when(F.col("make").isNotNull() | F.col("model").isNotNull(), F.concat(F.coalesce("make", F.lit("")), F.lit(" "), F.coalesce("model", F.lit(""))))
    folder = F.concat_ws(" ", "folder_name", "folder_alias")
    edited = (F.coalesce("edit_turns", F.lit(0)) != 0) | F.col("edit_crop").isNotNull()
    gps = S.valid_gps(F.col("gps_lat"), F.col("gps_lon"))
    fields = Fields(
        any=[F.col("folder_name"), F.col("folder_alias"), F.col("file_name"), F.col("make"), F.col("model"), F.col("lens"), S.focal_text(F.col("focal_mm")), S.aperture_text(F.col("aperture")), S.iso_text(F.col("iso")), F.col("tag_names"), S.caption(F.col("caption")), S.date_text(F.col("taken_at"))],
        words={"camera": camera, "lens": F.col("lens"), "tag": F.col("tag_names"), "folder": folder, "person": col("people_names"), "album": col("album_names")},
        facts={
            "starred": F.col("rating") >= 1, "edited": edited, "video": F.col("kind") == 1, "photo": F.col("kind") == 0, "duplicate": duplicate, **shape_facts(w, h),
            "has_gps": gps, "has_tag": F.col("tag_names").isNotNull(), "has_caption": S.caption(F.col("caption")).isNotNull(), "has_album": col("album_names").isNotNull(), "has_person": col("people_names").isNotNull(),
        },
        numbers={"size": F.col("size"), "iso": F.col("iso"), "aperture": F.col("aperture"), "focal": F.col("focal_mm"), "mp": w.cast("long") * h},
        taken=F.col("taken_at"), gps=(F.when(gps, F.col("gps_lat")), F.when(gps, F.col("gps_lon"))), faces=col("face_count").cast("long"),
    )
    return df, fields


def search_items(catalog, text: str) -> DataFrame:
    """Visible items that a query finds, with the items' own columns; a blank query finds nothing."""
    query = parse(text)
    items = catalog["items"]
    if not query.alternatives:
        return items.limit(0)
    df, fields = documents(catalog, query)
    return df.filter(compile_query(query, fields)).select(*items.columns)
