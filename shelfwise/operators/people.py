"""People: identity groups of faces, their names, counts and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_GROUPS = 200


def named_counts(people: DataFrame, detected: DataFrame, faces: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(id, name, n): visible items of each named person, from confirmed detections and linked contacts."""
    own = detected.filter("confirmed and person_id is not null").select("person_id", "item_id")
    linked = faces.join(links, "contact").select("person_id", "item_id")
    seen = own.unionByName(linked).join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    n = seen.groupBy(F.col("person_id").alias("id")).agg(F.countDistinct("item_id").alias("n"))
    return people.filter("name is not null").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contact_counts(contacts: DataFrame, faces: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(hash, name, n) of contacts that are linked to nobody."""
    seen = faces.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy(F.col("contact").alias("hash")).agg(F.countDistinct("item_id").alias("n"))
    return contacts.join(links.select(F.col("contact").alias("hash")), "hash", "left_anti").join(seen, "hash").select("hash", "name", "n")


def page(faces: DataFrame, people: DataFrame, strip: int, top: int = TOP_GROUPS) -> DataFrame:
    """(section, group, n, strip): unnamed groups of two faces or more (the largest ``top``), single faces, and people."""
    ranked = faces.withColumn("k", F.row_number().over(Window.partitionBy("person_id").orderBy("id")))
    first = ranked.filter(F.col("k") <= strip).groupBy("person_id").agg(F.sort_array(F.collect_list("id")).alias("strip"))
    n = faces.groupBy("person_id").agg(F.count("*").alias("n"))
    g = people.withColumnRenamed("id", "person_id").join(n, "person_id", "left").join(first, "person_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    section = F.when(F.col("ignored"), "ignored").when(F.col("name").isNotNull(), "people").when(F.col("n") >= 2, "unnamed").otherwise("singles")
    g = g.withColumn("section", section).filter("section <> 'singles' or n > 0")
    capped = g.filter("section in ('unnamed', 'singles')").withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "person_id"))).filter(F.col("r") <= top).drop("r")
    return g.filter("section not in ('unnamed', 'singles')").unionByName(capped).select("section", F.col("person_id").alias("group"), "n", "strip")


def offered_names(matches: DataFrame) -> DataFrame:
    """(group, contact): the contact that more than half of a group's matched faces carry; ties by contact."""
    n = matches.groupBy("group", "contact").agg(F.count("*").alias("n"))
    best = n.groupBy("group").agg(F.max(F.struct("n", F.col("contact"))).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("b.n") * 2 > F.col("total")).select("group", F.col("b.contact").alias("contact"))


def merge(faces: DataFrame, rejections: DataFrame, links: DataFrame, people: DataFrame, source: int, target: int) -> dict[str, DataFrame]:
    """Tables after ``source`` becomes ``target``: faces that were rejected from the target become nobody's."""
    if source == target:
        raise ValueError("a person cannot be merged into itself")
    unnamed = not people.filter((F.col("id") == source) & F.col("name").isNotNull()).count()
    barred = rejections.filter(F.col("person_id") == target).select(F.col("face_id").alias("id"), F.lit(True).alias("barred"))
    f = faces.join(barred, "id", "left")
    mine = F.col("person_id") == source
    f = f.withColumn("confirmed", F.when(mine & F.col("barred").isNull() & F.lit(unnamed), F.lit(True)).when(mine & F.col("barred").isNotNull(), F.lit(False)).otherwise(F.col("confirmed")))
    f = f.withColumn("person_id", F.when(mine, F.when(F.col("barred").isNull(), F.lit(target).cast("long"))).otherwise(F.col("person_id"))).drop("barred")
    to = lambda df: df.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast("long")).otherwise(F.col("person_id"))).distinct()
    return {"detected_faces": f.select(*faces.columns), "face_rejections": to(rejections), "person_contacts": to(links), "people": people.filter(F.col("id") != source)}


def reject(faces: DataFrame, rejections: DataFrame, ids: list[int]) -> dict[str, DataFrame]:
    """Faces leave their person and the pair is remembered."""
    hit = F.col("id").isin(ids) & F.col("person_id").isNotNull()
    new = faces.filter(hit).select(F.col("id").alias("face_id"), "person_id")
    freed = faces.withColumns({"confirmed": F.when(hit, F.lit(False)).otherwise(F.col("confirmed")), "person_id": F.when(hit, F.lit(None)).otherwise(F.col("person_id"))})
    return {"detected_faces": freed, "face_rejections": rejections.unionByName(new).distinct()}


def confirm(faces: DataFrame, ids: list[int]) -> DataFrame:
    return faces.withColumn("confirmed", F.when(F.col("id").isin(ids) & F.col("person_id").isNotNull(), F.lit(True)).otherwise(F.col("confirmed")))


def ignore(faces: DataFrame, ids: list[int], on: bool = True) -> DataFrame:
    return faces.withColumn("ignored", F.when(F.col("id").isin(ids), F.lit(on)).otherwise(F.col("ignored")))


def link_by_name(contacts: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """Links plus unlinked contacts whose name equals exactly one person's, whatever the case."""
    named = people.filter("name is not null").groupBy(F.lower("name").alias("n")).agg(F.min("id").alias("person_id"), F.count("*").alias("c")).filter("c = 1")
    free = contacts.join(links.select(F.col("contact").alias("hash")), "hash", "left_anti").withColumn("n", F.lower("name"))
    return links.unionByName(free.join(named, "n").select(F.col("hash").alias("contact"), "person_id"))


def merged_face_counts(sidecar: DataFrame, detected: DataFrame) -> DataFrame:
    """(item_id, n): detections plus sidecar faces that no detection matches."""
    from ..functions import scalars as S

    rect = F.struct("left", "top", "right", "bottom")
    s = sidecar.select("item_id", "contact", rect.alias("s"))
    d = detected.filter("not ignored").select("item_id", rect.alias("d"))
    alone = s.join(d.withColumnRenamed("item_id", "i2"), (F.col("item_id") == F.col("i2")) & S.same_face(F.col("s"), F.col("d")), "left_anti")
    return alone.select("item_id").unionByName(d.select("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))
