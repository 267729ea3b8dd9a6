"""Tags with user overlays and rename rules; albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective(file_tags: DataFrame, user_tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(item_id, tag): file tags that were not suppressed plus added ones, renamed by rule; a rule without target removes."""
    suppressed = user_tags.filter("not added").select("item_id", "tag")
    kept = file_tags.select("item_id", "tag").join(suppressed, ["item_id", "tag"], "left_anti")
    whole = kept.unionByName(user_tags.filter("added").select("item_id", "tag"))
    r = rules.select(F.col("tag").alias("from"), "target", F.lit(True).alias("ruled"))
    out = whole.join(r, whole["tag"] == r["from"], "left")
    return out.filter("ruled is null or target is not null").select("item_id", F.coalesce("target", "tag").alias("tag")).distinct()


def counts(tags: DataFrame, items: DataFrame) -> DataFrame:
    """(tag, visible, live) in case-insensitive order. ``items`` has id and hidden; only live rows."""
    j = tags.join(items.select(F.col("id").alias("item_id"), "hidden"), "item_id")
    return j.groupBy("tag").agg(F.count_if(~F.col("hidden")).alias("visible"), F.count("*").alias("live")).orderBy(F.lower("tag"), "tag")


def rename(rules: DataFrame, old: str, new: str) -> DataFrame:
    """Rules after a rename or merge: what pointed at ``old`` points at ``new``, and ``new`` has no rule of its own."""
    moved = rules.withColumn("target", F.when(F.col("target") == old, F.lit(new)).otherwise(F.col("target")))
    own = rules.sparkSession.createDataFrame([(old, new)], "tag string, target string")
    return moved.filter(~F.col("tag").isin(old, new)).unionByName(own).filter(~F.col("tag").eqNullSafe(F.col("target")))


def hide(rules: DataFrame, tag: str) -> DataFrame:
    """Rules after a removal: the tag and everything renamed to it show nowhere."""
    moved = rules.withColumn("target", F.when(F.col("target") == tag, F.lit(None)).otherwise(F.col("target")))
    return moved.filter(F.col("tag") != tag).unionByName(rules.sparkSession.createDataFrame([(tag, None)], "tag string, target string"))


def restore(rules: DataFrame, tag: str) -> DataFrame:
    return rules.filter(F.col("tag") != tag)


def active_rules(rules: DataFrame, file_tags: DataFrame, user_tags: DataFrame) -> DataFrame:
    carried = file_tags.select("tag").union(user_tags.filter("added").select("tag"))
    return rules.join(carried, "tag", "left_semi")


def change(user_tags: DataFrame, file_tags: DataFrame, items: DataFrame, tag: str, added: bool) -> tuple[DataFrame, int]:
    """Overlay rows after adding or removing ``tag`` on live ``items`` (id), and how many items really changed."""
    ids = items.select(F.col("id").alias("item_id")).distinct()
    mine = user_tags.filter(F.col("tag") == tag)
    has = file_tags.filter(F.col("tag") == tag).select("item_id").join(mine.filter("not added"), "item_id", "left_anti").union(mine.filter("added").select("item_id")).distinct()
    touched = ids.join(has, "item_id", "left_anti" if added else "left_semi")
    rest = user_tags.join(touched.withColumn("tag", F.lit(tag)), ["item_id", "tag"], "left_anti")
    from_file = file_tags.filter(F.col("tag") == tag).select("item_id")
    # An added row is needed only where the file does not say so; a suppressing one only where it does.
    new = touched.join(from_file, "item_id", "left_anti" if added else "left_semi").select("item_id", F.lit(tag).alias("tag"), F.lit(added).alias("added"))
    return rest.unionByName(new), touched.count()


def item_tags_in_order(tags: DataFrame) -> DataFrame:
    """First occurrence of each (item_id, tag) by source and sequence."""
    return tags.groupBy("item_id", "tag").agg(F.min(F.struct("src", "seq")).alias("p")).select("item_id", "tag", "p.src", "p.seq")


def album_counts(albums: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Albums with their visible members; an empty album stays unless it is mirrored from elsewhere."""
    seen = members.join(items.filter("not hidden").select(F.col("id").alias("item_id")), "item_id", "left_semi")
    n = seen.groupBy(F.col("album_id").alias("id")).agg(F.countDistinct("item_id").alias("n"))
    out = albums.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.filter("n > 0 or picasa_token is null").orderBy(F.lower("name"), "name", "id")


def album_add(members: DataFrame, album: int, items: DataFrame, now_ms: int) -> DataFrame:
    new = items.select(F.lit(album).cast("long").alias("album_id"), F.col("id").alias("item_id"), F.lit(now_ms).cast("long").alias("added_ms"))
    return members.unionByName(new.dropDuplicates(["item_id"]).join(members, ["album_id", "item_id"], "left_anti").select("album_id", "item_id", "added_ms"))


def album_remove(members: DataFrame, album: int, items: DataFrame) -> DataFrame:
    gone = items.select(F.lit(album).cast("long").alias("album_id"), F.col("id").alias("item_id"))
    return members.join(gone, ["album_id", "item_id"], "left_anti")


def newest_name(mirrored: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, name, named_at): a name is taken only from a source newer than the one that named last; agreement freshens."""
    both = mirrored.select("token", "name", "named_at").unionByName(seen.select("token", "name", "named_at"))
    return both.groupBy("token").agg(F.max_by("name", "named_at").alias("name"), F.max("named_at").alias("named_at"))


def follow(old, new, hidden):
    """(hidden, answer) after a mirrored flag is read: null to yes and a change follow, null to no only records."""
    follows = (old.isNull() & F.coalesce(new, F.lit(False))) | (old.isNotNull() & new.isNotNull() & (old != new))
    return F.struct(F.when(follows, new).otherwise(hidden).alias("hidden"), F.coalesce(new, old).alias("answer"))
