"""Queries over the provided tables, one for each group of operators, with the SQL that must agree.

The tables hold no pictures, so each operator runs on columns that mean the same: orders are items and customers their
folders, documents have content to duplicate, embeddings are feature vectors, events are changes over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import cdc, ordering, people, resolve, tags, views
from .plans import search
from .sources import media
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items: the customer is the folder, the date the capture time."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("folder_path"), F.col("o_orderdate").alias("taken_at"), F.col("o_orderkey").alias("file_name"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("size"),
    )


_ITEMS = "items as (select o_orderkey as id, o_custkey as folder, o_orderdate as taken, o_orderstatus as status, o_orderpriority as priority, o_totalprice as size from orders)"
_GRID = "oldest desc, folder, taken, id"
_PLACED = f"{_ITEMS}, placed as (select *, row_number() over (order by {_GRID}) - 1 as pos from (select *, min(taken) over (partition by folder) as oldest from items))"


# Views and orders.
@query(f"with {_PLACED} select id, folder as folder_path, oldest, pos from placed")
def view_all_grid_order(spark, d):
    return views.placed(orders(spark, d)).select("id", "folder_path", "oldest", "pos")


@query(f"with {_ITEMS}, f as (select * from items where priority = '1-URGENT') select id, row_number() over (order by {_GRID}) - 1 as pos from (select *, min(taken) over (partition by folder) as oldest from f)")
def view_filtered_placement(spark, d):
    return views.placed(orders(spark, d).filter("priority = '1-URGENT'")).select("id", "pos")


@query(f"with {_PLACED}, f as (select * from placed where priority = '1-URGENT') select id, row_number() over (order by {_GRID}) - 1 as pos from f")
def view_search_placement(spark, d):
    rows = orders(spark, d)
    return views.placed(rows.filter("priority = '1-URGENT'"), within=rows).select("id", "pos")


@query("select o_orderkey as id, o_orderdate as taken_at from orders order by o_orderdate desc, o_orderkey desc limit 500")
def view_recent_topk(spark, d):
    return views.recent(orders(spark, d)).select("id", "taken_at")


def _timeline(unit):
    sql = f"with p as (select date_trunc('{unit}', o_orderdate)::timestamp as period, count(*) as count, min(o_orderdate) as oldest from orders group by 1) select period, count, oldest, coalesce(sum(count) over (order by period desc rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from p"

    def run(spark, d):
        return views.timeline(orders(spark, d), F.date_trunc(unit, "taken_at"), "taken_at")

    run.__name__ = f"timeline_{unit}"
    query(sql)(run)


for _unit in ("day", "month", "year"):
    _timeline(_unit)


@query(f"with {_ITEMS}, o as (select *, row_number() over (order by taken, id) - 1 as pos from items), s as (select *, case when status = lag(status) over (order by pos) then 0 else 1 end as new from o), r as (select *, sum(new) over (order by pos) as run from s) select any_value(status) as key, min(pos) as \"offset\", count(*) as count, min(taken) as oldest from r group by run")
def sections_flat_runs(spark, d):
    flat = ordering.with_position(orders(spark, d), [F.asc("taken_at"), F.asc("id")])
    return ordering.sections(flat, F.col("status"), "taken_at").select("key", "offset", F.col("count").cast("long").alias("count"), "oldest")


@query(f"with {_PLACED}, s as (select *, case when folder = lag(folder) over (order by pos) then 0 else 1 end as new from placed), r as (select *, sum(new) over (order by pos) as run from s) select any_value(folder) as key, min(pos) as \"offset\", count(*) as count, min(taken) as oldest from r group by run")
def sections_folders(spark, d):
    return ordering.sections(views.placed(orders(spark, d)), F.col("folder_path"), "taken_at").select("key", "offset", F.col("count").cast("long").alias("count"), "oldest")


@query(f"with {_PLACED} select folder as folder_path, count(*) as count, min(taken) as oldest_taken, round(sum(size), 2) as bytes, max(taken) as newest_change, min(pos) as first_pos from placed group by folder")
def folder_tally(spark, d):
    return views.folder_tally(views.placed(orders(spark, d)), "folder_path", "taken_at", "size", "taken_at").withColumn("bytes", F.round("bytes", 2))


def _sort(name, setting, sql_order, back=False):
    def run(spark, d):
        return views.placed(orders(spark, d), setting, grouping="none" if setting.strip("-") == "date" else "folder", modified="taken_at").select("id", "pos")

    run.__name__ = name
    query(f"with {_ITEMS} select id, row_number() over (order by {sql_order}) - 1 as pos from (select *, min(taken) over (partition by folder) as oldest from items)")(run)


_REVERSED = "oldest, folder desc, taken desc, id desc"
_sort("sort_size", "size", f"size desc, {_GRID}")
_sort("sort_modified", "modified", f"taken desc, {_GRID}")
_sort("sort_date_timeline", "date", f"taken desc, {_GRID}")
_sort("sort_reverse", "-size", f"size, {_REVERSED}")


_NAMES = "select p_partkey as id, 'IMG_' || case when p_partkey % 3 = 0 then lpad((p_partkey % 97)::varchar, 4, '0') else (p_partkey % 97)::varchar end || case when p_partkey % 2 = 0 then 'b' else '' end as name from part"


@query(f"with n as ({_NAMES}), k as (select *, regexp_extract(lower(name), '^(img_)0*([0-9]*)(.*)$', 2) as digits, regexp_extract(lower(name), '^(img_)0*([0-9]*)(.*)$', 3) as tail from n) select id, row_number() over (order by case when digits = '' then 0 else digits::int end, tail, id) - 1 as pos from k")
def sort_name_natural(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    n = (F.col("id") % 97).cast("string")
    named = part.withColumn("name", F.concat(F.lit("IMG_"), F.when(F.col("id") % 3 == 0, F.lpad(n, 4, "0")).otherwise(n), F.when(F.col("id") % 2 == 0, F.lit("b")).otherwise(F.lit(""))))
    return ordering.with_position(named, [ordering.natural_key(F.col("name")), F.asc("id")]).select("id", "pos")


@query(f"with {_PLACED} select id, pos from placed where pos >= 100 and pos < 300")
def page(spark, d):
    return ordering.page(views.placed(orders(spark, d)), 100, 200).select("id", "pos")


@query(f"with {_PLACED}, a as (select pos as p0 from placed where id = (select min(o_orderkey) from orders)) select id, pos - p0 as away, row_number() over (order by abs(pos - p0), pos - p0 desc) - 1 as rank from placed, a where abs(pos - p0) between 1 and 5")
def neighbours(spark, d):
    rows = orders(spark, d)
    first = rows.agg(F.min("id")).first()[0]
    return ordering.neighbours(views.placed(rows), "id", first, 5).select("id", "away", "rank")


@query(f"with {_PLACED} select folder as folder_path, min(pos) as \"offset\" from placed group by folder")
def folder_jump(spark, d):
    return ordering.folder_offsets(views.placed(orders(spark, d)))



@query(f"with {_PLACED}, n as (select count(*) as n from orders), w as (select s as stride from n, (select unnest(range(1, n + 1)) as s from n) where gcd(s, n) = 1 order by abs(s - round(n * 0.618)), s limit 1), k as (select k, (k * stride) % n as pos from n, w, (select unnest(range(0, n)) as k from n)) select id, pos, k as step from k join placed using (pos)")
def slideshow_walk(spark, d):
    """Every place with the step at which a walk by a coprime stride reaches it."""
    rows = views.placed(orders(spark, d))
    n = rows.count()
    return views.slideshow(rows, 0, views.stride_for(n), n).select("id", "pos", "step")


@query("select o_custkey as folder_path, year(min(o_orderdate))::int as year, row_number() over (order by year(min(o_orderdate)) desc, min(o_orderdate) desc, o_custkey) - 1 as rank from orders group by o_custkey")
def sidebar_by_year(spark, d):
    f = orders(spark, d).groupBy("folder_path").agg(F.min("taken_at").alias("oldest")).withColumn("year", F.year("oldest"))
    return ordering.with_position(f, [F.desc("year"), F.desc("oldest"), F.asc("folder_path")], "rank").select("folder_path", "year", "rank")


@query("with y as (select year(o_orderdate)::int as year, o_orderstatus as s, o_orderdate as t, o_orderkey as k from orders), m as (select *, lag(year) over (order by t desc, k desc) as before from y) select year, k as first_id from m where before is distinct from year")
def year_marks(spark, d):
    rows = orders(spark, d).withColumn("year", F.year("taken_at"))
    flat = ordering.with_position(rows, [F.desc("taken_at"), F.desc("id")])
    marks = ordering.sections(flat, F.col("year"), "taken_at")
    return marks.join(flat, marks["offset"] == flat["pos"]).select(marks["key"].alias("year"), F.col("id").alias("first_id"))


# Aggregates.
def _described(rows, **given):
    """``rows`` with the columns that statistics read; those not given are null."""
    kinds = {"kind": "int", "size": "double", "taken_at": "long", "make": "string", "model": "string", "lens": "string"}
    return rows.select(*[given.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


@query("select count(*) filter (o_orderstatus <> 'F') as photos, count(*) filter (o_orderstatus = 'F') as videos, round(sum(o_totalprice), 2) as bytes, min(o_orderdate) as oldest, max(o_orderdate) as newest from orders")
def stats_totals(spark, d):
    rows = orders(spark, d)
    day = rows.schema["taken_at"].dataType
    kind = F.when(F.col("status") == "F", 1).when(F.col("status") != "F", 0)
    totals = views.statistics(_described(rows, kind=kind, size=F.col("size"), taken_at=F.unix_timestamp("taken_at")))["totals"]
    return totals.select("photos", "videos", F.round("bytes", 2).alias("bytes"), *[F.timestamp_seconds(c).cast(day).alias(c) for c in ("oldest", "newest")])


@query("select year(ts)::int as year, count(*) as n from events group by 1")
def stats_years(spark, d):
    return views.statistics(_described(table(spark, d, "events"), taken_at=F.unix_timestamp("ts")))["years"]


@query("select p_brand || ' ' || p_type as name, count(*) as n from part group by 1 order by n desc, name limit 10")
def stats_top_makers(spark, d):
    return views.statistics(_described(table(spark, d, "part"), make=F.col("p_brand"), model=F.col("p_type")))["cameras"]


@query("select least(floor(l_extendedprice / 110000.0 * 64), 63)::int as bin, count(*) as n from lineitem group by 1")
def histogram_64(spark, d):
    return views.histogram(table(spark, d, "lineitem"), "l_extendedprice", 110000.0)


@query("select sum(('0x' || substr(md5(doc_id::varchar || text), 1, 12))::bigint)::double as digest from documents")
def set_digest(spark, d):
    key = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.col("text"))), 1, 12), 16, 10).cast("long")
    return resolve.set_digest(table(spark, d, "documents"), [], key).select(F.col("digest").cast("double").alias("digest"))


# Search.
def _search(name, text, sql):
    def run(spark, d):
        docs = table(spark, d, "documents")
        rated = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        docs = docs.join(rated, "doc_id", "left")
        fields = search.Fields(
            any=[F.col("text"), F.col("lang"), F.col("source")], words={"tag": F.col("lang"), "folder": F.col("source")}, numbers={"size": F.col("n_chars"), "iso": F.col("doc_id")},
            facts={"starred": F.col("quality") >= 1, "has_tag": F.col("quality").isNotNull()}, taken=F.lit(1577836800) + F.col("doc_id") * 86400,
        )
        return docs.filter(search.compile_query(text, fields)).select("doc_id")

    run.__name__ = name
    query(f"with s as (select d.*, quality, to_timestamp(1577836800 + doc_id * 86400)::timestamp as taken, lower(text || chr(0) || lang || chr(0) || source) as hay from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id)) select doc_id from s where {sql}")(run)


_has = lambda w: f"contains(hay, '{w}')"
_search("search_words", "the license", f"{_has('the')} and {_has('license')}")
_search("search_or", "license OR token", f"{_has('license')} or {_has('token')}")
_search("search_negate", "license -apache -is:starred", f"{_has('license')} and not {_has('apache')} and not coalesce(quality >= 1, false)")
_search("search_phrase", '"licensed under the" AND mit OR', f"{_has('licensed under the')} and {_has('mit')}")
_search("search_prefix", "tag:de folder:src1 from:", "lang = 'de' and contains(source, 'src1')")
_search("search_dates", "from:2020-03 to:2020-06-15 -on:04-01", "taken >= '2020-03-01' and taken < '2020-06-16' and not (month(taken) = 4 and day(taken) = 1)")
_search("search_numbers", "size:>2kb size:<=4kb iso:<500", "n_chars >= 2049 and n_chars <= 4096 and doc_id <= 499")
_search("search_rounded", "size:3kb", "n_chars >= 2560 and n_chars <= 3583")
_search("search_facts", "is:starred has:tag -tag:en", "quality >= 1 and lang <> 'en'")
_search("search_empty", "OR from: AND", "false")


@query("select c_custkey as id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(48.137) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.137)) * pow(sin((radians(11.575) - radians(lon)) / 2), 2)))), 6) as km from (select c_custkey, 45.0 + (c_custkey % 700) / 100.0 as lat, 8.0 + (c_custkey % 900) / 100.0 as lon from customer) where 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(48.137) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.137)) * pow(sin((radians(11.575) - radians(lon)) / 2), 2)))) * 1000 <= 250000")
def search_near(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(45.0) + (F.col("c_custkey") % 700) / 100.0).alias("lat"), (F.lit(8.0) + (F.col("c_custkey") % 900) / 100.0).alias("lon"))
    near = c.filter(search.compile_query("near:48.137,11.575,250km", search.Fields(gps=(F.col("lat"), F.col("lon")))))
    return near.select("id", F.round(S.distance_km(F.col("lat"), F.col("lon"), F.lit(48.137), F.lit(11.575)), 6).alias("km"))


@query("select conv_id from conversations group by conv_id having count(*) >= 3")
def search_faces_count(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.filter(search.compile_query("faces:3+", search.Fields(faces=F.col("n")))).select("conv_id")


# Overlays.
def _tag_tables(spark, d):
    docs = table(spark, d, "documents")
    file_tags = docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("tag")).unionByName(docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("tag")))
    user = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("item_id"), F.lit("best").alias("tag"), F.lit(True).alias("added"))
    user = user.unionByName(docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("item_id"), F.lit("en").alias("tag"), F.lit(False).alias("added")))
    rules = spark.createDataFrame([("src1", "first"), ("src2", "first"), ("src3", None), ("fr", "French")], "tag string, target string")
    return docs, file_tags, user, rules


_TAGS = """rules(tag, target) as (values ('src1', 'first'), ('src2', 'first'), ('src3', null), ('fr', 'French')),
  raw as (select doc_id as item_id, lang as tag from documents union all select doc_id, source from documents),
  kept as (select item_id, tag from raw where not (tag = 'en' and item_id % 7 = 0) union all select doc_id, 'best' from documents where doc_id % 10 = 0),
  eff as (select distinct item_id, coalesce(target, k.tag) as tag from kept k left join rules r on k.tag = r.tag where r.tag is null or target is not null)"""


@query(f"with {_TAGS} select item_id, tag from eff")
def tags_effective(spark, d):
    _, file_tags, user, rules = _tag_tables(spark, d)
    return tags.effective(file_tags, user, rules)


@query(f"with {_TAGS} select tag, count(*) filter (item_id % 5 <> 0) as visible, count(*) as live from eff group by tag")
def tag_counts(spark, d):
    docs, file_tags, user, rules = _tag_tables(spark, d)
    return tags.counts(tags.effective(file_tags, user, rules), docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 == 0).alias("hidden")))


@query(f"with {_TAGS} select item_id from eff where tag = 'first'")
def tag_view(spark, d):
    _, file_tags, user, rules = _tag_tables(spark, d)
    return tags.effective(file_tags, user, rules).filter("tag = 'first'").select("item_id")


@query("select * from (values ('a', 'd'), ('b', 'd'), ('c', 'd')) t(tag, target)")
def tag_rename_merge(spark, d):
    rules = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", None)], "tag string, target string")
    return tags.rename(rules, "c", "d")


@query("select l as id, coalesce(n, 0)::bigint as n from (select unnest(range(0, 11)) as l) left join (select label, count(distinct vec_id) as n from embeddings where vec_id % 3 <> 0 group by label) on l = label")
def album_counts(spark, d):
    e = table(spark, d, "embeddings")
    albums = spark.range(11).select("id", F.concat(F.lit("album "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("picasa_token"))
    members = e.select(F.col("label").cast("long").alias("album_id"), F.col("vec_id").alias("item_id"))
    return tags.album_counts(albums, members, e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3 == 0).alias("hidden"))).select("id", "n")


@query("select user_id::varchar as token, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) as name, max(ts) as at from events group by user_id")
def newest_writer_name(spark, d):
    e = table(spark, d, "events")
    seen = e.select(F.col("user_id").cast("string").alias("token"), F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("named_at"))
    even = (F.col("named_at.event_id") % 2).eqNullSafe(0)  # the two sources
    return tags.newest_name(seen.filter(even), seen.filter(~even)).select("token", "name", F.col("named_at.ts").alias("at"))


@query("""select doc_id, case when (old is null and new) or (old is not null and new is not null and old <> new) then new else hid end as hidden, coalesce(new, old) as answer from (
  select doc_id, case doc_id % 3 when 0 then null when 1 then true else false end as old, case (doc_id // 3) % 3 when 0 then null when 1 then true else false end as new, doc_id % 2 = 0 as hid from documents)""")
def hidden_follow(spark, d):
    three = lambda c: F.when(c == 1, F.lit(True)).when(c == 2, F.lit(False))
    docs = table(spark, d, "documents").select("doc_id", three(F.col("doc_id") % 3).alias("old"), three(F.floor(F.col("doc_id") / 3) % 3).alias("new"), (F.col("doc_id") % 2 == 0).alias("hid"))
    f = docs.select("doc_id", tags.follow(F.col("old"), F.col("new"), F.col("hid")).alias("f"))
    return f.select("doc_id", "f.hidden", "f.answer")


# Entity resolution.
_DUP = "h as (select doc_id, n_chars, md5(text) as hash from documents), g as (select n_chars, hash, min(doc_id) as \"group\", count(*) as copies from h group by 1, 2 having count(*) > 1)"


@query("select doc_id from documents where n_chars in (select n_chars from documents group by n_chars having count(*) > 1)")
def dup_candidates(spark, d):
    return resolve.exact_candidates(table(spark, d, "documents"), "n_chars").select("doc_id")


@query(f"with {_DUP} select doc_id as key, hash, \"group\", copies from h join g using (n_chars, hash)")
def dup_exact(spark, d):
    return resolve.exact_groups(table(spark, d, "documents"), "doc_id", "n_chars", F.col("text"))


@query(f"with {_DUP} select count(*) as n, count(distinct \"group\") as groups from h join g using (n_chars, hash)")
def dup_count(spark, d):
    return resolve.exact_groups(table(spark, d, "documents"), "doc_id", "n_chars", F.col("text")).agg(F.count("*").alias("n"), F.countDistinct("group").alias("groups"))


@query(f"with {_DUP}, a as (select min(doc_id) as anchor from h join g using (n_chars, hash)) select doc_id as id from h where doc_id = (select anchor from a) or hash = (select hash from h where doc_id = (select anchor from a))")
def copies_of(spark, d):
    docs = table(spark, d, "documents")
    anchor = resolve.exact_groups(docs, "doc_id", "n_chars", F.col("text")).agg(F.min("key")).first()[0]
    rows = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"), F.lit(None).cast("long").alias("similar_group"))
    return views.copies_of(rows, anchor).select("id")


_BITS = "b as (select vec_id, embedding, list_transform(embedding, lambda x: x > 0) as s from embeddings)"
_NEAR = f"{_BITS}, p as (select a.vec_id as a, b.vec_id as b, len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) as distance from b a join b on a.vec_id < b.vec_id), c as (select * from p where distance <= 18)"


def _bits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", S.sign_bits(F.col("embedding")).alias("h"))


@query(f"with {_NEAR} select a, b, distance from c")
def lookalike_pairs(spark, d):
    close = resolve.lookalike_pairs(_bits(spark, d).select("vec_id", "h"), "vec_id", "h", 18)
    return close.select("a", "b", F.col("distance").cast("long").alias("distance"))


@query(f"with recursive {_NEAR}, e as (select a, b from c union all select b, a from c), r as (select a as n, a as l from e union select e.b, r.l from r join e on r.n = e.a) select n as key, min(l) as \"group\" from r group by n")
def lookalike_groups(spark, d):
    return resolve.lookalike_groups(_bits(spark, d), "vec_id", "h", 18)


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    size = F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    path = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    seen = docs.filter("doc_id % 5 <> 0").select(path.alias("path"), size.alias("size"), F.col("doc_id").alias("mtime_ms"))
    known = docs.filter("doc_id % 3 <> 0").select(path.alias("path"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ms"), (F.col("doc_id") % 10 == 0).alias("missing"), (F.col("doc_id") % 2 + 1).alias("exif_version"))
    return seen, known


_CDC = """seen as (select '/lib/' || source || '/' || doc_id as path, case when doc_id % 11 = 0 then n_chars + 1 else n_chars end as size from documents where doc_id % 5 <> 0),
  known as (select '/lib/' || source || '/' || doc_id as path, doc_id as id, n_chars as size, doc_id % 10 = 0 as missing, doc_id % 2 + 1 as v from documents where doc_id % 3 <> 0),
  x as (select path, case when k.path is null then 'added' when s.path is null and starts_with(path, '/lib/src4/') then 'kept' when s.path is null and missing then 'purged' when s.path is null then 'marked_missing'
    when s.size = k.size and not missing and v < 2 then 'enriched' when s.size = k.size and not missing then 'unchanged' else 'changed' end as status from seen s full join known k using (path))"""


@query(f"with {_CDC} select path, status from x")
def cdc_diff(spark, d):
    return cdc.diff(*_snapshots(spark, d), 2, ["/lib/src4"]).select("path", "status")


@query(f"with {_CDC} select status, count(*) as n from x group by status")
def cdc_report(spark, d):
    return cdc.report(cdc.diff(*_snapshots(spark, d), 2, ["/lib/src4"]))


@query(f"with {_CDC} select path, status = 'marked_missing' as missing from x where status not in ('purged', 'added')")
def cdc_soft_delete(spark, d):
    seen, known = _snapshots(spark, d)
    changes = cdc.diff(seen, known, 2, ["/lib/src4"])
    items = known.select("id", "path", "size", "mtime_ms", F.when(F.col("missing"), F.lit(1).cast("long")).alias("missing_since"))
    out = cdc.apply(items, changes, items.limit(0), 99)
    return out.join(changes.select("id", "status"), "id").select("path", F.when(F.col("status") == "kept", F.lit(False)).otherwise(F.col("missing_since").isNotNull()).alias("missing"))


@query("""with o as (select doc_id as id, n_chars, md5(text) as h, source as name from documents where doc_id % 2 = 0), n as (select doc_id as id, n_chars, md5(text) as h, source as name from documents where doc_id % 2 = 1),
  ok as (select n_chars, h from o group by 1, 2 having count(*) <= 32), p as (select n.id as new_id, o.id as old_id, n.name = o.name as named from n join o using (n_chars, h) join ok using (n_chars, h)),
  f as (select new_id, old_id from (select *, count(*) over (partition by new_id) as a, count(*) over (partition by old_id) as b from p where named) where a = 1 and b = 1),
  r as (select * from p where new_id not in (select new_id from f) and old_id not in (select old_id from f)),
  s as (select new_id, old_id from (select *, count(*) over (partition by new_id) as a, count(*) over (partition by old_id) as b from r) where a = 1 and b = 1) select * from f union all select * from s""")
def moved_resolution(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.md5("text").alias("h"), F.col("source").alias("name"))
    return resolve.moved(docs.filter("id % 2 = 1"), docs.filter("id % 2 = 0").withColumn("gone", F.lit(True)), ["n_chars", "h"])


# Vectors and people.
@query("select label as \"group\", i - 1 as i, round(sum(embedding[i]::double), 4) as s from embeddings, (select unnest(range(1, 65)) as i) group by 1, 2")
def centroids(spark, d):
    c = resolve.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("group", F.posexplode("v").alias("i", "s")).select("group", F.col("i").cast("long").alias("i"), F.round("s", 4).alias("s"))


@query("with c as (select label, list(s order by i) as v from (select label, i, sum(embedding[i]::double) as s from embeddings, (select unnest(range(1, 65)) as i) group by 1, 2) group by label) select vec_id, round(list_cosine_similarity(embedding::double[], v), 4) as similarity from embeddings join c using (label)")
def cosine_to_centroid(spark, d):
    e = table(spark, d, "embeddings")
    c = resolve.centroids(e, "label", "embedding").withColumnRenamed("group", "label")
    return e.join(c, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("v")), 4).alias("similarity"))


@query()
def leader_clusters(spark, d):
    """Order decides, so SQL cannot say it; the tests hold it against a plain loop. All vectors are one sequential group."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return resolve.leader_clusters(e, 0.45)



@query("with g as (select user_id as \"group\", count(*) as n, array_to_string(list(event_id order by event_id)[1:3], ',') as strip from events group by user_id), s as (select case when n >= 2 then 'unnamed' else 'singles' end as section, * from g) select section, \"group\", n, strip from s qualify row_number() over (partition by section order by n desc, \"group\") <= 200")
def people_page_all(spark, d):
    """Every section of the page; no group here is named or ignored."""
    faces = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"))
    who = faces.select(F.col("person_id").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("ignored"))
    return people.page(faces, who, 3).select("section", "group", "n", F.array_join(F.col("strip").cast("array<string>"), ",").alias("strip"))


@query("with n as (select user_id as \"group\", event_type as contact, count(*) as n from events group by 1, 2) select \"group\", max_by(contact, struct_pack(n := n, c := contact)) as contact from n group by \"group\" having max(n) * 2 > sum(n)")
def offered_names(spark, d):
    return people.offered_names(table(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_type").alias("contact")))


@query("with n as (select o_custkey as \"group\", o_orderstatus as contact, count(*) as n from orders group by 1, 2) select \"group\", max_by(contact, struct_pack(n := n, c := contact)) as contact from n group by \"group\" having max(n) * 2 > sum(n)")
def offered_names_of_orders(spark, d):
    """Groups of which about a third have a name that more than half agree on."""
    return people.offered_names(orders(spark, d).select(F.col("folder_path").alias("group"), F.col("status").alias("contact")))


_BOX = "select p_partkey as id, p_partkey // 4 as item_id, (p_partkey % 7) / 16.0 as \"left\", (p_partkey % 5) / 16.0 as top, (p_partkey % 7) / 16.0 + 0.25 + (p_partkey % 3) / 8.0 as \"right\", (p_partkey % 5) / 16.0 + 0.25 + (p_partkey % 4) / 8.0 as bottom from part"


def _boxes(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        p.alias("id"), F.floor(p / 4).alias("item_id"), (p % 7 / 16.0).alias("left"), (p % 5 / 16.0).alias("top"), (p % 7 / 16.0 + 0.25 + p % 3 / 8.0).alias("right"),
        (p % 5 / 16.0 + 0.25 + p % 4 / 8.0).alias("bottom"), (p % 13).cast("double").alias("score"),
    )


def _box_pairs(spark, d):
    r = F.struct("left", "top", "right", "bottom")
    b = _boxes(spark, d)
    return b.select("item_id", F.col("id").alias("a"), r.alias("ra")).join(b.select("item_id", F.col("id").alias("b"), r.alias("rb")), "item_id").filter("a < b")


@query(f"with x as ({_BOX}) select a.id as a, b.id as b, round(i / (wa + wb - i), 6) as iou from (select a, b, greatest(least(a.right, b.right) - greatest(a.left, b.left), 0) * greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0) as i, (a.right - a.left) * (a.bottom - a.top) as wa, (b.right - b.left) * (b.bottom - b.top) as wb from x a join x b on a.item_id = b.item_id and a.id < b.id)")
def rect_iou(spark, d):
    return _box_pairs(spark, d).select("a", "b", F.round(S.overlap(F.col("ra"), F.col("rb")), 6).alias("iou"))


@query(f"with x as ({_BOX}), c as (select *, (\"left\" + \"right\") / 2 as cx, (top + bottom) / 2 as cy from x) select a.id as a, b.id as b from c a join c b on a.item_id = b.item_id and a.id < b.id where (a.cx between b.left and b.right and a.cy between b.top and b.bottom) or (b.cx between a.left and a.right and b.cy between a.top and a.bottom)")
def rect_same(spark, d):
    return _box_pairs(spark, d).filter(S.same_face(F.col("ra"), F.col("rb"))).select("a", "b")


@query()
def nms(spark, d):
    """Greedy; the tests hold it against a plain loop."""
    return resolve.suppress(_boxes(spark, d)).select("id", "item_id")


# Incremental.
@query("with e as (select ts, case when ts - lag(ts) over (order by ts) < interval 15 minutes then 0 else 1 end as new from events), r as (select ts, sum(new) over (order by ts) as run from e) select min(ts) as start, max(ts) as last, count(*) as n from r group by run")
def session_debounce(spark, d):
    return watch.sessions(table(spark, d, "events"), "ts", 900)


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), r as (select *, sum(new) over (partition by user_id order by ts) as run from e) select user_id, min(ts) as start, max(ts) as last, count(*) as n from r group by user_id, run")
def session_debounce_by_user(spark, d):
    return watch.sessions(table(spark, d, "events"), "ts", 6 * 3600, ["user_id"])


_PATHS = "p as (select distinct regexp_replace(url, '^[a-z]+://', '/') as dir from pages union select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '/[^/]*$', '') from pages where page_id % 4 = 0)"


@query(f"with {_PATHS} select dir from p a where dir <> '' and not exists (select 1 from p b where b.dir <> a.dir and b.dir <> '' and starts_with(a.dir, b.dir || '/'))")
def plan_scans_collapse(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("dir"))
    dirs = pages.select("dir").union(pages.filter("page_id % 4 = 0").select(F.regexp_replace("dir", "/[^/]*$", ""))).filter("dir <> ''")
    return watch.plan_scans(dirs, ["/"])


# Sources and scalars.
@query("select page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')), '') as title from pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", media.page_text(F.col("html"))["title"].alias("title"))


@query("select event_id, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, strftime(ts, '%Y-%m-%d') as text from events")
def scalar_dates(spark, d):
    s = F.unix_timestamp("ts")
    e = table(spark, d, "events").select("event_id", S.civil(s).alias("c"), S.date_text(s).alias("text"))
    return e.select("event_id", "c.year", "c.month", "c.day", "text")


@query("select p_partkey as id, case when p_partkey % 8 + 1 between 5 and 8 then p_size else p_size * 2 end as width, case when p_partkey % 8 + 1 between 5 and 8 then p_size * 2 else p_size end as height, lpad(lower(hex(p_partkey)), 16, '0') as hex, (p_partkey % 65536) * 281474976710656 // 281474976710656 as part from part")
def scalar_geometry(spark, d):
    p = table(spark, d, "part")
    size = S.oriented(F.col("p_size") * 2, F.col("p_size"), F.col("p_partkey") % 8 + 1)
    packed = S.crop_pack(F.col("p_partkey") % 65536, F.lit(1), F.lit(2), F.lit(3))
    return p.select(F.col("p_partkey").alias("id"), size["width"].alias("width"), size["height"].alias("height"), S.hex_key(F.col("p_partkey")).alias("hex"), S.crop_parts(packed)["left"].alias("part"))



@query("select name, lower_name, case when n = 1 then name else regexp_replace(name, '[.][^.]*$', '') || ' (' || n || ')' || regexp_extract(name, '[.][^.]*$') end as out_name, id from (select p_partkey as id, case when p_partkey % 2 = 0 then 'scan.jpg' else 'Scan.JPG' end as name, 'scan.jpg' as lower_name, row_number() over (order by p_partkey) as n from part)")
def export_names_all(spark, d):
    """Every row, those whose names clash only by case too."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.lit("scan.jpg")).otherwise(F.lit("Scan.JPG")).alias("name"))
    return media.export_names(p, "name").withColumn("lower_name", F.lower("name")).select("name", "lower_name", "out_name", "id")
