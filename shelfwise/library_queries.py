"""Queries of changes to a library, over documents as items, their sources as folders, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import orders, query, table
from .operators import library as lib
from .operators import ordering, passes, resolve, views
from .streaming import watch

_I = """i as (select doc_id as id, cast(substr(source, 4) as bigint) as folder_id, 'f' || doc_id || '.JPG' as file_name, n_chars as size, doc_id * 10 as mtime_ms, case when doc_id % 4 = 0 then null else doc_id % 2 end as rating,
  doc_id % 5 = 0 as hidden, case when doc_id % 9 = 0 then 1 end as missing_since, (doc_id % 6 = 0)::int as kind, doc_id % 3 as thumb_state, case when doc_id % 7 = 0 then null else doc_id % 4 end as face_version,
  doc_id % 2 as edit_turns, null::bigint as edit_crop, doc_id % 2 as exif_version, case when doc_id % 8 = 0 then 'given' end as caption, text, lang from documents)"""


def _items(spark, d):
    p = F.col("doc_id")
    return table(spark, d, "documents").select(
        p.alias("id"), F.substring("source", 4, 9).cast("long").alias("folder_id"), F.concat(F.lit("f"), p.cast("string"), F.lit(".JPG")).alias("file_name"), F.col("n_chars").alias("size"), (p * 10).alias("mtime_ms"),
        F.when(p % 4 != 0, p % 2).alias("rating"), (p % 5 == 0).alias("hidden"), F.when(p % 9 == 0, F.lit(1).cast("long")).alias("missing_since"), (p % 6 == 0).cast("int").alias("kind"), (p % 3).alias("thumb_state"),
        F.when(p % 7 != 0, p % 4).alias("face_version"), (p % 2).alias("edit_turns"), F.lit(None).cast("long").alias("edit_crop"), (p % 2).alias("exif_version"), F.when(p % 8 == 0, F.lit("given")).alias("caption"), "text", "lang",
    )


def _folders(spark, d):
    return _items(spark, d).select(F.col("folder_id").alias("id")).distinct().select("id", (F.col("id") % 3).alias("watched_id"), F.lit(False).alias("hidden"), F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("path"))


def _roots(spark):
    return spark.createDataFrame([(0, "/a", True), (1, "/b", False), (2, "/c", True), (3, "/empty", True)], "id long, path string, online boolean")


@query(f"with {_I} select id, hidden or id % 2 = 0 as hidden, id % 2 = 0 and not hidden as changed from i")
def hide_items(spark, d):
    items = _items(spark, d)
    return lib.set_hidden(items, items.filter("id % 2 = 0").select("id").unionByName(items.select("id").filter("id % 4 = 0"))).select("id", "hidden", "changed")


@query(f"with {_I} select id, hidden or folder_id in (3, 5) as hidden from i")
def hide_folder(spark, d):
    _, items = lib.set_folder_hidden(_folders(spark, d), _items(spark, d), spark.createDataFrame([(3,), (5,)], "id long"))
    return items.select("id", "hidden")


@query(f"with {_I} select id, case when id % 3 = 0 then id % 6 else rating end as rating from i")
def set_ratings(spark, d):
    items = _items(spark, d)
    return lib.set_ratings(items, items.filter("id % 3 = 0").select("id", (F.col("id") % 6).alias("rating"))).select("id", "rating")


@query(f"with {_I}, e as (select *, id % 4 = 0 and id % 3 <> edit_turns as other from i) select id, case when other then id % 3 else edit_turns end as edit_turns, case when not other then face_version end as face_version, case when not other then thumb_state end as thumb_state from e")
def set_edits(spark, d):
    items = _items(spark, d)
    out, _ = lib.set_edits(items, items.filter("id % 4 = 0").select("id", (F.col("id") % 3).alias("edit_turns"), F.lit(None).cast("long").alias("edit_crop")))
    return out.select("id", "edit_turns", "face_version", "thumb_state")


@query(f"with {_I}, r(id, path) as (values (0, '/a'), (1, '/b'), (2, '/c'), (3, '/empty')) select r.id, path, count(i.id) as n from r left join (select * from i where missing_since is null and not hidden) i on folder_id % 3 = r.id group by r.id, path")
def root_counts(spark, d):
    return lib.root_counts(_items(spark, d), _folders(spark, d), _roots(spark))


@query(f"with {_I} select id from i where folder_id % 3 <> 1")
def online_items(spark, d):
    return lib.online_items(_items(spark, d), _folders(spark, d), _roots(spark)).select("id")


@query(f"with {_I} select id, (id % 2 = 0 and id % 10 <> 0)::int as rating from i where missing_since is null and folder_id < 6 and rating is distinct from (id % 2 = 0 and id % 10 <> 0)::int")
def mirror_stars(spark, d):
    """Sidecars of folders 0 to 5 have a line for each file whose number does not end in nought; even ones are starred."""
    items = _items(spark, d)
    lines = items.filter("folder_id < 6 and id % 10 <> 0").select("folder_id", F.lower("file_name").alias("file"), (F.col("id") % 2 == 0).alias("starred"))
    empty = items.filter("folder_id < 6").select("folder_id").distinct().select("folder_id", F.lit("-").alias("file"), F.lit(False).alias("starred"))
    return lib.mirror_stars(items, lines.unionByName(empty))


@query("with m as (select doc_id % 6 as album_id, doc_id as item_id from documents), t as (select (doc_id + doc_id // 100) % 6 as album_id, doc_id as item_id from documents where (doc_id + doc_id // 100) % 6 < 4) select album_id, item_id, 'remove' as change from m where album_id in (select album_id from t) and (album_id, item_id) not in (select album_id, item_id from t) union all select *, 'add' from t where (album_id, item_id) not in (select album_id, item_id from m)")
def mirror_albums(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    told = docs.select(((F.col("item_id") + F.floor(F.col("item_id") / 100)) % 6).alias("album_id"), "item_id").filter("album_id < 4")
    return lib.mirror_albums(docs.select((F.col("item_id") % 6).alias("album_id"), "item_id"), told)


@query("with t as (select user_id::varchar as hash, max_by(event_type, struct_pack(at := event_id, name := event_type)) as name from events group by user_id), c as (select c_custkey::varchar as hash, case when c_custkey % 2 = 0 then 'click' else 'x' end as name from customer) select hash, t.name, case when c.hash is null then 'insert' else 'rename' end as change from t left join c using (hash) where c.hash is null or c.name <> t.name")
def upsert_contacts(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("hash"), F.when(F.col("c_custkey") % 2 == 0, F.lit("click")).otherwise(F.lit("x")).alias("name"))
    told = table(spark, d, "events").select(F.col("user_id").cast("string").alias("hash"), F.col("event_type").alias("name"), F.col("event_id").alias("at"))
    return lib.upsert_contacts(known, told)


@query(f"with {_I} select 'items' as name, count(*) as n from i where id % 7 <> 0 union all select 'item_tags', count(*) from i where id % 7 <> 0 union all select 'detected_faces', count(*) from i where id % 7 <> 0 union all select 'face_rejections', count(*) from i where id % 7 <> 0 and id % 2 = 0")
def cascade_deletes(spark, d):
    """Faces' ids are their items' plus a million; rejections hang on faces."""
    items = _items(spark, d)
    tables = {
        "items": items, "item_tags": items.select(F.col("id").alias("item_id"), F.col("lang").alias("tag")), "detected_faces": items.select((F.col("id") + 1_000_000).alias("id"), F.col("id").alias("item_id")),
        "face_rejections": items.filter("id % 2 = 0").select((F.col("id") + 1_000_000).alias("face_id"), F.lit(1).alias("person_id")),
    }
    out = lib.cascade(tables, "items", items.filter("id % 7 = 0").select("id"))
    parts = [out[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"with {_I} select id, case when exif_version < 1 and id % 3 <> 0 then coalesce('read ' || id, caption) else caption end as caption, case when exif_version < 1 and id % 3 <> 0 then 1 else exif_version end as exif_version from i")
def backfill(spark, d):
    """Facts of every third file were read from an older state of it, and do not count."""
    items = _items(spark, d)
    facts = items.select("id", "size", F.when(F.col("id") % 3 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.concat(F.lit("read "), F.col("id").cast("string")).alias("caption"))
    return lib.backfill(items, facts, 1).select("id", "caption", "exif_version")


@query(f"with {_I} select id, case when id % 2 = 0 and id % 5 <> 1 then 9 else thumb_state end as thumb_state from i")
def thumb_states(spark, d):
    items = _items(spark, d)
    done = items.filter("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ms", F.lit(9).cast("long").alias("state"))
    return lib.set_thumb_state(items, done).select("id", "thumb_state")


@query("with h as (select *, md5(text) as h from documents), n as (select h as \"group\", count(distinct lang) + max((lang is null)::int) as a, count(distinct source) + max((source is null)::int) as b, count(distinct n_chars) + max((n_chars is null)::int) as c from h where h is not null group by h having count(*) > 1) select \"group\", array_to_string(list_filter([case when a > 1 then 'lang' end, case when b > 1 then 'source' end, case when c > 1 then 'n_chars' end], lambda x: x is not null), ',') as differing from n")
def differing_facts(spark, d):
    docs = table(spark, d, "documents").withColumn("h", F.md5("text"))
    shared = docs.groupBy("h").count().filter("count > 1").select("h")
    out = lib.differing_facts(docs.join(shared, "h", "left_semi"), "h", ["lang", "source", "n_chars"])
    return out.select("group", F.array_join("differing", ",").alias("differing"))


@query(f"with {_I} select count(*) filter (face_version is not distinct from 2) as done, count(*) as total from i where missing_since is null and kind = 0 and thumb_state = 1")
def face_progress(spark, d):
    return lib.progress(_items(spark, d), 2)


@query(f"with {_I} select id from i where missing_since is null and kind = 0 and thumb_state = 1 and face_version is distinct from 2")
def face_work(spark, d):
    return lib.face_work(_items(spark, d), 2)


@query("with k as (select o_orderdate as d, o_orderkey as o from orders order by 1, 2 limit 1 offset 700) select o_orderkey as id, o_orderdate as taken_at from orders, k where (o_orderdate, o_orderkey) > (d, o) order by o_orderdate, o_orderkey limit 200")
def keyset_page(spark, d):
    """The page behind the 701st row."""
    rows = orders(spark, d).select("id", "taken_at")
    last = lib.keyset_page(rows, ["taken_at", "id"], None, 701).agg(F.max_by(F.struct("taken_at", "id"), F.struct("taken_at", "id")).alias("k")).first().k
    return lib.keyset_page(rows, ["taken_at", "id"], (last.taken_at, last.id), 200)


@query("with b as (select vec_id, list_transform(embedding, lambda x: x > 0) as s from embeddings) select a.vec_id as a, b.vec_id as b, len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) as distance from b a join b on a.vec_id < b.vec_id where len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) <= 7")
def lookalike_pairs_near(spark, d):
    """At the default distance."""
    from .catalog_queries import _bits

    close = resolve.lookalike_pairs(_bits(spark, d).select("vec_id", "h"), "vec_id", "h", 7)
    return close.select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("with n as (select user_id as \"group\", case when user_id % 2 = 0 and event_id % 3 <> 0 then 'most' else event_type end as contact, count(*) as n from events group by 1, 2) select \"group\", max_by(contact, struct_pack(n := n, c := contact)) as contact from n group by \"group\" having max(n) * 2 > sum(n)")
def offered_names_some(spark, d):
    """Every second person has a contact that two thirds of the faces carry."""
    from .operators import people

    e = table(spark, d, "events")
    return people.offered_names(e.select(F.col("user_id").alias("group"), F.when((F.col("user_id") % 2 == 0) & (F.col("event_id") % 3 != 0), F.lit("most")).otherwise(F.col("event_type")).alias("contact")))


_S = "s as (select doc_id, (doc_id % 6 = 0)::int as kind, n_chars as size, 1577836800 + doc_id * 86400 as taken_at, case when doc_id % 3 = 0 then null else lang end as make, case when doc_id % 4 = 0 then null else source end as model from documents)"


def _facts(spark, d):
    p = F.col("doc_id")
    return table(spark, d, "documents").select((p % 6 == 0).cast("int").alias("kind"), F.col("n_chars").alias("size"), (F.lit(1577836800) + p * 86400).alias("taken_at"), F.when(p % 3 != 0, F.col("lang")).alias("make"), F.when(p % 4 != 0, F.col("source")).alias("model"), F.col("lang").alias("lens"))


@query(f"with {_S} select count(*) filter (kind = 0) as photos, count(*) filter (kind = 1) as videos, sum(size)::bigint as bytes, min(taken_at) as oldest, max(taken_at) as newest, count(*) filter (make is null and model is null) as no_camera from s")
def statistics_totals(spark, d):
    return views.statistics(_facts(spark, d))["totals"]


@query(f"with {_S} select concat_ws(' ', make, model) as name, count(*) as n from s where make is not null or model is not null group by 1 order by n desc, name limit 10")
def statistics_cameras(spark, d):
    return views.statistics(_facts(spark, d))["cameras"]


@query(f"with {_I} select folder_id as id, n, row_number() over (order by n desc, '/r/' || folder_id) - 1 as rank from (select folder_id, count(*) as n from i group by 1)")
def sidebar_by_count(spark, d):
    items = _items(spark, d).withColumn("taken_at", F.col("mtime_ms"))
    return lib.folder_names(_folders(spark, d).withColumn("name", F.col("path")), items, "count").select("id", "n", "rank")



# Passes and reads.
_NEAR = "b as (select vec_id, list_transform(embedding, lambda x: x > 0) as s from embeddings), c as (select a.vec_id as a, b.vec_id as b from b a join b on a.vec_id < b.vec_id where len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) <= 7), e as (select a, b from c union all select b, a from c), r as (select a as n, a as l from e union select e.b, r.l from r join e on r.n = e.a)"


@query(f"with recursive {_NEAR} select vec_id as id, g as similar_group from embeddings left join (select n, min(l) as g from r group by n) on n = vec_id")
def lookalike_pass(spark, d):
    """Stored groups of before are all wrong, so the pass replaces each of them."""
    from .catalog_queries import _bits

    none = F.lit(None).cast("long")
    rows = _bits(spark, d).select(F.col("vec_id").alias("id"), F.col("h").alias("percep_hash"), none.alias("missing_since"), F.lit(0).alias("kind"), F.col("vec_id").cast("string").alias("path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ms"), F.lit(0).alias("edit_turns"), none.alias("edit_crop"), (F.lit(-1) - F.col("vec_id")).alias("similar_group"))
    out, _, _ = passes.lookalike_pass(rows, 7)
    return out.select("id", "similar_group")


@query("""with f as (select c_custkey as id, c_mktsegment as name, case when c_custkey % 4 = 0 then 'old ' || c_custkey when c_custkey % 10 = 0 then (select c_mktsegment from customer t where t.c_custkey = c.c_custkey + 1) end as alias, c_custkey % 6 = 0 as hidden from customer c)
  select t.id, case when t.id % 2 = 1 and t.alias is null and not t.hidden and o.alias is distinct from t.name then o.alias else t.alias end as alias, t.hidden or (t.id % 2 = 1 and t.alias is null and coalesce(o.hidden, false)) as hidden from f t left join f o on o.id = t.id - 1""")
def folder_inheritance(spark, d):
    """Every odd folder holds what was in the even one before it."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    after = c.select((F.col("id") - 1).alias("id"), F.col("name").alias("next"))
    alias = F.when(F.col("id") % 4 == 0, F.concat(F.lit("old "), F.col("id").cast("string"))).when(F.col("id") % 10 == 0, F.col("next"))
    folders = c.join(after, "id", "left").select("id", "name", alias.alias("alias"), (F.col("id") % 6 == 0).alias("hidden"))
    moves = folders.filter("id % 2 = 0").select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.col("id").alias("at"))
    items = folders.select("id", F.col("id").alias("folder_id"), F.lit(False).alias("hidden"))
    return passes.inherit_folder_flags(folders, items, moves)[0].select("id", "alias", "hidden")


_U = "u as (select page_id, regexp_replace(url, '^[a-z]+://', '/') as path from pages), ro as (select min(page_id) as id, '/' || split_part(path, '/', 2) as path from u group by 2), di as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from u)"


@query(f"with {_U} select ro.id as watched_id, dir from di join ro on dir = ro.path or starts_with(dir, ro.path || '/') where ro.id % 2 = 0 and not (dir = '/example.com/a' or starts_with(dir, '/example.com/a/'))")
def plan_sidecars(spark, d):
    """Directories of pages, below every second host."""
    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))
    roots = u.groupBy(F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))).alias("path")).agg(F.min("page_id").alias("id")).filter("id % 2 = 0")
    return watch.plan_sidecars(u.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")), roots, ["/example.com/a"])


@query("with k as (select o_custkey as c from (select *, min(o_orderdate) over (partition by o_custkey) as oldest from orders) order by oldest desc, o_custkey, o_orderdate, o_orderkey limit 1 offset 500) select o_orderkey as id from orders, k where o_custkey = c")
def folder_at(spark, d):
    return ordering.folder_at(views.placed(orders(spark, d)), 500).select("id")


@query("with p as (select user_id as id, user_id % 5 = 0 as named, user_id % 7 = 0 as ignored from (select distinct user_id from events)), g as (select user_id from events join p on id = user_id where not named and not ignored and event_id % 3 <> 0 and event_id % 11 <> 0 group by user_id having count(*) >= 2) select (select count(*) from p where named) as named, (select count(*) from g) as to_name")
def people_counts(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("item_id"), F.col("user_id").alias("person_id"))
    who = e.select(F.col("person_id").alias("id")).distinct().select("id", F.when(F.col("id") % 5 == 0, F.lit("n")).alias("name"), (F.col("id") % 7 == 0).alias("ignored"))
    items = e.select("id", F.when(F.col("id") % 11 == 0, F.lit(1)).alias("missing_since"), (F.col("id") % 3 == 0).alias("hidden"))
    return passes.people_counts(who, e, items)


@query(f"with {_I} select folder_id, id, lower(file_name) as name, rating from i where missing_since is null and folder_id in (select folder_id from i where missing_since is null and lang = 'de')")
def mirror_reads(spark, d):
    """Live rows of folders that hold a live row in German."""
    items = _items(spark, d).withColumn("picasa_hidden", F.lit(None).cast("boolean"))
    held = passes.folders_with(items, items.filter("lang = 'de'").select(F.col("id").alias("item_id")))
    return passes.folder_rows(items, held).drop("picasa_hidden")


@query(f"with {_I} select id from i where missing_since is null and face_version is distinct from 2")
def resumed_pass(spark, d):
    return passes.to_process(_items(spark, d), "face_version", 2).select("id")


@query(f"with {_S} select year(to_timestamp(taken_at))::int as year, count(*) as n from s group by 1")
def statistics_years(spark, d):
    return views.statistics(_facts(spark, d))["years"]


@query("select root as path from (values ('/lib/src1'), ('/lib/src2'), ('/lib/src10'), ('/')) t(root) where root = '/' or exists (select 1 from documents where doc_id % 50 = 0 and ('/lib/' || source || '/' || doc_id = root or starts_with('/lib/' || source || '/' || doc_id, root || '/')))")
def degraded_roots(spark, d):
    """Errors lie on the path of every fiftieth document."""
    roots = spark.createDataFrame([("/lib/src1",), ("/lib/src2",), ("/lib/src10",), ("/",)], "root string")
    errors = table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit("lost").alias("message"))
    return watch.degraded_roots(errors, roots).select(F.col("root").alias("path"))
