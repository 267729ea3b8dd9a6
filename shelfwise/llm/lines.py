"""Line dedup by distinct-site spread (operator 6).

A HyperLogLog sketch of the sites of each line's hash is gathered by plain aggregation. A line whose estimate is clearly
above the threshold is boilerplate; one whose estimate is near it gets an exact count of its distinct sites. Each
boilerplate line stays at its first place in the corpus (smallest doc_id, then line number) and goes everywhere else.

Lines are cut at ``\\n`` and compared by their characters without white space at the ends; lines with fewer than
``min_words`` words never go. The sketch's error is about 3 % (2**10 registers), the exact band is 30 % on either side.

Defined cases: a null text has no lines and stays null; a null site is a site of its own; repeated rows lose and keep the
same lines, so a row repeated as it is keeps its first places in every repeat; an empty table gives an empty result; other
columns pass through :func:`dedup` (its own are prefixed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize
from .quality import words

SITES, MIN_WORDS, REGISTERS, BAND = 3, 5, 10, 0.3
ENDS = " \t\r\x0b\x0c"
P = "__l_"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc, site, no, line): the hash of every line of enough words, with its place."""
    each = docs.select(
        F.col("doc_id").alias("doc"), F.col("source").alias("site"), F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("no", "raw"),
    )
    each = each.withColumn("line", F.btrim("raw", F.lit(ENDS)))
    each = each.filter(F.size(words(F.col("line"))) >= min_words)
    return each.select(F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("key2"), "doc", "site", "text_hash", "no")


def boilerplate(places: DataFrame, sites: int) -> DataFrame:
    """(key, key2, first): the lines of at least ``sites`` distinct sites and their first place, written."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("n"))
    sketched = places.groupBy("key", "key2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, REGISTERS)).alias("about"), F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("n"))
    sketched = materialize(sketched.filter((F.col("n") > 1) & (F.col("about") >= int(sites * (1 - BAND)))), "line-sketches")
    sure = F.col("about") > sites * (1 + BAND)
    near = sketched.filter(~sure).select("key", "key2", "first")
    # Only lines near the threshold are gathered again, one row for each of their sites.
    hit = join_lookup(places, near.select(F.col("key").alias("n1"), F.col("key2").alias("n2")), [("key", "n1"), ("key2", "n2")]).filter(F.col("n1").isNotNull())
    again = hit.groupBy("key", "key2", site.alias("site")).agg(F.lit(1).alias("one"))
    exact = again.groupBy("key", "key2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= sites)
    return materialize(sketched.filter(sure).select("key", "key2", "first").unionByName(near.join(exact, ["key", "key2"], "left_semi")), "boilerplate")


def removals(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, gone): line numbers that go, for each distinct document that loses any."""
    places = _places(docs, min_words)
    bad = boilerplate(places, sites).select(F.col("key").alias("b1"), F.col("key2").alias("b2"), "first")
    hit = join_lookup(places, bad, [("key", "b1"), ("key2", "b2")]).filter(F.col("first").isNotNull())
    hit = hit.filter(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.no") == F.col("no"))))
    return hit.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id", site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``__l_n_lines`` and ``__l_n_removed``."""
    thin = docs.select(docs[doc_id].alias("doc_id"), docs[site].alias("source"), docs[text].alias("text"))
    gone = removals(thin, sites, min_words).select(F.col("doc").alias(f"{P}doc"), F.col("text_hash").alias(f"{P}hash"), F.col("gone").alias(f"{P}gone"))
    left = docs.withColumn(f"{P}own", F.xxhash64(docs[text]))
    out = left.join(gone, left[doc_id].eqNullSafe(gone[f"{P}doc"]) & (left[f"{P}own"] == gone[f"{P}hash"]), "left")
    lines, lost = _lines(F.col(text)), F.col(f"{P}gone")
    # One place for each line up to the last that goes, so that no line looks through them all.
    at = F.transform(lost, lambda x, k: F.struct(x.alias("to"), (x - F.coalesce(F.get(lost, k - 1), F.lit(-1)) - 1).alias("stay")))
    out = out.withColumn(f"{P}map", F.flatten(F.transform(at, lambda g: F.concat(F.array_repeat(F.lit(None).cast("int"), g["stay"]), F.array(g["to"])))))
    kept = F.when(lost.isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, k: F.get(F.col(f"{P}map"), k).isNull()), "\n"))
    counts = {f"{P}n_lines": F.coalesce(F.size(lines), F.lit(0)), f"{P}n_removed": F.coalesce(F.size(lost), F.lit(0)), f"{P}kept": kept}
    out = out.withColumns({k: F.when(F.col(text).isNull(), F.lit(0)).otherwise(c) if k.endswith(("lines", "removed")) else c for k, c in counts.items()})
    return out.select(*[F.col(f"{P}kept").alias(c) if c == text else docs[c] for c in docs.columns], f"{P}n_lines", F.greatest(f"{P}n_removed", F.lit(0)).alias(f"{P}n_removed"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: its lines, how many went, and the words and digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = dedup(docs)
    return out.select(
        "doc_id", F.col(f"{P}n_lines").cast("long").alias("n_lines"), F.col(f"{P}n_removed").cast("long").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without boilerplate lines, with their own columns only and n_chars to match."""
    out = dedup(docs).drop(f"{P}n_lines", f"{P}n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def lines_sql(table: str, sites: int = SITES, min_words: int = MIN_WORDS, columns: str = "doc_id, text, lang, source") -> str:
    """Common table expressions up to ``rebuilt`` (rid, n_lines, n_removed, kept)."""
    return f"""
    l_docs as (select row_number() over () as rid, {columns} from {table}),
    l_raw as (select rid, doc_id, source, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as no from l_docs where text is not null),
    l_all as (select *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from l_raw),
    l_long as (select * from l_all where len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {min_words}),
    l_bad as (select line, arg_min({{'d': doc_id, 'n': no}}, (coalesce(doc_id, -9223372036854775808), no)) as f from l_long group by line having count(distinct coalesce('s' || source, 'n')) >= {sites}),
    l_gone as (select rid, no from l_long join l_bad using (line) where not (f.d is not distinct from doc_id and f.n = no)),
    rebuilt as (select rid, count(*) as n_lines, count(g.no) as n_removed, string_agg(raw, chr(10) order by no) filter (g.no is null) as kept from l_all left join l_gone g using (rid, no) group by rid)"""


ORACLE = f"""with {lines_sql('documents')}
    select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, length(coalesce(kept, ''))::bigint as kept_chars, sha256(coalesce(kept, '')) as kept_sha256
    from l_docs left join rebuilt using (rid)"""
QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
