"""Quality rules with adaptive thresholds (operator 8, DataFrame functions only).

Each document gets integer measures; per (lang, source) a quantile sketch of each measure is gathered, and a document
is kept when its measures lie within fences drawn from its own group's quantiles.

The sketch is a log-linear histogram: a value below 1024 is its own bucket, above that a bucket spans 1/512 of its
value. Adding two sketches is adding counts, so they merge in any order with the same result, and a quantile is exact
below 1024 and within 0.2 % above. Sketches of sources merge into one per language and one of all documents, which
serve groups with fewer than ``min_docs`` documents.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; null ``lang`` or ``source`` is a
group of its own; repeated rows each count and each get a verdict; an empty table gives an empty result; extra columns
pass through :func:`judge` untouched (its own columns are prefixed, see ``PREFIX``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, join_lookup, let, materialize

PREFIX = "__q_"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: measure: (smallest distance of the upper fence from the upper quartile, of the lower fence from the lower one).
#: Symbols, repeated words and repeated lines in thousandths; mean word length in hundredths of a character.
SPREAD = {"sym": (60, None), "rep": (200, None), "dup": (250, None), "len": (250, 200)}
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    n = F.size(w)

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def measured(docs: DataFrame, text: str = "text", prefix: str = PREFIX) -> DataFrame:
    """``docs`` with the base counts and the base verdict, in columns that begin with ``prefix``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    word_stats = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    line_stats = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counts = F.struct(
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # A generator of one row: no filter or projection above can repeat what it computes.
    m = F.col(f"{prefix}m")
    df = docs.select("*", F.explode(F.array(F.struct(word_stats.alias("w"), line_stats.alias("l"), counts.alias("c")))).alias(f"{prefix}m"))
    df = df.withColumns({
        f"{prefix}n_words": m["w"]["n_words"], f"{prefix}n_repeat_words": m["w"]["n_repeat_words"], f"{prefix}n_lines": m["l"]["n_lines"],
        f"{prefix}n_dup_lines": m["l"]["n_dup_lines"], f"{prefix}word_chars": m["c"]["word_chars"], f"{prefix}n_symbols": m["c"]["n_symbols"],
    }).drop(f"{prefix}m")
    return df.withColumn(f"{prefix}base_failed", (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words")))


def _measures(prefix: str) -> dict[str, Column]:
    whole = lambda a, b: F.expr(f"`{prefix}{a[0]}` * {a[1]} div greatest(`{prefix}{b}`, 1)")
    return {"sym": whole(("n_symbols", 1000), "word_chars"), "rep": whole(("n_repeat_words", 1000), "n_words"), "dup": whole(("n_dup_lines", 1000), "n_lines"), "len": whole(("word_chars", 100), "n_words")}


def bucket(v: Column) -> Column:
    """The lower end of the log-linear bucket of a whole number >= 0."""
    cut = F.greatest(F.length(F.conv(v.cast("string"), 10, 2)) - 10, F.lit(0))
    return F.when(v < 1024, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut))


def sketches(df: DataFrame, groups: list[str], prefix: str = PREFIX) -> DataFrame:
    """(g0, g1, measure, bucket, n): the histograms of the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _measures(prefix).items()]))
    own = df.filter(~F.col(f"{prefix}base_failed")).select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], pairs.alias("m"))
    return own.groupBy(*[f"g{i}" for i in range(len(groups))], F.col("m.measure").alias("measure"), F.col("m.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches to the columns ``by`` and draw the fences: one row per group with docs and lo/hi per measure.

    A quantile is the smallest bucket at which four times the running count reaches 1 or 3 times the total. The
    running count is over the buckets of one measure of one group, a few thousand rows at most whatever the input.
    """
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    run = merged.withColumns({"run": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    q = run.groupBy(*by, "measure").agg(
        F.min(F.when(4 * F.col("run") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("run") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        F.max("total").alias("total"),
    )
    aggs = [F.max("total").alias("docs")]
    for k, (up, down) in SPREAD.items():
        one = lambda c, k=k: F.max(F.when(F.col("measure") == k, c))
        aggs.append(one(F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(up))).alias(f"{k}_hi"))
        if down is not None:
            aggs.append(one(F.col("q1") - F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(down))).alias(f"{k}_lo"))
    return q.groupBy(*by).agg(*aggs)


LIMITS = [f"{k}_hi" for k in SPREAD] + [f"{k}_lo" for k, v in SPREAD.items() if v[1] is not None]


def thresholds(sketch: DataFrame, min_docs: int = 30) -> DataFrame:
    """Fences per (g0, g1): from the group's own sketch, else the one of its g0, else the one of all documents."""
    sketch = materialize(sketch, "quality-sketch")
    own, mid = fences(sketch, ["g0", "g1"]), fences(sketch, ["g0"])
    top = fences(sketch.withColumn("all", F.lit(1)), ["all"])
    j = own.alias("o").join(mid.alias("m"), F.col("o.g0").eqNullSafe(F.col("m.g0")), "left").join(F.broadcast(top.alias("t")), F.lit(True), "left")
    picked = [F.when(F.col("o.docs") >= min_docs, F.col(f"o.{c}")).when(F.col("m.docs") >= min_docs, F.col(f"m.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in LIMITS]
    return materialize(j.select(F.col("o.g0").alias("g0"), F.col("o.g1").alias("g1"), *picked), "quality-fences")


def judge(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"), min_docs: int = 30, prefix: str = PREFIX) -> DataFrame:
    """``docs`` plus ``prefix``-ed counts, ``base_failed`` and ``kept``.

    Texts are counted twice, once for the sketches and once beside their verdict, instead of being written or shuffled.
    """
    table = measured(docs, text, prefix)
    return verdicts(table, groups, min_docs, prefix)


def verdicts(table: DataFrame, groups: tuple[str, str] = ("lang", "source"), min_docs: int = 30, prefix: str = PREFIX) -> DataFrame:
    limits = thresholds(sketches(table, list(groups), prefix), min_docs)
    limits = limits.select(*[F.col(c).alias(f"{prefix}{c}") for c in limits.columns])
    joined = join_lookup(table, limits, [(groups[0], f"{prefix}g0"), (groups[1], f"{prefix}g1")])
    good = F.lit(True)
    for k, v in _measures(prefix).items():
        good = good & F.coalesce(v <= F.col(f"{prefix}{k}_hi"), F.lit(True))
        if SPREAD[k][1] is not None:
            good = good & F.coalesce(v >= F.col(f"{prefix}{k}_lo"), F.lit(True))
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & good).drop(*limits.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its base counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    table = materialize(measured(docs).drop("text"), "quality-counts")
    out = verdicts(table)
    return out.select("doc_id", *[F.col(PREFIX + c).alias(c) for c in [*BASE, "base_failed", "kept"]])


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that pass, with their own columns only. They are written once beside their counts."""
    table = materialize(measured(docs).filter(~F.col(f"{PREFIX}base_failed")), "quality-counted")
    return verdicts(table).filter(f"`{PREFIX}kept`").select(*docs.columns)


_SQL_FENCE = {
    k: f"max(case when measure = '{k}' then q3 + greatest(3 * (q3 - q1), {up}) end) as {k}_hi" + (f", max(case when measure = '{k}' then q1 - greatest(3 * (q3 - q1), {down}) end) as {k}_lo" if down is not None else "")
    for k, (up, down) in SPREAD.items()
}


def _sql_fences(name: str, by: str) -> str:
    cols = f"{by}, " if by else ""
    part = f"partition by {cols}measure"
    return f"""{name} as (select {cols}max(total) as docs, {', '.join(_SQL_FENCE.values())} from (
      select {cols}measure, min(case when 4 * run >= total then bucket end) as q1, min(case when 4 * run >= 3 * total then bucket end) as q3, max(total) as total from (
        select *, sum(n) over ({part} order by bucket) as run, sum(n) over ({part}) as total from (
          select {cols}measure, bucket, sum(n) as n from sketch group by {cols}measure, bucket)) group by {cols}measure) {'group by ' + by if by else ''})"""


def counts_sql(table: str, columns: str = "doc_id, text, lang, source") -> str:
    """Common table expressions up to ``verdict`` (the columns named, the counts and kept)."""
    ws = r"[\x20\x09-\x0D]"
    own = f"""
    numbered as (select row_number() over () as rid, {columns} from {table}),
    w as (select rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from numbered),
    win as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
    gram as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as c from win),
    hit as (select distinct rid, i + d as p from gram, (select unnest([0, 1, 2]) as d) where c > 1),
    rep as (select rid, count(*) as n_repeat_words from hit group by rid),
    counted as (select n.*, len(ws)::bigint as n_words, length(regexp_replace(coalesce(text, ''), '{ws}', '', 'g'))::bigint as word_chars,
      length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from numbered n join w using (rid) left join rep using (rid)),
    based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols * 1000 // greatest(word_chars, 1) as sym,
      n_repeat_words * 1000 // greatest(n_words, 1) as rep, n_dup_lines * 1000 // greatest(n_lines, 1) as dup, word_chars * 100 // greatest(n_words, 1) as len from counted),
    long as (unpivot (select lang as g0, source as g1, sym, rep, dup, len from based where not base_failed) on sym, rep, dup, len into name measure value v),
    sketch as (select g0, g1, measure, case when v < 1024 then v else (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) end as bucket, count(*) as n from long group by all)"""
    pick = ", ".join(f"case when o.docs >= 30 then o.{c} when m.docs >= 30 then m.{c} else t.{c} end as {c}" for c in LIMITS)
    good = " and ".join([f"coalesce({k} <= {k}_hi, true)" for k in SPREAD] + [f"coalesce({k} >= {k}_lo, true)" for k, v in SPREAD.items() if v[1] is not None])
    return f"""{own}, {_sql_fences('own', 'g0, g1')}, {_sql_fences('mid', 'g0')}, {_sql_fences('top', '')},
    lim as (select o.g0, o.g1, {pick} from own o left join mid m on o.g0 is not distinct from m.g0 cross join top t),
    verdict as (select b.*, not base_failed and {good} as kept from based b left join lim on lang is not distinct from g0 and source is not distinct from g1)"""


ORACLE = f"with {counts_sql('documents')} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from verdict"
QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": ORACLE}
