"""Mixing sources to target weights by a time-varying curriculum (operator 2).

Training time runs from 0 to 1. Each source has a schedule of weights over time, linear between knots; its integral is
the source's share. Cumulative token demand, target times the integral up to t, is inverted at each document's place in
its source's token order: the moment at which the source has asked for that many tokens is the document's position.
Documents are range-sorted by it. A source that must give more than it has passes again over its documents; the copy of a
later pass has the position at which the source has asked for all passes before it as well.

Targets: the sizes' total is shared by weight, a source stops at ``max_epochs`` times its size, and the excess is shared
again by weight until none is above. Order within a source is by the MD5 of doc_id, so reruns agree.

Running sums over a source are built from three levels of MD5 prefixes (256 coarse parts, 65,536 fine parts, documents
of a fine part), so no task ever holds a whole source. Only the per-source table, one row each, is ordered in one task.

Defined cases: a null or empty text has size 0 and is never taken; a null source is the last one; repeated rows each have
their own place; when all sizes are 0 so are targets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, materialize
from .quality import words

MAX_EPOCHS = 3
#: Relative weight over time for sources of weight 1, 2 and 3: knots (time, factor). Factors integrate to 1.
SCHEDULES = {1: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (1.0, 1.5)]}


def integral(knots: list[tuple[float, float]]) -> list[float]:
    """Area below the schedule up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def inverse(knots: list[tuple[float, float]], y: Column) -> Column:
    """The time at which the schedule's area, as a part of the whole, reaches ``y``."""
    area, out = integral(knots), None
    for k in range(len(knots) - 1, 0, -1):
        (t0, w0), (t1, w1) = knots[k - 1], knots[k]
        need = y * F.lit(area[-1]) - F.lit(area[k - 1])
        slope = (w1 - w0) / (t1 - t0)
        inside = F.lit(t0) + (need / F.lit(w0) if slope == 0 else (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * need) - F.lit(w0)) / F.lit(slope))
        out = inside if out is None else F.when(y * F.lit(area[-1]) <= F.lit(area[k]), inside).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size); one row per source, written."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    cap = (max_epochs * F.col("source_size")).cast("double")
    filled = weighed.withColumns({"cap": cap, "level": cap / F.col("weight")})
    by = Window.orderBy("level", F.col("source").asc_nulls_last())
    total = F.sum(F.col("source_size").cast("double")).over(Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    stepped = filled.withColumns({"rate": (total - before) / rest, "n": F.row_number().over(by)})
    # Sources below the first whose cap is not reached are full; that one's rate holds for all others.
    rate = F.min_by(F.when(F.col("rate") <= F.col("level"), F.col("rate")), F.when(F.col("rate") <= F.col("level"), F.col("n"))).over(Window.partitionBy())
    return materialize(stepped.withColumn("rate", rate).select("source", "source_size", "weight", F.least("cap", F.col("rate") * F.col("weight")).alias("target")), "mix-targets")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash, fine, md) plus ``before``: the source's words ahead of the document in its order."""
    md = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", F.size(words(F.coalesce("text", F.lit("")))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), md.alias("md"))
    rows = materialize(rows.withColumn("fine", F.substring("md", 1, 4)), "mix-sizes")
    fine = rows.groupBy("source", "fine").agg(F.sum("size").alias("s")).withColumn("coarse", F.substring("fine", 1, 2))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("s").alias("s"))
    ahead = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = coarse.select(F.col("source").alias("cs"), F.col("coarse").alias("cc"), ahead(Window.partitionBy("source").orderBy("coarse")).alias("c0"))
    f = fine.withColumn("f0", ahead(Window.partitionBy("source", "coarse").orderBy("fine")))
    f = f.join(c, f["source"].eqNullSafe(c["cs"]) & (f["coarse"] == c["cc"])).select(F.col("source").alias("fs"), F.col("fine").alias("ff"), (F.col("f0") + F.col("c0")).alias("start"))
    w = Window.partitionBy("source", "fine").orderBy("md", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(w), F.lit(0)))
    out = inner.join(f, inner["source"].eqNullSafe(f["fs"]) & (inner["fine"] == f["ff"]))
    return out.withColumn("before", F.col("start") + F.col("inner")).drop("fs", "ff", "start", "inner")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, schedules: dict | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, size, source_size, target, epochs (times it is taken), taken, positions.

    ``positions`` has one for each copy, in billionths of the run, empty where the document is not taken.
    """
    schedules = schedules or SCHEDULES
    rows = placed(docs)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = targets(sizes, max_epochs).select(F.col("source").alias("ts"), "source_size", "weight", "target")
    j = join_lookup(rows, per_source, [("source", "ts")])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("full", full)
    rest = F.col("target") - (F.col("full") * F.col("source_size")).cast("double")
    more = (2 * F.col("before") + F.col("size")).cast("double") <= 2 * rest
    j = j.withColumn("epochs", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("full") + more.cast("long"), F.lit(max_epochs))).cast("long"))

    def at(copy: Column) -> Column:
        share = F.least((copy * F.col("source_size") + F.col("before")).cast("double") / F.col("target"), F.lit(1.0))
        time = None
        for weight, knots in schedules.items():
            time = F.when(F.col("weight") == weight, inverse(knots, share)) if time is None else time.when(F.col("weight") == weight, inverse(knots, share))
        return F.floor(time * F.lit(1e9))

    positions = F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1), at)).otherwise(F.array().cast("array<bigint>"))
    return j.select("doc_id", "text_hash", "size", "source_size", "target", "weight", "before", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), positions.alias("positions"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it and its copies' positions, range-sorted by that of the first."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, in training order, with its own columns only."""
    m = mix(docs.select("doc_id", "source", "text"))
    # Rows that are equal in id and text differ in their places only; they are numbered to be told apart.
    same = Window.partitionBy("doc_id", "text_hash").orderBy("before")
    m = m.withColumn("__m_k", F.row_number().over(same)).filter("epochs > 0")
    m = m.select(F.col("doc_id").alias("__m_id"), F.col("text_hash").alias("__m_hash"), "__m_k", F.col("positions").alias("__m_positions"))
    own = docs.withColumn("__m_own", F.xxhash64("text"))
    own = own.withColumn("__m_n", F.row_number().over(Window.partitionBy("doc_id", "__m_own").orderBy(F.xxhash64(*docs.columns))))
    j = own.join(m, own["doc_id"].eqNullSafe(m["__m_id"]) & (own["__m_own"] == m["__m_hash"]) & (own["__m_n"] == m["__m_k"]))
    j = j.withColumn("__m_at", F.explode("__m_positions"))
    return j.repartitionByRange("__m_at", "doc_id").sortWithinPartitions("__m_at", "doc_id").select(*docs.columns)


def mix_sql(table: str, max_epochs: int = MAX_EPOCHS) -> str:
    """Common table expressions up to ``mixed``."""
    arms = []
    for weight, knots in SCHEDULES.items():
        (t0, w0), (t1, w1) = knots
        need, slope = f"(y * {integral(knots)[-1]!r}::double - 0.0::double)", (w1 - w0) / (t1 - t0)
        arms.append(f"when weight = {weight} then {t0!r}::double + " + (f"{need} / {w0!r}::double" if slope == 0 else f"(sqrt({w0 * w0!r}::double + {2 * slope!r}::double * {need}) - {w0!r}::double) / ({slope!r}::double)"))
    return f"""
    m_rows as (select row_number() over () as mid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as md from {table}),
    m_src as (select source, sum(size)::bigint as source_size from m_rows group by source),
    m_w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, ({max_epochs} * source_size)::double as cap from m_src),
    m_step as (select *, cap / weight as level, (sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rate from m_w),
    m_t as (select source, source_size, weight, least(cap, (select rate from m_step where rate <= level order by level, source nulls last limit 1) * weight) as target from m_step),
    m_at as (select r.*, source_size, weight, target, coalesce(sum(size) over (partition by r.source order by md, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as before,
      case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from m_rows r join m_t t on r.source is not distinct from t.source),
    m_e as (select *, case when size = 0 then 0 else least(whole + (case when (2 * before + size)::double <= 2 * (target - (whole * source_size)::double) then 1 else 0 end), {max_epochs}) end as epochs
      from m_at),
    m_copy as (select mid, weight, least((e * source_size + before)::double / target, 1.0::double) as y from (select *, unnest(range(0, epochs)) as e from m_e)),
    m_pos as (select mid, list_sort(list(floor(least(greatest(case {' '.join(arms)} end, 0.0::double), 1.0::double) * 1e9)::bigint)) as p from m_copy group by mid),
    mixed as (select m_e.*, (size * epochs)::bigint as taken, p[1] as position, coalesce(array_to_string(p, ','), '') as positions from m_e left join m_pos using (mid))"""


ORACLE = f"with {mix_sql('documents')} select doc_id, size, source_size, target, taken, position, positions from mixed"
QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": ORACLE}
