"""Secret scans with corpus-wide ownership frequency (operator 9, DataFrame functions only).

Candidates of several kinds are found in every whole text. Their values' hashes are counted over the whole corpus by
distinct repositories and owners: a value that many owners or very many repositories hold is a widely copied example, one
that few hold is an owner-specific credential and looks live. Spans of the base kinds always stay; spans of the other kinds count only
where the corpus says that they look live and where no base span overlaps them.

Here a document is a repository and its source the owner; :func:`scan` takes other columns.

Defined cases: a null text is an empty one; a null owner or doc_id is a value of its own; repeated rows each get their
row, and count once as repositories; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, let, materialize

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
#: Kinds that the method adds, in one pass; the first that matches at a place wins.
ADDED = {
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+",
    "vendor": r"(?:gh[pousr]|glpat|xox[abprs]|[sprk]k_(?:live|test))[_-][A-Za-z0-9_-]{16,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "url": r"://[^\x00-\x20/:@]{1,200}:[^\x00-\x20/@]{1,200}@",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
KINDS = [*BASE, *ADDED]
#: A value that this many owners hold is a widely copied example.
EXAMPLE_OWNERS = 3
#: So is one that this many repositories hold, whoever owns them.
EXAMPLE_REPOS = 50
SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def found(text: Column, pattern: str, kind, value) -> Column:
    """Leftmost non-overlapping matches as structs of start and end (code points), kind and value.

    The pieces between matches and the matches alternate, so places are running sums of their lengths.
    """

    def places(gaps: Column, hits: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), kind(x["hit"]).alias("kind"), value(x["hit"]).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        pairs = F.transform(hits, lambda h, k: F.struct(F.length(F.get(gaps, k)).cast("long").alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")), lambda a, x: F.struct(step(a, x)["at"].alias("at"), step(a, x)["out"].cast(SPAN).alias("out")))["out"]

    return let(F.split(text, pattern, -1), lambda g: F.when(F.size(g) <= 1, F.array().cast(SPAN)).otherwise(places(g, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))


def _no(kind: str) -> int:
    return KINDS.index(kind)


def spans(text: Column) -> dict[str, Column]:
    """Arrays of candidate spans: the base ones that hold, and the added ones."""
    t = F.coalesce(text, F.lit(""))
    own = lambda h: h
    assign = F.filter(found(t, ASSIGN, lambda h: F.lit(_no("assign")), lambda h: F.regexp_extract(h, ASSIGN, 2)), lambda s: F.length(s["value"]) >= 6)
    access = found(t, ACCESS, lambda h: F.lit(_no("access")), own)
    hexes = found(t, HEX, lambda h: F.lit(_no("hex")), own)

    def added_kind(h: Column) -> Column:
        c = F.when(F.startswith(h, F.lit("://")), F.lit(_no("url"))).when(F.startswith(h, F.lit("-----BEGIN ")), F.lit(_no("pem")))
        return c.when(F.regexp_like(h, F.lit(f"^(?:{ADDED['jwt']})$")), F.lit(_no("jwt"))).when(F.regexp_like(h, F.lit(f"^(?:{ADDED['vendor']})$")), F.lit(_no("vendor"))).otherwise(F.lit(_no("opaque")))

    mixed = lambda s: (s["kind"] != _no("opaque")) | (F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[a-z]")) & F.regexp_like(s["value"], F.lit("[A-Z]")))
    added = F.filter(found(t, "|".join(ADDED.values()), added_kind, own), mixed)
    return {"base": F.concat(assign, access, hexes), "added": added}


def _shown(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos) of (hash, owner, repo): repeated rows collapse before each shuffle."""
    once = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(doc_id, base, spans) of every row.

    ``base`` holds the base spans in order, ``spans`` all of them with ``owners``, ``repos`` and ``live``.
    """
    s = spans(docs[text])
    row = docs.select(F.monotonically_increasing_id().alias("rid"), docs[doc_id].alias("doc_id"), docs[owner].alias("owner"), docs[repo or doc_id].alias("repo"), *[c.alias(k) for k, c in s.items()])
    table = materialize(row, "secrets-spans")  # row numbers are fixed from here on
    each = table.filter((F.size("base") > 0) | (F.size("added") > 0)).select("rid", "owner", "repo", F.explode(F.concat("base", "added")).alias("s"))
    each = each.select("rid", "owner", "repo", F.sha2("s.value", 256).alias("hash"), F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    # Only values that are found in two repositories or more; a copied example is the hottest of all and is never shuffled by its hash.
    counted = materialize(ownership(each.select("hash", "owner", "repo")).filter("repos > 1").withColumnRenamed("hash", "known"), "secrets-shared")
    judged = join_lookup(each.select("rid", "hash", "start", "kind", "end"), counted, [("hash", "known")])
    judged = judged.withColumns({"owners": F.coalesce("owners", F.lit(1).cast("long")), "repos": F.coalesce("repos", F.lit(1).cast("long"))})
    live = (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    per_row = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", live.alias("live")))).alias("all"))
    out = table.select("rid", "doc_id").join(per_row, "rid", "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint,live:boolean>>"))
    base = F.filter(every, lambda x: x["kind"] < len(BASE))
    added = lambda b: F.filter(every, lambda x: (x["kind"] >= len(BASE)) & x["live"] & ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return out.select("doc_id", base.alias("base"), let(base, lambda b: F.sort_array(F.concat(b, added(b)))).alias("spans"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with its base counts, their digest, all spans, and how many look live or copied."""
    found_ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == _no(k))).cast("long").alias(f"n_{k}")
    return found_.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def _either_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


def _sql() -> str:
    # DuckDB's own (?i) would also fold letters outside ASCII.
    assign = "(" + _either_case(["password", "passwd", "secret", "token", "api_?key"]) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    added = "|".join(ADDED.values())
    kinds = " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))

    def hits(name: str, pattern: str, kind: str, value: str, keep: str) -> str:
        total = lambda x, k: f"coalesce(list_sum(list_transform({x}[1:{k}], lambda z: length(z))), 0)"
        return f"""{name} as (select * from (select rid, doc_id, source, {kind} as kind, start::bigint as start, (start + length(hit))::bigint as stop, {value} as v from (
            select rid, doc_id, source, h[k] as hit, {total('g', 'k')} + {total('h', 'k - 1')} as start from (
              select *, unnest(range(1, len(h) + 1)) as k from (select rid, doc_id, source, string_split_regex(t, '{pattern}') as g, regexp_extract_all(t, '{pattern}') as h from d)))) where {keep})"""

    vendor, jwt = ADDED["vendor"], ADDED["jwt"]
    added_kind = f"case when starts_with(hit, '://') then 6 when starts_with(hit, '-----BEGIN ') then 5 when regexp_full_match(hit, '{jwt}') then 3 when regexp_full_match(hit, '{vendor}') then 4 else 7 end"
    shown = lambda a: f"coalesce(string_agg(case {a}.kind {kinds} end || ':' || {a}.start || ':' || {a}.stop, ',' order by {a}.start, {a}.kind, {a}.stop), '')"
    return f"""with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
    {hits('a', assign, '0', f"regexp_extract(hit, '{assign}', 2)", 'length(v) >= 6')},
    {hits('b', ACCESS, '1', 'hit', 'true')}, {hits('c', HEX, '2', 'hit', 'true')},
    {hits('e', added, added_kind, 'hit', "kind <> 7 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]'))")},
    base as (select * from a union all select * from b union all select * from c),
    every as (select * from base union all select * from e),
    freq as (select v, count(distinct coalesce(source, '-none-')) as owners, count(distinct coalesce(doc_id::varchar, '-') || ' ' || coalesce(source, '-none-')) as repos from every group by v),
    judged as (select every.*, owners < {EXAMPLE_OWNERS} and repos < {EXAMPLE_REPOS} as live from every join freq using (v)),
    kept as (select j.* from judged j where kind < 3 or (live and not exists (select 1 from base b where b.rid = j.rid and b.start < j.stop and j.start < b.stop))),
    x as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, {shown('base')} as s from base group by rid),
    y as (select rid, {shown('kept')} as spans, count(*) filter (live) as n_live, count(*) filter (not live) as n_example from kept group by rid)
    select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(s, '')) as base_sha256,
      coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example from d left join x using (rid) left join y using (rid)"""


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES = {"op9_secret_scan": _sql()}
