"""Every contract query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from shelfwise import catalog_queries as c
from shelfwise import library_queries  # noqa: F401 - registers its queries
from shelfwise.operators import resolve

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{D}/{f}')")
    return con


def normal(rows, columns):
    order = sorted(columns)

    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return f"{float(x):.6f}" if isinstance(x, (int, float, np.integer, np.floating)) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(one(r[columns.index(k)]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(c.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = c.QUERIES[name](spark, D)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(c.ORACLES[name])
    want = normal(rel.fetchall(), rel.columns)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(c.QUERIES) - set(c.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert c.QUERIES[name](spark, D).count() > 0


def test_lookalike_pairs_with_copies_against_sql(spark, tmp_path):
    """Every fifth vector comes again as an exact copy and as a longer one, which has the same signs."""
    con = duckdb.connect()
    e = f"select vec_id, embedding, label from read_parquet('{D}/embeddings.parquet')"
    again = "select vec_id + {k}, list_transform(embedding, lambda x: (x * {k} / 1000)::float), label from e where vec_id % 5 = 0"
    con.execute(f"copy (with e as ({e}) from e union all {again.format(k=1000)} union all {again.format(k=2000)}) to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    df = c.QUERIES["lookalike_pairs"](spark, str(tmp_path))
    rel = con.sql(c.ORACLES["lookalike_pairs"])
    want = normal(rel.fetchall(), rel.columns)
    assert len(want) > 200
    assert normal([tuple(r) for r in df.collect()], df.columns) == want


def leaders(rows, threshold):
    """Leader clustering by a plain loop: (id, cluster, similarity)."""
    sums, lead, out = [], [], []
    for i, v in sorted(rows, key=lambda r: r[0]):
        v = np.asarray(v, float)
        score = [s @ v / (np.linalg.norm(s) * np.linalg.norm(v)) for s in sums]
        at = int(np.argmax(score)) if score else -1
        if at >= 0 and score[at] >= threshold:
            sums[at] = sums[at] + v
            out.append((i, lead[at], round(score[at], 9)))
        else:
            sums.append(v)
            lead.append(i)
            out.append((i, i, 1.0))
    return out


def test_leader_clusters_against_a_plain_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r.id, r.cluster, round(r.similarity, 9)) for r in c.QUERIES["leader_clusters"](spark, D).collect())
    want = leaders(rows, 0.45)
    assert got == want
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "label").collect()}
    assert any(label[i] != label[k] for i, k, _ in want)  # vectors of different labels meet


def test_leader_clusters_of_few_large_groups_against_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 6))
    rows = [(int(i), (centres[rng.integers(8)] + rng.normal(size=6) * 0.4).tolist()) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.id, r.cluster, round(r.similarity, 9)) for r in resolve.leader_clusters(df, 0.8).collect())
    assert got == leaders(rows, 0.8)


def test_slideshow_walk_reaches_every_place_once(spark):
    rows = c.QUERIES["slideshow_walk"](spark, D).orderBy("step").collect()
    n = spark.read.parquet(f"{D}/orders.parquet").count()
    assert [r.step for r in rows] == list(range(n)) and sorted(r.pos for r in rows) == list(range(n))
    assert len({(b.pos - a.pos) % n for a, b in zip(rows, rows[1:])}) == 1 and rows[1].pos > 1


def test_export_names_all_holds_case_clashes(spark):
    rows = c.QUERIES["export_names_all"](spark, D).collect()
    assert len(rows) == spark.read.parquet(f"{D}/part.parquet").count()
    assert len({r.out_name.lower() for r in rows}) == len(rows)
    assert {r.id: r.out_name for r in rows if r.id <= 3} == {0: "scan.jpg", 1: "Scan (2).JPG", 2: "scan (3).jpg", 3: "Scan (4).JPG"}


def test_people_page_all_holds_singles(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 7)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = c.QUERIES["people_page_all"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("singles", 6, 1, "3"), ("singles", 7, 1, "4"), ("unnamed", 5, 2, "1,2")]
    assert sorted(con.sql(c.ORACLES["people_page_all"]).fetchall()) == sorted(map(tuple, df.collect()))
