import numpy as np

from shelfwise.llm import vectors
from shelfwise.llm.graph import components


def brute(ids, rows, threshold):
    """Links and components by comparing all pairs."""
    n = len(rows)
    x = np.zeros((n, max((len(r) for r in rows if r), default=1)))
    good = np.zeros(n, bool)
    for k, r in enumerate(rows):
        if r and None not in r and np.isfinite(r).all() and np.any(r):
            x[k, : len(r)] = np.asarray(r, float) / np.linalg.norm(r)
            good[k] = True
    hit = (x @ x.T >= threshold) & good[:, None] & good[None]
    np.fill_diagonal(hit, False)
    label = list(range(n))
    changed = True
    while changed:
        new = [min([label[k], *[label[j] for j in np.flatnonzero(hit[k])]]) for k in range(n)]
        changed, label = new != label, new
    low = {}
    for k in range(n):
        if ids[k] is not None:
            low[label[k]] = min(low.get(label[k], ids[k]), ids[k])
    return hit.sum(1), [low.get(label[k]) if good[k] else ids[k] for k in range(n)]


def data(seed=5, n=600, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    rows = [(centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.4])).tolist() for _ in range(n)]
    rows += [rows[0]] * 7 + [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] + [1.0] * (dim - 1), (np.array(rows[3]) * 1e-30).tolist()]
    ids = [int(i) for i in rng.permutation(len(rows))]
    ids[4] = None
    ids[-9] = ids[0]
    return ids, rows


def test_against_brute_force(spark):
    ids, rows = data()
    want_links, want_comp = brute(ids, rows, 0.95)
    df = spark.createDataFrame([(i, r, 7) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, n_links int").repartition(3)
    for recall in (1.0, vectors.RECALL):
        got = sorted(((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_dedup(df, recall=recall).collect()), key=str)
        want = sorted(((i is None, i, int(k), c, i == c) for i, k, c in zip(ids, want_links, want_comp, strict=True)), key=str)
        assert got == want, recall


def test_vectors_of_several_lengths(spark):
    """Near copies link within each length, the rare ones too; a prefix of another vector does not."""
    rng = np.random.default_rng(3)
    rows = [(c + rng.standard_normal(d) * 0.05).tolist() for d, n in ((16, 60), (5, 9), (1, 3), (40, 2)) for c in rng.standard_normal((n, d)) for _ in range(3)]
    rows += [[*rows[0][:5]], [*rows[0], 0.0]]
    ids, want_links, want_comp = list(range(len(rows))), np.zeros(len(rows), int), list(range(len(rows)))
    for d in {len(r) for r in rows}:
        mine = [k for k in ids if len(rows[k]) == d]
        links, comp = brute(mine, [rows[k] for k in mine], 0.95)
        for k, n, c in zip(mine, links, comp, strict=True):
            want_links[k], want_comp[k] = n, c
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_dedup(df, recall=1.0).collect()}
    assert got == {k: (int(want_links[k]), want_comp[k]) for k in ids}


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = [(np.ones(8) + rng.standard_normal(8) * 0.1).tolist() for _ in range(150)] + rng.standard_normal((60, 8)).tolist()
    ids = list(range(len(rows)))
    want_links, want_comp = brute(ids, rows, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_dedup(spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>"), recall=1.0).collect()}
    assert got == {i: (int(k), c) for i, k, c in zip(ids, want_links, want_comp, strict=True)}


def test_empty_and_tiny(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_dedup(empty).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.near_dedup(one).collect()] == [(5, 0, 5, True)]


def test_query_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    want, comp = brute([r.vec_id for r in rows], [list(r.embedding) for r in rows], 0.95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.op7_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.vec_id: (int(k), c) for r, k, c in zip(rows, want, comp, strict=True)}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1080)] + [(None, 3), (7, 7)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    while True:
        new = dict(label)
        for a, b in edges:
            if a is not None and a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
