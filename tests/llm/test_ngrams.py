import re

import numpy as np
import pytest

from shelfwise.llm import ngrams


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted(((d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed, copies=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ſ", "K"]
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    passage, out = text(70), []
    for _ in range(40):
        out.append(text(int(rng.integers(5, 160))))
    for base in out[:12]:  # copies at all distances around the threshold
        for edits in (0, 1, 1, 2, 3, 4, 5, 8):
            new = list(base)
            for _ in range(edits):
                new[int(rng.integers(len(new)))] = str(rng.choice(vocabulary))
            out.append(new)
    template = text(120)
    for _ in range(copies):  # one large group of near copies
        new = list(template)
        for _ in range(int(rng.integers(0, 7))):
            new[int(rng.integers(len(new)))] = f"x{rng.integers(1000)}"
        out.append(new)
    for _ in range(40):  # a passage that many share
        out.append(text(int(rng.integers(20, 120))) + passage)
    texts = [" ".join(w) for w in out] + [None, "", " \t\n", "one two three", "ONE two  three", "one two three four five", "one two three four", "a b c d e f", "A B C D E F", "\x1cone\x85two", " ".join(passage), " ".join(passage)]
    ids = [int(i) for i in rng.permutation(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    return [*rows, (None, texts[0]), (None, "lonely text without any id at all"), rows[3], rows[3]]


@pytest.mark.parametrize("seed,block,least", [(1, 1024, 32), (2, 10, 5), (3, 25, 8)])
def test_against_brute_force(spark, monkeypatch, seed, block, least):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "HOT_LEAST", least)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.join(df).collect()), key=str)
    assert got == brute(rows)


def test_tree_finds_all_links_of_random_sets():
    rng = np.random.default_rng(9)
    for _ in range(15):
        base = [rng.integers(0, 2**63, int(rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]
        sets = []
        for b in base:
            for _ in range(3):
                keep = b[rng.random(len(b)) < rng.choice([1.0, 0.95, 0.85, 0.7])]
                sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        classes = ngrams.Classes(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    classes.join(i, j)
        want, got = classes.labels(), ngrams.linked(sets)
        assert [[want[i] == want[j] for j in range(len(sets))] for i in range(len(sets))] == [[got[i] == got[j] for j in range(len(sets))] for i in range(len(sets))]


def test_stage_keeps_one_of_each(spark):
    rows = corpus(4, copies=10)
    df = spark.createDataFrame([(d, t, "en", "s", 3) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = ngrams.one_of_each(df)
    assert out.columns == df.columns
    kept = out.collect()
    comps = {c for _, n, c in brute(rows) if n}
    assert len([r for r in kept if set_of(r.text)]) == len(comps)
    assert {r.doc_id for r in kept if not set_of(r.text)} == {d for d, t in rows if not set_of(t)}


@pytest.mark.parametrize("block", [1024, 4])
def test_stage_keeps_unlinked_documents_without_ids(spark, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"t{k}w{x}" for x in rng.integers(0, 50, 90)) for k in range(6)]
    near = [f"{texts[1]} tail{k}" for k in range(12)]
    rows = [(None, t) for t in [*texts, *near, texts[2]]] + [(7, texts[3]), (8, "one text of a repeated id here"), (8, "and quite another one with it")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    kept = ngrams.one_of_each(df).collect()
    one = [next((k for k in range(6) if r.text.startswith(texts[k])), r.text) for r in kept]
    assert sorted(one, key=str) == sorted([*range(6), rows[-2][1], rows[-1][1]], key=str)


def test_empty(spark):
    assert ngrams.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ngrams.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).select("component_id").first()[0] == 1


@pytest.mark.parametrize("common", [13, 14])
@pytest.mark.parametrize("rows_kept", [50, 120, 5000])
def test_cut_runs_lose_no_link(spark, monkeypatch, rows_kept, common):
    """Shingles of very many sets, whose rows come in several parts. Sets of 100 shingles must share 14: the first and the
    last set share the common ones and two others; the rest only the common ones, which tie them where there are 14."""
    monkeypatch.setattr(ngrams, "RUN_ROWS", rows_kept)
    sets = 430
    rows = [(1000 + t, k, 100) for t in range(common) for k in range(1, sets + 1)] + [(10 + t, k, 100) for t in range(2) for k in (1, sets)] + [(3, 1, 100), (90, 2, 100), (91, sets, 100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        df = spark.createDataFrame(rows, "token long, sid long, n int")
        ties = [tuple(r) for r in ngrams._candidates(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {x: k for k, x in enumerate({*range(1, sets + 1), *[x for t in ties for x in t]})}
    reach = ngrams.Classes(len(at))
    for a, b in ties:
        reach.join(at[a], at[b])
    tied = {k for k in range(1, sets + 1) if reach.find(at[k]) == reach.find(at[1])}
    assert tied == ({1, sets} if common == 13 else set(range(1, sets + 1)))


@pytest.mark.parametrize("block,tokens,run", [(8, 500_000, 200_000), (1024, 600, 20)])
def test_long_texts_and_small_chunks(spark, monkeypatch, block, tokens, run):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngrams, "RUN_ROWS", run)
    monkeypatch.setattr(ngrams, "HOT_LEAST", 20)
    rng = np.random.default_rng(31)
    long = [f"l{x}" for x in rng.integers(0, 4000, 30_000)]
    near = [*long[:14_000], "changed", *long[14_001:]]
    rows = corpus(8, copies=90)
    rows = [*rows, (9001, " ".join(long)), (9002, " ".join(near)), (9003, " ".join(long[:20_000])), (9004, " ".join(long[:22_400]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.join(df).collect()), key=str) == brute(rows)
