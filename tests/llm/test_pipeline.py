import hashlib

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from shelfwise.llm import lines, mixing, ngrams, pieces, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(path):
    """The first four stages in DuckDB, the last with the library."""
    c = duckdb.connect()
    c.execute(f"create table documents as select {', '.join(COLUMNS)} from read_parquet('{path}')")
    own = ", ".join(COLUMNS)
    c.execute(f"create table a as with {quality.counts_sql('documents', own)} select {own} from verdict where kept")
    c.execute(f"create table b as with {lines.lines_sql('a', columns=own)} select doc_id, case when text is null then null else coalesce(kept, '') end as text, lang, source, length(coalesce(kept, '')) as n_chars from l_docs left join rebuilt using (rid)")
    c.execute(f"""create table d as with recursive r as (select row_number() over () as rid, * from b), {ngrams.pairs_sql('b')}
        select {', '.join('r.' + x for x in COLUMNS)} from r join jac using (rid) where n_shingles = 0 or r.doc_id = component_id""")
    c.execute(f"create table e as with {mixing.mix_sql('d')}, r as (select row_number() over () as mid, * from d) select r.doc_id, r.text, unnest(range(0, epochs)) from r join mixed using (mid)")
    lib, out = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), []
    for d, t, _ in c.sql("select * from e").fetchall():
        ids = [*lib.encode(t or ""), 2]
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_brute_force(spark, sf):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, f"/root/testdata/{sf}").collect())
    want = brute(f"/root/testdata/{sf}/documents.parquet")
    assert len(want) > 50
    assert got == want


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (3, "word " * 60, "en", "s", 300)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == df.columns
            stage(spark, docs, "").count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
