import glob
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import common, tokens

PATH = tokens.default_tokenizer()
LIB = Tokenizer.from_file(PATH)
HARD = [
    None, "", "  \n\t ", "a", "It's  we'll they've 's", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "É é́ ñ ǅ İstanbul ΣΑΣ", "　wide space nbsp", "\x85next\x1cfs", "漢字 😀", "x" * 2000,
    "word\r\nnext\x0b\x0cpage", "a ̀ b", "12 3½ 45", "!!! ... #hash", "the the the " * 200,
]


def want(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


def check(texts):
    ids, at = tokens.WordCoder.of(PATH).encode_batch(pa.array(texts, pa.string()))
    for t, i, j in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[i:j].tolist() == want(t), repr(t)


def test_matches_the_library():
    check(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" abehtS'sl\n.,éß1̀́"), st.characters(blacklist_categories=["Cs"])), max_size=50), max_size=6))
def test_matches_the_library_on_any_text(texts):
    check(texts)


def test_the_cache_starts_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    coder = tokens.WordCoder(PATH)
    for texts in (["a b c d e"], ["f g a"], ["h i j k a b"], ["a z"]):
        ids, at = coder.encode_batch(pa.array(texts))
        assert ids.tolist() == want(texts[0])


def test_query_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = tokens.op5_token_output(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    for i, t in rows:
        crc = zlib.crc32(np.array(want(t), "<u4").tobytes())
        assert any(r.doc_id == i and r.ids_crc32 == crc and r.n_tokens == len(want(t)) for r in got)


def test_one_document_is_read_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"document number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    manifest = tokens.write(df, f"file://{tmp_path}/shards")
    assert not glob.glob(f"{tmp_path}/shards/*.part")
    paths = [r.path for r in manifest.collect()]
    found = [x for p in paths if (x := tokens.Shard(p).find(123)) is not None]
    assert len(found) == 1 and found[0].tolist() == want(f"document number 123 " * (123 % 7))
    assert all(tokens.Shard(p).find(12345) is None for p in paths)
    assert {r.doc_id: r.ids for r in tokens.read(manifest).collect()}[8] == want("document number 8 ")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.checks(tokens.write(df, common.new_path(spark, "tokens"))).count() == 0


def test_runs_read_what_single_reads_do(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(HARD * 3)], "doc_id long, text string").coalesce(1)
    paths = [r.path for r in tokens.write(df, f"file://{tmp_path}/shards").collect()]
    for path in paths:
        shard = tokens.Shard(path)
        alone = [shard.ids(k).tolist() for k in range(len(shard))]
        for most in (1, 50, 1 << 20):
            runs = list(shard.runs(most))
            assert [x.tolist() for _, ids in runs for x in ids] == alone
            assert [lo for lo, _ in runs] == np.r_[0, np.cumsum([len(ids) for _, ids in runs])[:-1]].tolist()
            assert most > 1 or all(len(ids) == 1 for _, ids in runs)
    assert sum(len(tokens.Shard(p)) for p in paths) == 3 * len(HARD)
