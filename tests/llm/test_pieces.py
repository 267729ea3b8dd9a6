import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import pieces

MODEL = pieces.default_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "   lead", "x" * 3000, "ab" * 500, " " * 300 + "z" + " " * 41, "tab\tnew\nline", "▁odd▁ ▁", "é́ ñ 漢字 😀 \U0001f9d1‍\U0001f680",
    "12345 3.14", "\x00\x01 nul", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bananananana", "the the the thethe", "Ééééé ierieriererer", "!!!!!!!! ######## $$$$$$$$$", "�﻿", "word " * 50,
]


def expected(text):
    ids = [*LIB.encode(text or ""), 2]
    return ids, LIB.decode(ids)


def check(texts):
    got = pieces.load(MODEL).encode_batch(pa.array(texts, pa.string())).lists()
    for t, ids in zip(texts, got, strict=True):
        want, back = expected(t)
        assert ids == want, t
        assert pieces.load(MODEL).decode(ids) == back, t


def test_matches_the_library_on_hard_texts():
    check(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" abehtnisor▁\n.,éß1"), st.characters(blacklist_categories=["Cs"])), max_size=60), max_size=6))
def test_matches_the_library_on_any_text(texts):
    check(texts)


def test_long_repetitive_words():
    rng = np.random.default_rng(3)
    check(["".join(rng.choice(list("thenai "), 4000)) for _ in range(3)] + ["".join(rng.choice(list("ab"), 2000))])


def test_query(spark, tmp_path):
    rows = [(i, t, "en", "dup") for i, t in enumerate(HARD)] + [(None, "null id", None, None), (3, HARD[3], "en", "dup")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op10_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        ids, back = expected(t)
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {1: "some text", 2: ""}
    assert pieces.digests(df.limit(0)).count() == 0


def test_span_pieces_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.PieceModel(str(tmp_path / "none.model"))


def test_batches_cut_by_size():
    from shelfwise.llm.common import slices

    texts = [f"é{'ü' * (i % 50)} word{i} and  more" for i in range(500)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(slices(iter([batch]), "text", 700))
    assert len(parts) > 20
    got = [ids for p in parts for ids in pieces.load(MODEL).encode_batch(p.column(1)).lists()]
    assert got == [expected(t)[0] for t in texts]
