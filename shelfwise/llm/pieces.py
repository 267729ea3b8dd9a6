"""SentencePiece encoding and decoding by vectorised merge rounds (operator 10).

The words of a batch of texts (a word is a run of spaces and what follows it) are deduplicated, their characters laid
out in one flat array, and pairs merged in rounds: each round finds every word's pair of lowest rank with a segmented
minimum, merges its leftmost places in all words at once, and compacts the arrays, until no word has a mergeable pair.

A word's later places of the same rank merge in the same round only while the merges before them make no pair that the
one-at-a-time order would take first, so the ids are those of the sequential algorithm. Cutting at spaces is exact
because no piece of the model has a space after another character; the loader checks this.

Defined cases: a null or empty text has only the end id and decodes to the empty text; repeated rows are encoded each; a
null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
NEVER = np.int32(2**31 - 1)


class PieceModel:
    """A byte-fallback BPE model file, as tables for numpy."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only byte-fallback BPE models without normalisation and with a leading space are supported")
        pieces = list(proto.pieces)
        self.size = len(pieces)
        ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("the model has pieces that span words")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
        # Symbols are piece ids; a character that is no piece itself gets a number above them.
        chars = {c for p in ids for c in p}
        self.symbol = {c: ids[c] if c in ids else self.size + k for k, c in enumerate(sorted(chars))}
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for c, s in self.symbol.items():
            self.char_symbol[ord(c)] = s
        order = {s: k for k, s in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        known = ids | {c: s for c, s in self.symbol.items() if c not in ids}
        self.wide = self.size + len(chars) + 1
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in known and p[k:] in known:
                    pairs[known[p[:k]] * self.wide + known[p[k:]]] = (order[pieces[i].score], i)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()], np.int32)
        self.pair_id = np.array([pairs[k][1] for k in self.pair_key.tolist()], np.int32)
        self.end_id = next(i for i, p in enumerate(pieces) if p.type == CONTROL and p.piece == "</s>")
        self.id_text = pa.array([str(i) for i in range(self.size)], pa.large_string())
        text = [b"" if p.type == CONTROL else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.id_bytes = pa.array(text, pa.large_binary())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; rank NEVER where none."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NEVER), np.where(hit, self.pair_id[at], -1)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the flat symbols of many words; ``word`` is ascending. Returns symbols and their words."""
        done_sym, done_word = [], []
        rank, made = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(sym)])
            if (least == NEVER).any():  # whole words leave the arrays
                over = np.repeat(least == NEVER, lengths)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, made = sym[~over], word[~over], rank[~over], made[~over]
                keep = least != NEVER
                least, lengths = least[keep], lengths[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # In a run of neighbouring places every other one merges, from the left.
            head = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            run = np.flatnonzero(head)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            at = self._allowed(at, sym, word, rank, made)
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            new = place[at]
            touched = np.concatenate([new, new[new > 0] - 1])
            r, m = self._pairs_at(touched, sym, word)
            rank[touched], made[touched] = r, m
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _pairs_at(self, i: np.ndarray, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.minimum(i + 1, len(sym) - 1)
        inside = (i + 1 < len(sym)) & (word[i] == word[j])
        return self.lookup(sym[i], np.where(inside, sym[j], -1))

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(np.arange(len(sym)), sym, word)

    def _allowed(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """The places that can merge together: in each word, up to the first merge that makes a pair due before the next place."""
        w = word[at]
        again = np.r_[False, w[1:] == w[:-1]]
        if not again.any():
            return at
        n = len(sym)
        left = np.maximum(at - 1, 0)
        left_sym = np.where((at > 0) & (word[left] == w), sym[left], -1)
        beside = again & np.r_[False, at[1:] == at[:-1] + 2]
        left_sym[beside] = made[at[np.flatnonzero(beside) - 1]]
        right = np.minimum(at + 2, n - 1)
        right_sym = np.where((at + 2 < n) & (word[right] == w), sym[right], -1)
        soon = np.minimum(self.lookup(left_sym, made[at])[0], self.lookup(made[at], right_sym)[0]) <= rank[at]
        before = np.cumsum(soon) - soon  # of all places so far, this one not counted
        start = np.flatnonzero(~again)
        return at[before == np.repeat(before[start], np.diff(np.r_[start, len(at)]))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words (each given without its first space) and the offsets of the words in them."""
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), "<u4").astype(np.int64) if words else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self.char_symbol[points]
        strange = sym < 0
        sym = np.where(strange, -2 - points, sym)  # never merges; bytes come later
        sym, word = self.merge(sym.astype(np.int64), word)
        bare = (sym >= self.size) | (sym < 0)
        if bare.any():
            named = {s: ord(c) for c, s in self.symbol.items() if s >= self.size}
            spots = np.flatnonzero(bare)
            spelled = [[self.byte_id[b] for b in chr(named[s] if s > 0 else -2 - s).encode()] for s in sym[spots].tolist()]
            widths = np.ones(len(sym), np.int64)
            widths[spots] = [len(x) for x in spelled]
            place = np.cumsum(widths) - widths
            out = np.repeat(sym, widths)
            for i, x in zip(place[spots].tolist(), spelled, strict=True):
                out[i : i + len(x)] = x
            sym, word = out, np.repeat(word, widths)
        return sym.astype(np.int32), np.searchsorted(word, np.arange(len(words) + 1))

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of texts (null: none), each without its first space, and the offsets of the texts in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}")
        plain = pc.if_else(pc.or_(odd, pc.equal(texts, "")), None, texts)
        parts = pc.split_pattern(plain, " ")
        if not pc.any(odd).as_py():
            counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
            return parts.flatten(), np.r_[0, np.cumsum(counts)].astype(np.int64)
        lists = parts.to_pylist()
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            lists[i] = [m[1:] for m in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + texts[i].as_py().replace(" ", SPACE))]
        counts = [len(x or ()) for x in lists]
        return pa.array([w for x in lists for w in x or ()], pa.large_string()), np.r_[0, np.cumsum(counts)].astype(np.int64)

    def encode_batch(self, texts: pa.Array) -> Encoded:
        words, offsets = self.split(texts)
        coded = words.dictionary_encode()
        ids, starts = self.encode_words(coded.dictionary.to_pylist())
        return Encoded(self, ids, starts, coded.indices.to_numpy(zero_copy_only=False), offsets)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the model's own library gives it: one leading space goes."""
        raw = b"".join(self.id_bytes.take(pa.array(ids, pa.int64())).to_pylist())
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


class Encoded:
    """The ids of a batch of texts, held once per distinct word."""

    def __init__(self, model: PieceModel, ids: np.ndarray, starts: np.ndarray, index: np.ndarray, offsets: np.ndarray):
        self.model, self.ids, self.starts, self.index, self.offsets = model, ids, starts, index, offsets

    def counts(self) -> np.ndarray:
        """Ids of each text, the end id not counted."""
        total = np.r_[0, np.cumsum(np.diff(self.starts)[self.index])]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _joined(self, table: pa.Array, by: str | bytes, kind: pa.DataType) -> pa.Array:
        each = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.starts, pa.int64()), table.take(pa.array(self.ids))), pa.scalar(by, kind))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.offsets, pa.int64()), each.take(pa.array(self.index))), pa.scalar(by, kind))

    def id_texts(self) -> pa.Array:
        """Decimal ids of each text joined by one space, without the end id."""
        return self._joined(self.model.id_text, " ", pa.large_string())

    def texts(self) -> pa.Array:
        """Decoded bytes of each text; its first space is still there."""
        return self._joined(self.model.id_bytes, b"", pa.large_binary())

    def lists(self) -> list[list[int]]:
        """Ids of each text with the end id."""
        n = np.diff(self.starts)[self.index]
        flat = self.ids[np.repeat(self.starts[:-1][self.index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return [[*x.tolist(), self.model.end_id] for x in np.split(flat, np.cumsum(self.counts())[:-1])] if len(self.offsets) > 1 else []


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every text's ids with the end id. ``model`` is a path that all executors have."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.record_batch([b.column(0), pa.array(load(path).encode_batch(b.column(1)).lists(), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    df = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else load(path).decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m = load(path)
            e = m.encode_batch(b.column(1))
            end = str(m.end_id)
            shown = [hashlib.sha256((f"{x} {end}" if x else end).encode()).hexdigest() for x in e.id_texts().to_pylist()]
            plain = [hashlib.sha256(x[x[:1] == b" " :]).hexdigest() for x in e.texts().to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(e.counts() + 1, pa.int64()), pa.array(shown, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
