"""Token-ID output in shards of separately compressed documents (operator 5).

A shard file holds the ids of its documents in ascending doc_id order, each document compressed on its own with one
zstandard dictionary that all shards share, so a short document compresses well and is read without its neighbours:

    b"SWTOK001" | blobs | footer | footer length (8 bytes) | b"SWTOK001"

The footer is a JSON header (dictionary hash, bytes per id, number of documents) and the index arrays: doc_id, whether
it is null, tokens per document, end offset of each blob. The dictionary lies beside the shards under its hash.

The dictionary is trained on the ids of at most about ``SAMPLE_DOCS`` documents, picked by a hash of doc_id, at most
``SAMPLE_IDS`` ids of each; it changes the files' size, never what they hold. A shard is written under another name and
renamed, by a name that depends on its place only, so a task that runs again leaves the same file.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows with equal doc_ids stay apart, in
the order of a hash of their texts; an empty table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, slices

MAGIC = b"SWTOK001"
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES, LEVEL = 2000, 2048, 1 << 16, 3
CACHED_WORDS = 500_000
READ_DOCS, READ_BYTES = 2000, 4 << 20
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Ids of whole texts from the tokenizers library, which sees each distinct word of a worker once.

    Cutting at ASCII white space is exact for this tokenizer: it drops white space, and neither its normaliser nor its
    pattern looks across it. Ids of up to ``CACHED_WORDS`` words stay for later batches; this changes only speed.
    """

    _kept: dict[str, WordCoder] = {}
    MARKS = (".", ",", "!", "?", ";", ":")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        rule = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if rule.get("behavior") != "Removed" or not rule.get("invert"):
            raise ValueError("only tokenizers that drop white space are supported")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    @classmethod
    def of(cls, path: str) -> WordCoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _learn(self, words: list[str]) -> None:
        """Give each new word a slot.

        ASCII letters with at most one mark behind them are two pieces to the tokenizer's pattern and lower-cased by its
        normaliser, so such a word is put together from its bare form and the mark. A bare form passes the normaliser and
        the pattern unchanged, so the library's model takes it directly; all else goes through the whole tokenizer.
        """
        whole, made = dict.fromkeys(["", *self.MARKS]), []
        for w in words:
            if w.isascii() and (w.isalpha() or (w[-1:] in self.MARKS and w[:-1].isalpha())):
                mark = "" if w.isalpha() else w[-1]
                bare = w[: len(w) - len(mark)].lower()
                whole[bare] = None
                if bare != w:
                    made.append((w, bare, mark))
            else:
                whole[w] = None
        fresh = [w for w in whole if w not in self.slot]
        bare = [w for w in fresh if w.isascii() and w.isalpha() and w.islower()]
        model = self.tokenizer.model
        self._encode(bare, lambda some: [[t.id for t in model.tokenize(w)] for w in some])
        rest = [w for w in fresh if not (w.isascii() and w.isalpha() and w.islower())]
        self._encode(rest, lambda some: [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        made = [m for m in made if m[0] not in self.slot]
        if made:
            parts = np.fromiter((self.slot[x] for m in made for x in m[1:]), np.int64, 2 * len(made))
            lengths = self.starts[parts + 1] - self.starts[parts]
            at = np.cumsum(lengths) - lengths
            flat = self.flat[np.repeat(self.starts[parts] - at, lengths) + np.arange(int(lengths.sum()))]
            self._append([m[0] for m in made], flat, lengths[::2] + lengths[1::2])

    def _encode(self, words: list[str], library) -> None:
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            ids = library(some)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._append(some, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def _append(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(self.slot), int(self.starts[len(self.slot)])
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(flat)] = flat
        self.starts[n + 1 : n + len(words) + 1] = at + np.cumsum(lengths)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def encode_batch(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text's followed by the end id, and the offsets of the texts in them."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.slot]
        if len(self.slot) + len(fresh) > CACHED_WORDS and fresh:
            known = [w for w in words if w in self.slot] if len(self.slot) > CACHED_WORDS else None
            if known is not None:  # start again from what this batch uses
                self.slot, self.starts[0] = {}, 0
                fresh = words
        self._learn(fresh)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        of = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        n = self.starts[of + 1] - self.starts[of]
        text_words = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))].astype(np.int64)
        total = np.r_[0, np.cumsum(n)]
        offsets = total[text_words] + np.arange(len(texts) + 1)
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        body = self.flat[np.repeat(self.starts[of] - total[:-1], n) + np.arange(total[-1])]
        mask = np.ones(len(out), bool)
        mask[offsets[1:] - 1] = False
        out[mask] = body
        return out, offsets


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _write_file(path: str, data: bytes) -> None:
    files, name = _fs(path)
    files.create_dir(os.path.dirname(name))
    with files.open_output_stream(name) as f:
        f.write(data)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary trained on the driver from the bounded sample."""
    import zstandard

    step = max(1, docs.count() // SAMPLE_DOCS)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(4 * SAMPLE_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            coder = WordCoder.of(tokenizer)
            ids, at = coder.encode_batch(b.column(0))
            yield pa.record_batch([pa.array([ids[i : min(j, i + SAMPLE_IDS)].astype(f"<u{coder.width}").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["ids"])

    sample = sorted(bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(sample)[-DICT_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """Streams documents into one shard; only the index is held in memory."""

    def __init__(self, path: str, dictionary: bytes, width: int):
        import zstandard

        self.path, self.width, self.hash = path, width, hashlib.sha256(dictionary).hexdigest()
        self.files, self.name = _fs(path)
        self.files.create_dir(os.path.dirname(self.name))
        self.part = f"{self.name}.{os.getpid()}-{np.random.SeedSequence().entropy:x}.part"
        self.out = self.files.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self.ids, self.null, self.tokens, self.ends, self.at = [], [], [], [], len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        blob = self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(blob)
        self.at += len(blob)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.tokens.append(len(ids))
        self.ends.append(self.at)

    def close(self) -> None:
        head = json.dumps({"dictionary": self.hash, "width": self.width, "documents": len(self.ids)}).encode()
        footer = struct.pack("<Q", len(head)) + head + np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.tokens, "<u8").tobytes() + np.array(self.ends, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        self.files.move(self.part, self.name)


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, path: str):
        import zstandard

        files, name = _fs(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a complete shard")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = self.file.read_at(length, size - 16 - length)
        n = struct.unpack("<Q", footer[:8])[0]
        head, at = json.loads(footer[8 : 8 + n]), 8 + n
        k = head["documents"]
        arrays = []
        for kind in ("<i8", "u1", "<u8", "<u8"):
            arrays.append(np.frombuffer(footer, kind, k, at))
            at += arrays[-1].nbytes
        self.doc_ids, self.null, self.tokens, self.ends = arrays
        self.width = head["width"]
        data = self.file_beside(files, name, head["dictionary"])
        if hashlib.sha256(data).hexdigest() != head["dictionary"]:
            raise ValueError(f"{path}: the dictionary does not have its hash")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    @staticmethod
    def file_beside(files, name: str, digest: str) -> bytes:
        with files.open_input_file(f"{os.path.dirname(name)}/dictionary-{digest}") as f:
            return f.read()

    def __len__(self) -> int:
        return len(self.tokens)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; nothing else of the blobs is read."""
        start = int(self.ends[k - 1]) if k else len(MAGIC)
        blob = self.file.read_at(int(self.ends[k]) - start, start)
        return np.frombuffer(self.decompressor.decompress(blob), f"<u{self.width}").astype("<u4")

    def runs(self, most: int = READ_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first, ids of the documents from there on), all documents in order: one read of about ``most`` bytes a run."""
        lo = 0
        while lo < len(self):
            start = int(self.ends[lo - 1]) if lo else len(MAGIC)
            hi = max(lo + 1, min(lo + READ_DOCS, int(np.searchsorted(self.ends, start + most, side="right"))))
            data = memoryview(self.file.read_at(int(self.ends[hi - 1]) - start, start))
            at = [0, *(self.ends[lo:hi].astype(np.int64) - start).tolist()]
            yield lo, [np.frombuffer(self.decompressor.decompress(data[i:j]), f"<u{self.width}").astype("<u4") for i, j in zip(at[:-1], at[1:], strict=True)]
            lo = hi

    def find(self, doc_id: int) -> np.ndarray | None:
        known = np.flatnonzero(self.null == 0)
        k = np.searchsorted(self.doc_ids[known], doc_id)
        return self.ids(int(known[k])) if k < len(known) and self.doc_ids[known[k]] == doc_id else None


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write shards below ``folder``, a path that all executors share; returns (shard, path, n_docs, n_ids), written."""
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer)
    _write_file(f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()}", dictionary)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, n = TaskContext.get().partitionId(), None, 0
        path = f"{folder}/shard-{shard:06d}.swtok"
        for b in slices(batches, "text"):
            coder = WordCoder.of(tokenizer)
            writer = writer or ShardWriter(path, shared.value, coder.width)
            ids, at = coder.encode_batch(b.column(1))
            for d, i, j in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                writer.add(d, ids[i:j])
            n += len(ids)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(writer.ids)], pa.int64()), pa.array([n], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    tie = F.xxhash64("text")
    ordered = docs.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "token-shards")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards that ``write`` lists."""
    return _read(manifest, lambda d, start, ids: [pa.array(d, pa.int64()), pa.array(start, pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], "doc_id long, start long, ids array<long>")


def checks(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    return _read(manifest, lambda d, start, ids: [pa.array(d, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(manifest: DataFrame, columns, schema: str) -> DataFrame:
    # The running sum is over shards, one small row each, not over documents.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                starts = base + np.r_[0, np.cumsum(shard.tokens.astype(np.int64))]
                for lo, ids in shard.runs():
                    hi = lo + len(ids)
                    doc_ids = [None if shard.null[k] else int(shard.doc_ids[k]) for k in range(lo, hi)]
                    yield pa.record_batch(columns(doc_ids, starts[lo:hi], ids), names=names)

    placed = manifest.select("path", before.alias("base"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's ids written to shards and read back, as checksums."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return checks(write(docs, new_path(spark, "tokens")))


QUERIES = {"op5_token_output": op5_token_output}
ORACLES: dict[str, str] = {}
