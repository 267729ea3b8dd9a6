"""Language identification by hierarchical discrimination (operator 3).

A linear stage picks the language family; inside a family one-versus-one linear support vector machines separate its
languages by votes. Features are hashed byte pairs and triples of the lower-cased whole text, as shares of all of them,
so every model is a table of weights and a text's margin is the mean weight of its n-grams: one pass of numpy over a
batch of texts, however long they are.

Models learn from text and lang only, from about ``SAMPLE`` labelled rows shared out evenly over the languages
(``LEAST_EACH`` of each at least, where there are so many) and picked by a hash of doc_id and text, by averaged
stochastic gradient steps on the hinge loss in a fixed order. Families are a fixed table; a language outside
it is a family of its own.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; so does every text when no row is
labelled; with one learned language every text with a letter gets it; repeated rows get equal answers; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

SAMPLE, BUCKETS, EPOCHS, PENALTY = 3000, 4096, 30, 1e-4
LEAST_EACH = 16
# Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode letter category."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the pair and of the triple at each byte of the joined texts, and the texts' offsets."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32) if len(low) else np.zeros(0, np.uint32)
    padded = np.concatenate([raw, np.zeros(2, np.uint32)])
    two = padded[:-2] * np.uint32(257) + padded[1:-1]
    three = two * np.uint32(263) + padded[2:]
    mixed = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)
    return mixed(two), mixed(three) + BUCKETS, offsets - offsets[0]


def _spans(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    start = offsets[:-1]
    return start, np.maximum(offsets[1:] - (order - 1), start)


def means(table: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean weight of each text's pairs plus that of its triples, for one model."""
    total = 0.0
    for order, at in ((2, grams[0]), (3, grams[1])):
        run = np.r_[0.0, np.cumsum(table[at])]
        lo, hi = _spans(grams[2], order)
        total = total + (run[hi] - run[lo]) / np.maximum(hi - lo, 1)
    return total


def features(texts: list[str] | pa.Array) -> np.ndarray:
    """Dense shares of the buckets, for training."""
    two, three, offsets = ngrams(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    out = np.zeros((len(texts), 2 * BUCKETS), np.float32)
    for order, at in ((2, two), (3, three)):
        for k, (lo, hi) in enumerate(zip(*_spans(offsets, order), strict=True)):
            if hi > lo:
                out[k] += np.bincount(at[lo:hi], minlength=2 * BUCKETS) / (hi - lo)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM for y in {-1, 1}; classes weigh alike. ``scale`` evens out the features."""
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    w, b, mean_w, mean_b, rng, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, np.random.default_rng(0), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 32)):
            t += 1
            rate = 1.0 / (1.0 + 0.05 * t)
            some = x[at]
            active = y[at] * (some @ (scale * w) + b) < 1
            g = (weight[at] * y[at] * active) / len(at)
            w = w * (1 - rate * PENALTY) + rate * (scale * (g @ some))
            b += rate * g.sum()
            mean_w += (w - mean_w) / t
            mean_b += (b - mean_b) / t
    return mean_w * scale, mean_b


class Hierarchy:
    """The family stage and the one-versus-one machines of each family."""

    def __init__(self, texts: list[str] | np.ndarray, langs: list[str]):
        """``texts``: texts, or their features."""
        self.langs = sorted(set(langs))
        of = np.array([self.langs.index(x) for x in langs])
        self.families = sorted({FAMILY.get(x, f"only-{x}") for x in self.langs})
        family = np.array([self.families.index(FAMILY.get(x, f"only-{x}")) for x in self.langs])
        self.members = [np.flatnonzero(family == f).tolist() for f in range(len(self.families))]
        x = texts if isinstance(texts, np.ndarray) else features(texts)
        spread = x.std(axis=0)
        scale = np.where(spread > 0, 1 / np.maximum(spread, 1e-4), 0.0) / np.sqrt(x.shape[1])
        self.pairs = lambda n: [(a, b) for a in range(n) for b in range(a + 1, n)]
        learn = lambda m, y: fit_svm(x[m], np.where(y, 1.0, -1.0), scale)
        fams = family[of]
        two = len(self.families) == 2
        self.family_models = [learn(np.ones(len(of), bool), fams == f) for f in range(len(self.families))][two:] if len(self.families) > 1 else []
        self.models = {(a, b): learn((of == a) | (of == b), (of == b)[(of == a) | (of == b)]) for group in self.members for i, a in enumerate(group) for b in group[i + 1 :]}
        del self.pairs

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        grams, n = ngrams(texts), len(texts)
        sure = lambda margin: 1 / (1 + np.exp(-np.clip(3 * margin, -60, 60)))
        if not self.family_models:
            family, score = np.zeros(n, int), np.ones(n)
        else:
            margins = [means(w, grams) + b for w, b in self.family_models]
            if len(margins) == 1:  # one machine tells two families apart
                family, score = (margins[0] > 0).astype(int), sure(np.abs(margins[0]))
            else:
                m = np.stack(margins, axis=1)
                family = m.argmax(axis=1)
                score = sure(m.max(axis=1))
        lang = np.zeros(n, int)
        for f, group in enumerate(self.members):
            votes, size = np.zeros((n, len(group))), len(group)
            for i, a in enumerate(group):
                for j in range(i + 1, size):
                    w, b = self.models[(a, group[j])]
                    p = sure(means(w, grams) + b)
                    votes[:, i] += (p <= 0.5) + 1e-3 * (1 - p)
                    votes[:, j] += (p > 0.5) + 1e-3 * p
                    if size == 2:
                        pair = np.maximum(p, 1 - p)
            here = family == f
            lang[here] = np.array(group)[votes[here].argmax(axis=1)]
            if size > 1:
                score[here] *= pair[here] if size == 2 else np.clip(votes[here].max(axis=1) / (size - 1), 0, 1)
        return [self.langs[k] for k in lang], np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """Learn on the driver from a bounded sample of each language of (doc_id, text, lang); None without labelled rows.

    Executors count the sample's n-grams: the driver gets shares of at most ``2 * BUCKETS`` buckets a row,
    however long the texts are."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return None
    each = max(LEAST_EACH, sample // len(counts))
    steps = docs.sparkSession.createDataFrame([(r.lang, max(1, r.n // each), r.least) for r in counts], "lang string, step long, least long")
    some = labelled.join(F.broadcast(steps), "lang").filter((F.pmod("h", "step") == 0) | (F.col("h") == F.col("least")))  # one row a language
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(1).to_pylist()
                good = [k for k, t in enumerate(texts) if has_letter(t)]
                dense = features([texts[k] for k in good])
                at = [np.flatnonzero(row) for row in dense]
                digest = [hashlib.sha256(texts[k].encode()).digest() for k in good]
                cols = [part.column(0).take(pa.array(good, pa.int64())), part.column(2).take(pa.array(good, pa.int64())), pa.array(digest, pa.binary())]
                cols += [pa.array([i.astype("<i2").tobytes() for i in at], pa.binary()), pa.array([row[i].astype("<f4").tobytes() for row, i in zip(dense, at, strict=True)], pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "lang", "digest", "bucket", "share"])

    picked = some.filter(F.col("k") <= 2 * each).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    rows = picked.mapInArrow(count, "doc_id string, lang string, digest binary, bucket binary, share binary").collect()
    rows = {(r.doc_id or "", bytes(r.digest), r.lang): r for r in rows}
    rows = [rows[k] for k in sorted(rows)]  # the same order in every run
    if not rows:
        return None
    x = np.zeros((len(rows), 2 * BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.bucket, "<i2")] = np.frombuffer(r.share, "<f4")
    return Hierarchy(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            texts = b.column(1)
            good = np.array([x is not None and has_letter(x) for x in texts.to_pylist()], bool)
            pred, score = (shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts))))
            yield pa.record_batch([b.column(0), pa.array([p if g else UNKNOWN for p, g in zip(pred, good, strict=True)], pa.string()), pa.array(np.where(good, score, 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
