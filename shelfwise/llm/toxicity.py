"""Toxicity severity by cumulative-link ordinal regression (operator 4).

Grades 0, 1 and 2 are ordered; P(grade <= k) = sigmoid(cut_k - score), with one weight per feature shared by all cuts.
A text's features are its whole words and the first 4, 5 and 6 letters of its words; a weight counts once for every time
its feature occurs, and each word costs a learned constant, what clean text gathers by chance. The sum is divided by
sqrt(1 + words / ``LENGTH``), as chance grows with the root of the length: a long text is not toxic for being long. The
output is the expected severity, the most likely grade, and P(grade >= 1).

``labels`` has toxic as 0 or 1. Its documents get training grades: 0 where not toxic; a toxic one is 2 where it has more
telling words than the median of the toxic ones, else 1. Features are those whose document frequency among toxic
rows is significantly above that among the others (likelihood ratio), at most ``FEATURES``. Learning uses at most about
``SAMPLE`` labelled rows of each kind, picked by a hash of doc_id; every row is scored.

Defined cases: a null or empty text scores as one without features; a very long text is read whole and judged by the
same measure as a short one; without labelled rows, or without both kinds, every
severity is 0; rows with a null label do not count; repeated rows get equal answers; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .quality import words

SAMPLE, FEATURES, LEAST_DOCS, LEAST_RATIO, LEAST_GAIN = 5000, 2000, 4, 5.0, 18.0
STEMS = (4, 5, 6)
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "…“”„‘’«»¡¿—–"
GRADES, LENGTH = 3, 100.0


def shrink(words: np.ndarray) -> np.ndarray:
    """What a text's sum is multiplied by."""
    return 1 / np.sqrt(1 + words / LENGTH)


def keys(word: str) -> list[str]:
    """The features of a lower-cased word without punctuation at its ends: itself, and its first letters with a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]] if word else []


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, words): a bounded part of the labelled documents of each kind, written."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "toxic-labels")
    counts = {bool(r.toxic): r["count"] for r in known.groupBy(F.col("toxic") > 0).count().toDF("toxic", "count").collect()}
    step = F.when(F.col("toxic") > 0, F.lit(max(1, counts.get(True, 0) // size))).otherwise(F.lit(max(1, counts.get(False, 0) // size)))
    # At most about twice ``size`` ids of each kind by the steps above, so this side is bounded.
    ids = known.filter(F.pmod(F.xxhash64("doc_id"), step) == 0).limit(4 * size)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    every = words(F.lower(F.coalesce("text", F.lit(""))))
    bare = F.transform(every, lambda w: F.btrim(w, F.lit(EDGES)))
    return materialize(picked.select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.array_remove(bare, "").alias("words"), F.size(every).alias("size")), "toxic-sample")


def choose(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features that tell toxic rows from others, by likelihood ratio."""
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    each = rows.select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("f"))
    c = each.groupBy("f").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.sum((~F.col("toxic")).cast("long")).alias("b"))
    c = c.filter(F.col("a") >= LEAST_DOCS)
    pa_, pb = F.col("a") / n_toxic, F.col("b") / n_clean
    p = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    term = lambda k, q: F.when(k > 0, k * F.log(q / p)).otherwise(F.lit(0.0))
    gain = 2 * (term(F.col("a"), pa_) + term(F.col("b"), pb) + term(n_toxic - F.col("a"), (1 - pa_) / (1 - p) * p) + term(n_clean - F.col("b"), (1 - pb) / (1 - p) * p))
    best = c.filter(pa_ >= LEAST_RATIO * pb).withColumn("gain", gain).filter(F.col("gain") >= LEAST_GAIN)
    return [r.f for r in best.orderBy(F.desc("gain"), "f").limit(FEATURES).collect()]


class Sparse:
    """A matrix of few non-zero entries."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value.astype(np.float64), shape

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        row, col = np.nonzero(dense)
        return cls(row, col, dense[row, col], dense.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def fit_ordinal(x: Sparse | np.ndarray, y: np.ndarray, grades: int = GRADES, steps: int = 1500, penalty: float = 1e-5, free: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered cuts by full-batch Adam on the log-likelihood; cuts stay ordered by positive gaps.

    Rows of grade 0 and rows above it weigh the same in all. No weight is negative, as every feature was chosen for being
    more frequent in toxic rows, but that of the last column is free where ``free`` says so."""
    x = Sparse.of(x) if isinstance(x, np.ndarray) else x
    n, d = x.shape
    weigh = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y == 0).sum(), 1)))
    params = np.concatenate([np.zeros(d), [1.0], np.full(grades - 2, 0.5)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        w, gaps = params[:d], np.exp(params[d + 1 :])
        cuts = params[d] + np.r_[0.0, np.cumsum(gaps)]
        score = x.times(w)
        upper = np.where(y < grades - 1, sig(cuts[np.minimum(y, grades - 2)] - score), 1.0)
        lower = np.where(y > 0, sig(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # slopes of log p in the upper and lower cut
        du[y == grades - 1], dl[y == 0] = 0.0, 0.0
        du, dl = du * weigh, dl * weigh
        g_cuts = np.array([(du * (y == k)).sum() - (dl * (y == k + 1)).sum() for k in range(grades - 1)]) / n
        g = np.concatenate([-x.turned_times(du - dl) / n - penalty * w, [g_cuts.sum()], [g_cuts[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        params[: d - free] = np.maximum(params[: d - free], 0.0)
    return params[:d], params[d] + np.r_[0.0, np.cumsum(np.exp(params[d + 1 :]))]


class Severity:
    """Feature weights, cuts, and what every ``LENGTH`` words add."""

    def __init__(self, weights: dict[str, float], cuts: np.ndarray, length: float = 0.0):
        self.weights, self.cuts, self.length = weights, cuts, length

    def word(self, word: str) -> float:
        bare = word.strip(EDGES)
        return sum(self.weights.get(k, 0.0) for k in keys(bare))

    def expect(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, likeliest grade and P(grade >= 1)."""
        above = 1 / (1 + np.exp(np.clip(self.cuts[None] - score[:, None], -50, 50)))
        each = -np.diff(np.c_[np.ones(len(score)), above, np.zeros(len(score))], axis=1)
        return above.sum(axis=1), each.argmax(axis=1), above[:, 0]


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Severity | None:
    rows = sample(docs, labels, size)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts.get(True) or not counts.get(False):
        return None
    names = choose(rows, counts[True], counts[False])
    if not names:
        return None
    at = rows.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[at.value[k] for w in x for k in keys(w) if k in at.value] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "size", "hits"])

    # At most 4 * size rows of the few features they hold.
    got = sorted((bool(r.toxic), sorted(r.hits), r.size) for r in rows.select("toxic", "words", "size").mapInArrow(count, "toxic boolean, size int, hits array<int>").collect())
    toxic = np.array([g[0] for g in got])
    telling = np.array([len(g[1]) for g in got])
    row = np.repeat(np.arange(len(got)), telling)
    cell, times = np.unique(row * len(names) + np.array([h for g in got for h in g[1]], np.int64), return_counts=True)
    size = np.array([g[2] for g in got], np.float64)
    scale = shrink(size)
    doc, col = np.r_[cell // len(names), np.arange(len(got))], np.r_[cell % len(names), np.full(len(got), len(names))]
    x = Sparse(doc, col, np.r_[times, size / LENGTH] * scale[doc], (len(got), len(names) + 1))
    telling = telling * scale
    y = np.where(toxic, np.where(telling > np.median(telling[toxic]), 2, 1), 0)
    weights, cuts = fit_ordinal(x, y, free=True)
    return Severity({f: float(w) for f, w in zip(names, weights, strict=False)}, cuts, min(float(weights[-1]), 0.0))


def score(docs: DataFrame, model: Severity | None) -> DataFrame:
    """(doc_id, severity, grade, p_toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for b in slices(batches, "text"):
            n, m = b.num_rows, shared.value
            if m is None:
                severity, grade, p = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
            else:
                parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(b.column(1).cast(pa.large_string()), "")))
                coded = parts.flatten().dictionary_encode()
                if len(kept) > 300_000:
                    kept.clear()
                known = coded.dictionary.to_pylist()
                for w in known:
                    if w not in kept:
                        kept[w] = m.word(w)
                index = coded.indices.to_numpy(zero_copy_only=False)
                worth = np.fromiter((kept[w] for w in known), np.float64, len(known))[index] if len(known) else np.zeros(0)
                full = np.fromiter((w != "" for w in known), bool, len(known))[index] if len(known) else np.zeros(0, bool)
                at = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))].astype(np.int64)
                total, size = (np.diff(np.r_[0.0, np.cumsum(v)][at]) for v in (worth, full))
                severity, grade, p = m.expect((total + m.length * size / LENGTH) * shrink(size))
            yield pa.record_batch([b.column(0), pa.array(severity, pa.float64()), pa.array(grade.astype(np.int32), pa.int32()), pa.array(p, pa.float64())], names=["doc_id", "severity", "grade", "p_toxic"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's expected severity, and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
