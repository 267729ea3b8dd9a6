"""Embedding near-dedup by an inverted multi-index (operator 7).

Unit vectors are rotated to their principal axes, dealt alternately into two halves, and each half gets a codebook; the
two codebooks' product grid has the cells. From a vector, a cell's distance is how far it must move, half by half, to
cross into that cell (the hyperplanes between centroids). The two codebooks' sorted distances are merged as a
multi-sequence, nearest cells first, out to the radius that reaches ``recall`` for neighbours at exactly the threshold;
closer neighbours are reached more surely. Every pair that meets in a cell is verified in double precision.

Codebooks, rotation and radius are fitted on at most ``SAMPLE`` vectors (picked by a hash) of each length; every vector is
indexed, in the grid of its own length, and every vector searches. Cells are worked on in blocks of at most about ``BLOCK`` vectors a side, so one cell
that holds a third of all vectors is many tasks. A block returns counts and a spanning set of links, never all pairs.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components links with nothing and is its own
component; vectors of different lengths have no cosine and do not link; equal vectors link with each other; rows that
repeat a vec_id are vectors of their own and count as others; a null vec_id is a vector without an id, its component is the smallest id
it reaches, null if none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize
from .graph import components

THRESHOLD, RECALL, SAMPLE, BLOCK = 0.95, 0.9999, 20_000, 4096
PER_CELL, MOST_CENTROIDS = 256, 256


class MultiIndex:
    """Rotation, two codebooks and the search radius."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float):
        rng = np.random.default_rng(11)
        self.dim, self.threshold = sample.shape[1], threshold
        if self.dim < 2:
            sample = np.pad(sample, ((0, 0), (0, 2 - self.dim)))
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.rotation = axes[:, ::-1]
        k = int(min(MOST_CENTROIDS, max(2, np.ceil(np.sqrt(n / PER_CELL))), len(sample)))
        rotated = sample @ self.rotation
        self.books = [self._kmeans(rotated[:, h::2], k, rng) for h in (0, 1)]
        self.k = k
        gaps = [np.linalg.norm(b[:, None] - b[None], axis=2) for b in self.books]
        self.gaps = [np.where(g > 0, g, np.inf) for g in gaps]
        self.radius = self._calibrate(sample, rng, recall)

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
        book = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((book**2).sum(1)[None] - 2 * x @ book.T, axis=1)
            count = np.bincount(near, minlength=k)
            for c in np.flatnonzero(count):
                book[c] = x[near == c].mean(axis=0)
        return book

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (np.pad(x, ((0, 0), (0, 2 - self.dim))) if self.dim < 2 else x) @ self.rotation

    def distances(self, rotated: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each vector, and per half the squared distance to cross into each centroid's part."""
        cell, out = np.zeros(len(rotated), np.int64), []
        for h, (book, gap) in enumerate(zip(self.books, self.gaps, strict=True)):
            x = rotated[:, h::2]
            d = (x**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * x @ book.T
            own = np.argmin(d, axis=1)
            cross = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
            out.append(np.maximum(cross, 0.0) ** 2)
            cell = cell * self.k + own
        return cell, out

    def _calibrate(self, sample: np.ndarray, rng, recall: float) -> float:
        """The smallest radius (squared) that reaches ``recall`` of simulated neighbours at the threshold."""
        if recall >= 1:
            return 2 * (1 - self.threshold) * (1 + 1e-9)
        q = np.repeat(sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)], 10, axis=0)
        side = rng.standard_normal(q.shape)
        side -= (side * q).sum(1)[:, None] * q
        norm = np.linalg.norm(side, axis=1)[:, None]
        other = self.threshold * q + np.sqrt(1 - self.threshold**2) * side / np.where(norm > 0, norm, 1)
        _, (one, two) = self.distances(self.rotate(q))
        cell, _ = self.distances(self.rotate(other))
        at = np.arange(len(q))
        return float(np.quantile(one[at, cell // self.k] + two[at, cell % self.k], recall)) * 1.1 + 1e-9

    def visits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Cells within the radius, nearest first: the product of the two sorted halves cut where the sum exceeds it."""
        i, j = np.flatnonzero(one <= self.radius), np.flatnonzero(two <= self.radius)
        total = one[i][:, None] + two[j][None]
        a, b = np.nonzero(total <= self.radius)
        return (i[a] * self.k + j[b])[np.argsort(total[a, b], kind="stable")]


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, and which of them can be."""
    v = v.astype(np.float64)
    most = np.abs(v).max(axis=1, initial=0.0)
    good = np.isfinite(most) & (most > 0)
    v = v / np.where(good, most, 1.0)[:, None]
    norm = np.linalg.norm(v, axis=1)
    return np.where(good[:, None], v / np.where(good, norm, 1.0)[:, None], 0.0), good


def _unit(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one."""
    if dim and isinstance(column, pa.ListArray) and not column.null_count and not column.flatten().null_count and (column.value_lengths().to_numpy() == dim).all():
        return _scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    rows = column.to_pylist()
    dim = dim or next((len(x) for x in rows if x), 1)
    out, good = np.zeros((len(rows), dim)), np.zeros(len(rows), bool)
    for k, x in enumerate(rows):
        if x is not None and len(x) == dim and None not in x:
            v = np.asarray(x, np.float64)
            most = np.abs(v).max(initial=0.0)
            if np.isfinite(most) and most > 0:
                v = v / most
                out[k], good[k] = v / np.linalg.norm(v), True
    return out, good


def spanning(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest number reachable from each of ``n`` nodes."""
    label = np.arange(n)
    if not links:
        return label
    a, b = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(base: dict, query: dict, same: bool, threshold: float) -> list:
    """Link counts of the vectors of a block and a spanning set of its links. ``same``: each unordered pair once."""
    nb, nq = len(base["row"]), len(query["row"])
    count_b, count_q, label = np.zeros(nb, np.int64), np.zeros(nq, np.int64), np.arange(nb + nq)
    for lo in range(0, nq, 512):
        hit = query["x"][lo : lo + 512] @ base["x"].T >= threshold
        if same:
            hit &= query["row"][lo : lo + 512, None] > base["row"][None]
        qi, bi = np.nonzero(hit)
        if len(qi):
            count_q[lo : lo + 512] = hit @ base["w"]
            count_b += query["w"][lo : lo + 512] @ hit
            label = spanning(nb + nq, [(np.arange(nb + nq), label), (bi, nb + lo + qi)])
    row, count = np.concatenate([base["row"], query["row"]]), np.concatenate([count_b, count_q])
    keep = count > 0
    return [row[keep], count[keep], row[label[keep]]]


def links(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All vectors (vec_id, key), the distinct ones (row, key, n_same, low), and links found: (row, count, to).

    ``count`` adds up to a distinct vector's links to others, repeats counted; (row, to) span the links."""
    spark = df.sparkSession
    rows = df.select(df[vec_id].alias("vec_id"), df[embedding].cast("array<double>").alias("v"))
    rows = materialize(rows.withColumn("key", F.sha2(F.to_json(F.struct("v")), 256)), "vectors")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    distinct = rows.filter(F.col("v").isNotNull() & finite).groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("n_same"), F.min("vec_id").alias("low"))
    distinct = materialize(distinct.withColumn("row", F.monotonically_increasing_id()), "vectors-distinct")
    n = distinct.count()
    if not n:
        return rows, distinct, spark.createDataFrame([], "row long, count long, to long")
    # One grid for each length of vectors; a grid's cells have numbers of their own.
    indexes, cells = {}, 0
    for dim, many in sorted((r.dim, r["count"]) for r in distinct.groupBy(F.size("v").alias("dim")).count().collect()):
        same = distinct.filter(F.size("v") == dim)
        part = same.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, many // sample))) == 0).limit(2 * sample).orderBy("key")
        picked = part.select("v").toArrow().column(0).combine_chunks()
        if not len(picked):
            picked = same.orderBy("key").limit(1).select("v").toArrow().column(0).combine_chunks()
        unit, good = _unit(picked, dim)
        indexes[dim] = MultiIndex(unit[good], many, threshold, recall), cells
        cells += indexes[dim][0].k ** 2
    shared = spark.sparkContext.broadcast(indexes)
    # Vectors travel as they are stored: single precision is half as much to shuffle, and scaling it again is exact.
    single = isinstance(df.schema[embedding].dataType.elementType, FloatType)
    kind, arrow = ("float", pa.float32()) if single else ("double", pa.float64())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                lengths = s.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths).tolist():
                    m, first = shared.value[dim]
                    p = s.take(pa.array(np.flatnonzero(lengths == dim)))
                    unit, good = _unit(p.column(1), dim)
                    if good.any():
                        row = p.column(0).to_numpy()[good]
                        cell, (one, two) = m.distances(m.rotate(unit[good]))
                        seen = [v[v >= c] + first for c, v in ((c, m.visits(o, t)) for c, o, t in zip(cell.tolist(), one, two, strict=True))]
                        yield pa.record_batch([pa.array(row, pa.int64()), p.column(1).filter(pa.array(good)).cast(pa.list_(arrow)), p.column(2).filter(pa.array(good)), pa.array(cell + first, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], names=["row", "x", "w", "cell", "visits"])

    placed = materialize(distinct.select("row", "v", "n_same").mapInArrow(assign, f"row long, x array<{kind}>, w long, cell long, visits array<long>"), "vectors-cells")
    visit = placed.select("row", "x", "w", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    # One row a cell, at most MOST_CENTROIDS squared: how many blocks each side of it is cut into.
    sides = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("nb")).join(visit.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("nq")), "cell")
    sides = F.broadcast(materialize(sides, "vectors-sides"))
    base = placed.select("row", "x", "w", "cell").join(sides, "cell").select("cell", F.pmod(F.xxhash64("row"), "nb").alias("bp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qp"), "row", "x", "w", F.lit(None).cast("long").alias("own"))
    query = visit.join(sides, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bp"), F.pmod(F.xxhash64("row", F.lit(1)), "nq").alias("qp"), "row", "x", "w", "own")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        row, w = table.column("row").to_numpy(), table.column("w").to_numpy()
        x, _ = _scaled(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1))
        own = table.column("own").to_numpy().astype(np.float64)  # NaN: one of the cell's own vectors
        part = lambda m: {"row": row[m], "w": w[m], "x": x[m]}
        b, home = np.isnan(own), own == cell
        out = [_block(part(b), part(q), same, threshold) for same, q in ((True, home), (False, ~home & ~b)) if b.any() and q.any()]
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({"row": pa.array(cols[0], pa.int64()), "count": pa.array(cols[1], pa.int64()), "to": pa.array(cols[2], pa.int64())})

    found = materialize(base.unionByName(query).groupBy("cell", "bp", "qp").applyInArrow(verify, "row long, count long, to long"), "vectors-links")
    return rows, distinct, found


def near_dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    rows, distinct, found = links(df, vec_id, embedding, threshold, recall, sample)
    classes = components(found, "row", "to").withColumnRenamed("node", "row")
    counted = found.groupBy("row").agg(F.sum("count").alias("count"))
    each = distinct.select("row", "key", "n_same", "low").join(counted, "row", "left").join(classes, "row", "left")
    each = each.withColumn("component", F.coalesce("component", "row"))
    low = each.groupBy("component").agg(F.min("low").alias("component_id"))
    each = materialize(each.join(low, "component").select(F.col("key").alias("k"), (F.coalesce("count", F.lit(0)) + F.col("n_same") - 1).alias("n_links"), "component_id"), "vectors-classes")
    out = rows.select("vec_id", "key").join(each, F.col("key") == F.col("k"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links, component, and whether it stays."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_embedding_near_dedup": op7_embedding_near_dedup}
ORACLES: dict[str, str] = {}
