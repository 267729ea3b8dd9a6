"""Entity resolution: exact duplicates, look-alikes, moved rows, identity groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordering import written

CANDIDATE_CAP = 32
#: Up to this number of counted edges one task connects them.
SMALL_EDGES = 200_000
#: Where a hash would meet more than this share of all others by bands, hashes are compared block by block instead.
MEET_MOST = 0.01
#: Hashes of a block: at most where all blocks meet, and where a first forest is made of blocks by themselves.
BLOCK, FOREST_BLOCK = 65_536, 16_384
#: Hashes of both sides that are compared at a time, and links that are held before they are handed on.
STRIP, HELD = (8, 4096), 200_000
ABSENT = -(2**62)


def exact_candidates(rows: DataFrame, size: str) -> DataFrame:
    """Rows whose size another row has too: only these need hashing."""
    shared = rows.groupBy(F.col(size).alias("__s")).count().filter("count > 1")
    return rows.join(shared, F.col(size) == F.col("__s"), "left_semi")


def exact_groups(rows: DataFrame, key: str, size: str, content: Column) -> DataFrame:
    """(key, hash, group, copies): rows of equal size and content, named by the smallest key."""
    hashed = exact_candidates(rows, size).select(F.col(key).alias("key"), F.col(size).alias("size"), F.md5(content).alias("hash"))
    groups = hashed.groupBy("size", "hash").agg(F.min("key").alias("group"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(groups, ["size", "hash"]).select("key", "hash", "group", "copies")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Large: join all higher neighbours of each node to its minimum; small: all lower ones."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    j = around.join(low, F.col("u") == F.col("c"))
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("u > v").distinct()


def _hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after edges (a, b) too: of each node the smallest place in its component."""
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, x, y)
        np.minimum.at(label, y, x)
        while (label != label[label]).any():
            label = label[label]
    return label


def _connected_at_once(edges: DataFrame) -> DataFrame:
    """(node, label) of a counted, small table of edges, in one task: trees of smallest nodes, hooked and flattened."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        nodes, at = np.unique(np.concatenate([p[c].to_numpy() for c in ("u", "v") for p in parts]), return_inverse=True)
        label = _hooked(np.arange(len(nodes)), *at.reshape(2, -1))
        yield pd.DataFrame({"node": nodes, "label": nodes[label]})

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").coalesce(1).mapInPandas(work, f"node {kind}, label {kind}")


def connected(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, label): the smallest node of each connected component; nodes without edges are left out.

    Large and small stars by turns, each round a written table, until no edge changes: rounds grow with the logarithm of
    the longest path and have no cap. A table of ``small`` counted edges or fewer is connected by one task.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    last = None
    while (seen := edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()) != last:
        if last is None and seen.n <= small:
            return _connected_at_once(edges)
        last, edges = seen, written(_stars(_stars(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def band_plan(distance: int, width: int = 64, most: int = 512) -> tuple[list[int], int]:
    """Edges of bands of a hash, and how many bits of a band are turned in search.

    Two hashes that close differ in at most ``distance // bands`` bits of some band. Of all numbers of bands whose search
    keys number ``most`` or fewer for a hash, the one that meets the fewest hashes by chance.
    """
    best = None
    for n in range(1, min(distance + 1, width) + 1):
        keys = [sum(comb(w, i) for i in range(distance // n + 1)) for w in (width // n, -(-width // n))]
        if n * keys[1] <= most and (best is None or n * keys[0] / 2 ** (width // n) < best[0]):
            best = n * keys[0] / 2 ** (width // n), n
    n = best[1] if best else distance + 1
    return [k * width // n for k in range(n + 1)], distance // n


def band_share(distance: int, width: int = 64) -> float:
    """The share of all others that a hash meets by :func:`band_plan`, by chance."""
    edges, radius = band_plan(distance, width)
    return sum(sum(comb(w, i) for i in range(radius + 1)) / 2**w for w in np.diff(edges).tolist())


def lookalike_candidates(hashes: DataFrame, distance: int) -> DataFrame:
    """(h, h2) of distinct hashes ``h``, h < h2, that are as close as ``distance // bands`` in some band; may repeat."""
    edges, radius = band_plan(distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    cut = lambda k: F.shiftrightunsigned("h", edges[k]).bitwiseAND(F.lit(signed((1 << (edges[k + 1] - edges[k])) - 1)))
    turned = lambda w: [signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(w), r)]
    own = [F.struct(F.lit(k).alias("band"), cut(k).alias("part")) for k in range(len(edges) - 1)]
    searched = lambda k: lambda m: F.struct(F.lit(k).alias("band"), cut(k).bitwiseXOR(m).alias("part"))
    near = [F.transform(F.lit(turned(edges[k + 1] - edges[k])).cast("array<bigint>"), searched(k)) for k in range(len(edges) - 1)]
    keyed = hashes.select("h", F.explode(F.array(*own)).alias("k")).select("h", "k.band", "k.part")
    asked = hashes.select("h", F.explode(F.concat(*near)).alias("k")).select(F.col("h").alias("h2"), "k.band", "k.part")
    return keyed.join(asked, ["band", "part"]).filter("h < h2").select("h", "h2")


def lookalike_hashes(rows: DataFrame, bits: str, distance: int) -> DataFrame:
    """(h, h2, distance) of distinct hashes, h < h2, that differ in at most ``distance`` bits, exact for every distance.

    Hashes are joined, not rows. Hashes that pair with anything stay out; distance 0 pairs nothing. Bands that select too
    little (:data:`MEET_MOST`) are not used: all hashes are compared then, in blocks.
    """
    hashes = _good(rows, bits, distance).select(F.col(bits).alias("h")).distinct()
    if band_share(distance) > MEET_MOST:
        hashes = written(hashes.select("h", F.col("h").alias("name")), "hashes")
        return _compared(*_all_blocks(hashes, hashes.count()), distance).toDF("h", "h2", "distance")
    close = lookalike_candidates(hashes, distance).withColumn("distance", S.hamming(F.col("h"), F.col("h2")))
    return close.filter(F.col("distance") <= distance).distinct()


def _block(blocks: int, salt: int = 0) -> Column:
    """By name, so that rows of one hash spread over all blocks."""
    return F.pmod(F.xxhash64("name", F.lit(salt)), F.lit(blocks))


def _all_blocks(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Tiles in which each two of ``n`` hashes meet once, and their number: blocks with each other and by themselves."""
    blocks = max(-(-n // BLOCK), min(12, -(-n // 1024)), 1)
    own, other = F.col("block"), F.col("other")
    at = hashes.withColumn("block", _block(blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    return at.select((F.least(own, other) * blocks + F.greatest(own, other)).alias("tile"), side.alias("side"), *hashes.columns), blocks * (blocks + 1) // 2


def _own_blocks(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Tiles of blocks by themselves, dealt twice in different ways, and their number."""
    blocks = max(-(-n // FOREST_BLOCK), 1)
    tiles = F.explode(F.array(_block(blocks, 1), _block(blocks, 2) + blocks))
    return hashes.select(tiles.alias("tile"), F.lit(2).alias("side"), *hashes.columns), 2 * blocks


def _some_blocks(some: DataFrame, few: int, hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Tiles in which ``few`` hashes meet all ``n``, and their number."""
    rows, cols = -(-few // BLOCK), max(-(-n // BLOCK), min(24, -(-n // 1024)), 1)
    down, across = F.explode(F.sequence(F.lit(0), F.lit(rows - 1))), F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    a = some.withColumn("k", across).select((_block(rows) * cols + F.col("k")).alias("tile"), F.lit(0).alias("side"), *hashes.columns)
    b = hashes.withColumn("k", down).select((F.col("k") * cols + _block(cols)).alias("tile"), F.lit(1).alias("side"), *hashes.columns)
    return a.unionByName(b), rows * cols


def _by_tile(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The three sides of each tile, of batches that are sorted by tile."""
    held, last = [], None
    for batch in chain(batches, [None]):
        for tile, part in [(None, None)] if batch is None else batch.groupby("tile"):
            if held and tile != last:
                whole = pd.concat(held)
                yield [whole[whole["side"] == k] for k in range(3)]
                held = []
            last = tile
            held.append(part)


def _close(a: np.ndarray, b: np.ndarray, distance: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of hashes as close as ``distance``, and their distances. own: both are the same, and each two meet once."""
    a, b, (rows, cols) = a.view(np.uint64), b.view(np.uint64), STRIP
    held, n = [], 0
    for j in range(0, len(b), cols):
        part = b[j : j + cols]
        for i in range(0, min(len(a), j + len(part)) if own else len(a), rows):
            gap = np.bitwise_count(a[i : i + rows, None] ^ part).ravel()
            at = np.flatnonzero(gap <= distance)
            if own:
                at = at[i + at // len(part) < j + at % len(part)]
            if len(at):
                held.append((i + at // len(part), j + at % len(part), gap[at]))
                n += len(at)
                if n >= HELD:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _expanded(hits: np.ndarray, other: np.ndarray, starts: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of classes that met, places of all pairs of their rows and the number of the hit, some at a time."""
    n = sizes[0][hits] * sizes[1][other]
    ends = np.cumsum(n)
    for low in range(0, int(n.sum()), HELD):
        at = np.arange(low, min(low + HELD, int(ends[-1])))
        hit = np.searchsorted(ends, at, "right")
        at, wide = at - (ends - n)[hit], sizes[1][other[hit]]
        yield starts[0][hits[hit]] + at // wide, starts[1][other[hit]] + at % wide, hit


def _listed(a: pd.DataFrame, b: pd.DataFrame, distance: int, own: bool) -> Iterator[pd.DataFrame]:
    """(a, b, distance) of the rows of a tile: distinct hashes are compared, and rows of one hash are close too."""
    sides = [x.sort_values("h") for x in ((a,) if own else (a, b))] * (2 if own else 1)
    names = [x["name"].to_numpy() for x in sides]
    (x, *one), (y, *two) = [np.unique(x["h"].to_numpy(), return_index=True, return_counts=True) for x in sides]
    starts, sizes = zip(one, two)
    found = _close(x, y, distance, own)
    if own and (again := np.flatnonzero(sizes[0] > 1)).size:
        found = chain([(again, again, np.zeros(len(again), np.int32))], found)
    for i, j, gap in found:
        for p, q, hit in _expanded(i, j, starts, sizes):
            good = (i[hit] != j[hit]) | (p < q) if own else slice(None)
            p, q, hit = names[0][p[good]], names[1][q[good]], hit[good]
            other = p != q
            yield pd.DataFrame({"a": np.minimum(p, q)[other], "b": np.maximum(p, q)[other], "distance": gap[hit[other]].astype(np.int32)})


def _forest(a: pd.DataFrame, b: pd.DataFrame, distance: int, own: bool) -> Iterator[pd.DataFrame]:
    """(a, b): fewer edges than a tile has hashes, with the components of all of its links."""
    names = np.concatenate([x["name"].to_numpy() for x in ((a,) if own else (a, b))])
    label = np.arange(len(names))
    for i, j, _ in _close(a["h"].to_numpy(), b["h"].to_numpy(), distance, own):
        label = _hooked(label, i, j if own else len(a) + j)
    at = np.flatnonzero(label != np.arange(len(names)))
    yield pd.DataFrame({"a": names[label[at]], "b": names[at]})


def _compared(dealt: DataFrame, tiles: int, distance: int, linked: bool = False) -> DataFrame:
    """(a, b, distance), a < b: names of close rows (h, name) that meet in tiles (tile, side). Side 0 meets side 1, side 2 itself.

    ``linked``: (a, b) of a forest of each tile instead.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, own in _by_tile(batches):
            a, b = (own, own) if len(own) else (a, b)
            yield from (_forest if linked else _listed)(a, b, distance, len(own) > 0)

    kind = dealt.schema["name"].dataType.simpleString()
    by_tile = dealt.repartition(min(tiles, 10_000), "tile").sortWithinPartitions("tile")
    return by_tile.mapInPandas(work, f"a {kind}, b {kind}" + ", distance int" * (not linked))


def _groups_by_blocks(first: DataFrame, copies: DataFrame, distance: int) -> DataFrame:
    """(node, label) of hashes (h, name) and edges (a, b) to their copies, where hashes that are linked by others need not meet.

    Blocks by themselves make a forest first. Only hashes outside of its largest component meet all others then.
    """
    first = written(first, "hashes")
    n = first.count()
    if n <= FOREST_BLOCK:
        return connected(_compared(*_all_blocks(first, n), distance, True).unionByName(copies))
    labels = written(connected(_compared(*_own_blocks(first, n), distance, True).unionByName(copies)), "labels")
    most = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")
    rest = written(first.join(labels.join(F.broadcast(most), "label").select(F.col("node").alias("name")), "name", "left_anti").select("h", "name"), "rest")  # one row
    few = rest.count()
    if not few:
        return labels
    more = _compared(*(_all_blocks(first, n) if 2 * few > n else _some_blocks(rest, few, first, n)), distance, True)
    return connected(labels.toDF("b", "a").unionByName(more))


def _good(rows: DataFrame, bits: str, distance: int) -> DataFrame:
    return rows.filter(F.col(bits).isNotNull() & ~S.matches_anything(F.col(bits), distance)) if distance > 0 else rows.limit(0)


def lookalike_pairs(rows: DataFrame, key: str, bits: str, distance: int, confirm: Column | None = None) -> DataFrame:
    """(a, b, distance), a < b: all pairs of rows whose hashes differ in at most ``distance`` bits, rows of one hash too.

    Hashes that pair with anything stay out; distance 0 pairs nothing. ``confirm`` is a condition on columns of both rows,
    prefixed ``a_`` and ``b_``, that must also hold. n rows of one hash are n * (n - 1) / 2 pairs: :func:`lookalike_groups`
    says the same in n rows.
    """
    good = _good(rows, bits, distance)
    if confirm is None and band_share(distance) > MEET_MOST:
        good = written(good.select(F.col(bits).alias("h"), F.col(key).alias("name")), "hashes")
        return _compared(*_all_blocks(good, good.count()), distance)
    shared = good.groupBy(F.col(bits).alias("h")).count().filter("count > 1").select("h", F.col("h").alias("h2"), F.lit(0).alias("distance"))
    close = lookalike_hashes(rows, bits, distance).unionByName(shared)
    a = good.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = good.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    pairs = close.join(a, F.col("h") == F.col(f"a_{bits}")).join(b, F.col("h2") == F.col(f"b_{bits}"))
    pairs = pairs.filter((F.col("h") != F.col("h2")) | (F.col(f"a_{key}") < F.col(f"b_{key}")))
    if confirm is not None:
        pairs = pairs.filter(confirm)
    return pairs.select(F.least(f"a_{key}", f"b_{key}").alias("a"), F.greatest(f"a_{key}", f"b_{key}").alias("b"), "distance")


def lookalike_groups(rows: DataFrame, key: str, bits: str, distance: int, same: Column | None = None) -> DataFrame:
    """(key, group): connected look-alikes, named by the smallest key; single rows are left out.

    ``same`` is a condition on columns of both rows, prefixed ``a_`` and ``b_``, that must also hold.
    """
    if same is None:  # rows of one hash are look-alikes by themselves; only hashes need connecting
        first = rows.filter(F.col(bits).isNotNull() & ~S.matches_anything(F.col(bits), distance)).groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("lead"))
        if distance > 0 and band_share(distance) > MEET_MOST:
            copies = rows.select(F.col(bits).alias("h"), F.col(key).alias("b")).join(first, "h").select(F.col("lead").alias("a"), "b").filter("a <> b")
            return _groups_by_blocks(first.select("h", F.col("lead").alias("name")), copies, distance).select(F.col("node").alias("key"), F.col("label").alias("group"))
        close = lookalike_hashes(rows, bits, distance)
        one, two = first.toDF("h", "lead1"), first.toDF("h2", "lead2")
        edges = close.join(one, "h").join(two, "h2").select(F.col("lead1").alias("a"), F.col("lead2").alias("b"))
        own = rows.select(F.col(bits).alias("h"), F.col(key).alias("b")).join(one, "h").select(F.col("lead1").alias("a"), "b")
        return connected(edges.unionByName(own)).select(F.col("node").alias("key"), F.col("label").alias("group"))
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    close = lookalike_hashes(rows, bits, distance)
    pairs = close.select("h", "h2").join(a, F.col("h") == F.col(f"a_{bits}")).join(b, F.col("h2") == F.col(f"b_{bits}"))
    equal = a.join(b, (F.col(f"a_{bits}") == F.col(f"b_{bits}")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    edges = pairs.select(*a.columns, *b.columns).unionByName(equal).filter(same).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))
    return connected(edges).select(F.col("node").alias("key"), F.col("label").alias("group"))


def moved(new: DataFrame, old: DataFrame, keys: list[str], name: str = "name", gone: str = "gone", cap: int = CANDIDATE_CAP) -> DataFrame:
    """(new_id, old_id): new rows that are old ones moved.

    Rows meet on ``keys``; a key with more than ``cap`` old rows says nothing. A pair of equal names wins if it is the
    only such pair for both; of what is left, a pair counts if it is the only one for both. Ambiguity stays new.
    """
    crowded = old.groupBy(*keys).count().filter(F.col("count") <= cap).drop("count")
    o = old.filter(F.col(gone)).join(crowded, keys, "left_semi").select(*keys, F.col("id").alias("old_id"), F.col(name).alias("old_name"))
    pairs = new.select(*keys, F.col("id").alias("new_id"), F.col(name).alias("new_name")).join(o, keys).select("new_id", "old_id", (F.col("new_name") == F.col("old_name")).alias("named"))

    def alone(p: DataFrame) -> DataFrame:
        n, o = Window.partitionBy("new_id"), Window.partitionBy("old_id")
        return p.withColumns({"n": F.count("*").over(n), "o": F.count("*").over(o)}).filter("n = 1 and o = 1").select("new_id", "old_id")

    first = alone(pairs.filter("named"))
    rest = pairs.join(first.select("new_id"), "new_id", "left_anti").join(first.select("old_id"), "old_id", "left_anti")
    return first.unionByName(alone(rest))


LEADER_ROWS = 64


def leader_clusters(vectors: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    """(id, cluster, similarity): each vector joins the cluster with the nearest sum so far, or starts its own.

    The order of ids decides, so one block of vectors (``block``, for example a shard) is one sequential task; without
    ``block`` all vectors are. Vectors of different blocks never meet. A few vectors at a time are held against all sums
    of before at once; sums that change or start among them are looked at again one by one.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].tolist()
        if not ids:
            return pd.DataFrame({"id": [], "cluster": [], "similarity": []})
        vecs = np.array([np.asarray(v, np.float64) for v in pdf["v"]])
        norms = np.linalg.norm(vecs, axis=1)
        sums, lengths, k = np.zeros((1024, vecs.shape[1])), np.zeros(1024), 0
        lead, out = [], []
        for start in range(0, len(ids), LEADER_ROWS):
            some, old = vecs[start : start + LEADER_ROWS], k
            scores = some @ sums[:old].T / np.maximum(lengths[:old], 1e-300)
            changed: list = []
            for j, v in enumerate(some):
                i, norm, at, best = ids[start + j], norms[start + j], -1, 0.0
                if k and norm > 0:
                    scores[j, changed] = sums[changed] @ v / np.maximum(lengths[changed], 1e-300)
                    near = [(float(scores[j, c]), c) for c in ([int(scores[j].argmax())] if old else [])]
                    if k > old:
                        fresh = sums[old:k] @ v / np.maximum(lengths[old:k], 1e-300)
                        near.append((float(fresh.max()), old + int(fresh.argmax())))
                    best, at = max(near, key=lambda x: (x[0], -x[1]))
                    best /= norm
                if at >= 0 and best >= threshold:
                    sums[at] += v
                    out.append((i, lead[at], best))
                    if at < old and at not in changed:
                        changed.append(at)
                else:
                    at, k = k, k + 1
                    if k > len(sums):
                        sums, lengths = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([lengths, np.zeros_like(lengths)])
                    sums[at] = v
                    lead.append(i)
                    out.append((i, i, 1.0))
                lengths[at] = np.linalg.norm(sums[at])
        return pd.DataFrame(out, columns=["id", "cluster", "similarity"])

    df = vectors.withColumn("__block", F.col(block) if block else F.lit(0))
    return df.select("id", "v", "__block").groupBy("__block").applyInPandas(work, "id long, cluster long, similarity double")


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Per item, boxes by falling score; one that overlaps a kept one by more than ``most`` goes."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        kept: list = []
        for r in pdf.itertuples():
            if all(_iou(r, k) <= most for k in kept):
                kept.append(r)
        return pdf[pdf["id"].isin([k.id for k in kept])]

    return boxes.groupBy("item_id").applyInPandas(work, boxes.schema)


def _iou(a, b) -> float:
    w, h = max(min(a.right, b.right) - max(a.left, b.left), 0.0), max(min(a.bottom, b.bottom) - max(a.top, b.top), 0.0)
    union = (a.right - a.left) * (a.bottom - a.top) + (b.right - b.left) * (b.bottom - b.top) - w * h
    return w * h / union if union > 0 else 0.0


def best_fit(old: DataFrame, new: DataFrame, least: float = 0.0) -> DataFrame:
    """(old_id, new_id): per item, old and new boxes paired greedily by overlap, each used once."""
    o = old.select("item_id", F.col("id").alias("old_id"), F.struct("left", "top", "right", "bottom").alias("o"))
    n = new.select("item_id", F.col("id").alias("new_id"), F.struct("left", "top", "right", "bottom").alias("n"))
    pairs = o.join(n, "item_id").withColumn("fit", S.overlap(F.col("o"), F.col("n"))).filter(F.col("fit") > least).select("item_id", "old_id", "new_id", "fit")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_o, taken_n, out = set(), set(), []
        for r in pdf.sort_values(["fit", "old_id", "new_id"], ascending=[False, True, True]).itertuples():
            if r.old_id not in taken_o and r.new_id not in taken_n:
                taken_o.add(r.old_id), taken_n.add(r.new_id)
                out.append((r.old_id, r.new_id))
        return pd.DataFrame(out, columns=["old_id", "new_id"])

    return pairs.groupBy("item_id").applyInPandas(work, "old_id long, new_id long")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, v): component sums of each group's vectors, in one aggregation."""
    parts = vectors.select(F.col(group).alias("group"), F.posexplode(vector).alias("i", "x")).groupBy("group", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return parts.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("v"))


def set_digest(rows: DataFrame, columns: list[str], hashed: Column | None = None) -> DataFrame:
    """One number that depends on the set of rows but not on their order. ``hashed``: another whole number for each row."""
    each = F.xxhash64(*columns) if hashed is None else hashed
    return rows.agg(F.sum(each.cast("decimal(38,0)")).alias("digest"))
