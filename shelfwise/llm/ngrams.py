"""N-gram Jaccard join with signature trees (operator 1).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets link when 100 * |A and B| >= 75 * |A or B|.
The join is exact:

1. Digests. Equal sets are one set from here on. Shingles that repeat within a run of texts are counted, and the most
   frequent ones (at most ``HOT_MOST``, each in ``HOT_LEAST`` sets or more) go last in the order of shingles.
2. Subtrees. Linked sets share at least k of their first n - ceil(0.75 n) + k shingles in that order; k grows with n, so
   that a passage alone does not tie long texts. Meetings at shingles of few sets are counted by pair. Those at a common
   shingle are not: a pair needs k less the smaller number of common shingles among either's first ones. Only a set that
   has k or more of them there is tied by them, to nodes made of the shingle and the set's range of sizes, never to other
   sets: a hot shingle is no hot key, and a group of near copies makes about as many ties as it has members. The ties'
   connected components hold every link; each is a subtree and its sets come together once.
3. Signature tree. In a subtree sets are sorted by size and smallest shingles; each tree node holds the OR of its sets'
   bitmaps, their range of sizes, and the most shingles that share a bit in one of its sets. Two nodes are walked together
   from the root; a pair is pruned when no two sets below can overlap enough, or when all of them are one class already.
   Pairs of sets that remain are verified on the shingles themselves.
4. Small subtrees share a call, up to about ``CALL_TOKENS`` shingles. One of more than ``BLOCK`` sets or ``BLOCK_TOKENS``
   shingles is cut by ranges of size (linked sets lie in the same range or in neighbouring ones) and these into chunks,
   which all get the first few sets of the ranges around them. What does not end in the component's main class is then
   walked against the chunks of its own and the neighbouring ranges, so such a component is many tasks and still exact.

Only the bounded list of frequent shingles reaches the driver. Texts are read whole; they are shuffled to the subtrees as
texts, which are smaller than their shingles. What is written holds only sets that may link.

Defined cases: null texts and texts without words have no shingles and link with nothing; fewer than five words are one
shingle, the whole sequence; a very long text is one set like others, and a few of them fill a chunk; repeated rows are
equal sets; a null doc_id belongs to its component, whose id is the smallest doc_id that is not null (null where there is
none); an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices
from .graph import components

WORDS, PERCENT = 5, 75
HOT_MOST, HOT_LEAST, HOT_LOCAL, RUN_TOKENS = 200_000, 32, 3, 2_000_000
EXTRA, EXTRA_SHARE, GROUP = 8, 16, 64
BLOCK, BLOCK_TOKENS, CALL_TOKENS, PIVOTS, FAN, PARENTS = 1024, 500_000, 400_000, 4, 4, 4096
BATCH_BYTES, RUN_ROWS, SALTS = 2_000_000, 200_000, 256
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(low)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    at = coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), counts)
    blank = np.fromiter((w == "" for w in vocabulary), bool, len(vocabulary))[at] if len(vocabulary) else np.zeros(0, bool)
    word, text = hashes[at[~blank]] if len(vocabulary) else np.zeros(0, np.uint64), text[~blank]
    n = np.bincount(text, minlength=len(texts))
    start = np.cumsum(n) - n
    run = np.full(max(len(word) - WORDS + 1, 0), U(WORDS))
    for k in range(WORDS):
        run = _mix(run * U(0x9E3779B97F4A7C15) + word[k : k + len(run)])
    out = []
    for s, m in zip(start.tolist(), n.tolist(), strict=True):
        if m >= WORDS:
            v = np.sort(run[s : s + m - WORDS + 1])
            out.append(v[np.r_[True, v[1:] != v[:-1]]])
        elif m:
            h = np.full(1, U(m))
            for k in range(m):
                h = _mix(h * U(0x9E3779B97F4A7C15) + word[s + k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a = _mix(tokens ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = _mix(tokens + U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(np.int64(_mix(np.array([a ^ U(len(tokens))]))[0].view(np.int64))), int(np.int64(_mix(np.array([b + U(len(tokens))]))[0].view(np.int64)))


def _digests(docs: DataFrame) -> DataFrame:
    """Written rows: (doc_id, th, n, s1, s2) of every document, and (token, c) of shingles that repeat in a run of texts."""

    def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, c = np.unique(np.concatenate(held), return_counts=True)
        return token[c >= HOT_LOCAL].view(np.int64), c[c >= HOT_LOCAL]

    names = ["doc_id", "th", "n", "s1", "s2", "token", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def repeated() -> pa.RecordBatch:
            token, c = counted(held)
            none = pa.nulls(len(token), pa.int64())
            return pa.record_batch([pa.nulls(len(token), kind), none, none, none, none, pa.array(token), pa.array(c)], names=names)

        for b in slices(batches, "text", BATCH_BYTES):
            kind, sets = b.column(0).type, shingles(b.column(2))
            s = [digest(x) if len(x) else (None, None) for x in sets]
            for x, k in zip(sets, s, strict=True):
                if len(x) and k not in seen:
                    seen.add(k)
                    held.append(x)
                    size += len(x)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([k[0] for k in s], pa.int64()), pa.array([k[1] for k in s], pa.int64()), none, none], names=names)
            if size > RUN_TOKENS:
                yield repeated()
                held, size, seen = [], 0, set()
        if held:
            yield repeated()

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return materialize(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, n long, s1 long, s2 long, token long, c long"), "shingle-digests")


def _frequent(digests: DataFrame) -> np.ndarray:
    """The bounded list of frequent shingles, sorted."""
    total = digests.filter("token is not null").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_LEAST)
    rows = total.orderBy(F.desc("c"), "token").limit(HOT_MOST).select("token").toArrow().column(0)
    return np.sort(rows.to_numpy().astype(np.int64).view(np.uint64))


def _least(n):
    """How many of their first shingles two linked sets share at least, the smaller of n shingles."""
    return np.minimum(EXTRA + n // EXTRA_SHARE, -(-PERCENT * n // 100))


def _first(tokens: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles that must meet those of every linked set, and which of them are frequent."""
    n = len(tokens)
    must = -(-PERCENT * n // 100)
    length = n - must + int(_least(n))
    is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(n, bool)
    order = np.argsort(is_hot, kind="stable")[:length]
    return tokens[order], is_hot[order]


def _range_of(n: np.ndarray | int) -> np.ndarray:
    """The range of sizes a size is in; sizes that can link are in the same range or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(100.0 / PERCENT) + 1e-9).astype(np.int64)


def _index(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, sid, n): the first shingles of every set, once for each run of texts that has it; n < 0 at frequent ones."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in slices(batches, "text", BATCH_BYTES):
            token, sid, size = [], [], []
            for x in shingles(b.column(0)):
                if len(x) and (k := digest(x)) not in seen:
                    if len(seen) < 100_000:
                        seen.add(k)
                    first, h = _first(x, shared.value)
                    token.append(first)
                    sid.append(np.full(len(first), k[0]))
                    size.append(np.where(h, -len(x), len(x)))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(sid)), pa.array(np.concatenate(size).astype(np.int32))], names=["token", "sid", "n"])

    return docs.select("text").mapInArrow(run, "token long, sid long, n int")


def _pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, begun: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Meetings at rows sorted by token and size: pairs (a, b, smaller k, times met) of small groups, and the rows of large ones.

    ``begun``: the first token's rows are the rest of a large group."""
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    rows = np.diff(np.r_[start, len(token)])
    length = rows.copy()
    if begun and len(length):
        length[0] += GROUP + 1
    length[n[start] < 0] = GROUP + 1
    group = np.repeat(length, rows)
    out_a, out_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for gap in range(1, int(length[length <= GROUP].max(initial=0))):
        near = np.flatnonzero((token[gap:] == token[:-gap]) & (group[gap:] <= GROUP))
        out_a.append(near)
        out_b.append(near + gap)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    fits = (100 * n[a].astype(np.int64) >= PERCENT * n[b].astype(np.int64)) & (sid[a] != sid[b])
    a, b = a[fits], b[fits]
    k = _least(n[a].astype(np.int64))
    lo, hi = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
    order = np.lexsort((hi, lo))
    lo, hi, k = lo[order], hi[order], k[order]
    new = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(lo) else np.zeros(0, int)
    return [lo[new], hi[new], np.minimum.reduceat(k, new) if len(new) else k, np.diff(np.r_[new, len(lo)])], np.flatnonzero(group > GROUP)


def _meetings(index: DataFrame) -> DataFrame:
    """Written: pairs (a, b, k, met) of sets, and each set's common first shingles as (sid, token, k, -range of sizes - 1)."""

    def told(cols: list[np.ndarray], begun: bool) -> pa.RecordBatch:
        token, sid, n = cols
        once = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])] if len(token) else np.zeros(0, bool)
        token, sid, n = token[once], sid[once], n[once]
        pairs, common = _pairs(token, sid, n, begun)
        size = np.abs(n[common].astype(np.int64))
        cols = [np.concatenate([p, r]) for p, r in zip(pairs, [sid[common], token[common], _least(size), -1 - _range_of(size)], strict=True)]
        return pa.record_batch([pa.array(x.astype(np.int64)) for x in cols], names=["a", "b", "k", "met"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [np.zeros(0, np.int64)] * 3, None
        for b in batches:
            cols = [np.concatenate([r, b.column(k).to_numpy()]) for k, r in enumerate(rest)]
            if not len(cols[0]):
                continue
            # The last token's rows wait for the next batch. A very long run is cut; its parts are parts of a large group.
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            long = cut == 0 and len(cols[0]) > RUN_ROWS
            if cut or long:
                yield told([x[:cut] if cut else x for x in cols], long or last == cols[0][0])
                last, cut = cols[0][-1] if long else None, cut or len(cols[0])
            rest = [x[cut:] for x in cols]
        if len(rest[0]):
            yield told(rest, last == rest[0][0])

    # Frequent shingles are spread.
    salt = F.when(F.col("n") < 0, F.pmod(F.xxhash64("sid"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    met = index.repartition("token", salt).sortWithinPartitions("token", "n", "sid").mapInArrow(meet, "a long, b long, k long, met long")
    return materialize(met, "shingle-meetings")


def _nodes(common: DataFrame) -> DataFrame:
    """(a, b): ties of sets by their common first shingles (sid, token, range). Nodes that a set ties are tied once by a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, last = {}, {}

        def root(x: int) -> int:
            while nodes.setdefault(x, x) != x:
                nodes[x] = nodes[nodes[x]]
                x = nodes[x]
            return x

        for b in batches:
            sid, token, at = (b.column(k).to_numpy() for k in range(3))
            both = np.arange(2, dtype=np.uint64)[None] + at.astype(np.uint64)[:, None] + U(1)
            own = _mix(token.view(np.uint64)[:, None] + both * U(0x9E3779B97F4A7C15)).view(np.int64)
            ties = []
            for s, (one, two) in zip(sid.tolist(), own.tolist(), strict=True):
                if s not in last:
                    last = {s: one}
                    ties.append((one, s))
                for o in (one, two):
                    if (u := root(last[s])) != (v := root(o)):
                        nodes[v] = u
                        ties.append((last[s], o))
            if len(nodes) > 500_000:
                nodes.clear()
            if ties:
                yield pa.record_batch([pa.array([t[k] for t in ties], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return common.select("sid", "token", "at").repartition("sid").sortWithinPartitions("sid").mapInArrow(run, "a long, b long")


def _candidates(index: DataFrame) -> DataFrame:
    """(a, b): ties between sets, or sets and nodes, whose connected components hold every link, written."""
    meetings = _meetings(index)
    common = meetings.filter("met < 0").select(F.col("a").alias("sid"), F.col("b").alias("token"), "k", (-F.col("met") - 1).alias("at"))
    held = materialize(common.groupBy("sid").agg(F.count("*").alias("h"), F.max("k").alias("least")), "shingle-common")
    pairs = meetings.filter("met > 0").groupBy("a", "b").agg(F.min("k").alias("k"), F.sum("met").alias("met"))
    one, two = (held.select(F.col("sid").alias(f"{x}_sid"), F.col("h").alias(f"{x}_h")) for x in "ab")
    pairs = pairs.join(one, F.col("a") == F.col("a_sid"), "left").join(two, F.col("b") == F.col("b_sid"), "left")
    spare = F.least(F.coalesce("a_h", F.lit(0)), F.coalesce("b_h", F.lit(0)))
    pairs = pairs.filter(F.col("met") >= F.greatest(F.lit(1), F.col("k") - spare)).select("a", "b")
    ties = _nodes(common.join(held.filter("h >= least").select("sid"), "sid", "left_semi"))
    out = materialize(pairs.unionByName(ties), "shingle-candidates")
    release(meetings, held)
    return out


class Classes:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.up))], np.int64)


class SignatureTree:
    """A tree of OR-combined bitmaps and size ranges over sets of shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        most = max(len(s) for s in sets)
        self.bits = min(1 << 13, max(256, 1 << (2 * most - 1).bit_length()))
        words = self.bits // 64
        maps = np.zeros((len(sets), words), np.uint64)
        for k, s in enumerate(sets):
            bit = s >> U(64 - self.bits.bit_length() + 1)
            np.bitwise_or.at(maps[k], (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
        sizes = np.array([len(s) for s in sets], np.int64)
        slack = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]  # bitmap, least size, largest size, most shingles beyond one a bit
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, sl = self.levels[-1]
            first = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, first, axis=0), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(sl, first)))

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether any two sets below the nodes can overlap enough."""
        m, lo, hi, sl = self.levels[level]
        fits = (100 * hi[x] >= PERCENT * lo[y]) & (100 * hi[y] >= PERCENT * lo[x])
        out = np.zeros(len(x), bool)
        at = np.flatnonzero(fits)
        for part in np.array_split(at, max(1, len(at) // 4_000)):
            both = np.bitwise_count(m[x[part]] & m[y[part]]).sum(axis=1).astype(np.int64)
            most = np.minimum(np.minimum(both + np.minimum(sl[x[part]], sl[y[part]]), hi[x[part]]), hi[y[part]])
            out[part] = (100 + PERCENT) * most >= PERCENT * (lo[x[part]] + lo[y[part]])
        return out

    def one_class(self, level: int, label: np.ndarray) -> np.ndarray:
        """The class of all sets below each node, -1 where they have several."""
        first = np.arange(0, len(label), FAN**level)
        lo, hi = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        return np.where(lo == hi, lo, -1)

    def walk(self, classes: Classes, wanted: np.ndarray | None = None) -> None:
        """Join the classes of all linked pairs; with ``wanted``, of pairs with at least one such set."""
        n = len(self.sets)
        same = Marks(self.sets)
        if wanted is None:
            for k in range(n - 1):  # neighbours in the sorted order are the likeliest links
                same.check(classes, k, k + 1)
        x = y = np.zeros(1, np.int64)
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            count, kept = len(self.levels[level][1]), []
            some = np.ones(count, bool) if wanted is None else np.maximum.reduceat(wanted, np.arange(0, n, FAN**level))
            label = self.one_class(level, classes.labels())
            for lo in range(0, len(x), PARENTS):  # a part of the pairs of parents at a time: memory holds what survives
                px, py = x[lo : lo + PARENTS], y[lo : lo + PARENTS]
                if level < top:
                    i, j = np.divmod(np.arange(FAN * FAN), FAN)
                    px, py = (px[:, None] * FAN + i).ravel(), (py[:, None] * FAN + j).ravel()
                    good = (px < count) & (py < count) & (px <= py)
                    px, py = px[good], py[good]
                if not level:
                    label = classes.labels()
                open_ = ~((label[px] >= 0) & (label[px] == label[py])) & (some[px] | some[py])
                px, py = px[open_], py[open_]
                good = self.may_link(level, px, py)
                if level:
                    kept.append((px[good], py[good]))
                    continue
                for a, b in zip(px[good].tolist(), py[good].tolist(), strict=True):
                    if a != b:
                        same.check(classes, a, b)
            if level:
                x, y = (np.concatenate([k[side] for k in kept]) if kept else np.zeros(0, np.int64) for side in (0, 1))


class Marks:
    """Exact overlaps of the sets of a block, which are sorted arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets

    def check(self, classes: Classes, a: int, b: int) -> None:
        if classes.find(a) == classes.find(b):
            return
        small, large = sorted((self.sets[a], self.sets[b]), key=len)
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if 100 * both >= PERCENT * (len(small) + len(large) - both):
            classes.join(a, b)


def linked(sets: list[np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    """The class of each set of a block (the number of one of its members)."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k][:2].tolist()))
    classes = Classes(len(sets))
    if len(sets) > 1:
        SignatureTree([sets[k] for k in order]).walk(classes, None if wanted is None else wanted[order])
    out = np.zeros(len(sets), np.int64)
    out[order] = np.array(order)[classes.labels()]
    return out


LINKS = "a long, b long"
WORK = ["comp", "s1", "text", "wanted"]


def _links(table: pa.Table) -> pa.Table:
    """(a, b): each set of a call that is linked, and its class, both by s1. Components are walked one by one."""
    comp, sid = table.column("comp").to_numpy(), table.column("s1").to_numpy()
    wanted = table.column("wanted").to_numpy(zero_copy_only=False)
    order = np.lexsort((~wanted, sid, comp))
    order = order[np.r_[True, sid[order][1:] != sid[order][:-1]]]  # a set may come twice; the wanted one counts
    comp, sid, wanted = comp[order], sid[order], wanted[order]
    rows = table.select(["text"]).take(pa.array(order)).combine_chunks().to_batches()
    sets = [x for b in slices(iter(rows), "text", BATCH_BYTES) for x in shingles(b.column(0))]
    a, b = [], []
    for part in np.split(np.arange(len(sid)), np.flatnonzero(np.diff(comp)) + 1):
        label = part[linked([sets[k] for k in part], None if wanted[part].all() else wanted[part])]
        far = label != part
        a.append(sid[part][far])
        b.append(sid[label][far])
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _near(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` once for every chunk of their component in their own range of sizes (``band``) and the neighbouring ones."""
    rows = rows.withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    target = sizes.select(F.col("comp").alias("t_comp"), F.col("band").alias("t_band"), F.col("parts").alias("t_parts"))
    j = rows.join(target, (rows["comp"] == target["t_comp"]) & (rows["at"] == target["t_band"]))
    return j.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_parts") - 1))).drop("t_comp", "t_band", "t_parts")


def _parts(count, tokens) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("long")


def _linked_sets(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """(node, component) of the sets (s1) that link with another."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + F.lit(1e-9)).cast("long")
    cands = cands.withColumn("band", band)
    sizes = cands.groupBy("comp", "band").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    whole = sizes.groupBy("comp").agg(F.sum("c").alias("wc"), F.sum("t").alias("wt")).select(F.col("comp").alias("w_comp"), ((F.col("wc") > BLOCK) | (F.col("wt") > BLOCK_TOKENS)).alias("large"), "wt")
    sizes = sizes.join(whole, F.col("comp") == F.col("w_comp")).select("comp", "band", _parts(F.col("c"), F.col("t")).alias("parts"), "large", "t")
    sizes = materialize(sizes, "shingle-sizes")
    total = sizes.agg(F.sum("t").alias("t"), F.max("large").alias("large")).first()
    calls = max(1, (total.t or 0) // CALL_TOKENS)
    placed = cands.join(sizes.drop("t"), ["comp", "band"])
    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    held = own.join(placed, own["d"].eqNullSafe(placed["rep_id"]) & (own["h"] == placed["rep_th"]))
    held = held.select("comp", "s1", "text", F.lit(True).alias("wanted"), "band", "parts", "large", "n")
    small = lambda df: df.filter(~F.col("large")).select(*WORK, F.pmod(F.xxhash64("comp"), F.lit(calls)).alias("k1"), F.lit(-1).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"))
    if not total.large:
        return components(materialize(small(held).groupBy("k1", "k2", "k3").applyInArrow(_links, LINKS), "shingle-ties"))
    held = materialize(held, "shingle-subtrees")
    rows, large = held.filter("large"), sizes.filter("large")
    chunk = F.pmod(F.xxhash64("s1"), F.col("parts"))
    pick = rows.groupBy("comp", "band").agg(*[F.min_by("s1", F.xxhash64("s1", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pick = pick.select("comp", "band", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("s1"))
    pivots = _near(rows.join(pick, ["comp", "band", "s1"], "left_semi").dropDuplicates(["s1"]), large)
    first = small(held).unionByName(rows.select(*WORK, F.col("comp").alias("k1"), F.col("band").alias("k2"), chunk.alias("k3")))
    first = first.unionByName(pivots.select(*WORK, F.col("comp").alias("k1"), F.col("at").alias("k2"), F.col("chunk").alias("k3")))
    first = materialize(first.groupBy("k1", "k2", "k3").applyInArrow(_links, LINKS), "shingle-ties")
    found = components(first)
    members = rows.select("comp", "band", "n", "s1").distinct()
    labelled = members.join(found, members["s1"] == found["node"], "left").withColumn("class", F.coalesce("component", "s1"))
    main = labelled.groupBy("comp", "class").count().groupBy("comp").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    stray = materialize(labelled.join(main, "comp").filter(F.col("class") != F.col("main")).select("comp", "band", "n", "s1"), "shingle-strays")
    if not stray.isEmpty():
        # Lots of strays of one range of sizes meet every chunk around it.
        lots = materialize(stray.groupBy("comp", "band").agg(_parts(F.count("*"), F.sum("n")).alias("lots")), "shingle-lots")
        meets = _near(lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))), large)
        meets = meets.select("comp", F.col("at").alias("k1"), F.col("chunk").alias("k2"), F.col("band").alias("k3"), F.col("lot").alias("k4"))
        base = rows.select("comp", "s1", "text", F.lit(False).alias("wanted"), F.col("band").alias("k1"), chunk.alias("k2")).join(meets, ["comp", "k1", "k2"])
        asked = rows.join(stray.select("s1"), "s1", "left_semi").join(lots, ["comp", "band"])
        asked = _near(asked, large).select(*WORK, F.col("at").alias("k1"), F.col("chunk").alias("k2"), F.col("band").alias("k3"), F.pmod(F.xxhash64("s1", F.lit(1)), F.col("lots")).alias("k4"))
        second = base.unionByName(asked).groupBy("comp", "k1", "k2", "k3", "k4").applyInArrow(_links, LINKS)
        found = components(materialize(first.unionByName(second), "shingle-ties"))
    release(held)
    return found


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id) of every row; ``th`` is Spark's xxhash64 of the text."""
    return _rooted(docs, doc_id, text).drop("root")


def _rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of :func:`join` plus ``root``, a key of the component that is null only for rows without shingles."""
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    digests = _digests(docs)
    each = digests.filter("token is null").select("doc_id", "th", "n", "s1", "s2")
    reps = each.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("rep"), F.max("n").alias("n"))
    reps = materialize(reps, "shingle-sets")
    ties = _candidates(_index(docs, _frequent(digests)))
    comps = components(ties)
    cands = reps.join(comps, reps["s1"] == comps["node"]).select("s1", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "n", F.col("component").alias("comp"))
    cands = materialize(cands, "shingle-members")
    release(ties)
    found = _linked_sets(docs, cands)
    labelled = reps.join(found, reps["s1"] == found["node"], "left").select("s1", "s2", "low", F.coalesce("component", "s1").alias("root"))
    low = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    final = labelled.drop("low").join(low, "root").select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "component_id", "root")
    final = materialize(final, "shingle-classes")
    release(cands, reps)
    out = each.join(final, (each["s1"] == final["r1"]) & (each["s2"] == final["r2"]), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its component."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the first document of each component, and every document without shingles; its own columns only."""
    found = materialize(_rooted(docs), "jaccard")
    linked_ = found.filter("n_shingles > 0")
    keep = linked_.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*")
    keep = keep.unionByName(found.filter("n_shingles = 0").select("doc_id", "th").distinct())
    keep = keep.select(F.col("doc_id").alias("__j_id"), F.col("th").alias("__j_th"))
    own = docs.withColumn("__j_own", F.xxhash64("text"))
    out = own.join(keep, own["doc_id"].eqNullSafe(keep["__j_id"]) & (own["__j_own"] == keep["__j_th"]), "left_semi")
    if not linked_.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():  # a row that is repeated as it is
        out = out.dropDuplicates(["doc_id", "__j_own"])
    return out.select(*docs.columns)


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}


def pairs_sql(table: str) -> str:
    """Common table expressions up to ``jac`` (rid, doc_id, n_shingles, component_id), all pairs that share a shingle."""
    return f"""
    j_rows as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table}),
    j_sh as (select rid, list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) as s from j_rows),
    j_sort as (select rid, list_sort(s) as s from j_sh),
    j_set as (select min(rid) as sid, s, len(s) as n from j_sort where len(s) > 0 group by s),
    j_tok as (select sid, n, unnest(s) as t from j_set),
    j_link as (select a.sid as x, b.sid as y from j_tok a join j_tok b on a.t = b.t and a.sid < b.sid and 100 * a.n >= {PERCENT} * b.n and 100 * b.n >= {PERCENT} * a.n
      group by a.sid, b.sid, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
    j_edge as (select x, y from j_link union all select y, x from j_link),
    j_reach as (select sid as x, sid as r from j_set union select e.y as x, r from j_reach join j_edge e using (x)),
    j_comp as (select x as sid, min(r) as c from j_reach group by x),
    j_doc as (select h.rid, len(h.s) as n_shingles, c from j_sort h left join j_set z on h.s = z.s left join j_comp using (sid)),
    jac as (select j.rid, r.doc_id, n_shingles::bigint as n_shingles, case when c is null then r.doc_id else min(r.doc_id) over (partition by c) end as component_id from j_doc j join j_rows r using (rid))"""


ORACLES = {"op1_ngram_jaccard": f"with recursive {pairs_sql('documents')} select doc_id, n_shingles, component_id from jac"}
