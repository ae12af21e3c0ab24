"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Every document becomes the set of its n-grams (hashes of 64 bits) and a sketch: 128 MinHash values, of which a byte
   each and 32 hashes of 4 values each (the bands) are kept. Documents with the same set form a class; from here on
   there is one row a class, known by a number of its own.
2. Candidates are classes that share a band. A pair similar enough misses every band with a chance of 5e-8 or less.
3. Bayesian pruning: a pair's MinHash values are compared a part at a time; with a uniform prior the similarity then has a
   beta posterior, and the pair is dropped as soon as the chance of reaching the threshold falls below a tolerance.
4. What is left is verified on the sets, exactly.

Bands with few classes give pairs, each once. Bands with many classes would give pairs in the square of their number.
Their classes are gathered into clusters (connected by such bands). In a cluster, sets whose sizes differ too much for the threshold
can't be similar, so classes are sorted into size cells of which only equal and neighbouring ones meet; a cell is cut into
blocks by a hash, and each pair of blocks is one unit of work, in which candidates are found (the same rule: a band in common),
pruned and verified on matrices and of which only numbers of links and a spanning forest come out. Nothing is capped:
large groups only make more units, of the same size. The work for links inside a group of different texts of about one length
grows with the square of the group, as the number of its links does, and a set is sent to as many units as its cell has blocks.

Results: per document the class of near duplicates (the largest doc_id that is connected to it by links), the number of
links to different texts, and to other documents (with copies). Defined results: null and empty texts, and texts without
any words, have no n-grams, no links, and each is its own class, and so is a row without a doc_id; texts shorter than n words
have one n-gram, all their words; words are what lies between white space, as it is, and texts are taken whole; repeated rows count as
copies; a doc_id on two different texts is two documents, each with its own links; a similarity of exactly the threshold is a link;
an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, fresh, join_uneven, materialize

WORDS, THRESHOLD = 5, 0.8
#: MinHash values, values in a band, values compared at a time.
VALUES, BAND, STEP = 128, 4, 16
#: A pair is dropped when the posterior chance of reaching the threshold is below this.
TOLERANCE = 1e-9
#: A band with more classes than this makes a cluster; classes in a block.
DENSE, BLOCK = 48, 64

BANDS = VALUES // BAND
_MULTIPLY = np.random.default_rng(20_240_229).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P2
    return h ^ (h >> np.uint64(29))


_words: dict[str, int] = {}


def _word_hash(w: str) -> int:
    h = _words.get(w)
    if h is None:
        if len(_words) > 500_000:
            _words.clear()
        h = _words[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return h


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _mix(np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words)))
    k = min(n, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = _mix(out * _P1 + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def minhashes(items: np.ndarray) -> np.ndarray:
    """VALUES 32-bit MinHash values of a set that isn't empty."""
    out = np.empty(VALUES, dtype=np.uint32)
    for at in range(0, len(items), 2048):  # stays in the cache
        some = items[at : at + 2048]
        for v in range(0, VALUES, 8):
            low = ((some[None, :] * _MULTIPLY[v : v + 8, None]) >> np.uint64(32)).min(axis=1)
            out[v : v + 8] = low if not at else np.minimum(out[v : v + 8], low)
    return out


def sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands' 32-bit hashes and the values' low bytes."""
    v = values.reshape(BANDS, BAND).astype(np.uint64)
    h = v[:, 0]
    for j in range(1, BAND):
        h = _mix(h * _P1 + v[:, j])
    return (h >> np.uint64(32)).astype(np.uint32), (values & np.uint32(255)).astype(np.uint8)


@lru_cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step, the fewest matches with which the posterior chance of reaching the threshold isn't below the
    tolerance. Matching bytes also occur by chance, one time in 256."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log(1 - p)
            w = np.exp(logs - logs.max())
            if w[s >= threshold].sum() >= tolerance * w.sum():
                out.append(m)
                break
        else:
            out.append(n + 1)
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of a and b (bytes of MinHash values) stay."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        seen[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[seen[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def reaches(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, threshold: float) -> bool | np.ndarray:
    return common >= threshold * (a + b - common) - 1e-9


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in x with each in y, by matrix products over the items that both sides have."""
    xs, ys = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(xs, ys)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    if not len(shared):
        return out
    rows_x, rows_y = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])

    def places(items: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, items)
        at[at == len(shared)] = 0
        hit = shared[at] == items
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    (cx, rx), (cy, ry) = places(xs, rows_x), places(ys, rows_y)
    for c in range(0, len(shared), 8192):
        width = min(8192, len(shared) - c)
        ax, ay = np.zeros((len(x), width), dtype=np.float32), np.zeros((len(y), width), dtype=np.float32)
        for m, col, row in ((ax, cx, rx), (ay, cy, ry)):
            lo, hi = np.searchsorted(col, [c, c + width])
            m[row[lo:hi], col[lo:hi] - c] = 1
        out += ax @ ay.T
    return out


class Forest:
    """Union and find over numbers; the larger root wins."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (n := up.get(r, r)) != r:
            r = n
        while (n := up.get(x, x)) != r:
            up[x], x = r, n
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[min(a, b)] = max(a, b)


def fingerprint(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


SET_SCHEMA = "doc_id bigint, text_key bigint, size int, fingerprint binary, bands binary, bytes binary"


def sketched(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash of the text, number of n-grams, fingerprint of the set (null for an empty set) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prints, bands, low = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                if len(s):
                    x, y = sketch(minhashes(s))
                    prints.append(fingerprint(s))
                    bands.append(x.tobytes())
                    low.append(y.tobytes())
                else:
                    for out in (prints, bands, low):
                        out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (prints, bands, low))], ["doc_id", "text_key", "size", "fingerprint", "bands", "bytes"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, SET_SCHEMA)


def _band_keys(classes: DataFrame) -> DataFrame:
    """node, key: one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS).astype(np.int64) | number
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "key"])

    return classes.select("node", "bands").mapInArrow(run, "node bigint, key bigint")


#: Rounds after which components() gives up with an error; a component of n nodes takes about log n of them.
ROUNDS = 200


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the largest number of its component) for all nodes of edges (a, b).

    Large-star and small-star take turns: first every node's smaller neighbours are tied to the largest number in its
    neighbourhood, then every node and its larger neighbours are tied to the largest of these. Neither parts nor joins
    components; in the end each is a star around its root. Rounds grow with the logarithm of a component's nodes, not
    with its diameter. Each round is written to the shared folder.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(links, f"{name}-0")
    for k in range(1, ROUNDS + 1):
        # nodes with more than one larger neighbour, or with larger and smaller ones
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 OR up > 0 AND down > 0").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        total = max(1, links.count())
        largest = links.select(F.col("a").alias("b"), F.col("b").alias("top"), F.lit(0).alias("below")).unionByName(links.select("b", F.col("b").alias("top"), F.lit(1).alias("below")))
        largest = largest.groupBy("b").agg(F.max("top").alias("top"), F.sum("below").alias("below")).filter("below > 0")
        large = materialize(join_uneven(links, largest, "b", "below", total).select("a", F.col("top").alias("b")).distinct(), f"{name}-{k}-large")
        highest = materialize(large.groupBy("a").agg(F.max("b").alias("top"), F.count(F.lit(1)).alias("above")), f"{name}-{k}-highest")
        small = join_uneven(large, highest, "a", "above", max(1, large.count())).select(F.col("b").alias("a"), F.col("top").alias("b")).filter("a <> b")
        old, links = links, materialize(small.unionByName(highest.select("a", F.col("top").alias("b"))).distinct(), f"{name}-{k}")
        discard(old, large, highest)
    raise RuntimeError(f"components of {name} aren't finished after {ROUNDS} rounds")


LINK_SCHEMA = "a bigint, b bigint, texts bigint, docs bigint, edge boolean"


def _links(found: dict[int, list[int]], forest: Forest) -> pa.RecordBatch:
    """Numbers of links of each class, and the forest's edges."""
    nodes = list(found)
    edges = [(x, forest.root(x)) for x in list(forest.up)]
    edges = [(x, r) for x, r in edges if x != r]
    return pa.RecordBatch.from_arrays(
        [pa.array([*nodes, *(e[0] for e in edges)], pa.int64()), pa.array([None] * len(nodes) + [e[1] for e in edges], pa.int64()), pa.array([*(found[x][0] for x in nodes), *(0 for _ in edges)], pa.int64()), pa.array([*(found[x][1] for x in nodes), *(0 for _ in edges)], pa.int64()), pa.array([False] * len(nodes) + [True] * len(edges), pa.bool_())],
        ["a", "b", "texts", "docs", "edge"],
    )


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and its set (bytes) for the classes in wanted (node, rep, print: the set's fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, n) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["print", "items"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text"))
    # the list of classes grows with the input, so it is never broadcast: the plan is the same at every size
    found = texts.join(wanted.select("rep").distinct().hint("merge"), "rep", "left_semi").select("text").mapInArrow(run, "print binary, items binary").dropDuplicates(["print"])
    return found.join(wanted.select("node", "print"), "print").drop("print")


def similar_classes(docs: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """LINK_SCHEMA rows over classes (node, rep, print, size, copies, bands, bytes): numbers of links to be added up, and edges."""
    keys = materialize(_band_keys(classes), "bands")
    members = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("node").alias("top")).filter("members > 1")
    members = materialize(members, "band-members")
    live = materialize(join_uneven(keys, members, "key", "members", max(1, keys.count())).filter("members IS NOT NULL"), "live-bands")

    # Clusters of bands with many classes.
    dense = live.filter(F.col("members") > DENSE)
    clusters = components(dense.select(F.col("node").alias("a"), F.col("top").alias("b")), "clusters").withColumnRenamed("root", "cluster")
    clusters = materialize(clusters, "clusters")

    # Pairs of the other bands, with the sketches; of a band's members each meets the later ones.
    sparse = live.filter(F.col("members") <= DENSE).join(clusters, "node", "left").select("key", "node", "cluster")
    other = sparse.select("key", F.col("node").alias("b"), F.col("cluster").alias("b_cluster"))
    pairs = sparse.withColumnRenamed("node", "a").join(other, "key").filter("a < b AND NOT (cluster <=> b_cluster AND cluster IS NOT NULL)").select("a", "b").distinct()
    small = classes.select("node", "bytes")
    pairs = pairs.join(small.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a").join(small.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b")

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, VALUES) for c in ("x", "y"))
                stay = pa.array(prune(x, y, threshold))
                yield b.select(["a", "b"]).filter(stay)

    likely = materialize(pairs.mapInArrow(pruned, "a bigint, b bigint"), "likely-pairs")
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).unionByName(clusters.select("node")).distinct()
    wanted = materialize(classes.select("node", "rep", "print", "copies", "size").join(nodes, "node"), "wanted-classes")
    sets = materialize(_sets_of(docs, wanted, n).join(wanted.select("node", "copies"), "node"), "sets")

    def side(c: str) -> DataFrame:
        return sets.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items"), F.col("copies").alias(f"{c}_copies"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list[int]] = {}
            forest = Forest()
            for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "a_items", "b_items", "a_copies", "b_copies")), strict=True):
                x, y = np.frombuffer(r[2], dtype=np.uint64), np.frombuffer(r[3], dtype=np.uint64)
                if reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold):
                    for node, copies in ((r[0], r[5]), (r[1], r[4])):
                        had = found.setdefault(node, [0, 0])
                        had[0] += 1
                        had[1] += copies
                    forest.join(r[0], r[1])
            yield _links(found, forest)

    from_pairs = likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(verify, LINK_SCHEMA)

    # Size cells of the clusters, and their blocks. A cell is so wide that a set is at the threshold to the next cell's at most.
    width = -float(np.log(threshold)) * (1 + 1e-9)
    placed = clusters.join(wanted.select("node", "size"), "node").withColumn("cell", F.floor(F.log(F.col("size").cast("double")) / width).cast("int"))
    placed = materialize(placed.withColumn("at", F.concat_ws(":", "cluster", "cell")), "size-cells")
    cells = placed.groupBy("cluster", "cell", "at").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    near = Window.partitionBy("cluster").orderBy("cell")  # as many rows as sizes have logarithms
    below = F.when(F.lag("cell").over(near) == F.col("cell") - 1, F.lag("blocks").over(near)).otherwise(0)
    above = F.when(F.lead("cell").over(near) == F.col("cell") + 1, F.lead("blocks").over(near)).otherwise(0)
    cells = materialize(cells.select("at", "members", "blocks", below.alias("below"), above.alias("above")), "cells")
    dealt = join_uneven(placed, cells, "at", "members", max(1, placed.count())).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def units(count: str, low: Column, high: Column) -> Column:
        """Units with each of the blocks of a cell, as (lower cell, its block, the other cell's block, cells apart)."""
        numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.struct((F.col("cell") + low).alias("lower"), F.when(high == 0, F.least(F.col("block"), i)).when(low < 0, i).otherwise(F.col("block")).alias("low"), F.when(high == 0, F.greatest(F.col("block"), i)).when(low < 0, F.col("block")).otherwise(i).alias("high"), high.alias("apart")))

    each = F.concat(units("blocks", F.lit(0), F.lit(0)), units("above", F.lit(0), F.lit(1)), units("below", F.lit(-1), F.lit(1)))
    dealt = dealt.withColumn("unit", F.explode(each)).select("node", "cluster", "cell", "block", "unit.lower", "unit.low", "unit.high", "unit.apart")

    def block(t: pa.Table) -> pa.Table:
        lower, low, high, apart = (t[c][0].as_py() for c in ("lower", "low", "high", "apart"))
        cell, at = t["cell"].to_numpy(), t["block"].to_numpy()
        nodes, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        raw = np.frombuffer(b"".join(t["bytes"].to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
        bands = np.frombuffer(b"".join(t["bands"].to_pylist()), dtype=np.uint32).reshape(-1, BANDS)
        first, second = np.flatnonzero((at == low) & (cell == lower)), np.flatnonzero((at == high) & (cell == lower + apart))
        found: dict[int, list[int]] = {}
        forest = Forest()
        if len(first) and len(second):
            shared = np.zeros((len(first), len(second)), dtype=bool)
            for k in range(BANDS):
                shared |= bands[first, k][:, None] == bands[second, k][None, :]
            i, j = np.nonzero(np.triu(shared, 1) if low == high and not apart else shared)
            stay = prune(raw[first[i]], raw[second[j]], threshold)
            i, j = i[stay], j[stay]
            if len(i):
                x, y = np.unique(i), np.unique(j)
                items = t["items"].take(pa.array(np.union1d(first[x], second[y]))).to_pylist()
                items = dict(zip(np.union1d(first[x], second[y]).tolist(), (np.frombuffer(v, dtype=np.uint64) for v in items), strict=True))
                a, b = [items[k] for k in first[x].tolist()], [items[k] for k in second[y].tolist()]
                p, q = np.searchsorted(x, i), np.searchsorted(y, j)
                common = common_counts(a, b)[p, q]
                linked = reaches(common, np.array([len(v) for v in a])[p], np.array([len(v) for v in b])[q], threshold)
                p, q = first[i[linked]], second[j[linked]]
                texts, docs_n = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
                for u, v in ((p, q), (q, p)):
                    np.add.at(texts, u, 1)
                    np.add.at(docs_n, u, copies[v])
                found = {int(nodes[k]): [int(texts[k]), int(docs_n[k])] for k in np.flatnonzero(texts)}
                for a, b in zip(nodes[p].tolist(), nodes[q].tolist(), strict=True):
                    forest.join(a, b)
        return pa.Table.from_batches([_links(found, forest)])

    whole = sets.join(classes.select("node", "bands", "bytes").join(clusters.select("node"), "node"), "node")
    from_blocks = dealt.join(whole, "node").groupBy("cluster", "lower", "low", "high", "apart").applyInArrow(block, LINK_SCHEMA)
    links = materialize(from_pairs, "pair-links").unionByName(materialize(from_blocks, "block-links"))
    discard(keys, members, live, clusters, likely, wanted, sets, placed, cells)
    return links


def judged_rows(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, root (number of the group; null without n-grams), class_id, text_links, links of every row of docs."""
    rows = materialize(sketched(docs, n), "sketches")
    total = rows.count()
    usable = rows.filter(F.col("fingerprint").isNotNull() & F.col("doc_id").isNotNull())
    grouped = usable.groupBy("fingerprint").agg(F.max("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "bands", "bytes")))
    classes = materialize(grouped.withColumnRenamed("fingerprint", "print").withColumn("node", F.monotonically_increasing_id()), "classes")
    links = similar_classes(docs, classes, n, threshold)
    roots = materialize(components(links.filter("edge").select("a", "b"), "groups"), "roots")
    counts = links.filter("NOT edge").groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    known = classes.select("node", "rep", "print", "copies").join(roots, "node", "left").join(counts.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known, "known-classes")
    tops = known.groupBy("root").agg(F.max("rep").alias("class_id"), F.count(F.lit(1)).alias("classes"))
    known = join_uneven(known, tops, "root", "classes", max(1, known.count())).select(F.col("print").alias("fingerprint"), "copies", "root", "class_id", F.coalesce("texts", F.lit(0)).alias("text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = materialize(known, "known")
    narrow = rows.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint"))
    out = join_uneven(narrow, known, "fingerprint", "copies", total)
    return out.select("doc_id", "text_key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_links", F.lit(0)).cast("bigint").alias("text_links"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, text_links, links of every row of docs (doc_id, text)."""
    return judged_rows(docs, n, threshold).select("doc_id", "class_id", "text_links", "links")


def one_of_each(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class the row with the largest doc_id stays, of two texts with that id one; rows
    that repeat id and text are one document, which stays once; all columns stay, whatever their names."""
    row_key, kept_key = fresh(docs, 2)

    def key(doc_id: Column, text_key: Column) -> Column:
        return F.concat_ws(":", text_key.cast("string"), doc_id.cast("bigint").cast("string"))

    rows = judged_rows(docs, n, threshold)
    # rows without a group are groups by themselves, known by their key
    group = F.coalesce(F.col("root").cast("string"), F.concat(F.lit("="), key(F.col("doc_id"), F.col("text_key"))))
    kept = rows.filter("root IS NULL OR doc_id = class_id").groupBy(group.alias("group")).agg(F.min(key(F.col("doc_id"), F.col("text_key"))).alias(kept_key)).select(kept_key)
    once = docs.withColumn(row_key, key(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))).dropDuplicates([row_key])
    return once.join(kept.distinct().hint("merge"), F.col(row_key) == F.col(kept_key), "left_semi").drop(row_key)
