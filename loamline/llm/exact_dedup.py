"""Exact dedup over a sharded minimal perfect hash of the digests seen so far.

A document is known by the SHA-256 of its text. Distinct digests are dealt to shards; each shard holds a minimal
perfect hash (levels of bit arrays, the collisions of one level go to the next), whose slots hold the full digest, the
winner's id, a locator of the winner's row, and the group's size. A table is taken in batches. The digests of a batch are
looked up in the hash over all earlier ones: a lookup computes the slot and then compares all 32 bytes, so digests that
aren't in the index are told apart from members. Members are repeats and only change their slot's winner and size; nonmembers
are groups by themselves and go, with the members, into the next index, which always holds old and new digests. In
the end the digests of the table are looked up in the last index, and every row is judged by its digest's slot. Rows are
grouped before they meet the index, so a task sees the digests of a shard, however many rows repeat them.

Defined results: a null text counts as empty, an empty text equals other empty ones; texts are compared whole, whatever their
length; of equal texts the row with the largest doc_id stays, a null doc_id is smaller than any other; of rows that repeat both
text and doc_id exactly one is kept, and none if an earlier table had that row; an empty table gives no rows and leaves the
history as it is; other columns, whatever their names, are neither needed nor touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_uneven, materialize, partitions

#: Bits a key in each level of the hash, and levels at most; keys left after the last level are found by bisection.
GAMMA, LEVELS = 1.5, 24
#: Distinct digests a shard holds on average at most.
SHARD_KEYS = 16_384

INDEX_SCHEMA = "shard int, shards int, sizes array<int>, bits binary, slots binary, winners array<bigint>, locators array<bigint>, counts array<bigint>"
GROUP_SCHEMA = "digest binary, winner bigint, locator bigint, size bigint"
#: The locator of a winner that isn't a row of the table at hand, but of an earlier one.
ELSEWHERE = -1


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a digest falls in a level: its bytes are uniform, so a word of it, turned by the level, serves as the hash."""
    turn = np.uint64(7 * (level // 4) + 1)
    w = words[:, level % 4]
    return ((w >> turn) ^ (w << (np.uint64(64) - turn))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        flat = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: sum(sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flat = flat
        self.rank = np.cumsum(flat, dtype=np.int64) - flat

    @classmethod
    def build(cls, words: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and each key's slot."""
        left, sizes, chunks = np.arange(len(words)), [], []
        found: list[np.ndarray] = []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = _place(words[left], level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            chunks.append(bits)
            order = np.argsort(at[alone], kind="stable")
            found.append(left[alone][order])
            left = left[~alone]
        if len(left):  # next to impossible for distinct digests
            found.append(left[np.lexsort(words[left].T)])
        flat = np.concatenate(chunks) if chunks else np.zeros(0, dtype=np.uint8)
        keys = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        slots = np.empty(len(words), dtype=np.int64)
        slots[keys] = np.arange(len(keys))
        return cls(sizes, np.packbits(flat).tobytes()), slots

    def packed(self) -> bytes:
        return np.packbits(self.flat).tobytes()

    def slot(self, words: np.ndarray) -> np.ndarray:
        """A slot for each digest, -1 where no level has one."""
        out, left = np.full(len(words), -1, dtype=np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(words[left], level, size).astype(np.int64) + self.starts[level]
            hit = self.flat[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


class Shard:
    """One shard of the index: lookups are checked byte for byte."""

    def __init__(self, sizes, bits, slots, winners, locators, counts):
        self.hash, self.slots = PerfectHash(sizes, bits), np.frombuffer(slots, dtype="<u8").reshape(-1, 4)
        self.winners, self.locators, self.counts = winners, locators, counts
        self.tail = int(self.hash.flat.sum())

    @classmethod
    def build(cls, digests: list[bytes], winners: list[int | None], locators: list[int], counts: list[int]) -> Shard:
        words = _words(digests)
        found, slot = PerfectHash.build(words)
        order = np.argsort(slot)
        return cls(found.sizes, found.packed(), words[order].tobytes(), *([x[i] for i in order] for x in (winners, locators, counts)))

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The slots that hold these digests, -1 for nonmembers."""
        if not digests or not len(self.slots):
            return np.full(len(digests), -1, dtype=np.int64)
        words = _words(digests)
        at = self.hash.slot(words)
        same = (self.slots[at] == words).all(axis=1) & (at >= 0)
        for i in np.flatnonzero(~same) if self.tail < len(self.slots) else ():
            hit = np.flatnonzero((self.slots[self.tail :] == words[i]).all(axis=1))
            if len(hit):
                at[i], same[i] = self.tail + hit[0], True
        return np.where(same, at, -1)

    def digests(self) -> list[bytes]:
        raw = self.slots.tobytes()
        return [raw[i : i + 32] for i in range(0, len(raw), 32)]

    def extended(self, digests: list[bytes], winners: list[int | None], locators: list[int], counts: list[int]) -> Shard:
        """The shard with more groups: members change their slot (of equal winners the earlier one stays), nonmembers get one."""
        at = self.find(digests)
        own = [list(x) for x in (self.winners, self.locators, self.counts)]
        for i in np.flatnonzero(at >= 0).tolist():
            k = at[i]
            if winners[i] is not None and (own[0][k] is None or winners[i] > own[0][k]):
                own[0][k], own[1][k] = winners[i], locators[i]
            own[2][k] += counts[i]
        new = np.flatnonzero(at < 0).tolist()
        if not new:
            return Shard(self.hash.sizes, self.hash.packed(), self.slots.tobytes(), *own)
        return Shard.build(self.digests() + [digests[i] for i in new], *(x + [y[i] for i in new] for x, y in zip(own, (winners, locators, counts), strict=True)))

    def row(self, shard: int, shards: int) -> dict:
        return {"shard": shard, "shards": shards, "sizes": self.hash.sizes, "bits": self.hash.packed(), "slots": self.slots.tobytes(), "winners": self.winners, "locators": self.locators, "counts": self.counts}


_INDEX = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("slots", pa.binary()), ("winners", pa.list_(pa.int64())), ("locators", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and a number (row) of every row, once the table is written."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """digest, winner, its row, size of each group; combined before the shuffle, so a group of any size sends a row a task."""
    found = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size"))
    return found.select("digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("locator"), "size")


def _with_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _shard_of(index: pa.Table) -> Shard | None:
    if not index.num_rows:
        return None
    r = index.slice(0, 1).to_pylist()[0]
    return Shard(r["sizes"], r["bits"], r["slots"], r["winners"], r["locators"], r["counts"])


def _columns(t: pa.Table) -> list[list]:
    return [t[c].to_pylist() for c in ("digest", "winner", "locator", "size")]


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def extend_index(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The index that holds the digests of index (of as many shards) and those of groups (each digest once)."""

    def extend(new: pa.Table, old: pa.Table) -> pa.Table:
        shard = _shard_of(old)
        number = (new if new.num_rows else old)["shard"][0].as_py()
        if not new.num_rows:
            return old.select(_INDEX.names).cast(_INDEX)
        shard = shard.extended(*_columns(new)) if shard else Shard.build(*_columns(new))
        return pa.Table.from_pylist([shard.row(number, shards)], schema=_INDEX)

    return _with_shard(groups, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(extend, INDEX_SCHEMA)


def index_groups(index: DataFrame) -> DataFrame:
    """The groups that an index holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = _shard_of(pa.Table.from_batches([b.slice(i, 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(s.digests(), pa.binary()), *(pa.array(x, pa.int64()) for x in (s.winners, s.locators, s.counts))], ["digest", "winner", "locator", "size"])

    return index.mapInArrow(run, GROUP_SCHEMA)


def group_facts(groups: DataFrame, index: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """digest, winner, locator and size in the index of each group, whether history (an index of as many shards) knew it
    (seen), and its size in groups (here). A task sees the digests of a shard, not the rows."""

    def look(new: pa.Table, old: pa.Table) -> pa.Table:
        digests, _, _, sizes = _columns(new)
        found = {}
        for r in old.to_pylist() if digests else ():
            found[r["early"]] = Shard(r["sizes"], r["bits"], r["slots"], r["winners"], r["locators"], r["counts"])
        shard, none = found.get(False), np.full(len(digests), -1)
        at = shard.find(digests) if shard else none
        if (at < 0).any():
            raise ValueError("a digest isn't in the index")
        seen = found[True].find(digests) >= 0 if True in found else none >= 0
        return pa.table({"digest": pa.array(digests, pa.binary()), "winner": pa.array([shard.winners[k] for k in at], pa.int64()), "locator": pa.array([shard.locators[k] for k in at], pa.int64()), "size": pa.array([shard.counts[k] for k in at], pa.int64()), "seen": pa.array(seen, pa.bool_()), "here": pa.array(sizes, pa.int64())})

    both = index.withColumn("early", F.lit(False)).unionByName(history.withColumn("early", F.lit(True)))
    return _with_shard(groups, shards).groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(look, GROUP_SCHEMA + ", seen boolean, here bigint")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, index): every row of docs with keep_id, group_size, kept and seen; and the index that the next table takes as history.

    history: an index that an earlier call returned; its documents count in the groups and can win, so a new row that
    repeats an earlier document with a larger id isn't kept. seen: whether the text was in the index when the row's batch
    came. shards: of the index; by default as many as history has, or more once its shards have grown too large; it is
    dealt anew where the number changes. batches: docs are taken in so many, by a hash of the id.
    """
    spark = docs.sparkSession
    rows = materialize(text_digests(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "digests")
    total = rows.count()
    had, keys = 0, 0
    if history is not None:
        first = history.agg(F.max("shards"), F.min("shards"), F.sum(F.size("winners"))).first()
        had, keys = first[0] or 0, first[2] or 0
        if had != (first[1] or 0):
            raise ValueError("the shards of the history belong to different indexes")
    if not shards:
        shards = had or max(4 * partitions(spark), -(-total // SHARD_KEYS))
        if keys + total > 4 * SHARD_KEYS * shards:
            shards = -(-(keys + total) // SHARD_KEYS)
    index = empty_index(spark)
    if had:
        old = index_groups(history).withColumn("locator", F.lit(ELSEWHERE).cast("bigint"))
        index = materialize(extend_index(old, index, shards), "digest-index")
    groups = materialize(rows.groupBy("batch", "digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size")).select("batch", "digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("locator"), "size"), "digest-groups")
    facts = None
    before = []
    for k in range(batches):
        before.append(index)
        index = materialize(extend_index(groups.filter(F.col("batch") == k).drop("batch"), index, shards), "digest-index")
    for k in range(batches):
        own = group_facts(groups.filter(F.col("batch") == k).drop("batch"), index, before[k], shards).withColumn("batch", F.lit(k))
        facts = own if facts is None else facts.unionByName(own)
    # a digest may be in several batches; a row is judged by what its own batch met
    key = F.concat(F.col("digest"), F.col("batch").cast("string").cast("binary")).alias("key")
    facts = materialize(facts.select(key, "winner", "locator", "size", "seen", "here"), "digest-facts")
    out = join_uneven(rows.select(key, "doc_id", "digest", "row"), facts, "key", "here", max(1, total))
    return out.select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), (F.col("locator") == F.col("row")).alias("kept"), "seen"), index


def drop_repeats(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; all columns stay, whatever their names.

    Rows are known by digest and id. Rows that repeat both are brought down to one where they lie before anything is
    shuffled, so texts go through one shuffle, in which no key is hot.
    """
    row_key, kept_key = fresh(docs, 2)

    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat(digest, F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")).cast("binary"))

    kept = exact_dedup(docs, history, id_col=id_col, text_col=text_col)[0].filter("kept").select(key(F.col("doc_id"), F.col("digest")).alias(kept_key))
    once = docs.withColumn(row_key, key(F.col(id_col), digest_of(F.col(text_col)))).dropDuplicates([row_key])
    return once.join(kept.hint("merge"), F.col(row_key) == F.col(kept_key), "left_semi").drop(row_key)
