"""Packing of token sequences whose mixture is controlled by deficit round-robin.

Documents are tokenised once. The targets fix a schedule for the whole corpus: how many tokens of each source the first g
packed tokens hold, for every g (a source that runs dry leaves its share to the others). The schedule is cut into parts of
a bounded number of tokens, and every document is dealt to the part that holds its place in its source's queue (cut where
a part ends), so each part gets from each source what the schedule says, to the token. What rounding at a part's
beginning leaves a source owed or in debt is its deficit there, so deficits carry on from part to part without running
the parts in turn. In a part there is a queue for each source, and window after window of 2048 tokens is filled: each
source earns its target share of the window, sources are served in turn, whole tokens of what they are owed, and what is
left over goes into the next window. The credit of a window always equals its space: what a source that ran dry was owed
goes to the others by their shares. Sources that are owed less than a quantum wait, so that a small share isn't served
crumbs. Every token is packed. A part's last, unfull window is cut into sequences of powers of two, which need no padding.

Defined results: a null text counts as empty, its document is the end token alone; a null source is a source of its own;
repeated rows and rows without a doc_id are packed each; very long texts are cut over as many windows and parts as they
need; documents of a source follow one another in the order of the table; an empty table gives no rows; other columns,
whatever their names, aren't needed. Without targets every window follows the corpus's own shares; sources that targets
don't name (or give nothing) come after all others have run dry, by their own shares.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, running

#: Tokens in a sequence, the least number served to a source in a turn, the id that ends a document.
LENGTH, QUANTUM, END = 2048, 8, 1
#: Tokens in a packing part, about.
PART_TOKENS = 2_000_000
#: Tokens of a window that may go to what sources are owed from before the first window; the rest is carried on.
ARREARS = LENGTH // 20
#: Text between white space of this many characters is left to the slower tokenizer, whose time doesn't grow with the square.
LONG_PIECE = 2000
#: White space by one definition or another; a text with such characters is encoded whole.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_known: dict[str, tuple] = {}


def _fast_merges(path: str):
    """The byte-level merges in path for tiktoken, which runs them several times as fast with the same ids; None where
    ids aren't in the order of the merges or the words are split by another pattern."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, split = given["model"], given.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or given.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in given.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ordered = [model["vocab"][m] for m in merges]
    if ordered != sorted(ordered) or len(ranks) != 256 + len(set(merges)) or max(ranks[bytes([b])] for b in range(256)) > ordered[0]:
        return None
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("merges", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def tokenizer_of(path: str) -> tuple:
    """The tokenizer in path, its fast merges, its special tokens, and the type its ids fit into; loaded once a worker."""
    if path not in _known:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _known[path] = (tok, _fast_merges(path), [t.content for t in tok.get_added_tokens_decoder().values()], "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
    return _known[path]


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, as unsigned little-endian numbers of 16 bits where the vocabulary allows that, else of 32.

    The fast merges do the work; texts with special tokens, with characters that only some call white space, or with a
    very long piece go through the tokenizer itself.
    """
    tok, fast, special, kind = tokenizer_of(path)
    out: list[np.ndarray | None] = [None] * len(texts)
    slow = []
    for i, t in enumerate(texts):
        if fast is None or any(c in t for c in (_ODD[:4] if t.isascii() else _ODD)) or any(c in t for c in special) or len(t) > LONG_PIECE and max(map(len, t.split()), default=LONG_PIECE) >= LONG_PIECE:
            slow.append(i)
        else:
            out[i] = np.array(fast.encode_ordinary(t), dtype=kind)
    for i, e in zip(slow, tok.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, dtype=kind)
    return out


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, doc_tokens and ids (with the end token) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                found = encode(path, [t or "" for t in b.column(2).to_pylist()])
                ids = [x.tobytes() + np.array([END], dtype=x.dtype).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) + 1 for x in found], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "doc_tokens", "ids"])

    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    needed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source.alias("source"), F.col(text_col).cast("string").alias("text"))
    return needed.mapInArrow(run, "doc_id bigint, source string, doc_tokens bigint, ids binary")


class Schedule:
    """Which tokens of a source belong to which part.

    total: tokens of all sources. named: tokens of each source with a target. targets: their shares. A place in a source's
    queue is told by the number of its tokens before it.
    """

    def __init__(self, total: int, length: int, named: dict[str | None, int] | None = None, targets: dict[str | None, float] | None = None):
        self.total, self.length = total, length
        self.targets = {s: t for s, t in (targets or {}).items() if t > 0 and (named or {}).get(s)}
        self.knots = {s: ([0.0], [0.0]) for s in self.targets}  # tokens of all sources, tokens of this one
        left, at = {s: float(named[s]) for s in self.targets}, 0.0
        while left:
            share = sum(self.targets[s] for s in left)
            step = min(n * share / self.targets[s] for s, n in left.items())
            at += step
            for s in list(left):
                had = self.knots[s][1][-1] + step * self.targets[s] / share
                left[s] -= step * self.targets[s] / share
                dry = left[s] <= 1e-6 * max(1.0, step)
                self.knots[s][0].append(at)
                self.knots[s][1].append(float(named[s]) if dry else had)
                if dry:
                    del left[s]
        self.others = sum(named[s] for s in self.targets) if self.targets else 0  # where the sources without a target begin

    def cut(self, source: str | None, whole: int, part: int) -> tuple[int, float]:
        """Tokens of a source (whole of them in all) before a part, and what the source is owed there by rounding."""
        g = part * self.length
        if source in self.knots:
            exact = float(np.interp(g, *self.knots[source]))
            n = min(whole, int(exact + 0.5)) if g < self.knots[source][0][-1] else whole
            return n, exact - n if n < whole else 0.0
        rest, g = self.total - self.others, min(max(g - self.others, 0), self.total - self.others)
        n = (2 * g * whole + rest) // (2 * rest)
        return n, g * whole / rest - n

    def part(self, source: str | None, whole: int, place: int) -> int:
        """The part that holds a place."""
        if source in self.knots:
            g = float(np.interp(place, self.knots[source][1], self.knots[source][0]))
        else:
            g = self.others + place * (self.total - self.others) // whole
        k = int(g) // self.length
        while self.cut(source, whole, k + 1)[0] <= place:
            k += 1
        while k and self.cut(source, whole, k)[0] > place:
            k -= 1
        return k


def fill(queues: dict[str | None, deque], shares: dict[str | None, float], deficits: dict[str | None, float], rest: dict[str | None, float] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, window, offset) that empty the queues of [row, start, tokens left].

    shares: targets of a window. rest: shares of the sources without a target, which come when all others are dry.
    deficits: what sources are owed before the first window (or owe, if negative), and at the end after the last one.
    What is owed at the beginning is settled by at most ARREARS tokens a window.
    """
    left = {s: sum(d[2] for d in q) for s, q in queues.items()}
    turn = deque(sorted((s for s, n in left.items() if n), key=lambda s: (s is None, s or "")))
    credit = dict.fromkeys(turn, 0.0)
    arrears = {s: deficits.get(s, 0.0) for s in turn}
    window = 0
    while turn:
        got: dict[str | None, int] = {}
        space, first = LENGTH, True
        while space:
            live = [s for s in turn if left[s] and shares.get(s, 0.0) > 0] or [s for s in turn if left[s]]
            if not live:
                break
            weight = {s: shares.get(s, 0.0) or (rest or {}).get(s) or 1e-9 for s in live}
            if first:
                scale = min(1.0, ARREARS / max(1e-9, sum(abs(arrears[s]) for s in live)))
                for s in live:
                    credit[s] += arrears[s] * scale
                    arrears[s] -= arrears[s] * scale
            gap = (space - sum(credit[s] for s in live)) / sum(weight.values())
            for s in live:
                credit[s] += gap * weight[s]
            for s in live if first else ():  # what each is owed, in whole tokens
                n = min(int(credit[s] + 1e-9), left[s], space)
                if n >= min(QUANTUM, left[s]) and n > 0:
                    got[s] = n
                    credit[s], left[s], space = credit[s] - n, left[s] - n, space - n
            for s in sorted((s for s in live if left[s]), key=lambda s: -credit[s]):  # what is left over, to those owed most
                if not space:
                    break
                n = min(space, left[s], max(int(credit[s] + 1e-9), QUANTUM))
                got[s] = got.get(s, 0) + n
                credit[s], left[s], space = credit[s] - n, left[s] - n, space - n
            first = False
        offset = 0
        for s, n in got.items():
            queue = queues[s]
            while n:
                row, start, have = queue[0]
                take = min(have, n)
                yield row, start, take, window, offset
                offset, n = offset + take, n - take
                if take == have:
                    queue.popleft()
                else:
                    queue[0] = [row, start + take, have - take]
        window += 1
        turn.rotate(-1)
        if not all(left[s] for s in got):
            turn = deque(s for s in turn if left[s])
    deficits.update({s: credit[s] + arrears[s] for s in credit})


def _cut_tail(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The pieces of a last, unfull window dealt to sequences of powers of two."""
    total = sum(p[2] for p in pieces)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, k, offset = [], 0, 0
    first = pieces[0][3] if pieces else 0
    for row, start, n, _, _ in pieces:
        while n:
            take = min(n, sizes[k] - offset)
            out.append((row, start, take, first + k, offset))
            start, n, offset = start + take, n - take, offset + take
            if offset == sizes[k]:
                k, offset = k + 1, 0
    return out


PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, ids binary"
DEALT_SCHEMA = "part bigint, doc_id bigint, source string, doc_tokens bigint, start bigint, place bigint, whole bigint, ids binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _key(source: str = "source"):
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def pack(docs: DataFrame, path: str, targets: dict[str | None, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents. targets: the share of tokens of each source in a window; by default the corpus's own."""
    spark = docs.sparkSession
    rows = materialize(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    parts = max(partitions(spark), -(-total // PART_TOKENS))
    length = max(1, -(-total // (parts * LENGTH))) * LENGTH
    # rows are dealt to buckets evenly, whatever their ids; a bucket's tokens of a source follow those of the buckets before
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = materialize(rows.groupBy("bucket", _key().alias("key")).agg(F.sum("doc_tokens").alias("n")), "bucket-counts")
    starts = running(counts, "key", "bucket", "n", parts)
    named = None
    if targets:
        keys = {"" if s is None else f"={s}": s for s in targets}
        named = {keys[r["key"]]: r["n"] for r in counts.filter(F.col("key").isin(list(keys))).groupBy("key").agg(F.sum("n").alias("n")).collect()}  # as many as there are targets
    plan = Schedule(total, length, named, targets)
    kind = tokenizer_of(path)[3]
    width = np.dtype(kind).itemsize

    def deal(new: pa.Table, old: pa.Table) -> pa.Table:
        at = dict(zip(old["key"].to_pylist(), zip(old["before"].to_pylist(), old["whole"].to_pylist(), strict=True), strict=True))
        place = {k: v[0] for k, v in at.items()}
        new = new.sort_by("row")
        out = [[] for _ in range(8)]
        for doc_id, source, n, ids in zip(*(new[c].to_pylist() for c in ("doc_id", "source", "doc_tokens", "ids")), strict=True):
            key = "" if source is None else f"={source}"
            whole, begin, start = at[key][1], place[key], 0
            place[key] += n
            part = plan.part(source, whole, begin)
            while start < n:
                end = min(n, plan.cut(source, whole, part + 1)[0] - begin)
                if end > start:
                    for c, v in zip(out, (part, doc_id, source, n, start, begin + start, whole, ids[start * width : end * width]), strict=True):
                        c.append(v)
                    start = end
                part += 1
        schema = _arrow(DEALT_SCHEMA)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(t: pa.Table) -> pa.Table:
        schema = _arrow(PIECE_SCHEMA)
        t = t.sort_by([("source", "ascending"), ("place", "ascending")])
        part, sources, wholes, begins = t["part"][0].as_py(), t["source"].to_pylist(), t["whole"].to_pylist(), t["start"].to_numpy()
        raw = t["ids"].to_pylist()
        queues: dict[str | None, deque] = {}
        rest, owed = {}, {}
        for i, (s, w) in enumerate(zip(sources, wholes, strict=True)):
            if s not in queues:
                queues[s] = deque()
                owed[s] = plan.cut(s, w, part)[1]
                if s not in plan.targets:
                    rest[s] = float(w)
            queues[s].append([i, 0, len(raw[i]) // width])
        full = sum(map(len, raw)) // width // LENGTH
        pieces = list(fill(queues, plan.targets, owed, rest))
        cut = next((i for i, p in enumerate(pieces) if p[3] >= full), len(pieces))
        pieces[cut:] = _cut_tail(pieces[cut:])
        which, start, length, seq, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
        crcs, cuts = [], []
        for r, a, n in zip(which.tolist(), start.tolist(), length.tolist(), strict=True):
            ids = np.frombuffer(raw[r], dtype=kind, count=n, offset=a * width).astype("<u4").tobytes()
            crcs.append(zlib.crc32(ids))
            cuts.append(ids if with_ids else None)
        take = pa.array(which)
        return pa.Table.from_arrays(
            [t["doc_id"].take(take).combine_chunks(), pa.array(start + begins[which]), pa.array(length), pa.array(crcs, pa.int64()), t["doc_tokens"].take(take).combine_chunks(), pa.array(seq + (part << 32)), pa.array(offset), t["source"].take(take).combine_chunks(), pa.array(cuts, pa.binary())],
            schema=schema,
        )

    dealt = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(deal, DEALT_SCHEMA)
    return dealt.groupBy("part").applyInArrow(run, PIECE_SCHEMA)
