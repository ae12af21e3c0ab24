"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Four machines are compiled from the model file into tables of arcs:

- the normaliser: the character map (a trie of bytes with outputs; the longest match is rewritten, anything else copied), and
  the states for white space (in front, after a space, elsewhere) that drop, squeeze and mark spaces;
- the pieces: a trie of characters, whose final states write a piece's id;
- byte fallback: for a character that is no piece, arcs that write the ids of its bytes (or the unknown id);
- the order of merges (merge models): its state is the last piece; an arc to a next piece weighs 0 if the two stay as they
  are beside each other and infinity if merging would have joined parts of them first. It has too many arcs to be written
  out (pieces in the square); each is computed when it is first met, from the tables of how pieces come about.

Composed with an input they give a lattice over the places of the normalised text. The tropical shortest path is found by
relaxing the arcs in order of places. In merge models that depends on nothing but the last piece and the arcs that reach over a
place, so the composed machine is made deterministic as texts are read: its states are those, up to a bounded number, and a
step taken before is one lookup. In unigram models an arc weighs the piece's negated score. In merge models all
weights are 0 or infinity; what merging yields for a text begins with what it yields for the text up to any of the
path's places, so to each place leads exactly one path of finite weight, and one last piece is the whole state there.

How a piece comes about is its last merge, that of its halves, and so on. Beside each other, the parts of two
pieces at their border grow along the right edge of the first one's tree and the left edge of the second one's; the two
stay if at no moment the parts at the border make a piece that scores better than the merges either of them waits for.

Texts of merge models are cut where no piece can cross: before runs of space marks, and between characters of classes that no
piece mixes. (In unigram models the rounding of sums over the whole text decides ties, so they aren't cut.) Parts met before
are remembered, up to a bounded number.

Defined results: null counts as empty and has no ids; texts are encoded whole, in time that grows with their length; of equally
good paths the one whose last arc begins earlier stays; decoding takes the space in front away; repeated rows are each done; an empty table
gives no rows; other columns, whatever their names, aren't read. Models that put marks behind words, or of the word and
character types, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of texts that a worker remembers the ids of.
MEMORY = 500_000
#: Classes of characters by which texts are cut; all others are one more.
CLASSES = 8
#: States of the composed machine that a worker remembers.
STATES = 200_000
MARK = "▁"

# Numbers of fields and types in model files.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The trie of bytes and the outputs of a compiled character map; its double array serves as the table of arcs."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.outputs = blob[4 + size :]
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes read and written by the longest match at a place."""
        units, found = self.units, None
        state = self._offset(units[0])
        for i in range(at, len(text)):
            state ^= text[i]
            if state >= len(units) or units[state] & 0x800000FF != text[i]:
                break
            final, state = units[state] >> 8 & 1, state ^ self._offset(units[state])
            if final:
                begin = units[state] & 0x7FFFFFFF
                found = i + 1 - at, self.outputs[begin : self.outputs.index(0, begin)]
        return found


class Transducer:
    def __init__(self, model: bytes):
        self.scores: list[float] = []
        self.names: list[str] = []
        self.types: list[int] = []
        kind, suffix, self.prefix, self.squeeze, self.escape, charsmap = UNIGRAM, False, True, True, True, b""
        for number, value in _fields(model):
            if number == PIECE:
                f = dict(_fields(value))
                self.names.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == TRAINER:
                f = dict(_fields(value))
                kind, suffix = f.get(3, UNIGRAM), bool(f.get(24, 0))
            elif number == NORMALIZER:
                f = dict(_fields(value))
                self.prefix, self.squeeze, self.escape, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1)), f.get(2, b"")
        if kind not in (UNIGRAM, BPE) or suffix:
            raise ValueError("only unigram and merge models with marks in front of words are supported")
        self.kind = kind
        each = list(zip(self.names, self.types, strict=True))
        self.map = CharacterMap(charsmap) if charsmap else None
        self.user = sorted((n for n, t in each if t == USER), key=len, reverse=True)
        self.user_cut = re.compile("(" + "|".join(map(re.escape, self.user)) + ")") if self.user else None
        self.pieces = {n: i for i, (n, t) in enumerate(each) if t in (NORMAL, USER) or t == UNUSED and kind == BPE}
        self.bytes = {int(n[3:5], 16): i for i, (n, t) in enumerate(each) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        normal = [self.scores[i] for i, t in enumerate(self.types) if t == NORMAL]
        self.worst, self.best = np.float32(min(normal, default=0.0) - 10), max(normal, default=0.0)
        self.mark = MARK if self.escape else " "
        self.cuttable = kind == BPE and not any(self.mark in n.lstrip(self.mark) for n in self.pieces)
        self.parts = re.compile(f"{self.mark}*(?:{'|'.join([*self._classes(), f'[^{self.mark}]'])})|{self.mark}+", re.S)
        if kind == BPE:
            self._compile_merges()
        self._compile_pieces()
        self.memory: dict[str, bytes] = {}
        #: what each piece writes, as little-endian 32-bit numbers
        self.codes = [np.array(self.written(i, n), dtype="<i4").tobytes() for i, n in enumerate(self.names)]
        #: code points that each piece reads; one for byte fallback, whose number is -1
        self.reads = [*map(len, self.names), 1]
        # of each state of the composed machine: the next state for a character, the last piece, the arcs that reach over it
        self.after: list[dict[str, int]] = []
        self.last: list[int | None] = []
        self.over: list[tuple[tuple[int, int | None], ...]] = []
        self.states: dict[tuple[tuple[int, int | None], ...], int] = {}
        self._state(((0, None),))
        self.plain = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(n[3:5], 16)]) if t == BYTE else n.replace(MARK, " ").encode() for n, t in each]
        self.plain[self.unknown] = " ⁇ ".encode()

    # The normaliser.

    def _units(self, text: str) -> Iterator[str]:
        """What the character map writes, match by match; symbols of the user are copied."""
        raw, at = text.encode("utf-8", "replace"), 0
        symbols = [u.encode() for u in self.user]
        while at < len(raw):
            for u in symbols:
                if raw.startswith(u, at):
                    size, out = len(u), u
                    break
            else:
                found = self.map.longest(raw, at) if self.map else None
                size = found[0] if found else 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out = found[1] if found else raw[at : at + size]
            yield out.decode("utf-8", "replace")
            at += size

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if not self.map and not self.user:  # each character is copied
            if self.squeeze:
                text = re.sub("  +", " ", text.strip(" "))
            return (self.mark if self.prefix and text else "") + text.replace(" ", self.mark)
        out, in_front, after_space = [], self.squeeze, self.squeeze
        for unit in self._units(text):
            if in_front and unit == " ":
                continue
            in_front = False
            if after_space:
                unit = unit.lstrip(" ")
            if unit:
                out.append(unit)
                after_space = self.squeeze and unit.endswith(" ")
            elif not self.squeeze:
                after_space = False
        done = "".join(out)
        if self.squeeze:
            done = done.rstrip(" ")
        if in_front or not out:
            return ""
        return (self.mark if self.prefix else "") + done.replace(" ", self.mark)

    # The pieces.

    def _classes(self) -> list[str]:
        """Runs of characters that pieces join, be it by way of others; no piece holds neighbours of two classes or of none."""
        group: dict[str, set[str]] = {}
        for name in self.pieces:
            chars = name.replace(self.mark, "")
            if len(chars) > 1 and (chars[0] not in group or len({id(group.get(c)) for c in chars}) > 1):
                one = set(chars).union(*(group.get(c, ()) for c in chars))
                group.update(dict.fromkeys(one, one))
        each = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
        each = [*each[:CLASSES], set().union(*each[CLASSES:])]
        return [f"[{''.join(map(re.escape, sorted(g)))}]++" for g in each if g]

    def _compile_pieces(self) -> None:
        """arcs[state]: the next state for a character; final[state]: the piece written there, or -1."""
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [-1]
        for name, i in self.pieces.items():
            if self.kind == BPE and (self.types[i] == USER or i not in self.left_edge):
                continue
            state = 0
            for c in name:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = after
            self.final[state] = i

    # The order of merges.

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging yields: of all neighbours that make a piece the best-scored first, then the leftmost; and the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.pieces.get(parts[i] + parts[i + 1])
                if k is not None and self.types[k] != USER and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _compile_merges(self) -> None:
        """halves: the last merge of each piece that merging can yield. left_edge, right_edge: the parts on the edges of a
        piece's tree, from the character up. pairs: which pieces two pieces make. odd: pieces with a merge that doesn't score
        less than those before it, so that scores don't tell the order."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.left_edge: dict[int, tuple[int, ...]] = {}
        self.right_edge: dict[int, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.odd: set[int] = set()
        for name, i in sorted(self.pieces.items(), key=lambda p: len(p[0])):
            if self.types[i] == USER:
                continue
            if len(name) == 1:
                self.left_edge[i] = self.right_edge[i] = (i,)
                continue
            for k in range(1, len(name)):
                a, b = self.pieces.get(name[:k]), self.pieces.get(name[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
            parts, last = self._merges(name)
            if len(parts) == 1 and last[0] in self.pieces and last[1] in self.pieces:
                a, b = self.halves[i] = self.pieces[last[0]], self.pieces[last[1]]
                self.left_edge[i], self.right_edge[i] = (*self.left_edge[a], i), (*self.right_edge[b], i)
                if not all(h not in self.odd and (len(self.names[h]) == 1 or self.scores[h] > self.scores[i]) for h in (a, b)):
                    self.odd.add(i)
        self.weights: dict[int, bool] = {}

    def _stay(self, a: int, b: int) -> bool:
        """Whether the arc from piece a to piece b has a finite weight."""
        known = self.weights.get(a << 32 | b)
        if known is None:
            if len(self.weights) > 4 * MEMORY:
                self.weights.clear()
            known = self.weights[a << 32 | b] = self._grow(a, b) if a not in self.odd and b not in self.odd else self._merges(self.names[a] + self.names[b])[0] == [self.names[a], self.names[b]]
        return known

    def _grow(self, a: int, b: int) -> bool:
        left, right, scores = self.right_edge[a], self.left_edge[b], self.scores
        i = j = 0
        while True:
            across = self.pairs.get((left[i], right[j]))
            grows, waits = (scores[left[i + 1]] if i + 1 < len(left) else None), (scores[right[j + 1]] if j + 1 < len(right) else None)
            # of equal scores the leftmost merge comes first
            if across is not None and (grows is None or scores[across] > grows) and (waits is None or scores[across] >= waits):
                return False
            if grows is None and waits is None:
                return True
            if waits is None or grows is not None and grows >= waits:
                i += 1
            else:
                j += 1

    # Composition with an input, and the shortest path.

    def _state(self, over: tuple[tuple[int, int | None], ...]) -> int:
        """The state with these arcs over it: their places in the trie of pieces and the pieces in front of them, the longest first."""
        known = self.states.get(over)
        if known is None:
            known = self.states[over] = len(self.over)
            self.after.append({})
            self.last.append(over[-1][1])
            self.over.append(over)
        return known

    def _step(self, state: int, c: str) -> int:
        """Relaxes the arcs over a place by one character."""
        arcs, final, last, over = self.arcs, self.final, None, []
        for at, had in self.over[state]:
            to = arcs[at].get(c)
            if to is None:
                continue
            piece = final[to]
            if piece >= 0 and last is None and (had is None or had < 0 or self._stay(had, piece)):
                last = piece
            if arcs[to]:
                over.append((to, had))
        if last is None and final[arcs[0].get(c, 0)] < 0:
            last = -1
        if len(self.over) > STATES:  # begin anew; the state in front of a text is 0 again
            for table in (self.after, self.last, self.over, self.states):
                table.clear()
            self._state(((0, None),))
            return self._state((*over, (0, last)))
        to = self.after[state][c] = self._state((*over, (0, last)))
        return to

    def _pieces(self, text: str) -> list[int]:
        """The pieces on the shortest path of a merge model."""
        after, last, reads, state, found = self.after, self.last, self.reads, 0, []
        for c in text:
            to = after[state].get(c)
            state = self._step(state, c) if to is None else to
            found.append(last[state])
        out, at = [], len(found)
        while at:
            piece = found[at - 1]
            out.append(piece)
            at -= reads[piece]
        out.reverse()
        return out

    def path(self, text: str) -> list[tuple[int, str]]:
        """The arcs of the shortest path: pieces (-1 for byte fallback) and the text they read."""
        n, arcs, final = len(text), self.arcs, self.final
        if self.kind == BPE:
            pieces = self._pieces(text)
            ends = np.cumsum([self.reads[p] for p in pieces]).tolist()
            return [(p, text[end - self.reads[p] : end]) for p, end in zip(pieces, ends, strict=True)]
        # sums are kept in single precision, as the library does, since ties hang on it
        last, back = [None] * (n + 1), [0] * (n + 1)
        weight: list[np.float32 | None] = [np.float32(0)] + [None] * n
        for at in range(n):
            here, state, end, single = weight[at], 0, at, False
            while end < n:
                state = arcs[state].get(text[end])
                end += 1
                if state is None:
                    break
                piece = final[state]
                if piece >= 0:
                    single |= end == at + 1
                    sum_ = here + (np.float32(len(text[at:end].encode()) * np.float32(self.best) - 0.1) if self.types[piece] == USER else np.float32(self.scores[piece]))
                    if weight[end] is None or sum_ > weight[end]:
                        weight[end], last[end], back[end] = sum_, piece, at
            if not single and (weight[at + 1] is None or here + self.worst > weight[at + 1]):
                weight[at + 1], last[at + 1], back[at + 1] = here + self.worst, -1, at
        out, at = [], n
        while at:
            out.append((last[at], text[back[at] : at]))
            at = back[at]
        return out[::-1]

    def written(self, piece: int, text: str) -> list[int]:
        """The ids that an arc writes; a piece that isn't used writes its halves'."""
        if piece < 0:
            return [self.bytes[b] for b in text.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]
        if self.types[piece] == UNUSED and piece in getattr(self, "halves", {}):
            a, b = self.halves[piece]
            return self.written(a, self.names[a]) + self.written(b, self.names[b])
        return [piece]

    def _part(self, text: str) -> bytes:
        if self.kind == BPE and self.user_cut:
            return b"".join([self.codes[self.pieces[t]] if k % 2 else self._cut(t) for k, t in enumerate(self.user_cut.split(text))])
        return self._cut(text)

    def _cut(self, text: str) -> bytes:
        """What the shortest path of a text without symbols of the user writes."""
        if self.kind == BPE:
            pieces = self._pieces(text)
            if -1 not in pieces:
                return b"".join([self.codes[p] for p in pieces])
        return b"".join([self.codes[p] if p >= 0 else np.array(self.written(p, t), dtype="<i4").tobytes() for p, t in self.path(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        norm = self.normalise(text or "")
        if not norm:
            return b""
        memory = self.memory
        if not self.cuttable or self.user:
            out = self._part(norm)
        else:
            parts = self.parts.findall(norm)
            found = list(map(memory.get, parts))
            if None in found:
                if len(memory) > MEMORY:
                    memory.clear()
                for i in [i for i, ids in enumerate(found) if ids is None]:
                    p = parts[i]
                    found[i] = memory.get(p) or self._part(p)
                    if len(p) < 64:
                        memory[p] = found[i]
            out = b"".join(found)
        if len(self.bytes) < 256:  # neighbouring unknown characters are one
            ids = np.frombuffer(out, dtype="<i4")
            out = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])].tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_known: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The model in path, compiled once a worker."""
    if path not in _known:
        with open(path, "rb") as f:
            _known[path] = Transducer(f.read())
    return _known[path]


def encode_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array) and the decoded text's SHA-256 with whether decoding gives the normalised text back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, digests, same = [], [], []
                for text in b.column(1).to_pylist():
                    got = np.frombuffer(fst.encode(text), dtype="<i4")
                    back = fst.decode(got)
                    ids.append(got)
                    digests.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == (fst.normalise(text or "")[1:] if fst.prefix else fst.normalise(text or "")).replace(MARK, " "))
                sizes = np.cumsum([0, *map(len, ids)])
                values = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(sizes), pa.int64()), values, pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_rows(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in batches:
            texts = [fst.decode(np.array(i or [], dtype="<i4")) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
