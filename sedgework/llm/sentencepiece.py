"""SentencePiece encoding and decoding with source offsets.

The model file is parsed here: its pieces and its compiled character map (a double-array trie plus a
pool of replacement strings).  Normalising walks the source and takes at each place the longest
prefix that the trie knows, recording for each normalised character the source bytes that it came
from; each piece is then projected to its span of source bytes.  Where the map is empty, each character
is its own longest prefix, and its span is its UTF-8 width.

Merging works on stretches between places that no piece of the model crosses.  ``digests`` takes texts in
slices of SLICE bytes, merges the distinct stretches of a slice all at once (in each round every stretch
makes its best merge), and puts the ids and byte widths of each text together from them.  Nothing is
remembered between slices, so a worker's memory is bounded by a slice or its longest text.

Cases: null text counts as empty and gives no ids; white space, control characters and texts of any
length are encoded whole; characters outside the vocabulary fall back to byte pieces; equal texts
give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, slices, table

SIGN = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of text handled at once; stretches merged at once (so that their arrays stay in the processor's
#: cache); longer stretches than LONG are merged one by one with a heap.
SLICE, BLOCK, LONG = 4 << 20, 8192, 64
SHORT, NO_RANK = 40, 1 << 60


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        s += 7
        if c < 128:
            return x, i


def _fields(b: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class CharMap:
    """A compiled character map: 4 bytes of trie size, the trie's 32-bit units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.pool = (), b""
        if len(blob) > 4:
            n = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.pool = blob[4 + n :]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Length in bytes of the longest key at ``i`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for j in range(i, len(b)):
            c = b[j]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                at = units[node] & 0x7FFFFFFF
                found = j + 1 - i, self.pool[at : self.pool.index(b"\0", at)]
        return found


def width(piece: str) -> int:
    """Source bytes of a piece; the sign stands for one space."""
    return len(piece) if piece.isascii() else len(piece.encode("utf-8", "replace")) - 2 * piece.count(SIGN)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()


#: Patterns of stretches, the finest first: letters, digits and other characters, each after signs; or all up to the
#: next sign.  A model takes the first that cuts none of its pieces, as then no merge crosses a cut.
STRETCHES = (rf"{SIGN}*[^\W\d_{SIGN}]+|{SIGN}*\d+|{SIGN}*(?:[^\w{SIGN}]|_)+|{SIGN}+", f"{SIGN}*[^{SIGN}]+|{SIGN}+")


@dataclass
class Model:
    ids: dict[str, int]
    scores: list[float]
    surface: list[str]
    byte_id: list[int]
    byte_of: dict[int, int]
    kinds: list[int]
    charmap: CharMap
    unknown: int = 0
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    splits: re.Pattern | None = None
    ranks: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        order = {x: i for i, x in enumerate(sorted({self.scores[k] for k in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[self.scores[k]] for p, k in self.ids.items()}

    # -- normalising -------------------------------------------------------------------------
    def normalize(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text and, for each of its characters, the source byte span it came from."""
        raw = text.encode("utf-8", "replace")
        chars: list[str] = []
        starts: list[int] = []
        ends: list[int] = []

        def put(s: str, a: int, b: int) -> None:
            for c in s:
                c = SIGN if c == " " and self.escape else c
                if self.squeeze and c == SIGN and (not chars or chars[-1] == SIGN):
                    continue
                chars.append(c)
                starts.append(a)
                ends.append(b)

        i = 0
        while i < len(raw):
            hit = self.charmap.longest(raw, i)
            if hit:
                n, new = hit[0], hit[1].decode("utf-8", "replace")
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                new = raw[i : i + n].decode("utf-8", "replace")
            put(new, i, i + n)
            i += n
        while self.squeeze and chars and chars[-1] == SIGN:
            for x in (chars, starts, ends):
                x.pop()
        if chars and self.dummy_prefix:
            chars.insert(0, SIGN if self.escape else " ")
            starts.insert(0, 0)
            ends.insert(0, 0)
        return "".join(chars), starts, ends

    def aligned(self, text: str) -> tuple[str, list[int] | None, list[int] | None]:
        """As ``normalize``; without span lists where the map is empty and each character keeps its width."""
        if self.charmap.units or self.squeeze or not self.escape or SIGN in text:
            return self.normalize(text)
        return (SIGN if self.dummy_prefix and text else "") + text.replace(" ", SIGN), None, None

    # -- merging -----------------------------------------------------------------------------
    def merge(self, s: str) -> list[str]:
        """Pieces of a stretch: again and again the neighbours whose union has the best score, leftmost first."""
        sym: list[str] = list(s)
        if len(sym) <= SHORT:  # a scan for the best is faster than a heap here
            rank = self.ranks.get
            best = [rank(a + b, NO_RANK) for a, b in zip(sym, sym[1:])]
            while best and (least := min(best)) < NO_RANK:
                i = best.index(least)
                sym[i] += sym.pop(i + 1)
                best.pop(i)
                if i:
                    best[i - 1] = rank(sym[i - 1] + sym[i], NO_RANK)
                if i < len(best):
                    best[i] = rank(sym[i] + sym[i + 1], NO_RANK)
            return sym
        nxt = list(range(1, len(sym) + 1))
        prv = list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym):
                both = sym[a] + sym[b]
                k = self.ids.get(both)
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], a, b, both))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not sym[a] or not sym[b] or nxt[a] != b or sym[a] + sym[b] != both:
                continue
            sym[a], sym[b] = both, ""
            nxt[a] = nxt[b]
            if nxt[b] < len(sym):
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return [x for x in sym if x]

    def stretches(self, normal: str) -> list[str]:
        return self.splits.findall(normal) if self.splits else [normal] if normal else []

    def piece_ids(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        return [k] if k is not None else [self.byte_id[c] for c in piece.encode("utf-8", "replace")] if self.byte_id else [self.unknown]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, ...]:
        """Symbol of each code point (-1: in no piece); then sorted keys of two symbols that join, the symbol that
        they give, and its rank.  Symbols are ids, or numbers above them for characters that are no pieces."""
        symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, len(self.surface) + len(symbol))
        chars = np.full(0x110000, -1, np.int32)
        for p, k in symbol.items():
            if len(p) == 1:
                chars[ord(p)] = k
        found = [(symbol[p[:i]] << 32 | symbol[p[i:]], k, self.ranks[p]) for p, k in self.ids.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        keys, to, rank = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        o = np.argsort(keys)
        return chars, keys[o], to[o].astype(np.int32), rank[o].astype(np.int32)

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of ``pairs`` that joins symbols a and b; -1 where none does."""
        _, keys, _, _ = self.pairs
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (keys[at] == key), at, -1) if len(keys) else np.full(len(a), -1)

    def merge_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``merge`` for many stretches at once: number of pieces of each, then symbol and characters of each piece."""
        chars, _, to, ranks = self.pairs
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        sym, row, size = chars[text], np.repeat(np.arange(len(parts), dtype=np.int32), length), np.ones(len(text), np.int32)
        place = np.arange(len(text), dtype=np.int32)  # of a piece's first character: orders what is done
        last = np.append(row[1:] != row[:-1], True)
        join = np.append(self._joins(sym[:-1], sym[1:]), -1)
        join[last] = -1
        done: list[tuple] = []
        none = np.int32(2**31 - 1)
        while len(sym):
            rank = np.where(join >= 0, ranks[join], none) if len(ranks) else np.full(len(join), none)
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            number = np.cumsum(np.append(False, row[1:] != row[:-1]))
            best = np.minimum.reduceat(rank, head)
            open_ = (best < none)[number]
            if not open_.all():
                done.append((place[~open_], sym[~open_], size[~open_], row[~open_]))
                place, sym, size, row, join, rank, number = (x[open_] for x in (place, sym, size, row, join, rank, number))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best[number])
            i = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]  # the leftmost of each stretch
            sym[i] = to[join[i]]
            size[i] += size[i + 1]
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            i -= np.arange(len(i))  # places after the joined ones are gone
            place, sym, size, row, join = (x[stay] for x in (place, sym, size, row, join))
            for k in (i[i > 0] - 1, i[i + 1 < len(sym)]):
                join[k] = np.where(row[k] == row[k + 1], self._joins(sym[k], sym[k + 1]), -1)
            if i[-1] + 1 == len(sym):
                join[i[-1]] = -1
        place, sym, size, row = (np.concatenate(x) for x in zip(*done))
        o = np.argsort(place)
        return np.bincount(row, minlength=len(parts)), sym[o], size[o]

    def pieces_of(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Number of ids of each stretch; then of each id: itself, how far it moves on in the source, the width of its piece there."""
        short = [k for k, s in enumerate(parts) if len(s) <= LONG]
        some = [parts[k] for k in short]
        blocks = [self.merge_all(some[k : k + BLOCK]) for k in range(0, len(some), BLOCK)]
        n, sym, size = (np.concatenate(x) for x in zip(*blocks)) if blocks else (np.zeros(0, np.int64),) * 3
        if len(short) < len(parts):  # long stretches one by one, put back in order
            each, at = {}, 0
            for k, m in zip(short, n.tolist()):
                each[k] = sym[at : at + m].tolist(), size[at : at + m].tolist()
                at += m
            for k, s in enumerate(parts):
                if k not in each:
                    pieces = self.merge(s)
                    each[k] = [self.ids.get(p, -1) for p in pieces], [len(p) for p in pieces]
            n = np.array([len(each[k][0]) for k in range(len(parts))])
            sym, size = (np.array([x for k in range(len(parts)) for x in each[k][j]], np.int64) for j in (0, 1))
            some = parts
        text = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
        wide = np.append(0, np.cumsum(1 + (text >= 0x80) + (text >= 0x800) + (text >= 0x10000) - 2 * (text == ord(SIGN))))
        end = np.cumsum(size)
        width = wide[end] - wide[end - size]
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.surface)))
        if not len(odd):
            return n, sym.astype(np.int64), width, width
        # characters that are no pieces become their bytes, which share the character's span; the last moves on
        ids = [self.piece_ids(chr(text[end[k] - 1])) for k in odd.tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(x) for x in ids]
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(times) - times
        out, moves = np.repeat(sym.astype(np.int64), times), np.zeros(int(times.sum()), np.int64)
        for k, x in zip(first[odd].tolist(), ids):
            out[k : k + len(x)] = x
        moves[first + times - 1] = width
        return np.bincount(row, times, len(n)).astype(np.int64), out, moves, np.repeat(width, times)

    def digest_all(self, texts: list[str]) -> list[tuple[int, str, str, str]]:
        """Of each text: number of ids, digests of the ids, of the decoded text, and of the pieces' spans in the source.

        The last is the SHA-256 of start and end of each id's piece as 64-bit little-endian numbers.
        """
        number: dict[str, int] = {}
        rows, which, walked = [], [], []
        for t in texts:
            normal, starts, _ = self.aligned(t)
            walked.append(starts is not None)
            parts = self.stretches(normal) if starts is None else []
            which += [number.setdefault(s, len(number)) for s in parts]
            rows.append(len(parts))
        n, ids, moves, widths = self.pieces_of(list(number)) if number else (np.zeros(0, np.int64),) * 4
        which, rows = np.array(which, np.int64), np.array(rows, np.int64)
        take = n[which]
        src = np.repeat((np.cumsum(n) - n)[which] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        edge = np.append(0, np.cumsum(take))[np.append(0, np.cumsum(rows))].tolist()
        out = []
        for k, by_map in enumerate(walked):
            if by_map:
                found = self.spans(texts[k])
                own = [x[0] for x in found]
                out.append((len(own), _sha(",".join(map(str, own))), _sha(self.decode(own)), hashlib.sha256(np.array([x[2:] for x in found], "<i8").tobytes()).hexdigest()))
                continue
            at = src[edge[k] : edge[k + 1]]
            own, moved = ids[at], np.cumsum(moves[at])
            spans = np.empty((len(at), 2), "<i8")
            spans[:1, 0], spans[1:, 0] = 0, moved[:-1]
            spans[:, 1] = spans[:, 0] + widths[at]
            if self.dummy_prefix:  # the sign before the text has no source bytes
                spans -= 1
                np.maximum(spans, 0, out=spans)
            listed = own.tolist()
            out.append((len(listed), _sha(",".join(map(str, listed))), _sha(self.decode(listed)), hashlib.sha256(spans).hexdigest()))
        return out

    def digest(self, text: str) -> tuple[int, str, str, str]:
        return self.digest_all([text])[0]

    def plain(self, ids: list[int]) -> str:
        """Surface of ids, the dummy prefix still in place."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids))
        out: list[str] = []
        pending = bytearray()
        for k in ids:
            if k in self.byte_of:
                pending.append(self.byte_of[k])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.surface[k])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [k for s in self.stretches(self.aligned(text or "")[0]) for p in self.merge(s) for k in self.piece_ids(p)]

    def decode(self, ids: list[int]) -> str:
        s = self.plain(ids)
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s

    def spans(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(id, piece, start, end) of each piece; start and end are bytes of the source's UTF-8."""
        normal, starts, ends = self.normalize(text or "")
        at, out = 0, []
        for s in self.stretches(normal):
            for p in self.merge(s):
                a, b = starts[at], max(ends[at : at + len(p)])
                out += [(k, p, a, b) for k in self.piece_ids(p)]
                at += len(p)
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        blob = f.read()
    pieces, scores, kinds, norm, byte_fallback = [], [], [], {}, False
    for number, v in _fields(blob):
        if number == 1:
            p = dict(_fields(v))
            pieces.append(p[1].decode("utf-8"))
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif number == 2:
            byte_fallback = bool(dict(_fields(v)).get(35, 0))
        elif number == 3:
            norm = dict(_fields(v))
    own = {NORMAL, USER_DEFINED, UNUSED}
    ids = {p: k for k, p in enumerate(pieces) if kinds[k] in own}
    byte_of = {k: int(p[3:5], 16) for k, p in enumerate(pieces) if kinds[k] == BYTE}
    surface = [" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else p.replace(SIGN, " ") for p, kind in zip(pieces, kinds)]
    return Model(
        ids=ids,
        scores=scores,
        surface=surface,
        byte_id=[k for k, _ in sorted(byte_of.items(), key=lambda x: x[1])] if byte_fallback else [],
        byte_of=byte_of,
        kinds=kinds,
        charmap=CharMap(norm.get(2, b"")),
        unknown=kinds.index(UNKNOWN) if UNKNOWN in kinds else 0,
        dummy_prefix=bool(norm.get(3, 1)),
        squeeze=bool(norm.get(4, 1)),
        escape=bool(norm.get(5, 1)),
        splits=next((r for r in map(re.compile, STRETCHES) if all(r.fullmatch(p) and r.findall(p) == [p] for p in ids)), None),
    )


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: id, ids, pieces, and the byte span of each piece in the source."""
    kind = docs.schema[id_col].dataType
    out = f"{id_col} {kind.simpleString()}, ids array<int>, pieces array<string>, starts array<long>, ends array<long>"

    def run(batches):
        m = load(model_path)
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = m.spans(t)
                ids, pieces, starts, ends = map(list, zip(*s)) if s else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], b.schema.types[0]), pa.array([ids], pa.list_(pa.int32())), pa.array([pieces], pa.list_(pa.string())), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                    names=[id_col, "ids", "pieces", "starts", "ends"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), out)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches):
        m = load(model_path)
        for b in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]
            for x, y in slices(sizes, SLICE):
                cols = list(zip(*m.digest_all([t.as_py() or "" for t in b.column(1).slice(x, y - x)])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
