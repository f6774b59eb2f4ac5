"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new word segments are laid end to end and indexed by a suffix array, sorted as
deep as the longest piece. Every piece is binary-searched for its range of occurrences;
the occurrences are edges between positions, sorted by where they end, and relaxed from
left to right. For a byte-pair model the last piece of every prefix's encoding is unique:
an edge is taken if it can follow the last piece at its start, which holds if the pair's
own encoding leaves both whole. So relaxation needs no scores of paths.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, strung, text_bytes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Segments whose ids a worker remembers, and the characters indexed at once.
CACHE_SEGMENTS = 500_000
INDEX_CHARS = 1 << 21
GROUP_BYTES = 4 << 20
#: Above this many characters a segment is relaxed edge by edge, not in step with others.
LONG = 400
#: Pairs of pieces that a worker remembers of such segments.
CACHE_PAIRS = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """The pieces of a byte-pair model, with how each is put together."""

    def __init__(self, path: str):
        self.path = path
        self.piece: list[str] = []
        kinds, scores = [], []
        model_type, charsmap, dummy, squeeze = 1, b"", True, True
        for n, v in _fields(Path(path).read_bytes()):
            if n == 1:
                f = dict(_fields(v))
                self.piece.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif n == 2:
                model_type = dict(_fields(v)).get(3, 1)
            elif n == 3:
                f = dict(_fields(v))
                charsmap, dummy, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if model_type != 2 or charsmap or squeeze or USER in kinds:
            raise ValueError("only byte-pair models without normalisation or own symbols are read")
        self.dummy = dummy
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.kinds = kinds
        self.id = {p: i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == NORMAL}
        self._merges(scores)
        self.splittable = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        self.newline = not any("\n" in p for p in self.id)

    def _merges(self, scores: list[float]) -> None:
        n = len(self.piece)
        self.rank = np.full(n + 1, -1, dtype=np.int64)
        self.left, self.right = (np.full(n + 1, -1, dtype=np.int64) for _ in range(2))
        order = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -scores[i])
        rank = {self.piece[i]: r for r, i in enumerate(order)}
        usable = [i for p, i in self.id.items() if len(p) == 1]
        for i in order:
            parts = list(self.piece[i])
            last = None
            while len(parts) > 1:
                r, at = min(((rank.get(a + b, 1 << 60), j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
                if r == 1 << 60:
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1 and last and all(x in self.id for x in last):
                self.left[i], self.right[i] = (self.id[x] for x in last)
                self.rank[i] = rank[self.piece[i]]
                usable.append(i)
        #: Pieces that some text's encoding can hold, by text.
        self.usable = sorted(usable, key=lambda i: [ord(c) for c in self.piece[i]])
        pairs, ranks = [], []
        for i in order:  # every way to put a piece together
            p = self.piece[i]
            for j in range(1, len(p)):
                a, b = self.id.get(p[:j]), self.id.get(p[j:])
                if a is not None and b is not None:
                    pairs.append(a * (n + 1) + b)
                    ranks.append(rank[p])
        o = np.argsort(np.array(pairs))
        self.pairs, self.pair_rank = np.array(pairs)[o], np.array(ranks)[o]
        self._scalar: tuple | None = None

    def follow(self, u: int, v: int) -> bool:
        """``follows`` of one pair, remembered."""
        if u < 0 or v < 0:
            return True
        if self._scalar is None:
            self._scalar = (dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist(), {})
        pairs, rank, left, right, known = self._scalar
        n = len(self.piece) + 1
        asked = u * n + v
        got = known.get(asked)
        if got is None:
            if len(known) > CACHE_PAIRS:
                known.clear()
            got, limit = True, 1 << 60
            while True:
                if pairs.get(u * n + v, limit) < limit:
                    got = False
                    break
                ru, rv = rank[u], rank[v]
                if ru < 0 and rv < 0:
                    break
                if ru > rv:
                    limit, u = ru, right[u]
                else:
                    limit, v = rv + 1, left[v]
            known[asked] = got
        return got

    def follows(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays a pair when its text is encoded.

        Takes the later made of the two apart, again and again: were there a time at which
        what met at the seam could merge before either was made, the pair would not stay.
        """
        n = len(self.piece) + 1
        ok = np.ones(len(u), dtype=bool)
        at = np.flatnonzero((u >= 0) & (v >= 0))
        u, v = u[at], v[at]
        limit = np.full(len(at), 1 << 60)
        while len(at):
            key = u * n + v
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            broken = (self.pairs[i] == key) & (self.pair_rank[i] < limit)
            ok[at[broken]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~broken & ((ru >= 0) | (rv >= 0))
            at, u, v, ru, rv = at[go], u[go], v[go], ru[go], rv[go]
            first = ru > rv
            limit = np.where(first, ru, rv + 1)
            u, v = np.where(first, self.right[u], u), np.where(first, v, self.left[v])
        return ok


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` codes, by prefix doubling
    from as many codes as fit a word."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(rank.max(initial=1)).bit_length()
    have = max(1, min(depth, 62 // bits, len(codes)))
    key = np.zeros(len(codes), dtype=np.int64)
    for j in range(have):
        key <<= bits
        key[: len(codes) - j] |= rank[j:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(len(codes), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
    while have < depth and rank[order[-1]] < len(codes):
        key = rank * (len(codes) + 2)
        key[:-have] += rank[have:] if have < len(codes) else 0
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(codes), dtype=np.int64)
        rank[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
        have *= 2
    return order


class Encoder:
    def __init__(self, path: str):
        self.model = m = Model(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.depth = max(len(m.piece[i]) for i in m.usable)
        self.size = np.array([len(m.piece[i]) for i in m.usable])
        self.chars = np.zeros((len(m.usable), self.depth), dtype=np.int64)
        for r, i in enumerate(m.usable):
            self.chars[r, : self.size[r]] = [ord(c) for c in m.piece[i]]
        self.tokens = np.array(m.usable)
        self.single = np.array(sorted(ord(p) for p in m.id if len(p) == 1))

    def cut(self, texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
        """Segments of texts laid end to end, and where each text's begin.

        Pieces hold spaces at their beginning only, and no line break, so a segment is a run of
        spaces with the characters after it, or a line break; a model whose pieces hold more has
        whole texts for segments.
        """
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(sizes) - sizes
        raw = np.frombuffer(data, dtype=np.uint8)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[begins] = True
        first = first[:-1]
        if self.model.splittable and len(raw):
            space = raw == 32
            first[1:] |= space[1:] & ~space[:-1]
            if self.model.newline:
                line = raw == 10
                first |= line
                first[1:] |= line[:-1]
        starts = np.flatnonzero(first)
        offsets = np.r_[starts, len(raw)].astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(starts, np.r_[begins, len(raw)])

    def occurrences(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffix array that begins with each piece, by binary search."""
        padded = np.r_[codes, np.full(self.depth, -1)]
        lo, hi = np.zeros(len(self.tokens), np.int64), np.full(len(self.tokens), len(order), np.int64)
        for d in range(self.depth):
            live = np.flatnonzero((self.size > d) & (lo < hi))
            if not len(live):
                break
            want = self.chars[live, d]
            for side in (0, 1):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) >> 1
                    c = padded[order[np.minimum(mid, len(order) - 1)] + d]
                    right = open_ & ((c < want) if side == 0 else (c <= want))
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                if side == 0:
                    start = a
                else:
                    lo[live], hi[live] = start, a
        return lo, hi

    def learn(self, segments: list[str]) -> None:
        """Encode segments (spaces for the space mark) and remember their ids."""
        m = self.model
        codes = np.frombuffer("\0".join(segments).replace(" ", SPACE).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sizes = np.array([len(s) for s in segments])
        begins = np.cumsum(sizes + 1) - sizes - 1
        # Only what lies inside segments is matched: the separators match no piece.
        codes[(begins + sizes)[:-1]] = -1
        order = suffix_array(codes, self.depth)
        lo, hi = self.occurrences(codes, order)
        n = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(n)), n)
        start = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        token, end = self.tokens[piece], start + self.size[piece]
        # A character that is no piece is an edge of its own.
        odd = np.flatnonzero((codes >= 0) & ~np.isin(codes, self.single))
        start, end, token = np.r_[start, odd], np.r_[end, odd + 1], np.r_[token, np.full(len(odd), -1)]
        segment = np.repeat(np.arange(len(sizes)), sizes + 1)[: len(codes)]
        step = end - begins[segment[start]]
        long = sizes[segment[start]] > LONG
        last = np.full(len(codes) + 1, -2, dtype=np.int64)  # the piece that ends there; -2: none yet
        came = np.zeros(len(codes) + 1, dtype=np.int64)
        last[begins] = -1
        # A segment's first position is where its predecessor's separator ends, so each has its own.
        i = np.flatnonzero(~long)
        own = step[i].astype(np.int16)  # at most LONG; sorted by radix
        order = np.argsort(own, kind="stable")
        i, own = i[order], own[order]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(i) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            e = i[a:b]
            take = e[(last[start[e]] != -2) & m.follows(last[start[e]], token[e])]
            last[end[take]], came[end[take]] = token[take], start[take]
        i = np.flatnonzero(long)
        if len(i):
            i = i[np.argsort(end[i], kind="stable")]
            at: dict[int, int] = dict.fromkeys(begins[sizes > LONG].tolist(), -1)
            back: dict[int, int] = {}
            for s, e, t in zip(start[i].tolist(), end[i].tolist(), token[i].tolist(), strict=True):
                if e not in at and s in at and m.follow(at[s], t):
                    at[e], back[e] = t, s
            where = np.fromiter(back, dtype=np.int64, count=len(back))
            last[where], came[where] = [at[e] for e in back], list(back.values())
        at = begins + sizes
        rows, tokens, places = [], [], []
        live = np.arange(len(sizes))
        while len(live):
            p = at[live]
            rows.append(live)
            tokens.append(last[p])
            places.append(came[p])
            at[live] = came[p]
            live = live[at[live] > begins[live]]
        row, tok, place = (np.concatenate(x) for x in (rows, tokens, places))
        if (tok == -2).any():
            raise AssertionError("a segment was not covered")
        o = np.lexsort((place, row))
        row, tok, place = row[o], tok[o], place[o]
        ids = tok.astype("<u4").tobytes()
        cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
        at_byte = (4 * cuts).tolist()
        self.known.update(zip(segments, [ids[a:b] for a, b in zip(at_byte, at_byte[1:], strict=False)], strict=True))
        for s in np.unique(row[tok < 0]).tolist():  # characters that are no piece
            out: list[int] = []
            for t, c in zip(tok[cuts[s] : cuts[s + 1]].tolist(), codes[place[cuts[s] : cuts[s + 1]]].tolist(), strict=True):
                out += [t] if t >= 0 else [m.byte.get(x, m.unknown) for x in chr(c).encode()] if m.byte else [m.unknown]
            self.known[segments[s]] = np.array(out, dtype="<u4").tobytes()

    def values(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments. Of two generations of remembered ones the older goes as the
        younger fills up, so that common ones stay."""
        known, old = self.known, self.old
        out: list = list(map(known.get, segments))
        new = [i for i, v in enumerate(out) if v is None]
        part: list[str] = []
        held = 0
        for i in new:
            s = segments[i]
            got = old.get(s)
            if got is not None:
                known[s] = got
                continue
            part.append(s)
            held += len(s) + 1
            if held >= INDEX_CHARS:
                self.learn(part)
                part, held = [], 0
        if part:
            self.learn(part)
        for i in new:
            out[i] = known[segments[i]]
        if len(known) > CACHE_SEGMENTS // 2:
            self.old, self.known = known, {}
        return out

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text; an empty one has none."""
        lead, mark = (b" " if self.model.dummy else b""), SPACE.encode()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
                size += len(texts[end])
                end += 1
            segments, offsets = self.cut([lead + t.replace(mark, b" ") if t else t for t in texts[at:end]])
            coded = segments.dictionary_encode()
            yield from strung(self.values(coded.dictionary.to_pylist()), coded.indices.to_numpy(), offsets)
            at = end


class Decoder:
    def __init__(self, path: str):
        m = Model(path)
        self.dummy = m.dummy
        self.raw = []
        for p, k in zip(m.piece, m.kinds, strict=True):
            if k == BYTE:
                self.raw.append(bytes([int(p[1:-1], 16)]))
            elif k == CONTROL:
                self.raw.append(b"")
            elif k == UNKNOWN:
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(p.replace(SPACE, " ").encode())

    def __call__(self, ids: np.ndarray) -> str:
        """The text; bytes that form no character become the replacement character."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if self.dummy and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_OPEN: dict[tuple[type, str], object] = {}


def opened(kind: type, path: str):
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of each text; null for a null text, none for an empty one.

    Whole texts, rows with equal or null ids apart; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(Encoder, model)
        for b in batches:
            raw = list(encoder(text_bytes(b.column(1))))
            offsets = np.cumsum([0] + [len(x) // 4 for x in raw])
            values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            ids = pa.compute.if_else(b.column(1).is_null(), pa.scalar(None, ids.type), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(each, "id long, ids array<int>")


def decode(coded: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with piece ids; null for null. The inverse of ``encode``."""
    small_batches(coded.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = opened(Decoder, model)
        for b in batches:
            texts = [None if x is None else decoder(np.array(x, dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(each, "id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, decoded_sha256): encoded and decoded in one pass.

    A null text counts as empty. decoded_sha256 is of the text that the ids decode to.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = opened(Encoder, model), opened(Decoder, model)
        for b in batches:
            raw = list(encoder(text_bytes(b.column(1))))
            sha = [hashlib.sha256(decoder(np.frombuffer(x, dtype="<u4")).encode()).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(sha, pa.string())],
                ["id", "n_ids", "ids_crc32", "decoded_sha256"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(each, "id long, n_ids long, ids_crc32 long, decoded_sha256 string")
