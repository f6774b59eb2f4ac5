"""Removal of passages that repeat anywhere in a corpus, by suffix automata.

Documents stream through suffix automata of reference shards; their matching statistics
give the windows of ``window`` words that the shard holds more than once, and maximal
runs of such windows are removed. A corpus that is its own reference has no size that
could be broadcast, so its shards hold every passage that can repeat at all, and a shard's
automaton is built in the task that streams the shard's passages:

1. Each window is keyed by its minimizer, the least hash of its 8-word grams. Equal
   windows have equal minimizers at equal places, so a window whose minimizer occurs
   once is unique. Windows of a text that share an occurrence form a context.
2. Contexts that are equal as a whole (128 bits of their words' SHA-256) are folded into
   one with a weight, before the shuffle and before any text moves; so are all copies.
3. Every context under a repeated minimizer goes to the minimizer's shard. The automaton
   counts occurrences by weight, and it alone decides which windows repeat.
4. A minimizer with more than ``SPLIT`` different contexts (a very common line) is dealt
   out further: its contexts' windows are keyed anew by their least gram that few of them
   hold, folded again and sent to shards of their own, and so on while that helps. Which
   grams many hold is told from ``SAMPLE`` of the contexts: whatever is told, equal windows
   get equal keys, so only the shards' sizes hang on it.

A given reference is broadcast as automata, a block of bounded size at a time
(``remove_matches``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_long, discard, fresh, mixed, release, shuffle_partitions, small_batches, splittable, text_bytes, written

GRAM = 8
#: Different contexts under a minimizer beyond which they are dealt out by a second key.
SPLIT = 256
#: Contexts under such a minimizer that show which grams they share.
SAMPLE = 64
#: Words an automaton holds before the next one is begun.
SHARD_WORDS = 60_000
#: Words handled at once; a longer document is keyed in overlapping stretches.
STRETCH = 1 << 22
#: Words of documents that are keyed together.
TOGETHER = 250_000
#: Words whose hashes a worker remembers.
CACHE_WORDS = 300_000
#: Bytes of reference text whose automata are broadcast at once: some 60 times as much.
BROADCAST_BYTES = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_KNOWN = _Hashes()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, b, dtype=np.uint64))] for b in (_B, _B_INV)]
    return _POWERS[0], _POWERS[1]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


class Stretch:
    """Hashes of all runs of words in a row of words, given by their own hashes."""

    def __init__(self, words: np.ndarray):
        w = words
        up, self.down = _powers(len(words) + 1)
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(w * up[: len(w)], out=self.total[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of words[start:end], whatever stands around them."""
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def contexts(sizes: np.ndarray, words: np.ndarray, window: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of documents of ``sizes`` words, as hashes, laid end to end: (document, first window's start
    there, number of windows, minimizer hash) of every context. Grams whose hash is in
    ``common`` are least of all only where a window holds no other."""
    gram = min(GRAM, window)
    ends = np.cumsum(sizes)
    n = len(words)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    grams = Stretch(words).runs(at, at + gram)
    rank = grams >> np.uint64(1)
    if common is not None:
        rank |= np.isin(grams, common).astype(np.uint64) << np.uint64(63)
    # The upper 40 bits of the hash and the place: a minimum is the leftmost of the least.
    low = (rank & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = np.arange(n - window + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(starts)]
    inside = starts + window <= ends[doc]
    starts, doc = starts[inside], doc[inside]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    anchor = (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first, last = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
    d = doc[new]
    return d, first - (ends - sizes)[d], last - first + 1, grams[anchor[new]]


def _halves(contexts: list[bytes]) -> np.ndarray:
    """128 bits of the SHA-256 of each context's words, as two longs."""
    raw = b"".join([hashlib.sha256(x).digest()[:16] for x in contexts])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def _sliced(words: list[bytes], first: np.ndarray, size: np.ndarray) -> list[bytes]:
    """words[a : a + n], joined by spaces, for each of ``first`` and ``size``."""
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    return _between(b" ".join(words), ends, first, size)


def _between(text: bytes, ends: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The same of words that are joined already; ``ends``: where each word's successor begins."""
    begins = np.r_[0, ends[:-1]]
    return [text[a:b] for a, b in zip(begins[first].tolist(), (ends[first + size - 1] - 1).tolist(), strict=True)]


def _longs(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """(row, first, n, h, c1, c2): every context of every text."""
    names = ["row", "first", "n", "h", "c1", "c2"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(b.column(1), "")))
            coded = lists.flatten().dictionary_encode()
            hashes = hashed(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]
            long = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            joined = text_bytes(pc.binary_join(lists, " "))
            units: list[tuple[int, int, int]] = []  # row, first word, words
            held = 0

            def out(units: list[tuple[int, int, int]], rows=rows, hashes=hashes, long=long, offsets=offsets, joined=joined) -> pa.RecordBatch:
                u = np.array(units, dtype=np.int64)
                own = np.concatenate([np.arange(offsets[r] + a, offsets[r] + a + m) for r, a, m in units])
                d, first, n, h = contexts(u[:, 2], hashes[own], window)
                parts = []
                for r, a, m in units:  # stretches of a text are its bytes from one word to another
                    if a == 0 and m == offsets[r + 1] - offsets[r]:
                        parts.append(joined[r])
                    else:
                        at = np.r_[0, np.cumsum(long[offsets[r] : offsets[r + 1]] + 1)]
                        parts.append(joined[r][at[a] : at[a + m] - 1])
                c = _halves(_between(b" ".join(parts), np.cumsum(long[own] + 1), first + (np.cumsum(u[:, 2]) - u[:, 2])[d], n + window - 1)) if len(d) else np.empty((0, 2), np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array(rows[u[d, 0]]), pa.array((first + u[d, 1]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_long(h)), pa.array(c[:, 0]), pa.array(c[:, 1])], names
                )

            for i, m in enumerate(np.diff(offsets).tolist()):
                for at in range(0, m - window + 1, STRETCH):
                    part = min(m - at, STRETCH + window - 1)
                    if units and held + part > TOGETHER:
                        yield out(units)
                        units, held = [], 0
                    units.append((i, at, part))
                    held += part
            if units:
                yield out(units)

    return texts.mapInArrow(each, "row long, first int, n int, h long, c1 long, c2 long")


class SuffixAutomaton:
    """Of several texts of words with weights; each state knows how often its words occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, words: list, weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += weight
                continue
            p, cur = last, -1
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(weight)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            split = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            count.append(0)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = split
                p = link[p]
            link[q] = split
            if cur >= 0:
                link[cur] = split
                last = cur
            else:
                count[split] = weight
                last = split

    def finish(self) -> None:
        """Pass counts on to the suffixes; no text may be added after."""
        link, count = self.link, self.count
        for v in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            if link[v] > 0:
                count[link[v]] += count[v]

    def repeats(self, words: list, window: int, least: int) -> list[int]:
        """Starts of windows of ``words`` that occur at least ``least`` times here.

        Streams the words, keeping the matching statistics: the state of the longest
        suffix read so far that occurs, and its length.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v = matched = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            if matched >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                if count[u] >= least:
                    out.append(i - window + 1)
        return out


def _ranges(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of consecutive starts: (first, number)."""
    at = 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] == starts[end - 1] + 1:
            end += 1
        yield starts[at], end - at
        at = end


def _stream_shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key -> the ranges of their windows that the shard holds twice."""
    names, kinds = ["h", "c1", "c2", "at", "m"], [pa.int64()] * 3 + [pa.int32()] * 2
    held: list[tuple] = []
    n_words = 0

    def flush(held: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for x in held:
            automaton.add(x[-1], x[-2])
        automaton.finish()
        return _longs([(h, c1, c2, at, m) for h, c1, c2, _, words in held for at, m in _ranges(automaton.repeats(words, window, 2))], names, kinds)

    last = None
    for b in batches:
        for h, c1, c2, weight, text in zip(*(b[x].to_pylist() for x in ("h", "c1", "c2", "weight", "words")), strict=True):
            if h != last and n_words >= SHARD_WORDS:
                yield flush(held)
                held, n_words = [], 0
            last = h
            words = text.split(b" ")
            held.append((h, c1, c2, weight, words))
            n_words += len(words)
    if held:
        yield flush(held)


def _judged(pieces: DataFrame, window: int) -> DataFrame:
    """(h, c1, c2, at, m): the ranges of each piece's windows that repeat in its shard."""
    own = pieces.select("h", "c1", "c2", "weight", "words")
    dealt = own.repartition(shuffle_partitions(own.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(lambda it: _stream_shards(it, window), "h long, c1 long, c2 long, at int, m int")


def _cut(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the contexts (h, c1, c2, weight, different) that ``wanted`` names, by text."""
    names = ["h", "c1", "c2", "weight", "different", "words"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, wants in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = text.split()
                rows += [(x["h"], x["c1"], x["c2"], x["weight"], x["different"], b" ".join(words[x["first"] : x["first"] + x["n"] + window - 1])) for x in wants]
                if len(rows) > 20_000:
                    yield _longs(rows, names, kinds)
                    rows = []
            yield _longs(rows, names, kinds)

    by_text = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "n", "h", "c1", "c2", "weight", "different")).alias("wanted"))
    return texts.join(splittable(by_text), "row").select("text", "wanted").mapInArrow(each, "h long, c1 long, c2 long, weight long, different long, words binary")


def _grams(pieces: DataFrame, window: int) -> DataFrame:
    """(h, g): the grams of some ``SAMPLE`` contexts of each minimizer."""
    gram = min(GRAM, window)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, g = [], []
            for key, text in zip(b["h"].to_pylist(), b["words"].to_pylist(), strict=True):
                words = text.split(b" ")
                at = np.arange(len(words) - gram + 1)
                own = np.unique(Stretch(hashed(words)).runs(at, at + gram))
                h.append(np.full(len(own), key))
                g.append(as_long(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (h, g)], ["h", "g"])

    # Halves of a SHA-256 are as good as random.
    return pieces.where(F.pmod("c1", "different") < SAMPLE).select("h", "words").mapInArrow(grams, "h long, g long")


def _shared(pieces: DataFrame, window: int) -> DataFrame:
    """(h, common): the grams that, going by the sample, over half of ``SPLIT`` of a minimizer's contexts hold."""
    held = _grams(pieces, window).groupBy("h", "g").count().where("count > 1")
    sizes = splittable(pieces.select("h", "different").distinct())
    held = held.join(sizes, "h").where(2 * F.col("count") * F.col("different") > SAMPLE * SPLIT)
    return held.groupBy("h").agg(F.collect_list("g").alias("common"))


def _split(pieces: DataFrame, window: int, largest: int) -> DataFrame:
    """(h, c1, c2, at, m) of pieces under very common minimizers, dealt out by a second key.

    ``largest``: how many different contexts a minimizer has at most.
    """
    many = splittable(_shared(pieces, window))
    names = ["h", "c1", "c2", "weight", "words", "h0", "c10", "c20", "off"]

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, c1, c2, weight, text, common in zip(*(b[x].to_pylist() for x in ("h", "c1", "c2", "weight", "words", "common")), strict=True):
                words = text.split(b" ")
                _, first, n, key = contexts(np.array([len(words)]), hashed(words), window, np.array(common or [], dtype=np.int64).view(np.uint64))
                key = as_long(mixed(key ^ np.array([h], dtype=np.int64).view(np.uint64)))
                own = _sliced(words, first, n + window - 1)
                rows += [(k, *c, weight, x, h, c1, c2, a) for k, c, x, a in zip(key.tolist(), _halves(own).tolist(), own, first.tolist(), strict=True)]
            yield _longs(rows, names, [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()])

    parts = pieces.join(many, "h", "left").select("h", "c1", "c2", "weight", "words", "common")
    parts = written(parts.mapInArrow(anew, "h long, c1 long, c2 long, weight long, words binary, h0 long, c10 long, c20 long, off int"), "parts")
    folded = parts.groupBy("h", "c1", "c2").agg(F.sum("weight").alias("weight"), F.any_value("words").alias("words"))
    hot = written(parts.select("h", "c1", "c2").distinct().groupBy("h").agg(F.count("*").alias("different")).where(F.col("different") > SPLIT), "hot")
    now = hot.agg(F.max("different").alias("n")).first()["n"] or 0
    if 0 < 2 * now <= largest:
        again = written(folded.join(splittable(hot), "h"), "again")
        judged = _judged(folded.join(splittable(hot), "h", "left_anti"), window).unionByName(_split(again, window, now))
    else:  # no second key sets the rest apart: their automaton is as large as it is
        judged = _judged(folded, window)
    found = judged.groupBy("h", "c1", "c2").agg(F.collect_list(F.struct("at", "m")).alias("found"))
    back = parts.select("h", "c1", "c2", "h0", "c10", "c20", "off").join(splittable(found, merge=True), ["h", "c1", "c2"])
    back = back.select("h0", "c10", "c20", "off", F.explode("found").alias("x"))
    return back.select(F.col("h0").alias("h"), F.col("c10").alias("c1"), F.col("c20").alias("c2"), (F.col("off") + F.col("x.at")).alias("at"), F.col("x.m").alias("m"))


def repeated(texts: DataFrame, window: int) -> DataFrame:
    """(row, ranges): of ``texts`` (row, text), the ranges (first, n) of starts whose window repeats."""
    occ = written(_occurrences(texts, window), "occurrences")
    folded = written(occ.groupBy("h", "c1", "c2").agg(F.count("*").alias("weight"), F.min(F.struct("row", "first", "n")).alias("of")), "folded")
    release(texts.sparkSession)
    by_h = folded.groupBy("h").agg(F.sum("weight").alias("total"), F.count("*").alias("different")).where("total > 1")
    by_h = splittable(by_h.select("h", "different"))
    able = written(folded.join(by_h, "h").select("h", "c1", "c2", "weight", "of.*", "different"), "able")
    discard(folded)
    pieces = written(_cut(texts, able, window), "pieces")
    discard(able)
    judged = _judged(pieces.where(F.col("different") <= SPLIT), window)
    largest = pieces.agg(F.max("different").alias("n")).first()["n"] or 0
    if largest > SPLIT:
        judged = judged.unionByName(_split(pieces.where(F.col("different") > SPLIT), window, largest))
    found = written(judged.groupBy("h", "c1", "c2").agg(F.collect_list(F.struct("at", "m")).alias("found")), "judged")
    discard(pieces)
    # Occurrences lie in files by text, so those of a common context are spread over them.
    spans = occ.select("row", "first", "h", "c1", "c2").join(splittable(found, merge=True), ["h", "c1", "c2"])
    spans = spans.select("row", F.explode(F.transform("found", lambda x: F.struct((F.col("first") + x["at"]).alias("first"), x["m"].alias("n")))).alias("r"))
    ranges = written(spans.groupBy("row").agg(F.collect_list("r").alias("ranges")), "ranges")
    discard(occ)
    discard(found)
    return ranges


def kept_words(words: list[bytes], ranges: list[tuple[int, int]], window: int) -> list[bytes]:
    """``words`` without those that a window of ``ranges`` covers."""
    if not ranges:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for first, n in ranges:
        change[first] += 1
        change[first + n + window - 1] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): each document without repeated passages.

    Words are what ASCII white space leaves. A word goes if a window of ``window`` words
    that covers it also starts anywhere else, same document included; windows are judged
    on the input. ``kept`` is the kept words joined by one space, or the text as it was if
    nothing went (null stays null). Copies of a document lose their windows alike, and so
    do repeated rows and rows with null ids: each row is a document. Shorter documents keep
    all; an empty table gives an empty one; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "documents")
    ranges = repeated(own.select("row", "text"), window)
    marked = own.join(splittable(ranges), "row", "left").select("id", "text", "ranges")
    return marked.mapInArrow(lambda it: _apply(it, window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``; all rows and columns stay.

    As ``substring_dedup``; texts that lose nothing, nulls included, stay as they were.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    row, runs = fresh("_row", names), fresh("_ranges", names)
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    ranges = repeated(own.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), window)
    marked = own.join(splittable(ranges.toDF(row, runs)), row, "left").select(*(F.col(f"`{c}`") for c in names), runs)
    at = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for raw, ranges in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if raw and ranges:
                    words = raw.encode().split()
                    raw = b" ".join(kept_words(words, [(x["first"], x["n"]) for x in ranges], window)).decode()
                texts.append(raw)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(each, docs.schema)


def _joined(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of words, and the words joined by one space, of each text; null counts as empty."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(texts)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
    return n, text_bytes(pc.binary_join(lists, " "))


def _apply(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, own = _joined(b["text"])
        gone, sha, kept = [], [], []
        for raw, text, ranges in zip(b["text"].to_pylist(), own, b["ranges"].to_pylist(), strict=True):
            if ranges:
                words = text.split(b" ")
                left = kept_words(words, [(x["first"], x["n"]) for x in ranges], window)
                text = b" ".join(left)
                gone.append(len(words) - len(left))
                kept.append(text.decode())
            else:
                gone.append(0)
                kept.append(raw)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(n), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])


def _shards(texts: list[list[bytes]]) -> list[SuffixAutomaton]:
    out: list[SuffixAutomaton] = []
    n = SHARD_WORDS
    for words in texts:
        if n + len(words) > SHARD_WORDS:
            out.append(SuffixAutomaton())
            n = 0
        out[-1].add(words)
        n += len(words)
    for a in out:
        a.finish()
    return out


def remove_matches(docs: DataFrame, reference: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """As ``substring_dedup``, but a word goes if its window occurs in ``reference``.

    The reference is broadcast as suffix automata of shards, a block of about
    ``BROADCAST_BYTES`` of its text at a time, and the documents stream through each block;
    texts longer than a shard are cut in stretches that overlap by a window. A reference in
    the order of the documents' own size is better joined to them: ``substring_dedup``.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in text_bytes(b.column(0)):
                words = raw.split()
                out += [b" ".join(words[i : i + SHARD_WORDS + window - 1]) for i in range(0, len(words) - window + 1, SHARD_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    parts = reference.select(F.col(f"`{reference_col}`").cast("string").alias("text")).mapInArrow(stretches, "words binary").distinct()
    parts = written(parts, "reference")
    size = parts.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BROADCAST_BYTES))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "documents")
    spans = None
    for block in range(blocks):
        held = parts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()  # about BROADCAST_BYTES
        sent = spark.sparkContext.broadcast(_shards([bytes(r["words"]).split() for r in held]))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for row, raw in zip(b["row"].to_pylist(), b["text"].to_pylist(), strict=True):
                    words = (raw or "").encode().split()
                    rows += [(row, f, m) for a in sent.value for f, m in _ranges(a.repeats(words, window, 1))]
                yield _longs(rows, ["row", "first", "n"], [pa.int64(), pa.int32(), pa.int32()])

        found = written(own.select("row", "text").mapInArrow(each, "row long, first int, n int"), "matches")
        sent.destroy()
        spans = found if spans is None else spans.unionByName(found)
    ranges = spans.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    marked = own.join(splittable(ranges), "row", "left").select("id", "text", "ranges")
    return marked.mapInArrow(lambda it: _apply(it, window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
