"""Best-fit packing of token sequences by a configuration linear program.

Texts become token pieces of at most ``capacity`` ids. Only the length histogram, at
most ``capacity`` numbers whatever the corpus, reaches the driver. There the
configuration program (how many sequences of each mix of lengths) is solved by
multiplicative weights whose pricing step is a knapsack dynamic program, then rounded
down; what rounding leaves goes by best fit, longest first, into the gaps and into new
sequences. The plan maps (length, rank among pieces of that length) to a place, so each
executor places its own pieces.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, splittable, strung, written

#: Classes that lengths are rounded up to in the program, and its rounds.
CLASSES = 128
ROUNDS = 240
#: Roundings tried: how full a mix must be, and the share of it that is taken.
FULL = (0.9, 0.99)
SHARES = (0.9, 0.5, 0.2, 0.05)
#: Words whose ids a worker remembers.
CACHE_WORDS = 700_000
#: Bytes of text whose words are looked up together.
GROUP_BYTES = 8 << 20
#: Marks that end a word, each its own run after letters.
MARKS = b".,!?;:%#*$&"


def _plain() -> frozenset[str]:
    """Letters that stay one letter each when they are composed or lower-cased.

    From the Latin, Greek and Cyrillic blocks, where all versions of Unicode agree; a letter
    like the dotted capital I, whose small form is a letter and a mark, is none of them, nor
    is the capital sigma, whose small form hangs on its place.
    """
    same = lambda c: unicodedata.normalize("NFC", c) == c and len(c) == 1 and c.isalpha()
    return frozenset(c for c in map(chr, range(0x530)) if same(c) and same(c.lower()) and c != "Σ")


PLAIN = _plain()


class WordIds:
    """Ids of whole texts, from remembered ids of their words.

    Sound for tokenizers that compose, lower-case and drop white space, never join across
    it, and part letters from marks: a text's ids are then those of its white-space
    separated words in turn. The ids of a word of plain letters and of the marks that end
    it are those of the letters, then those of the marks; any other word is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        suffix = own["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        # Small plain letters need none of the steps before the model but the cut into words.
        own |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.lean = Tokenizer.from_str(json.dumps(own | {"added_tokens": []}))
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 4000):
            got = self.tokenizer.encode_batch_fast([x.decode() for x in words[at : at + 4000]], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in got]
        return out

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of small plain letters, each a single run: encoded together and cut where one ends."""
        out: list[bytes] = []
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.lean.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # this tokenizer has no mark for the end of a run
                out += self._encode(part)
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _found(self, word: bytes) -> bytes | None:
        got = self.known.get(word)
        return self.old.get(word) if got is None else got

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that aren't remembered."""
        cores = []
        for w in words:
            core = w.lower().rstrip(MARKS)
            if not core.isalpha():  # not ASCII letters alone
                letters = core.decode()
                core = letters.lower().encode() if letters and PLAIN.issuperset(letters) else b""
            cores.append(core)
        wanted = [c for c in set(cores) if c and self._found(c) is None]
        made = dict(zip(wanted, self._encode_letters(wanted), strict=True))
        marks = {w[len(w.rstrip(MARKS)) :] for w, c in zip(words, cores, strict=True) if c}
        other = [w for w, c in zip(words, cores, strict=True) if not c] + [m for m in marks if m and self._found(m) is None]
        whole = dict(zip(other, self._encode(other), strict=True)) | {b"": b""}
        self.known.update(made)

        def ids(w: bytes, core: bytes) -> bytes:
            if not core:
                return whole[w]
            own = made.get(core) or self._found(core)
            end = w[len(w.rstrip(MARKS)) :]
            return own + (whole.get(end) or self._found(end)) if end else own

        out = [ids(w, c) for w, c in zip(words, cores, strict=True)]
        self.known.update((m, whole[m]) for m in marks if m in whole and m)
        return out

    def values(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Of two generations the older goes as the younger fills up, so
        that common words stay."""
        out: list = list(map(self.known.get, words))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            for i in new:
                out[i] = self.old.get(words[i])
            fresh = [i for i in new if out[i] is None]
            for i, v in zip(fresh, self._learned([words[i] for i in fresh]), strict=True):
                out[i] = v
            if len(words) <= CACHE_WORDS // 2:  # one text may have more distinct words than are remembered
                self.known.update((words[i], out[i]) for i in new)
            if len(self.known) > CACHE_WORDS // 2:
                self.old, self.known = self.known, {}
        return out

    def __call__(self, texts: pa.Array | list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty.

        Words are told apart and numbered by Arrow, and only distinct ones become objects.
        """
        if isinstance(texts, list):
            texts = pa.array([t.decode() for t in texts], pa.string())
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, side="right")))
            lists = pc.ascii_split_whitespace(texts.slice(at, end - at))
            coded = lists.flatten().dictionary_encode()
            own = self.values(coded.dictionary.cast(pa.binary()).to_pylist())
            offsets = lists.offsets.to_numpy()
            yield from strung(own, coded.indices.to_numpy(), offsets - offsets[0])
            at = end


_OPEN: dict[str, WordIds] = {}


def _ids(path: str) -> WordIds:
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its partition."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _ids(tokenizer), TaskContext.get().partitionId()
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    n = len(own) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(seen[n])
                    seen[n] += 1
            ids_ = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(each, "id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable mix within ``capacity``: unbounded knapsack by dynamic programming.

    Returns how many of each size.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int32)
    for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        for at in range(size, capacity + 1, size):
            to = best[at : at + size]
            through = best[at - size : at - size + len(to)] + value
            up = through > to + 1e-15
            to[up] = through[up]
            last[at : at + size][up] = k
    mix, at = np.zeros(len(sizes), dtype=np.int64), capacity
    at = int(np.argmax(best))
    while at > 0:
        if last[at] < 0:
            at -= 1
            continue
        mix[last[at]] += 1
        at -= int(sizes[last[at]])
    return mix


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """A near-optimal fractional solution: mixes of sizes and how often each is used.

    Multiplicative weights on the covering program min sum(x), sum(mix * x) >= counts:
    a size's price falls exponentially with the share of it that is covered.
    """
    need, covered = counts.astype(float), np.zeros(len(sizes))
    used: dict[bytes, list] = {}
    eta = 2.0 * np.log(len(sizes) + 2)
    for _ in range(rounds):
        share = covered / need
        weights = np.exp(-eta * (share - share.min()))
        mix = price(sizes, weights / need, capacity)
        if not mix.any():
            break
        on = mix > 0
        step = float((need[on] / mix[on]).min()) / 8
        used.setdefault(mix.tobytes(), [mix, 0.0])[1] += step
        covered += step * mix
    if not used:
        return []
    # As many of each as their sizes ask for: no size is covered more than once over.
    over = np.maximum(covered / need, 1e-12)
    return [(mix, x / float(over[mix > 0].max())) for mix, x in used.values()]


def fewest(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> int:
    """A number of sequences that no packing stays below: the program's dual.

    Prices under which no mix is worth more than one sequence bound the total from below by
    what all pieces are worth. The classes' shortest lengths are priced, so that every
    packing of the pieces is one of the classes; the sum of lengths is a price list too.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return 0
    least = -(-sum(k * v for k, v in left.items()) // capacity)
    sizes, need, _ = _classes(left, min)
    covered = np.zeros(len(sizes))
    eta = 2.0 * np.log(len(sizes) + 2)
    for _ in range(rounds):
        share = covered / need
        prices = np.exp(-eta * (share - share.min())) / need
        mix = price(sizes, prices, capacity)
        worth = float(prices @ mix)
        if worth <= 0:
            break
        least = max(least, int(np.ceil(float(prices @ need) / worth - 1e-6)))
        on = mix > 0
        covered += float((need[on] / mix[on]).min()) / 8 * mix
    return least


def _classes(left: dict[int, int], stands) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Linear grouping into classes of about equal counts: the length that ``stands`` for
    each, its number of pieces, and its lengths with theirs, longest first."""
    lengths = np.array(sorted(left))
    counts = np.array([left[x] for x in lengths.tolist()])
    cls = np.minimum((np.cumsum(counts) - counts) * CLASSES // counts.sum(), CLASSES - 1)
    ids = np.unique(cls)
    sizes = np.array([stands(lengths[cls == c].tolist()) for c in ids])
    need = np.array([counts[cls == c].sum() for c in ids])
    return sizes, need, [[(int(x), left[int(x)]) for x in lengths[cls == c][::-1]] for c in ids]


@dataclass
class Group:
    """``count`` sequences that hold the same lengths."""

    count: int
    held: dict[int, int] = field(default_factory=dict)

    @property
    def full(self) -> int:
        return sum(k * v for k, v in self.held.items())


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups of sequences that hold every piece of ``histogram`` (length to number).

    The fractional solution is rounded down at several levels, each of which takes a share
    of every mix that is full enough and leaves the rest to best fit. The roundings and
    best fit of everything are compared, and the one with the fewest sequences stands.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    whole: list[Group] = []
    if left.pop(capacity, 0):
        whole.append(Group(histogram[capacity], {capacity: 1}))
    if not left:
        return whole
    sizes, need, members = _classes(left, max)
    mixes = sorted(configurations(sizes, need, capacity), key=lambda p: (-int(p[0] @ sizes), -p[1]))
    best = best_fit([], dict(left), capacity)
    for full in FULL:
        own = [(mix, x) for mix, x in mixes if int(mix @ sizes) >= full * capacity]
        for share in SHARES:
            groups, rest = _rounded([(mix, x * share) for mix, x in own], members)
            groups = best_fit(groups, rest, capacity)
            if sum(g.count for g in groups) < sum(g.count for g in best):
                best = groups
    return whole + best


def _rounded(mixes: list[tuple[np.ndarray, float]], members: list[list[tuple[int, int]]]) -> tuple[list[Group], dict[int, int]]:
    """Whole numbers of sequences of each mix, filled with the classes' longest pieces; what is left."""
    queues = [[[length, n] for length, n in m] for m in members]
    groups: list[Group] = []
    for mix, x in mixes:
        wants = {int(k): int(mix[k]) for k in np.flatnonzero(mix)}
        todo = min(int(x), *(sum(n for _, n in queues[k]) // m for k, m in wants.items()))
        while todo:
            # As many alike sequences as the longest of each class last.
            held: dict[int, int] = {}
            times = todo
            for k, n in wants.items():
                for length, has in queues[k]:
                    m = min(has, n)
                    held[length] = held.get(length, 0) + m
                    times = min(times, has // m)
                    n -= m
                    if not n:
                        break
            for k in wants:
                for entry in queues[k]:
                    entry[1] -= times * held.get(entry[0], 0)
                queues[k] = [e for e in queues[k] if e[1]]
            groups.append(Group(times, held))
            todo -= times
    return groups, {length: n for q in queues for length, n in q}


def best_fit(groups: list[Group], left: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first, of what is left into ``groups`` and new sequences."""
    by_free: dict[int, list[Group]] = {}
    frees: list[int] = []

    def put(g: Group) -> None:
        free = capacity - g.full
        if free not in by_free or not by_free[free]:
            by_free.setdefault(free, [])
            bisect.insort(frees, free)
        by_free[free].append(g)

    for g in groups:
        put(g)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                if n >= each:
                    put(Group(n // each, {length: each}))
                    n %= each
                else:
                    put(Group(1, {length: n}))
                    n = 0
                continue
            free = frees[at]
            g = by_free[free].pop()
            if not by_free[free]:
                frees.pop(at)
            times = min(n, g.count)
            if g.count > times:
                put(Group(g.count - times, dict(g.held)))
            put(Group(times, g.held | {length: g.held.get(length, 0) + 1}))
            n -= times
    return [g for gs in by_free.values() for g in gs if g.count]


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """Intervals of ranks of a length, each with its first sequence and offset, sorted by key."""
    rows, rank, first = [], {}, 0
    for g in groups:
        offset = 0
        for length, n in sorted(g.held.items(), reverse=True):
            at = rank.get(length, 0)
            rows.append((length, at, g.count, first, offset))
            rank[length] = at + n * g.count
            offset += n * length
        first += g.count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "first", "offset"), a.T, strict=True))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where each piece lies.

    Null and empty texts hold only the end id. Rows with equal or null ids are documents
    of their own. Documents longer than ``capacity`` are cut, no others. Sequences are
    gapless from 0; ties are broken by the pieces' order of reading. An empty table gives
    an empty one; extra columns are ignored.
    """
    held = written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = written(held.groupBy("part", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    at = places(plan(histogram, capacity))
    before = counts.select(
        "part",
        "length",
        (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"),
    )
    key = at["length"] << 44 | at["rank"] if len(at.get("length", ())) else np.empty(0, np.int64)
    size, first, offset, start = (at.get(k, np.empty(0, np.int64)) for k in ("count", "first", "offset", "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            into = rank - start[i]
            seq, off = first[i] + into % size[i], offset[i] + into // size[i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = held.join(splittable(before, merge=True), ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
