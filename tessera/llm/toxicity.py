"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

A lexicon of terms and stems is learned from labelled documents and kept as a trie. The
Levenshtein automata of its terms are run as one machine, the product of the trie with
the edit counts, made deterministic as words are met: a word is read letter by letter and
dies as soon as no term is within reach. A hit's context window tells quotation from
abuse (quotation marks, reporting verbs, address); a logistic model on hit counts by
context gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, discard, mixed, small_batches, splittable, written

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 24_000
#: Min-hashes of a text that tell how many of the sampled texts are like it.
SKETCH = 8
#: What a text without copies weighs; copies share it. Whole numbers add up the same in any order.
WHOLE = 840
#: Lengths of the stems that the lexicon may hold, beside whole words.
STEMS = (3, 4, 5, 6, 7, 8)
#: Features counted in a worker before the counts go on.
HELD = 200_000
#: Deterministic states remembered before they are made anew.
STATES = 50_000
#: Words on either side of a hit that are its context.
WINDOW = 6

_WORD = re.compile(r"[^\W\d_]+")
#: Terms that are abusive whatever the labels say: fixed values.
SEED = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")
_REPORTS = frozenset("said says wrote writes called calls quoted quote word term phrase dit écrit sagte schrieb dijo escribió".split())
_ADDRESS = frozenset("you your you're u ur tu vous du ihr sie usted vosotros".split())
_QUOTES = frozenset("\"“”«»„‘’'")


def edits(term: str) -> int:
    """Errors allowed in a misspelling of ``term``: short terms have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms (whole words) and stems (words that begin so), matched with few errors."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        self.children: list[dict[str, int]] = [{}]
        self.term: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.budget: list[int] = [0]  # most errors that a term below allows
        for words, mark in ((self.terms, self.term), (self.stems, self.stem)):
            for w in words:
                at = 0
                self.budget[0] = max(self.budget[0], edits(w) if mark is self.term else 0)
                for c in w:
                    nxt = self.children[at].get(c)
                    if nxt is None:
                        nxt = self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.term.append(False)
                        self.stem.append(False)
                        self.budget.append(0)
                    at = nxt
                    self.budget[at] = max(self.budget[at], edits(w) if mark is self.term else 0)
                mark[at] = True
        self.depth_edits = {}
        for w in self.terms:
            self.depth_edits[self._node(w)] = edits(w)
        self._reset()

    def _node(self, w: str) -> int:
        at = 0
        for c in w:
            at = self.children[at][c]
        return at

    def _reset(self) -> None:
        self.sets: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[int] = []
        self.start = self._state(self._closure({0: 0}))

    def _closure(self, errors: dict[int, int]) -> dict[int, int]:
        """With every node reached by leaving out letters of a term."""
        todo = list(errors.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and errors.get(child, 99) > e + 1:
                    errors[child] = e + 1
                    todo.append((child, e + 1))
        return errors

    def _state(self, errors: dict[int, int]) -> int:
        key = frozenset(errors.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(errors)
            self.moves.append({})
            # 2: spelled right, 1: misspelled, 0: no term
            self.found.append(max((2 if e == 0 else 1 for n, e in errors.items() if self.term[n] and e <= self.depth_edits[n]), default=0))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        """The state after reading ``c``; -1 if no term is in reach, -2 if a stem is read."""
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.budget[child] or (not cost and letter == c):
                    if out.get(child, 99) > cost:
                        out[child] = cost
            if e + 1 <= self.budget[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
        if any(self.stem[n] and not e for n, e in out.items()):
            return -2
        return self._state(self._closure(out)) if out else -1

    def match(self, word: str) -> int:
        """2 for a term or stem spelled right, 1 for a misspelled term, else 0."""
        if len(self.sets) > STATES:
            self._reset()
        state = self.start
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._step(state, c)
            if nxt < 0:
                return 2 if nxt == -2 else 0
            state = nxt
        return self.found[state]


FEATURES = ("bias", "right", "misspelled", "quoted", "reported", "addressed", "kinds", "dense")
#: Prior means and precisions of the weights: what they are where labels say nothing.
_MEAN = np.array([-4.0, 4.0, 2.0, -2.0, -1.0, 0.5, 2.0, 0.3])
_PRECISION = np.array([0.05, 0.1, 0.5, 1.0, 1.0, 1.0, 0.2, 1.0])


@dataclass
class Scorer:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: _MEAN.copy())

    def __getstate__(self):
        return (self.lexicon.terms, self.lexicon.stems, self.weights)

    def __setstate__(self, s):
        self.lexicon, self.weights = Lexicon(s[0], s[1]), s[2]

    def __post_init__(self):
        self.known: dict[str, int] = {}

    def hit(self, word: str) -> int:
        """``match``, remembered."""
        known = self.__dict__.setdefault("known", {})
        got = known.get(word)
        if got is None:
            if len(known) > 400_000:
                known.clear()
            got = known[word] = self.lexicon.match(word)
        return got

    def features(self, text: str) -> np.ndarray | None:
        """None if nothing is hit."""
        low = text.lower()
        words = _WORD.findall(low)
        hit = self.hit
        if not any(map(hit, words)):
            return None
        spans = list(_WORD.finditer(low))
        right = wrong = quoted = reported = addressed = 0.0
        kinds = set()
        for i, m in enumerate(spans):
            kind = hit(m[0])
            if not kind:
                continue
            a, b = m.span()
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            left, after = low[max(0, a - 40) : a], low[b : b + 40]
            inside = (a > 0 and b < len(low) and low[a - 1] in _QUOTES and low[b] in _QUOTES) or any(
                left.count(q) % 2 and p in after for q, p in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“"))
            )
            if inside:
                quoted += 1
            elif kind == 2:
                right += 1
            else:
                wrong += 1
            reported += any(w in _REPORTS for w in around)
            addressed += any(w in _ADDRESS for w in around)
            kinds.add(m[0][:5])
        squash = math.log1p
        return np.array([1.0, squash(right), squash(wrong), squash(quoted), squash(reported), squash(addressed), squash(len(kinds)), min(1.0, 20 * (right + wrong) / len(words))])

    def score(self, text: str | None) -> float:
        x = self.features(text) if text else None
        z = float(self.weights[0] if x is None else self.weights @ x)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Maximum a posteriori under the priors, by damped Newton steps."""
    w = _MEAN.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + _PRECISION * (w - _MEAN)
        h = x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(_PRECISION)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -1.5, 1.5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def telling(counts: DataFrame, positives: int, negatives: int) -> DataFrame:
    """The features of ``counts`` (w, stem, pos, neg) whose texts are toxic more often than
    chance allows, as (w, stem, share, gain): a test of likelihoods that asks for more the more
    features are mostly toxic in three texts or more. Weights are in ``WHOLE``s."""
    base = (positives + WHOLE) / (positives + negatives + 2 * WHOLE)
    able = counts.where((F.col("pos") >= 3 * WHOLE) & (F.col("pos") > F.col("neg")))
    tried = max(2, able.count())
    n = (F.col("pos") + F.col("neg")) / float(WHOLE)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    rest = F.greatest(1 - share, F.lit(1e-12))
    gain = n * (share * F.log(share / base) + (1 - share) * F.log(rest / (1 - base)))
    own = able.where(share > max(0.6, 2 * base))
    return own.select("w", "stem", share.alias("share"), gain.alias("gain")).where(F.col("gain") >= math.log(tried) + 1)


def choose(rows: list[tuple[str, bool, float]]) -> Lexicon:
    """A lexicon of telling features (word or stem, is a stem, share of toxic texts).

    A stem stands for all words and longer stems that begin with it.
    """
    stems: list[str] = []
    kept: set[str] = set()
    for w in sorted((w for w, is_stem, share in rows if is_stem and share >= 0.9), key=lambda w: (len(w), w)):
        if not any(w[:k] in kept for k in range(2, len(w))):
            stems.append(w)
            kept.add(w)
    terms = [w for w, is_stem, _ in rows if not is_stem and not any(w[:k] in kept for k in range(2, len(w) + 1))]
    return Lexicon([*SEED, *terms], stems)


def sketch(text: str) -> list[int]:
    """Min-hashes of a text's four-word grams."""
    w = text.lower().split()
    grams = {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
    own = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
    return [int(mixed(own ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)).min() >> np.uint64(1)) for k in range(1, SKETCH + 1)]


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, pos, neg): the labelled texts with the weight of either label.

    A text counts once however many rows hold it, and its labels share its weight. Near
    copies share weights too: a text's is divided by its expected number of likes, the mean
    over its min-hashes of how many sampled texts agree on one.
    """
    spark = docs.sparkSession
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    rows = texts.join(F.broadcast(own), "id")  # at most ``sample`` pairs of numbers are broadcast
    rows = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.any_value("text").alias("text"), F.count("*").alias("n"), F.sum((F.col("y") * WHOLE).cast("long")).alias("y"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int64()))], [*b.schema.names, "sketch"])

    small_batches(spark, FEW_ROWS)
    rows = written(rows.mapInArrow(each, "key string, text string, n long, y long, sketch array<long>"), "sampled")
    marks = rows.select("key", F.posexplode("sketch").alias("i", "m"))
    alike = marks.groupBy("i", "m").agg(F.count("*").alias("alike"))
    likes = marks.join(splittable(alike), ["i", "m"]).groupBy("key").agg(F.sum("alike").alias("likes"))
    weight = F.floor(F.lit(WHOLE * SKETCH) / F.col("likes")) + 1  # no text goes
    share = F.col("y") / (F.col("n") * WHOLE)
    own = rows.join(likes, "key").select("text", weight.alias("w"), F.rint(weight * share).cast("long").alias("pos"))
    out = written(own.select("text", "pos", (F.col("w") - F.col("pos")).alias("neg")), "weighed")
    discard(rows)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Learn lexicon and weights from the labelled documents.

    At most ``sample`` labelled ids are used, those with the least hash; nothing else is
    bounded, so the lexicon's size follows from the sample alone. Clashing labels of an id or
    of a text are averaged, and copies share a text's weight (``sampled``). The result
    doesn't hang on how rows are dealt out.
    """
    rows = sampled(docs, labels, id_col, text_col, label_col, sample)
    total = rows.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        names = ["w", "stem", "pos", "neg"]

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            got = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names
            )
            seen[0].clear()
            seen[1].clear()
            return got

        for b in batches:
            for t, *both in zip(b["text"].to_pylist(), b["pos"].to_pylist(), b["neg"].to_pylist(), strict=True):
                words = set(_WORD.findall(t.lower()))
                keys = [(w, False) for w in words if len(w) > 2]
                keys += [(s, True) for s in {w[:k] for w in words for k in STEMS if len(w) > k}]
                for c, n in zip(seen, both, strict=True):
                    if n:
                        for k in keys:
                            c[k] += n
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield out()
        yield out()

    counts = rows.mapInArrow(counted, "w string, stem boolean, pos long, neg long").groupBy("w", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts, "features")
    # What a test of the sample leaves; the sample bounds it.
    lexicon = choose([(r["w"], r["stem"], r["share"]) for r in telling(counts, total["pos"] or 0, total["neg"] or 0).collect()])
    discard(counts)
    first = Scorer(lexicon)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}
        for b in batches:
            for t, *both in zip(b["text"].to_pylist(), b["pos"].to_pylist(), b["neg"].to_pylist(), strict=True):
                x = first.features(t)
                own = seen.setdefault(tuple(np.round(x, 2).tolist()) if x is not None else (), [0, 0])
                own[0] += both[0]
                own[1] += both[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k) for k in seen], pa.list_(pa.float64())), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], ["x", "pos", "neg"]
        )

    found = rows.mapInArrow(described, "x array<double>, pos long, neg long").groupBy("x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()  # at most a row a sampled text
    found = sorted((tuple(r["x"]), r["pos"], r["neg"]) for r in found)
    discard(rows)
    if not found:
        return first
    nothing = (1.0, *[0.0] * (len(FEATURES) - 1))
    n = np.array([p + q for _, p, q in found], dtype=float)
    return Scorer(lexicon, _fit_weights(np.array([x or nothing for x, _, _ in found]), np.array([p for _, p, _ in found]) / n, n / WHOLE))


def scores(docs: DataFrame, model: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``out_col``, replaced if it is there.

    Null and empty texts have the score of a text without hits. Other columns, nulls and
    repeated rows stay as they are; an empty table stays empty.
    """
    small_batches(docs.sparkSession, FEW_ROWS)
    kept = [c for c in docs.columns if c != out_col]
    at = kept.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # short strings, as many as a bounded sample holds

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for b in batches:
            got = pa.array([score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, out_col])

    from pyspark.sql import types as T

    own = docs.select(*(F.col(f"`{c}`") for c in kept))
    return own.mapInArrow(each, T.StructType([*own.schema.fields, T.StructField(out_col, T.DoubleType())]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3: remainder 1 is held out."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3
