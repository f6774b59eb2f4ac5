"""Personal data by weak supervision.

Labelers of three sorts (format rules, gazetteers, context words) vote on candidate
spans. Votes are counted over all documents by pattern: kind, votes, and coarse traits of
the span that no labeler looks at (length, letters and digits, separators, neighbours,
words that speak of something else). There is a fixed number of patterns, whatever the
corpus holds. Expectation-maximisation estimates each labeler's reliability from the votes
alone. A logistic span classifier is then trained on the soft labels; it sees the traits
too, so what the labelers leave open is settled by what a span looks like. Spans of the
base rules always stay; the classifier adds others.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, small_batches

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = KINDS[:4]
#: How often a true number fails its own checksum (typing errors).
CHECKSUM_MISS = 0.005
LABELERS = ("format", "checksum", "gazetteer", "context", "shape")
#: What a kind's commonest pattern would weigh in the span classifier if it were the only one.
SPANS = 30.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose candidates; whatever overlaps a base span is left out.
_LOOSE = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}={0,2}")),
    ("phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("id", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9.-])")),
)
#: Gazetteers: fixed values.
_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "60", "65", "62", "2")
_PREFIXES = ("ghp_", "sk-", "sk_", "pk_", "AKIA", "xox", "AIza", "glpat-", "eyJ")
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "91")
_CUES = {
    "email": ("mail", "contact", "write to", "e-mail", "correo", "@"),
    "ip": ("ip", "host", "server", "address", "addr", "adresse"),
    "card": ("card", "visa", "credit", "tarjeta", "karte", "carte", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial"),
    "secret": ("token", "secret", "key", "passw", "pwd", "auth", "bearer", "credential"),
    "id": ("ssn", "social", "iban", "account", "passport", "identity", "konto"),
}
#: Words that speak of numbers and codes which are nobody's.
_OTHER = ("version", "isbn", "order", "invoice", "commit", "sha", "uuid", "doi", "http", "page", "chapter", "part no", "serial", "model")


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; linear however long the words are."""
    last, at = 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        if m:
            s = at
            while s > last and t[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                yield s, m.end()
                last = m.end()
                at = t.find("@", last)
                continue
        at = t.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> int | None:
    """The number if it is at most 255, however many zeros lead it."""
    own = digits.lstrip("0")
    return int(own or "0") if len(own) <= 3 and (len(own) < 3 or own <= "255") else None


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The base rules' spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return out
    for m in _IP.finditer(t):
        if all(_byte(p) is not None for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def loose_spans(t: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, which overlap neither base spans nor each other."""
    if not _DIGIT.search(t):
        return []
    starts, ends = [], []  # of what is taken: runs apart from each other, as base spans may overlap
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, rule in _LOOSE:
        for m in rule.finditer(t):
            a, b = m.span()
            if kind == "secret" and not (_DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            i = bisect.bisect_left(starts, b)
            if i and ends[i - 1] > a:
                continue
            out.append((kind, a, b))
            starts.insert(i, a)
            ends.insert(i, b)
    return out


def traits(t: str, kind: str, a: int, b: int) -> str:
    """One character a trait: length, variety, letters, separator, left, right, other talk."""
    s = t[a:b]
    core = [c for c in s if c.isalnum()]
    apart = sorted({c for c in s if not c.isalnum()})
    letters = [c for c in core if not c.isdigit()]
    side = lambda c: "^" if not c else "s" if c.isspace() else "a" if c.isalnum() else "=" if c in "=:\"'`" else "p"
    before = t[max(0, a - 28) : a].lower()
    return "".join(
        (
            str(min(9, len(s).bit_length())),
            str(4 * len(set(core)) // (len(core) + 1)),
            "d" if not letters else "l" if len(letters) == len(core) else "x" if any(c.isupper() for c in letters) and any(c.islower() for c in letters) else "m",
            "0" if not apart else "*" if len(apart) > 1 else {" ": "s", "-": "-", ".": "."}.get(apart[0], "o"),
            side(t[a - 1 : a]),
            side(t[b : b + 1]),
            "+" if any(c in before for c in _OTHER) else "0",
        )
    )


def pattern(t: str, kind: str, a: int, b: int, is_base: bool) -> str:
    """What the model knows of a span: its votes and its traits."""
    return f"{votes(t, kind, a, b, is_base)}|{traits(t, kind, a, b)}"


def votes(t: str, kind: str, a: int, b: int, is_base: bool) -> str:
    """Kind, base or loose, and one character a labeler: + for, - against, 0 silent."""
    s, d = t[a:b], _digits(t[a:b])
    before = t[max(0, a - 28) : a].lower()
    fmt = "+" if is_base else "0"
    check = gaz = "0"
    shape = "+"
    if kind == "email":
        gaz = "+" if s.rpartition(".")[2].lower() in _DOMAINS else "-"
        shape = "+" if len(s) <= 254 and ".." not in s else "-"
    elif kind == "ip":
        parts = s.split(".")
        gaz = "-" if _byte(parts[0]) in (0, 127, 255) else "+"
        shape = "+" if all(len(p) == 1 or p[0] != "0" for p in parts) else "-"
    elif kind == "card":
        fmt = "+" if 16 <= len(d) <= 19 else "-"
        check = "+" if luhn(d) else "-"
        gaz = "+" if d.startswith(_ISSUERS) else "-"
        shape = "-" if len(set(d)) < 3 else "+"
    elif kind == "phone":
        gaz = "+" if s[0] == "+" and d.startswith(_COUNTRIES) else "0" if s[0] != "+" else "-"
        fmt = "+" if is_base or s[0] == "(" else "0"
        shape = "-" if len(set(d)) < 3 else "+"
    elif kind == "secret":
        core = s.rstrip("=")
        hexed = not core.strip("0123456789abcdef") or not core.strip("0123456789ABCDEF")
        mixed = sum(x.isdigit() != y.isdigit() for x, y in zip(core, core[1:], strict=False))
        fmt = "+" if hexed and len(core) in (32, 40, 48, 56, 64, 96, 128) else "0"
        gaz = "+" if s.startswith(_PREFIXES) else "0"
        shape = "+" if mixed >= len(core) // 6 else "-"
        if a and b < len(t) and t[a - 1] in "\"'`" and t[b] in "\"'`":
            check = "+"
    elif kind == "id":
        if s[:2].isalpha():
            x = re.sub(r"[^A-Z0-9]", "", s)
            check = "+" if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else "-"
        else:
            check = "-" if s.startswith(("000", "666", "9")) or s[4:6] == "00" or s.endswith("0000") else "+"
        shape = "-" if len(set(d)) < 3 else "+"
    context = "+" if any(c in before for c in _CUES[kind]) else "0"
    return f"{kind}|{'b' if is_base else 'l'}|{fmt}{check}{gaz}{context}{shape}"


def candidates(t: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(t)
    return base, loose_spans(t, base)


class Model:
    """Labeler reliabilities, and the probability that each vote pattern is personal data."""

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], dtype=float)
        kinds = np.array([KINDS.index(p.split("|")[0]) for p in patterns], dtype=int)
        v = np.array([["-0+".index(c) for c in p.split("|")[2]] for p in patterns], dtype=int).reshape(-1, len(LABELERS))
        # Start from the majority of the votes.
        q = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
        # table[y, kind, labeler, vote]; the prior keeps a labeler better than chance.
        prior = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])
        table = np.zeros((2, len(KINDS), len(LABELERS), 3))
        share = np.full(len(KINDS), 0.5)
        for _ in range(rounds if len(patterns) else 0):
            for y, w in ((0, n * (1 - q)), (1, n * q)):
                table[y] = prior[y]
                for j in range(len(LABELERS)):
                    np.add.at(table[y, :, j, :], (kinds, v[:, j]), w)
                table[y] /= table[y].sum(axis=-1, keepdims=True)
            # Checksums aren't opinions: a true number all but never fails its own.
            failed = table[1, :, LABELERS.index("checksum"), 0]
            table[1, :, LABELERS.index("checksum"), 1:] *= ((1 - CHECKSUM_MISS) / (1 - failed))[:, None]
            table[1, :, LABELERS.index("checksum"), 0] = CHECKSUM_MISS
            total = np.bincount(kinds, n, len(KINDS))
            share = (np.bincount(kinds, n * q, len(KINDS)) + 1) / (total + 2)
            logit = np.log(share / (1 - share))[kinds]
            for j in range(len(LABELERS)):
                logit += np.log(table[1, kinds, j, v[:, j]] / table[0, kinds, j, v[:, j]])
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.reliability = table
        self.share = share
        # The span classifier: logistic in kind, votes and traits, on the soft labels. Weights
        # are shares of a kind's spans, so that they are alike at every size of the corpus.
        own = [(p.split("|") + [""])[3] for p in patterns]
        seen = sorted({(i, c) for x in own for i, c in enumerate(x)})
        column = {x: i for i, x in enumerate(seen)}
        look = np.zeros((len(patterns), len(seen)))
        for r, x in enumerate(own):
            look[r, [column[i, c] for i, c in enumerate(x)]] = 1.0
        x = np.concatenate([np.eye(len(KINDS))[kinds], (v == 2).astype(float), (v == 0).astype(float), look], axis=1)
        w = np.zeros(x.shape[1])
        if len(patterns):
            weight = SPANS * np.sqrt(n / np.bincount(kinds, n, len(KINDS))[kinds])
            for _ in range(400):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                g = x.T @ (weight * (p - q)) + 0.05 * w
                h = x.T @ (x * (weight * p * (1 - p) + 1e-6)[:, None]) + 0.05 * np.eye(len(w))
                step = np.linalg.solve(h, g)
                w -= np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break
        self.weights = w
        self.probability = dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count vote patterns over all documents, then estimate. The driver gets patterns only."""
    small_batches(docs.sparkSession, FEW_ROWS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    base, loose = candidates(t)
                    seen.update(pattern(t, *x, True) for x in base)
                    seen.update(pattern(t, *x, False) for x in loose)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(each, "pattern string, n long")
    return Model({r["pattern"]: r["n"] for r in counts.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def spans_of(t: str, probability: dict[str, float], threshold: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of one text."""
    base, loose = candidates(t)
    return base, [x for x in loose if probability.get(pattern(t, *x, False), 0.0) >= threshold]


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row per document.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; rows
    with equal or null ids are documents of their own; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession, FEW_ROWS)
    probability = (model or fit(docs, text_col)).probability

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, alls = [], [], []
            for t in b.column(1).to_pylist():
                base, more = spans_of(t or "", probability, threshold)
                c = Counter(k for k, _, _ in base)
                counts.append([c[k] for k in BASE])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                alls.append(joined(base + more))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(shas, pa.string()), pa.array(alls, pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(each, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(t: str, spans: list[tuple[str, int, int]]) -> str:
    """``t`` with each span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; other columns and nulls stay."""
    small_batches(docs.sparkSession, FEW_ROWS)
    probability = (model or fit(docs, text_col)).probability
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not t else redacted(t, sum(spans_of(t, probability, threshold), [])) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(each, docs.schema)
