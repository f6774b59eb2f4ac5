"""The training-data operators against brute force, with nulls, ties, copies and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, licences, packing, pieces, pii, simhash, substrings, toxicity, vectors, warc

DOCS = "doc_id long, text string, extra string, id long, k int"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "x", -1, 7) for i, t in texts], schema)


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, a common line, null, empty and a long text."""
    rng = random.Random(5)
    passage, line = words(rng, 60), words(rng, 20)
    out = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "a b")]
    whole = words(rng, 120)
    out += [(i, " ".join(whole)) for i in (5, 6, 7)]
    near = list(whole)
    near[70] = "changed"
    out.append((8, "\n".join(near)))
    for i in range(9, 30):
        own = words(rng, 50)
        at = rng.randrange(50)
        out.append((i, " ".join([*own[:at], *(passage if i % 3 else line), *own[at:]])))
    out.append((30, " ".join([*passage, *words(rng, 5), *passage])))
    out.append((31, " ".join(["same"] * 90)))
    out.append((32, " ".join(words(rng, 6000))))
    out.append((33, " ".join(passage[:35])))
    out.append((34, " ".join(passage[:34])))
    out += [(35, "repeated row " * 30), (35, "repeated row " * 30), (None, " ".join(whole)), (None, "alone")]
    return out


def brute_removed(texts, window):
    own = [(t or "").encode().split() for _, t in texts]
    seen = Counter(b" ".join(w[j : j + window]) for w in own for j in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[b" ".join(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("split", [256, 1])
def test_substrings(spark, texts, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    got = substrings.substring_dedup(frame(spark, texts), 35).collect()
    want = [(i, *x) for (i, _), x in zip(texts, brute_removed(texts, 35), strict=True)]
    assert sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((i is None, i or 0, *x) for i, *x in want)
    assert [r["kept"] for r in got if r["id"] == 0] == [None]
    cut = substrings.without_repeats(frame(spark, texts), 35)
    assert cut.columns == ["doc_id", "text", "extra", "id", "k"] and cut.count() == len(texts)


def test_substrings_empty_and_reference(spark):
    assert substrings.substring_dedup(frame(spark, [])).collect() == []
    docs = frame(spark, [(1, "a b c d e f"), (2, "x c d e y"), (3, None)])
    got = substrings.remove_matches(docs, spark.createDataFrame([("b c d e",), (None,)], "text string"), window=3)
    assert sorted((r["id"], r["kept"]) for r in got.collect() if r["kept"]) == [(1, "a f"), (2, "x y")]


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_reference_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", size)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 40)
    rng = random.Random(8)
    reference = [[rng.choice("abcd") for _ in range(rng.randrange(150))] for _ in range(8)]
    own = [[rng.choice("abcd") for _ in range(200)] for _ in range(20)] + [reference[0]]
    held = {tuple(w[j : j + 5]) for w in reference for j in range(len(w) - 4)}
    want = []
    for i, w in enumerate(own):
        gone = {j + k for j in range(len(w) - 4) if tuple(w[j : j + 5]) in held for k in range(5)}
        want.append((i, len(gone), " ".join(x for j, x in enumerate(w) if j not in gone) if gone else " ".join(w)))
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(own)])
    got = substrings.remove_matches(docs, spark.createDataFrame([(" ".join(w),) for w in reference], "text string"), window=5)
    assert sorted((r["id"], r["n_removed"], r["kept"]) for r in got.collect()) == want


def test_common_lines_in_all_orders(spark, monkeypatch):
    """One line in every text, lines in any order: hot minimizers whose windows differ or not."""
    monkeypatch.setattr(substrings, "SPLIT", 4)
    rng = random.Random(12)
    line, lines = words(rng, 20), [words(rng, 12) for _ in range(5)]
    own = [[*words(rng, 10 + i % 9), *line, *words(rng, 30), *(line if i % 4 else [])] for i in range(60)]
    own += [[x for j in rng.sample(range(5), 5) for x in lines[j]] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    got = substrings.substring_dedup(frame(spark, rows), 35).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == [(i, *x) for (i, _), x in zip(rows, brute_removed(rows, 35), strict=True)]

@pytest.mark.parametrize("sample", [1, 64])
def test_grams_of_a_sample_of_contexts(spark, monkeypatch, sample):
    """A common line makes rows of grams for some of its contexts only; whatever they tell, results are whole."""
    monkeypatch.setattr(substrings, "SAMPLE", sample)
    rng = random.Random(13)
    own = [(7, i, i, 1, 3000, " ".join(words(rng, 40)).encode()) for i in range(3000)]
    pieces = spark.createDataFrame(own, "h long, c1 long, c2 long, weight long, different long, words binary")
    grams = substrings._grams(pieces, 35)
    assert grams.columns == ["h", "g"] and grams.count() == sample * 33
    monkeypatch.setattr(substrings, "SPLIT", 4)
    line, twice = words(rng, 12), words(rng, 36)
    own = [[*words(rng, 40), *line, *words(rng, 40), *(twice if i % 9 == 0 else [])] for i in range(60)]
    own += [[*line, *twice[i:], *line, *own[i][20:]] for i in range(9)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    got = substrings.substring_dedup(frame(spark, rows), 35).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == [(i, *x) for (i, _), x in zip(rows, brute_removed(rows, 35), strict=True)]


def test_automaton_counts():
    rng = random.Random(1)
    for _ in range(200):
        own = [[rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(4)]
        a = substrings.SuffixAutomaton()
        weights = [rng.randrange(1, 3) for _ in own]
        for w, n in zip(own, weights, strict=True):
            a.add(w, n)
        a.finish()
        seen = Counter()
        for w, n in zip(own, weights, strict=True):
            seen.update({x: n * c for x, c in Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2)).items()})
        for w in own:
            assert a.repeats(w, 3, 2) == [j for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1]


def brute_components(fps, ids, radius=3):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, i in zip(group, ids, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_simhash(spark, texts):
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    fps = [simhash.fingerprint((t or "").encode()) for _, t in texts]
    ids = [i for i, _ in texts]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(i, f if f < 2**63 else f - 2**64, c) for i, f, c in zip(ids, fps, brute_components(fps, ids), strict=True)]
    assert sorted(((r["id"], r["fp"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one(frame(spark, texts)).collect()
    assert len(kept) == len(set(brute_components(fps, list(range(len(fps))))))
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("tile_rows", [8192, 5])
def test_simhash_links_of_any_shape(spark, tile_rows):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(40)})
    signed = [f if f < 2**63 else f - 2**64 for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tile_rows)
    for r in links.collect():
        pass
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tile_rows)).collect()}
    want = brute_components(fps, list(range(len(fps))))
    groups, mine = {}, {}
    for i, f in enumerate(signed):
        groups.setdefault(want[i], set()).add(f)
        mine.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "u long, v long")
    assert {r["node"]: r["root"] for r in common.components(links).collect()} == {i: 0 for i in range(1, n + 1)} | {1001: 1000}
    assert common.components(links.limit(0)).collect() == []


def plain_licences(rows, templates, threshold):
    n = len(rows)
    split = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    df = Counter(t for _, x in rows for t in set(split(x)))
    weight = lambda t: math.log((1 + n) / (1 + df[t])) + 1

    def vector(x):
        return {t: c * weight(t) for t, c in Counter(split(x)).items()}

    size = lambda v: math.sqrt(sum(w * w for w in v.values()))

    def best(x):
        own, found = vector(x), (0.0, 0)
        for j, (_, y) in enumerate(templates):
            v = vector(y)
            dot = sum(w * v.get(t, 0) for t, w in own.items())
            found = max(found, (round(dot / size(own) / size(v), 9) if own else 0.0, -j))
        return found

    own = {}
    for i, (path, x) in enumerate(rows):
        units = (x or "").split("\n")
        paragraph: list[str] = []
        for line in [*units, ""]:
            if split(line):
                paragraph.append(line)
            else:
                units.append(" ".join(paragraph))
                paragraph = []
        if path and re.match(licences.LICENCE_FILE, path.split("/")[-1]):
            units.append(x or "")
        c, j = max(best(u) for u in units)
        own[i] = (templates[-j][0], c) if c >= threshold else None
    held = {}
    for i, (path, _) in enumerate(rows):
        if path and own[i] and re.match(licences.LICENCE_FILE, path.split("/")[-1]):
            d = path.rpartition("/")[0]
            held[d] = min(held.get(d, (9, "", "")), (-own[i][1], path, own[i][0]))
    out = []
    for i, (path, _) in enumerate(rows):
        if own[i]:
            out.append((path, own[i][0], "own"))
            continue
        d = path.rpartition("/")[0] if path else None
        while d is not None and d not in held and d:
            d = d.rpartition("/")[0]
        hit = held.get(d) if d is not None else None
        out.append((path, hit[2], "inherited") if hit else (path, None, None))
    return out


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        ("a/LICENSE", "MIT\n" + mit), ("a/b/x.py", "code mit die"), ("a/b/c/y.py", None), ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("z/q.py", "text\nReleased under the MIT License.\nmore text"), ("z/r.py", "nothing at all"), ("LICENSE", ""), ("top.py", ""), (None, "Released under the MIT License."), (None, None),
        ("a/LICENSE-2", "Licensed under the Apache License, Version 2.0."), ("z/r.py", "nothing at all"), ("a/long.txt", "lorem the " * 4000),
        ("g/gpl.py", "x = 1\n# **\n# This program is free software: you can redistribute it\n#  and/or modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation, either version 3\n# of the License, or (at your option) any later version.\n#\n\n# more"),
    ]
    files = spark.createDataFrame([(p, t, "old", "c", "f", 1) for p, t in rows], "path string, text string, via string, dir string, `from` string, _own int")
    got = licences.scan(files)
    assert got.columns == ["path", "dir", "from", "_own", "licence", "similarity", "via", "inherited_from"]
    assert [r["licence"] for r in got.collect() if r["path"] == "g/gpl.py"] == ["GPL-3.0"]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["path"], r["licence"], r["via"]) for r in got.collect()), key=key) == sorted(plain_licences(rows, licences.TEMPLATES, 0.6), key=key)
    assert licences.scan(files.limit(0)).collect() == []


def test_licences_weigh_all_tokens(spark):
    """Words of all texts beside a notice weigh little, rare ones much."""
    common = " ".join(f"w{i}" for i in range(12))
    rows = [(f"{i}.txt", f"{common} t{i}") for i in range(300)]
    rows += [("a.txt", f"Released under the MIT License. {common}"), ("b.txt", "Released under the MIT License. " + " ".join(f"rare{i}" for i in range(12)))]
    df = Counter(t for _, x in rows for t in set(licences.tokens(x)))
    weigh = lambda t: licences.idf(len(rows), df[t])
    notice = sum(weigh(t) ** 2 for t in licences.tokens(licences.TEMPLATES[0][1]))
    want = math.sqrt(notice / sum(weigh(t) ** 2 for t in set(licences.tokens(rows[300][1]))))
    got = {r["path"]: (r["licence"], r["similarity"]) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a.txt"] == ("MIT", pytest.approx(want, abs=1e-8)) and got["b.txt"] == (None, None)


def test_licences_weigh_few_lines(spark):
    """Tokens of lines that can't reach the threshold aren't joined with their frequencies, and nothing else is lost."""
    rng = random.Random(3)
    notice = "Released under the MIT License."
    rows = [(f"p/{i}.txt", " ".join([*words(rng, i % 70), notice, *words(rng, i % 3)])) for i in range(140)]
    df = Counter(t for _, x in rows for t in set(licences.tokens(x)))
    w = licences.Weights(len(rows), df, licences.TEMPLATES, licences.THRESHOLD)
    units = spark.createDataFrame([(i, 0, licences.tokens(x)) for i, (_, x) in enumerate(rows)], "_row long, _at int, t array<string>")
    hopeful = {r["_row"] for r in licences._hopeful(units, w).collect()}
    want = plain_licences(rows, licences.TEMPLATES, licences.THRESHOLD)
    own = {i for i, x in enumerate(want) if x[2] == "own"}
    assert own and own <= hopeful and len(hopeful) < 40
    got = licences.scan(spark.createDataFrame(rows, "path string, text string"))
    assert sorted((r["path"], str(r["licence"]), str(r["via"])) for r in got.collect()) == sorted((p, str(x), str(v)) for p, x, v in want)


def test_lexicon_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    terms, stems = ["idiot", "disgusting", "scum", "worthless"], ["lowei"]
    lex = toxicity.Lexicon(terms, stems)
    rng = random.Random(4)
    tries = ["loweixyz", "lowe", "idiots", "diot", "scums", ""]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            how = rng.randrange(3)
            if how == 0 and i < len(w):
                w[i] = rng.choice("abcdeiost")
            elif how == 1 and i < len(w):
                del w[i]
            else:
                w.insert(i, rng.choice("abcdeiost"))
        tries.append("".join(w))
    for w in tries:
        want = 2 if w.startswith("lowei") else max((2 if w == t else 1 for t in terms if distance(w, t) <= toxicity.edits(t)), default=0)
        assert lex.match(w) == want, w


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        own, bad = words(rng, 60), i % 6 == 0
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(60), rng.choice(["grompf", "grompfen", "idiot"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (900, None), (901, ""), (902, "you idiot, you worthles moron"), (902, "you idiot, you worthles moron"), (None, "fine")])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int").where("doc_id is null or doc_id % 3 <> 1"))
    got = toxicity.scores(docs, model)
    assert got.columns == [*docs.columns, "score"]
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.7) == bool(y) for i, y in labels if i % 3 == 1]
    assert sum(held) / len(held) > 0.95 and score[902] > 0.7 and score[900] == score[901] < 0.3
    assert toxicity.scores(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).score("hello") < 0.5
    quoted, plain = model.score('she wrote "idiot" on the board'), model.score("what an idiot is this on the board")
    assert quoted < plain


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii(spark):
    rng = random.Random(7)
    texts = ["mail a.b@c.example.org or +1 (555) 555-0100", "ip 10.0.0.1 4111 1111 1111 1111", 'token = "0123456789abcdef0123456789abcdef01234567"', "é a@b.c", None, "", "9" * 30000, "a" * 30000 + "@b.c"]
    for _ in range(4000):
        al = rng.choice(["a@.-1 b", "0123456789 -", "+01() .-9", "1.25 .9", "a@b.c@d.e+5"])
        t = "".join(rng.choice(al) for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t
    docs = frame(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1])])
    got = pii.find(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["id"] is not None:
            own = plain_spans(texts[r["id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(pii.joined(own).encode()).hexdigest()
            assert set(pii.joined(own).split(",")) - {""} <= set(r["spans"].split(","))
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[0] == "mail [EMAIL] or [PHONE]" and red[1] == "ip [IP] [CARD]" and red[4] is None and red[5] == ""
    assert pii.find(docs.limit(0)).collect() == []


def test_pii_reliabilities():
    m = pii.Model({"card|b|+++0+": 500, "card|l|+-+0+": 40, "card|l|+--0+": 300, "secret|l|++0++": 90, "secret|l|000 -".replace(" ", "0"): 400})
    p = m.probability
    assert p["card|b|+++0+"] > 0.9 and p["card|l|+-+0+"] < 0.5 and p["secret|l|++0++"] > 0.5
    assert pii.Model({}).probability == {}


def vecs(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 24)).astype(np.float32)
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(400 + i, x[0].tolist(), "e") for i in range(30)]  # ties
    rows += [(500, None, "e"), (520, [], "e"), (540, [float("nan")] * 24, "e"), (560, [None] * 24, "e"), (580, [0.0] * 24, "e"), (None, x[1].tolist(), "e"), (600, [1.0, 2.0], "e"), (20, rows[20][1], "e")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), rows


def plain_search(rows, every, k, turn, zero):
    """By row: a repeated id stands for as many queries and candidates."""
    own = []
    for i, v, _ in rows:
        if i is not None and v and all(y is not None and math.isfinite(y) for y in v) and (zero or any(v)):
            own.append((i, turn(np.array(v, dtype=np.float64))))
    out = []
    for a, (i, q) in enumerate(own):
        if i % every == 0:
            near = sorted((-vectors.dots(q[None], c[None])[0], j) for b, (j, c) in enumerate(own) if b != a and len(c) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("pilot", [2048, 16])
def test_vector_searches(spark, monkeypatch, pilot):
    monkeypatch.setattr(vectors, "PILOT", pilot)
    monkeypatch.setattr(vectors, "GROWTH", 4)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 10_000 if pilot == 16 else 8 << 20)
    df, rows = vecs(spark)
    got = sorted(tuple(r) for r in vectors.kd_search(df, 50, 5).collect())
    assert got == [(q, r, i, int(s)) for q, r, i, s in plain_search(rows, 50, 5, lambda v: np.floor(256 * v), True)]
    got = vectors.one_bit_search(df, 20, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = Counter((r["query_id"], r["vec_id"], r["score"]) for r in got.collect()), Counter((q, i, s) for q, _, i, s in plain_search(rows, 20, 20, lambda v: v, False))
    assert got.total() == want.total() and (got & want).total() >= 0.95 * want.total()
    assert vectors.one_bit_search(df.limit(0)).collect() == [] and vectors.kd_search(df.limit(0)).collect() == []
    assert vectors.kd_search(df.where("vec_id % 50 <> 0")).collect() == []


def test_whole_numbers_of_any_size(spark):
    rows = [(i, [float(x) for x in v], "") for i, v in enumerate([(1e12, 3), (1e12, 2), (-1e12, 9), (1e11, 1e11), (0, 0)] * 3)]
    got = sorted(tuple(r) for r in vectors.kd_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string"), 7, 4).collect())
    want = []
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    for i in range(0, len(rows), 7):
        near = sorted((-min(2**63 - 1, max(-(2**63), a)), -a, j) for j, c in enumerate(ints) if j != i for a in [sum(x * y for x, y in zip(ints[i], c, strict=True))])
        want.append((i, [s for s, _, _ in near[:4]]))
    assert [(i, [-s for s in x]) for i, x in want] == [(i, [r[3] for r in got if r[0] == i]) for i, _ in want]


def test_kd_tree_prunes():
    """Clustered points: most leaves can't hold a score that counts."""
    rng = np.random.default_rng(1)
    points = np.floor(256 * (rng.standard_normal((40, 8)).repeat(200, axis=0) + 0.05 * rng.standard_normal((8000, 8))))
    scan = vectors.KdScan(np.arange(0, 8000, 50), points[::50], np.full(160, -np.inf), 5)
    scan.meet(np.arange(8000), np.arange(8000), points)
    assert scan.visited < 0.35 * scan.leaves
    q, s, i, _ = scan.best.held
    for a in range(160):
        score = points @ points[50 * a]
        score[50 * a] = -np.inf
        assert s[q == a].tolist() == np.sort(score)[::-1][:5].tolist()


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    own = [*texts, (77, "it's DON'T É é <|endoftext|> ΑΣ 12½, a　b ŉ İx 'S... ###")]
    got = packing.pack(frame(spark, own), path, 1, 512).collect()
    pieces_ = sorted((r["id"] is None, r["id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = []
    for i, x in own:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((i is None, i or 0, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces_ == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 512
    best = packing.best_fit([], dict(Counter(r["length"] for r in got)), 512)
    assert len(held) <= sum(g.count for g in best)
    assert packing.pack(frame(spark, []), path).collect() == []


def test_plan_and_price():
    rng = random.Random(9)
    for _ in range(20):
        h = {}
        for _ in range(rng.randrange(1, 400)):
            n = rng.randrange(1, 101)
            h[n] = h.get(n, 0) + rng.randrange(1, 30)
        groups = packing.plan(h, 100)
        got = Counter()
        for g in groups:
            assert g.full <= 100
            for length, n in g.held.items():
                got[length] += n * g.count
        assert got == Counter(h)
        best = sum(g.count for g in packing.best_fit([], dict(h), 100))
        assert sum(g.count for g in groups) <= best * 1.02 + 2
    mix = packing.price(np.array([3, 5, 7]), np.array([3.0, 5.2, 7.0]), 11)
    assert mix @ np.array([3, 5, 7]) <= 11 and math.isclose(mix @ np.array([3.0, 5.2, 7.0]), 11.2)


def test_warc(spark, tmp_path):
    same = "<html>" + "x" * 200
    rows = [(1, "http://a/1", same), (5, "http://a/\r\n5", same), (3, None, same), (2, "u", None), (4, "u", "short"), (6, "u", "short"), (None, "u", "nul" * 60), (7, "u", "é" * 90), (8, "u", "long " * 60000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 1) if i in (3, 5) else ("response", None))
        assert got[i]["payload"] == (None if i in (3, 5) else raw)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_splits():
    rng = random.Random(1)
    blob, offsets, payloads = b"", [], []
    for i in range(120):
        p = rng.randbytes(rng.choice([0, 5, 3000])) + (warc.MAGIC * 3 if i % 3 == 0 else b"") + (b"WARC/1.1" if i % 5 == 0 else b"")
        if i % 40 == 0:
            p = rng.randbytes(30000) + warc.record("x", b"inner", "d", 1, None, False, "2024") + p
        offsets.append(len(blob))
        blob += warc.record(f"http://{i}", p, "d", i, None, False, "2024")
        payloads.append(p)
    for split in (700, 20_000, 1 << 30):
        got = [x for s in range(0, len(blob), split) for x in warc.read_split(pa.BufferReader(blob), s, min(len(blob), s + split))]
        assert [o for o, _, _ in got] == offsets
        assert [b.partition(b"\r\n\r\n")[2] for _, _, b in got] == payloads


@pytest.mark.parametrize("at", [0, 1, 2])
def test_warc_long_urls(at):
    """Headers beyond any chunk, of the first, second and third record."""
    rng = random.Random(2)
    urls = [f"http://{i}" for i in range(4)]
    urls[at] = "data:," + rng.randbytes(1_200_000).hex()
    blob = b"".join(warc.record(u, b"text", "d", i, None, False, "2024") for i, u in enumerate(urls))
    for split in (300_000, 1 << 30):
        got = [x for s in range(0, len(blob), split) for x in warc.read_split(pa.BufferReader(blob), s, min(len(blob), s + split))]
        assert [h["warc-target-uri"] == u for (_, h, _), u in zip(got, urls, strict=True)] == [True] * 4


def test_warc_nested_archives():
    """Payloads that are archives themselves, stored as they are, of a few and of many records."""
    rng = random.Random(3)
    inner = lambda n, size: b"".join(warc.record("in", rng.randbytes(size), "d", 900 + i, None, False, "2024") for i in range(n))
    payloads = [inner(3, 9000), rng.randbytes(200), inner(400, 300), inner(2, 200_000), b"", inner(1, 70_000)]

    def stored(raw):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(zlib.decompress(raw, 31)) + z.flush()

    parts = [stored(warc.record("u", p, "d", i, None, False, "2024")) for i, p in enumerate(payloads)]
    assert b"".join(parts).count(warc.MAGIC) > 100  # stored, not deflated
    for end in (b"", b"\x1f\x8b\x08 torn"):
        blob = b"".join(parts) + end
        for split in (5_000, 20_000, 1 << 30):
            got = [x for s in range(0, len(blob), split) for x in warc.read_split(pa.BufferReader(blob), s, min(len(blob), s + split))]
            if not end:
                assert [int(h["x-page-id"]) for _, h, _ in got] == list(range(6))
                assert [b.partition(b"\r\n\r\n")[2] for _, _, b in got] == payloads
            else:
                assert not {int(h["x-page-id"]) for _, h, _ in got} & set(range(900, 1300))


def test_warc_refers_to_the_record(tmp_path):
    first, again = (warc.parse_head(zlib.decompress(warc.record("u", b"x" * 200, "d" * 64, k, 4, k != 4, "2024"), 31)) for k in (4, 9))
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"]


def test_sentencepiece(spark, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    hard = ["Hello  wörld\t ñ中\n a ", " ", "   ", "\n", "▁", "a▁ b", " \n \n", "a" * 50, "\0x", "🙂🙂 e", "the" * 300, "x" * 2000, " " * 500]
    hard += ["".join(rng.choice(["a", "th", "the", " ", "  ", "\n", "ing", "é", "中", "=", "0", "▁", "er"]) for _ in range(rng.randrange(40))) for _ in range(800)]
    own = [*texts, *((1000 + i, t) for i, t in enumerate(hard))]
    coded = pieces.encode(frame(spark, own), path)
    got = {r["id"]: r["ids"] for r in coded.collect() if r["id"] is not None}
    for i, t in own:
        if i is not None:
            assert got[i] == (None if t is None else sp.encode(t)), repr(t)
    back = {r["id"]: r["text"] for r in pieces.decode(coded, path).collect()}
    assert all(back[i] == (None if t is None else sp.decode(sp.encode(t))) for i, t in own if i is not None)
    d = {r["id"]: r for r in pieces.digests(frame(spark, own), path).collect()}
    assert d[1000]["n_ids"] == len(sp.encode(hard[0])) and d[0]["n_ids"] == 0
    assert pieces.encode(frame(spark, []), path).collect() == []


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(50):
        codes = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 60))])
        order = pieces.suffix_array(codes, 8)
        keys = [tuple(codes[i : i + 8].tolist()) for i in order]
        assert keys == sorted(keys)


def test_shared_dir_and_hash(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = common.written(spark.range(5))
    assert df.count() == 5
    begun = common.made()
    other, last = common.written(df.where("id > 2")), common.written(df)
    own = [x for x in common.made() if x not in begun]
    assert len(common.remove(spark, own, last.where("id = 1"))) == 1 and last.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist"):
        other.count()
    common.discard(last)
    assert common.made() == begun
    common.discard(df)
    session = spark.newSession()
    size = lambda: session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows, want in ((500, "500"), (2000, "2000"), (10**6, "10000")):
        common.small_batches(session, rows)
        assert size() == want
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    common.small_batches(session, 2000)
    assert size() == "700"
    assert spark.range(1).select(toxicity.fold("id") == F.lit(zlib.crc32(b"0") % 3)).first()[0]
