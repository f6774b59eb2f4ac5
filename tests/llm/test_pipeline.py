"""Each pipeline stage against brute force on all that its predecessor kept."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import common, jaccard, pii, simhash
from tessera.llm.common import components, written


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(50)
    docs, labels = [], []
    for i in range(180):
        own = words(70)
        if i % 6 == 0:
            own[10:10] = ["idiot", "grompf", "moron", "grompf"]
        elif i % 10 == 1:
            own[30:30] = passage
        elif i % 10 == 3:
            own[5:5] = [f"me.{i}@mail.example.com", "+1", "(555)", "555-0100"]
        docs.append([i, " ".join(own)])
        labels.append((i, 1, int(i % 6 == 0)))
    for i, of in enumerate((7, 7, 13)):  # copies
        docs.append([200 + i, docs[of][1]])
    docs += [[300, ""], [301, None], [302, " ".join(words(5000))], [None, "no id at all"], [303, "one"], [303, "one"]]
    return docs, labels


def cut(texts, window):
    own = [(t or "").encode().split() for t in texts]
    seen = Counter(b" ".join(w[j : j + window]) for w in own for j in range(len(w) - window + 1))
    out = []
    for t, w in zip(texts, own, strict=True):
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if seen[b" ".join(w[j : j + window])] > 1:
                keep[j : j + window] = [False] * window
        out.append(t if all(keep) else b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode())
    return out


def groups(fps):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    held = sorted(((i, t) for i, t in docs), key=key)
    for name, stage in C.STAGES:
        now = written(stage(spark, now, str(tmp_path)), name)
        if name == "packing":
            break
        assert now.columns == columns
        got = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=key)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now.collect())
        if name == "toxicity":
            want = [x for x in held if not (x[0] is not None and x[0] < 180 and x[0] % 6 == 0)]
        elif name == "simhash":
            g = groups([simhash.fingerprint((t or "").encode(), 5) for _, t in held])
            want = sorted((min((x for x, y in zip(held, g, strict=True) if y == k), key=key) for k in set(g)), key=key)
        elif name == "substring":
            want = list(zip([i for i, _ in held], cut([t for _, t in held], 35), strict=True))
        else:
            want = [(i, t if not t else pii.redacted(t, pii.base_spans(t))) for i, t in held]
        assert got == sorted(want, key=key), name
        held = got
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, x in held:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i is None, i or 0, k, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]) for r in now.collect()) == sorted(want)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("tile_rows", [1024, 16])
def test_near_copies(spark, monkeypatch, tile_rows):
    """Copies of a similarity from 0.7 to 0.97, chains of them and a large group."""
    monkeypatch.setattr(jaccard.links, "__defaults__", (*jaccard.links.__defaults__[:-1], tile_rows))
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    docs, scores = [], []
    for k in range(60):
        own = words(200)
        docs.append(" ".join(own))
        for _ in range(1 + k % 2):
            for at in rng.sample(range(5, 195), 1 + k % 6):
                own[at] = "changed"
            docs.append(" ".join(own))
            scores.append(near(docs[-2], docs[-1]))
    assert {round(s, 1) for s in scores} >= {0.7, 0.8, 0.9} and sum(0.8 <= s <= 0.97 for s in scores) > 40
    base = words(80)
    docs += [" ".join([*base[:j], f"x{j}", *base[j + 1 :]]) for j in range(60)]
    nine = " ".join(f"v{i}" for i in range(13))  # nine shingles
    docs += [nine, f"{nine} more", f"{nine} more and", f"{nine} more and yet another", "A b", "a B", "", None, " \n"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    rows = [(i, docs[k], "en", "src", 1) for i, k in enumerate(order)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and near(rows[i][1], rows[j][1]) >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.drop_near_copies(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))
    assert C.drop_near_copies(spark, frame.limit(0), "").collect() == []


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Near copies of a small table are linked without rounds of tables; more links give the same by rounds."""
    rng = random.Random(9)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(5)] + [(300, 300)]
    frame = spark.createDataFrame(pairs, "u long, v long")
    few, many = (sorted(map(tuple, components(frame, few=n).collect())) for n in (len(pairs), len(pairs) - 1))
    assert few == many and (205, 200) in few
    for own in ([(5, 5)], []):
        assert components(spark.createDataFrame(own, "u long, v long"), few=1).collect() == []
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i + 1], f"x{i}", *base[i + 2 :]]), "en", "src", 1) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made, put = [], common.written
    monkeypatch.setattr(common, "written", lambda df, what="step": made.append(what) or put(df, what))
    assert [r["doc_id"] for r in C.drop_near_copies(spark, frame, "").collect()] == [0]
    assert made and not {"large", "small"} & {*made}


def test_near_copies_are_found_by_simhash(spark, monkeypatch):
    """The stage's candidates are SimHashes that agree on a block and lie within the radius."""
    rng = random.Random(5)
    for n in (0, 1, 2, 5, 64, 301, 5000):
        own = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        got = simhash.wide(own, 3)
        for k in range(3):
            members = [int(x) for x in simhash.mixed(own + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))]
            assert int(got[k]) == sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in members) > n)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts, pairs = [], []
    for k in range(300):
        own = words(60 + k)
        texts.append(" ".join(own))
        own[20] = "changed"
        if k % 2:
            own[40 + k // 10] = "as well"
        texts.append(" ".join(own))
        if near(texts[-2], texts[-1]) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    assert len(pairs) > 250
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    root = {r["node"]: r["root"] for r in jaccard.candidates(frame, 0.8).collect()}
    assert all(root.get(b) == root.get(a, a) for a, b in pairs)
    hashes = [simhash.wide(jaccard.shingles(t.encode()), jaccard.LONGS) for t in texts]
    for b, a in root.items():  # pairs alone: no text is near any but its copy
        assert a == b - 1 and b % 2 == 1
        assert np.bitwise_count(hashes[a][: jaccard.SIGNED] ^ hashes[b][: jaccard.SIGNED]).sum() <= jaccard.radius(0.8)
    rows = [(i, t, "en", "src", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(jaccard, "radius", lambda least: -1)  # no SimHash is near any
    assert C.drop_near_copies(spark, frame, "").count() == len(rows)
