"""Each ``opN_`` query on small tables against an independent version of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tessera.llm import queries as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    texts: list = [None, "", " \n\t ", "one", "Two words", "İ! HEPSİ. BİRİ, İKİ!", "a b c　d"]
    texts += ["ip " + "0" * 5000 + "1.2.3.4 end", "mail a.b@c.example.org call +1 (555) 555-0100 from 10.0.0.1", "4111 1111 1111 1111 and 4111111111111111 5500000000000004"]
    texts += ["x" * 3000, " ".join(words(5000))]
    whole = words(90)
    texts += [" ".join(whole)] * 3 + [" ".join([*whole[:50], "changed", *whole[51:]])]
    texts += [" ".join([*words(20), *passage, *words(i)]) for i in range(12)]
    texts += ["Released under the MIT License.", "nothing to see", "SPDX-License-Identifier: MIT\nmore"]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b"]), len(t or "")) for i, t in enumerate(texts)]
    for i in range(100, 340):
        own = words(40)
        if i % 5 == 0:
            own[7:7] = ["idiot", "grompf", "moron"]
        rows.append((i, " ".join(own), "en", "a", 1))
    return rows


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = documents()
    write = lambda name, schema, own: pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in own], schema), at / f"{name}.parquet")
    write("documents", pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]), rows)
    write("labels", pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), [(i, 1, int(i % 5 == 0)) for i in range(100, 340)])
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    vectors = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i, v in enumerate(x)] + [(40, x[7].tolist(), 0), (40, x[3].tolist(), 0), (500, None, 0), (520, [0.0] * 16, 0)]
    write("embeddings", pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]), vectors)
    same = "<html>" + "x" * 200
    pages = [(1, "http://a/1", same), (2, "data:," + "ab" * 60000, "short"), (3, None, same), (4, "u", None), (5, "u", "short"), (6, "u", "é" * 90)]
    write("pages", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]), pages)
    return str(at), rows, vectors, pages


def by_sql(name, at):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    cursor = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    return names, sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, tables, name):
    names, want = by_sql(name, tables[0])
    got = Q.queries()[name](spark, tables[0])
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


def test_op2(spark, tables):
    _, rows, _, _ = tables

    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = SPACE.findall(low)
        if not w:
            return 0
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = sorted((r[0], f"{f:016x}", rows[g][0]) for r, f, g in zip(rows, fps, group, strict=True))
    got = Q.op2_simhash(spark, tables[0])
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want


def test_op4(spark, tables):
    at, rows, _, _ = tables
    got = Q.op4_toxicity(spark, at)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    own = {r["doc_id"]: r for r in got.collect()}
    assert sorted(own) == sorted(r[0] for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in own.items())
    held = [i for i in range(100, 340) if own[i]["held_out"]]
    assert len(held) > 50 and all(own[i]["predicted"] == int(i % 5 == 0) for i in held)
    again = {r["doc_id"]: r["score"] for r in Q.op4_toxicity(spark.newSession(), at).collect()}
    assert again == {i: r["score"] for i, r in own.items()}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base(t):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_op5(spark, tables):
    at, rows, _, _ = tables
    got = {r["doc_id"]: r for r in Q.op5_pii(spark, at).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, text, *_ in rows:
        own = base(text or "")
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in own) for k in ("email", "ip", "card", "phone")]
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        assert Counter(want.split(",")) - Counter([""]) <= Counter(got[i]["spans"].split(","))
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):  # what is added overlaps nothing
            others = [(int(x), int(y)) for k, x, y in spans if (k, int(x), int(y)) != (kind, a, b)]
            assert 0 <= a < b <= len(text) and ((kind, a, b) in own or not any(x < b and a < y for x, y in others))


def test_op5_adds_what_looks_personal(spark, tmp_path):
    """Planted spans that the base rules miss are found, and codes that are nobody's are left."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n):
        head = digits(n - 1)
        return next(head + c for c in "0123456789" if luhn(head + c))

    rows, planted, wrong = [], {}, {}
    for i in range(600):
        text = f"{word()} {word()} "
        if i % 6 == 0:
            span = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            planted[i] = ("secret", len(text) + 9, len(text) + 49)
            text += f'token = "{span}" {word()}'
        elif i % 6 == 1:
            text += f"card {card(16)} {word()}"
        elif i % 6 == 2:
            bad = card(16)
            bad = bad[:-1] + str((int(bad[-1]) + 3) % 10)
            wrong[i] = (len(text), len(text) + 16)
            text += f"{bad} {word()}"
        elif i % 6 == 3:
            text += f"mail {word()}@{word()}.example.org {word()}"
        rows.append((i, text, "en", "a", 1))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["spans"].split(",") for r in Q.op5_pii(spark, str(tmp_path)).collect()}
    assert all(":".join(map(str, x)) in got[i] for i, x in planted.items())
    assert not any(x.endswith(f":{a}:{b}") for i, (a, b) in wrong.items() for x in got[i])
    assert all(got[i] == [""] for i in range(600) if i % 6 >= 4)


def test_op6(spark, tables):
    at, _, vectors, _ = tables
    own = [(i, np.array(np.float32(v), dtype=float)) for i, v, _ in vectors if v and any(v)]
    want = []
    for a, (i, q) in enumerate(own):
        if i % 20 == 0:
            near = sorted((-math.fsum(q * c), j) for b, (j, c) in enumerate(own) if b != a)[:20]
            want += [(i, j, round(-s, 12)) for s, j in near]
    got = Q.op6_one_bit_search(spark, at)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = got.collect()
    mine = Counter((r["query_id"], r["vec_id"], round(r["score"], 12)) for r in rows)
    assert mine.total() == len(want) and (mine & Counter(want)).total() >= 0.9 * len(want)
    assert Counter(r["rank"] for r in rows) == {k: len(want) // 20 for k in range(1, 21)}


def test_op7(spark, tables):
    at, rows, _, _ = tables
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [r.asDict() for r in Q.op7_best_fit_packing(spark, at).collect()]
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 4096
    assert len(held) == -(-sum(x[3] for x in want) // 4096)  # no packing could use fewer


def test_op10(spark, tables):
    at, rows, _, _ = tables
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in Q.op10_sentencepiece(spark, at).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, text, *_ in rows:
        ids = sp.encode(text or "")
        assert (got[i]["n_ids"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
