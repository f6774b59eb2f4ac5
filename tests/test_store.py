"""Writes, history, standing queries, commit-time rules, CSV."""

import pytest

from tessera import history as H
from tessera.catalog import C, P
from tessera.model import Attribute, Concept, Fold, QueryError, Rule, Var
from tessera.operators import zset
from tessera.sources import csv
from tessera.sources.facts import facts, select
from tessera.store import Branch, Changes, applied
from tessera.streaming.subscription import Subscription

TASK = C(title="task/title:Text")
DONE = C(done="task/done:Boolean")
OPEN = C(desc="task/open:Text")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_retract_assert(spark):
    own = facts(spark, [("a/x", "e:1", "one"), ("a/x", "e:2", "two")])
    c = Changes().replace("a/x", "e:1", "uno").retract("a/x", "e:2", "two").assert_("a/x", "e:3", "three")
    got = applied(own, c.frame(spark))
    assert sorted((r["of"], r["vs"], r["cause"] is not None) for r in got.collect()) == [("e:1", "uno", True), ("e:3", "three", False)]
    same = applied(own, Changes().replace("a/x", "e:1", "one").frame(spark))
    assert {r["vs"]: r["cause"] for r in same.collect()} == {"one": None, "two": None}


def test_merges_by_version(spark, tmp_path):
    """What one side removed stays removed, whichever way branches have merged before."""
    at = str(tmp_path / "merge")
    a = Branch(spark, at, "a")
    a.transaction().assert_("x/v", "e:1", "one").assert_("x/v", "e:2", "two").commit()
    b = Branch(spark, at, "b")
    b.pull(a)
    values = lambda br: sorted(r["vs"] for r in br.facts().collect())
    a.transaction().retract("x/v", "e:1", "one").assert_("x/v", "e:3", "a's").commit()
    b.transaction().replace("x/v", "e:2", "b's").assert_("x/v", "e:4", "new").commit()
    a.pull(b)
    assert values(a) == ["a's", "b's", "new"]
    b.transaction().assert_("x/v", "e:5", "later").commit()
    b.pull(a)  # both ways
    assert values(b) == ["a's", "b's", "later", "new"]
    b.transaction().retract("x/v", "e:3", "a's").commit()  # removes what a wrote
    a.transaction().retract("x/v", "e:4", "new").assert_("x/v", "e:1", "one").commit()
    a.pull(b)
    b.pull(a)
    assert values(a) == values(b) == ["b's", "later", "one"]
    # Written anew on one side and removed, as it was, on the other: it stays.
    a.transaction().retract("x/v", "e:1", "one").commit()
    a.transaction().assert_("x/v", "e:1", "one").commit()
    b.transaction().retract("x/v", "e:1", "one").assert_("x/v", "e:6", "z").commit()
    a.pull(b)
    assert values(a) == ["b's", "later", "one", "z"]


def test_a_batch_keeps_its_order(spark):
    own = facts(spark, [("a/x", "e:1", "old"), ("a/y", "e:1", "kept"), ("a/x", "e:2", "p"), ("a/x", "e:2", "q")])
    put = lambda c: sorted((r["the"], r["of"], r["vs"], r["cause"] is not None) for r in applied(own, c.frame(spark)).collect())
    others = [("a/x", "e:2", "p", False), ("a/x", "e:2", "q", False), ("a/y", "e:1", "kept", False)]
    assert put(Changes().replace("a/x", "e:1", "b").replace("a/x", "e:1", "c")) == sorted([("a/x", "e:1", "c", True), *others])
    assert put(Changes().assert_("a/x", "e:1", "z").retract("a/x", "e:1", "z")) == sorted([("a/x", "e:1", "old", False), *others])
    assert put(Changes().retract("a/x", "e:1", "old").assert_("a/x", "e:1", "old")) == sorted([("a/x", "e:1", "old", False), *others])
    assert put(Changes().assert_("a/x", "e:1", "z").replace("a/x", "e:1", "c").assert_("a/x", "e:1", "d")) == sorted([("a/x", "e:1", "c", True), ("a/x", "e:1", "d", False), *others])
    assert put(Changes().replace("a/x", "e:1", "b").retract("a/x", "e:1", "b")) == sorted(others)
    # The same value may stand beside others: those go.
    assert put(Changes().replace("a/x", "e:2", "p")) == sorted([("a/x", "e:1", "old", False), ("a/x", "e:2", "p", False), ("a/y", "e:1", "kept", False)])


def test_a_branch_outlives_its_object(spark, tmp_path, monkeypatch):
    from tessera import store

    monkeypatch.setattr(store, "LOGS", 3)
    at = str(tmp_path / "durable")
    a = Branch(spark, at, "a")
    states = []
    for i in range(5):
        a.transaction().replace("task/title", "t:1", f"v{i}").assert_("task/tag", f"t:{i}", "x").commit()
        states.append(rows(a.facts().select("of", "vs")))
    again = Branch(spark, at, "a")
    assert rows(again.facts().select("of", "vs")) == states[-1]
    assert [rows(again.facts(r["id"]).select("of", "vs")) for r in again.revisions] == states
    assert {r["vs"] for r in H.live(again.history()).collect()} == {"v4", "x"}
    stale = Branch(spark, at, "a")
    a.transaction().assert_("task/tag", "t:9", "y").commit()
    with pytest.raises(QueryError, match="HeadMoved"):
        stale.transaction().assert_("task/tag", "t:8", "z").commit()
    # Another folder: fetch, pull, push, export and import.
    b = Branch(spark, str(tmp_path / "elsewhere"), "b")
    b.set_upstream(a)
    assert b.fetch()["id"] == a.head["id"] and b.head is None
    assert b.pull()["id"] == a.head["id"] and rows(b.facts()) == rows(a.facts())
    b.transaction().replace("task/title", "t:1", "b's").commit()
    b.push()
    again = Branch(spark, at, "a")
    assert rows(again.facts()) == rows(b.facts()) and {r["vs"] for r in select(again.facts(), the="task/title").collect()} == {"b's"}
    again.transaction().replace("task/title", "t:1", "a's").commit()
    b.transaction().assert_("task/tag", "t:1", "w").commit()
    with pytest.raises(QueryError, match="NotFastForward"):
        b.push()
    b.pull()
    assert {r["vs"] for r in select(b.facts(), the="task/title").collect()} == {"a's"} and select(b.facts(), the="task/tag", of="t:1").count() == 2
    b.export(csv.CsvFacts(str(tmp_path / "out")))
    c = Branch(spark, str(tmp_path / "third"))
    c.import_(csv.CsvFacts(str(tmp_path / "out")))
    assert rows(c.facts().drop("cause")) == rows(b.facts().drop("cause"))
    c.reset(None)
    assert c.facts().isEmpty() and Branch(spark, str(tmp_path / "third")).head is None


def test_branch_history_and_pull(spark, tmp_path):
    a = Branch(spark, str(tmp_path / "repo"), "a")
    with pytest.raises(QueryError, match="ReservedNamespace"):
        a.transaction().assert_("system.branch/name", "b:1", "x")
    t = a.transaction().replace("task/title", "t:1", "dig")
    assert rows(t.query(TASK)) == [("t:1", "dig")]  # before it is committed
    first = t.commit()
    assert a.transaction().replace("task/title", "t:1", "dig").commit() == first  # nothing new
    b = Branch(spark, str(tmp_path / "repo"), "b")
    b.pull(a)
    b.transaction().replace("task/title", "t:1", "dig deep").commit()
    a.transaction().replace("task/title", "t:2", "plant").commit()
    merged = a.pull(b)
    assert {r["vs"] for r in a.facts().collect()} == {"dig deep", "plant"}
    revs = H.revisions(spark, a.revisions)
    ids = [r["id"] for r in a.revisions]
    assert H.causality(revs, merged["id"], ids[0]) == "supersedes"
    assert H.causality(revs, ids[1], ids[2]) == "concurrent"
    assert H.common_ancestor(revs, ids[1], ids[2]) == first["id"]
    assert H.log(revs, merged["id"]).count() == 4
    assert {r["origin"]: r["edition"] for r in H.context(revs, merged["id"]).collect()} == {"a": 3, "b": 2}
    assert {r["vs"] for r in H.live(a.history()).collect()} == {"dig deep", "plant"}
    assert select(a.view(), the_prefix="system.branch/").count() == 2
    a.overlay(Changes().assert_("task/title", "t:9", "only here"))
    assert a.view().where("of = 't:9'").count() == 1 and a.facts().where("of = 't:9'").count() == 0


def test_induction(spark, tmp_path, monkeypatch):
    from tessera.streaming import induction

    monkeypatch.setattr(induction, "MAX_ROUNDS", 4)
    br = Branch(spark, str(tmp_path / "induce"))
    rule = Rule(OPEN, (P(TASK, this="?this", title="?desc"),), (P(DONE, this="?this", done=True),), head="assert")
    close = Rule(OPEN, (P(OPEN, this="?this", desc="?desc"), P(DONE, this="?this", done=True)), head="retract")
    br.transaction().replace("task/title", "t:1", "dig").replace("task/title", "t:2", "eat").commit([rule, close])
    assert select(br.facts(), the="task/open").count() == 2
    br.transaction().replace("task/done", "t:1", True).commit([rule, close])
    assert [r["of"] for r in select(br.facts(), the="task/open").collect()] == ["t:2"]
    n = Concept.of(n=Attribute("c/n", "UnsignedInteger", "many"))
    runaway = Rule(n, (P(n, this="?this", n="?m"), P("math/sum", of="?m", with_=1, is_="?n")), head="assert")
    with pytest.raises(QueryError, match="InductionDivergence"):
        br.transaction().assert_("c/n", "c:1", 1).commit([runaway])


def test_installed_rules_fire(spark, tmp_path):
    br = Branch(spark, str(tmp_path / "installed"))
    tag = Rule(C(tag="derived/tag:Text"), (P(TASK, this="?this", title="?tag"),), head="assert")
    br.transaction().replace("task/title", "t:1", "before").commit()
    br.transaction().install(tag).commit()  # runs over what is there
    tags = lambda b: sorted(r["vs"] for r in select(b.facts(), the="derived/tag").collect())
    assert tags(br) == ["before"]
    again = Branch(spark, str(tmp_path / "installed"))
    again.transaction().replace("task/title", "t:2", "while").commit()
    assert tags(again) == ["before", "while"]
    again.transaction().uninstall(tag).commit()
    again.transaction().replace("task/title", "t:3", "after").commit()
    assert tags(again) == ["before", "while"]
    # A backlog is drained, and a pulled rule catches up.
    drain = Rule(C(body="queue/body:Text"), (P(C(body="queue/body:Text"), this="?this", body="?body"),), head="retract")
    again.transaction().assert_("queue/body", "q:1", "pending").commit()
    other = Branch(spark, str(tmp_path / "installed"), "other")
    other.transaction().install(drain).commit()
    other.pull(again)
    assert select(other.facts(), the="queue/body").count() == 1
    other.induce()
    assert select(other.facts(), the="queue/body").count() == 0
    forged = Changes().assert_("system.rule/source", "rule:forged", "{}")
    other.commit(forged)
    assert [r.head for r in other.installed()] == ["retract"]


def test_rules_start_from_what_changed(spark, tmp_path):
    """From the changed entities of each premise on, the same comes out as from everything."""
    from tessera.plans import delta
    from tessera.plans.compile import Session
    from tessera.sources.facts import NarrowFacts

    owner = C(owner="task/owner:Entity")
    told = Rule(C(note="task/note:Text"), (P(TASK, this="?this", title="?t"), P(owner, this="?this", owner="?o"), P(C(name="p/name:Text"), this="?o", name="?n"), P("text/concatenate", first="?n", second="?t", is_="?note")), head="assert")
    own = facts(spark, [("task/title", f"t:{i}", f"title{i}") for i in range(6)] + [("task/owner", f"t:{i}", f"p:{i % 2}", "Entity") for i in range(6)] + [("p/name", f"p:{i}", f"n{i}") for i in range(2)])
    s = Session(spark, NarrowFacts(own), [])
    for changed, n in (([("p/name", "p:1")], 3), ([("task/title", "t:0")], 1), ([("task/owner", "t:1"), ("p/name", "p:0")], 4)):
        got = delta.derivations(s, told, spark.createDataFrame(changed, "the string, of string"), {c[0] for c in changed})
        assert len({r for x in got for r in rows(x.df.select("this", "note"))}) == n
    assert delta.derivations(s, Rule(told.deduce, told.when, (P(DONE, this="?this", done=True),), head="assert"), own, {"task/done"}) is None


def test_subscription_equals_recompute(spark):
    state = {"df": facts(spark, [("task/title", "t:1", "dig"), ("task/title", "t:2", "eat")])}
    sub = Subscription(spark, lambda: state["df"], TASK)
    assert len(rows(sub.poll().asserted)) == 2
    assert sub.poll() is None
    state["df"] = facts(spark, [("task/title", "t:1", "dig"), ("task/title", "t:3", "rest"), ("other/x", "t:9", 1)])
    delta = sub.poll()
    assert rows(delta.asserted) == [("t:3", "rest")] and rows(delta.retracted) == [("t:2", "eat")]
    assert (sub.recomputes, sub.maintenances) == (1, 1)
    assert rows(sub.rows) == rows(sub._derive(state["df"]))


def test_resumed_closure(spark):
    from tessera.plans.compile import Session
    from tessera.sources.facts import NarrowFacts

    edge, path = Concept.of(to=Attribute("g/edge", "Entity", "many")), Concept.of(to=Attribute("g/path", "Entity", "many"))
    rules = [Rule(path, (P(edge, this="?this", to="?to"),)), Rule(path, (P(edge, this="?this", to="?m"), P(path, this="?m", to="?to")))]
    old = [("g/edge", f"n:{i}", f"n:{i + 1}", "Entity") for i in range(4)]
    before = Session(spark, NarrowFacts(facts(spark, old)), rules).query(path)
    full = Session(spark, NarrowFacts(facts(spark, [*old, ("g/edge", "n:4", "n:5", "Entity")])), rules)
    assert rows(full.resumed(path, before)) == rows(full.query(path))


def test_subscriptions_equal_recomputation_on_random_edits(spark, tmp_path):
    """A join, a negation, a fold and a closure, over a branch: each poll as if derived anew."""
    import random

    person, boss = C(name="p/name:Text", dept="p/dept:Entity"), C(head="d/head:Text")
    away = C(day="p/away:Text")
    works, size = C(name="w/name:Text", head="w/head:Text"), C(n="d/size:UnsignedInteger")
    edge, path = Concept.of(to=Attribute("g/edge", "Entity", "many")), Concept.of(to=Attribute("g/path", "Entity", "many"))
    rules = [
        Rule(works, (P(person, this="?this", name="?name", dept="?d"), P(boss, this="?d", head="?head")), (P(away, this="?this", day="_"),)),
        Rule(size, (P(person, this="?p", dept="?this"),), reduce=(("n", Fold("count", Var("p"))),)),
        Rule(path, (P(edge, this="?this", to="?to"),)),
        Rule(path, (P(edge, this="?this", to="?m"), P(path, this="?m", to="?to"))),
    ]
    rng = random.Random(2)
    br = Branch(spark, str(tmp_path / "subs"))
    subs = [Subscription(spark, br, c, rules) for c in (works, size, path)]
    held = [[] for _ in subs]
    live = set()
    for step in range(4):
        c = Changes()
        for _ in range(5 if step else 14):
            x = rng.choice(
                [("p/name", f"p:{rng.randrange(4)}", f"n{rng.randrange(3)}", None), ("p/dept", f"p:{rng.randrange(4)}", f"d:{rng.randrange(2)}", "Entity"), ("d/head", f"d:{rng.randrange(2)}", f"h{rng.randrange(3)}", None), ("p/away", f"p:{rng.randrange(4)}", "mon", None), ("g/edge", f"n:{rng.randrange(5)}", f"n:{rng.randrange(5)}", "Entity")]
            )
            if x in live and rng.random() < 0.5:
                c.retract(*x)
                live.discard(x)
            else:
                (c.assert_ if x[0] == "g/edge" else c.replace)(*x)
                live.add(x)
        br.commit(c)
        for i, sub in enumerate(subs):
            delta = sub.poll()
            if delta is not None:
                for r in rows(delta.retracted):
                    held[i].remove(r)
                held[i] += rows(delta.asserted)
            assert sorted(held[i]) == rows(sub._derive(br.facts())) == rows(sub.rows), (step, i)
    assert all(sub.maintenances for sub in subs) and all(sub.recomputes == 1 for sub in subs)
    assert subs[0].poll() is None


def test_zset(spark):
    a = zset.of(spark.createDataFrame([("x",), ("x",), ("y",)], "k string"))
    b = zset.of(spark.createDataFrame([("x",), ("z",)], "k string"))
    assert rows(zset.difference(a, b)) == [("x", 1), ("y", 1), ("z", -1)]
    assert rows(zset.total(a, zset.scaled(a, -1))) == [("x", 0), ("y", 0)]
    assert rows(zset.expanded(a)) == [("x",), ("x",), ("y",)]


def test_csv_round_trip(spark, tmp_path):
    own = facts(
        spark,
        [("c/b", "e:1", b"\x00\x01\xff"), ("c/e", "e:1", "e:2", "Entity"), ("c/o", "e:1", True), ("c/t", "e:1", 'a "q", line\nnext'), ("c/n", "e:1", 10**30), ("c/i", "e:1", -5, "SignedInteger"), ("c/f", "e:1", 1.5, "Float", b"\x07"), ("c/r", "e:1", b"rec", "Record"), ("c/s", "e:1", "x/y", "Symbol")],
    )
    csv.write_facts(own, str(tmp_path / "out"))
    assert sorted(map(str, csv.read_facts(spark, str(tmp_path / "out")).collect())) == sorted(map(str, own.collect()))


def test_transaction_log(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("txn,at,the,of,as,is\n1,2020,se.post/title,post:1,text,old\n2,2021,se.post/title,post:1,text,new\n2,2021,se.post/tag,post:1,text,a\n3,2022,se.post/tag,post:1,text,b\n")
    got = csv.replayed(csv.read_log(spark, str(p)), {"se.post/tag"})
    assert sorted(r["vs"] for r in got.collect()) == ["a", "b", "new"]


def test_standing_query_over_a_stream(spark, tmp_path):
    from tessera.sources.facts import SCHEMA
    from tessera.streaming.subscription import standing

    inbox, seen = str(tmp_path / "in"), []
    facts(spark, [("task/title", "t:1", "dig")]).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    q = standing(stream, TASK, [], str(tmp_path / "kept"), lambda d, n: seen.append((n, rows(d.asserted), rows(d.retracted))))
    try:
        q.processAllAvailable()
        facts(spark, [("task/title", "t:2", "eat"), ("other/x", "t:1", 1)]).coalesce(1).write.mode("append").parquet(inbox)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x[1:] for x in seen] == [([("t:1", "dig")], []), ([("t:2", "eat")], [])]
    # Started again, it goes on.
    facts(spark, [("task/title", "t:3", "rest")]).coalesce(1).write.mode("append").parquet(inbox)
    q = standing(stream, TASK, [], str(tmp_path / "kept"), lambda d, n: seen.append((n, rows(d.asserted), rows(d.retracted))))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x[1:] for x in seen[2:]] == [([("t:3", "rest")], [])]


def test_revision_premises(spark):
    from tessera.plans.compile import Session
    from tessera.sources.facts import NarrowFacts

    revs = H.revisions(spark, [{"id": "r1", "origin": "a", "edition": 1, "parents": []}, {"id": "r2", "origin": "b", "edition": 2, "parents": ["r1", "r1"]}])
    own = facts(spark, [("note/at", "n:1", "r2")])
    s = Session(spark, NarrowFacts(own), revisions=revs)
    note = P(C(at="note/at:Text"), this="?n", at="?r")
    got = s.rows([note, P("history/revision", of="?r", branch="?b", issuer="?b", edition="?e"), P("history/revision-parent", of="?r", parent="?p")], select=["n", "b", "e", "p"])
    assert rows(got) == [("n:1", "b", 2, "r1")]


def test_files_as_relations(spark, tmp_path, monkeypatch):
    from tessera import store
    from tessera.plans.compile import Session
    from tessera.sources import layout
    from tessera.sources.blobs import BlobIndex
    from tessera.sources.facts import NarrowFacts

    monkeypatch.setattr(store, "LOGS", 2)
    br = Branch(spark, str(tmp_path / "files"))
    br.transaction().assert_("a/x", "e:1", "one").assert_("a/b", "e:1", b"raw").commit()
    br.transaction().retract("a/x", "e:1", "one").assert_("a/x", "e:2", "two").commit()
    blobs = BlobIndex.empty(spark).put(spark.createDataFrame([(b"h1", 10), (b"h2", 20)], "hash binary, size long"))
    s = Session(spark, NarrowFacts(br.facts()), tables=layout.tables(br, blobs.list()))
    log = f"log-{br.head['id']}"
    one = lambda what, *names, **where: rows(s.rows([P(what, **where)], select=list(names)))
    assert [x[0] for x in one("tree/node", "k", of=log, kind="?k", count="?n")] == ["index"]
    assert one("tree/manifest", "v", of=log, version="?v") == [(1,)]
    entry = (P("tree/span", of=log, node="?f"), P("tree/entry", of="?f", key="?key", state="?state", edition="?e"))
    got = rows(s.rows([*entry, P("order/key-part", of="?key", at="?at", kind="?kind", text="?text")], select=["state", "kind", "text"]))
    assert got == sorted([("asserted", k, t) for k, t in (("attribute", "a/x"), ("entity", "e:2"), ("vtype", "3"), ("value", "two"))] + [("removed", k, t) for k, t in (("attribute", "a/x"), ("entity", "e:1"), ("vtype", "3"), ("value", "one"))])
    kept = f"snapshot-{br.head['id']}"
    assert len(rows(s.rows([P("tree/span", of=kept, node="?f"), P("tree/key", of="?f", key="?k")], select=["k"]))) == 2
    bound = rows(s.rows([P("tree/span", of=kept, until="?u", at="?at"), P("order/separator-part", of="?u", kind="?kind")], select=["kind"]))
    assert ("min",) in bound
    spilled = rows(s.rows([P("tree/span", of=kept, node="?f"), P("tree/entry", of="?f", spill="?v"), P("tree/value", of="?v", size="?n", bytes="?b")], select=["n", "b"]))
    assert [(n, bytes(b)) for n, b in spilled] == [(3, b"raw")]
    assert [n for (n,) in one("tree/blob", "n", of="blobs", blob="?b", size="?n")] == [10, 20]
    with pytest.raises(QueryError, match="RequiredBindings"):
        s.rows([P("tree/node", of="?f", kind="?k")])


def test_blob_index(spark):
    from tessera.sources.blobs import BlobIndex

    put = lambda x, *rows_: x.put(spark.createDataFrame(list(rows_), "hash binary, size long"))
    drop = lambda x, h: x.retract(spark.createDataFrame([(h,)], "hash binary"))
    first = put(BlobIndex.empty(spark), (b"a", 1), (b"b", 2))
    gone = drop(first, b"a")
    assert first.has(b"a") and not gone.has(b"a") and not gone.merged(first).has(b"a") and not gone.has(b"zz")
    again = put(drop(gone, b"a"), (b"a", 1), (b"b", 2))
    assert sorted((bytes(h), v, n) for h, v, n in rows(again.list())) == [(b"a", 1, 1), (b"b", 1, 2)]
    assert [tuple(r) for r in again.get(b"b").collect()] == [(1, 2)]


def test_statements(spark):
    """A concept's values as writes, taken back, and kept for some entities only."""
    person = Concept.of(name=Attribute("p/name", "Text"), tag=Attribute("p/tag", "Symbol", "many"), age=Attribute("p/age", "UnsignedInteger", optional=True))
    c = Changes().concept(person, "p:1", name="Ann", tag="a/b").concept(person, "p:2", name="Bob", age=3)
    assert [(r[0], r[1], r[2]) for r in c.rows] == [("replace", "p/name", "p:1"), ("assert", "p/tag", "p:1"), ("replace", "p/name", "p:2"), ("replace", "p/age", "p:2")]
    own = applied(facts(spark, []), c.frame(spark))
    assert own.count() == 4 and rows(applied(own, c.reverted().frame(spark))) == []
    assert {r["of"] for r in applied(own, c.reverted().retain(["p:1"]).frame(spark)).collect()} == {"p:2"}
    with pytest.raises(QueryError, match="ValueRange"):
        Changes().concept(person, "p:3", age=-1)


def test_layers_of_branches(spark, tmp_path):
    """Facts and rules of branches beside each other, and of an overlay."""
    a, b = (Branch(spark, str(tmp_path / "layers"), x) for x in "ab")
    shout = Rule(C(loud="task/loud:Text"), (P(TASK, this="?this", title="?t"), P("text/upper-case", of="?t", is_="?loud")))
    a.transaction().assert_("task/title", "t:1", "dig").commit()
    b.transaction().install(shout).assert_("task/title", "t:2", "eat").commit()
    loud = C(loud="task/loud:Text")
    assert rows(a.session().query(loud)) == [] and rows(a.session(b).query(loud)) == [("t:1", "DIG"), ("t:2", "EAT")]
    laid = Changes()
    laid.rows += a.transaction().install(shout).changes.rows
    a.overlay(laid.assert_("task/title", "t:3", "here"), Changes().assert_("task/title", "t:1", "dig"))
    assert rows(a.session().query(loud)) == [("t:3", "HERE")]
    a.clear_overlay()
    assert rows(a.session().query(loud)) == []
