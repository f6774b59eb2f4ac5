"""The rule engine on small facts: bindings, elections, recursion, checks."""

import pytest
from pyspark.sql import functions as F

from tessera import notation
from tessera.catalog import C, P, folds
from tessera.model import Attribute, Concept, Const, QueryError, Rule, Var
from tessera.plans.compile import Session
from tessera.sources.facts import NarrowFacts, elect, facts, overlaid, select, union, without

PERSON = C(name="person/name:Text")
MAYBE = C(name="person/name:Text", nick="person/nick:Text?")
PARENT = Concept.of(to=Attribute("family/parent", "Entity", "many"))
ANCESTOR = Concept.of(to=Attribute("family/ancestor", "Entity", "many"))


@pytest.fixture(scope="module")
def people(spark):
    return facts(
        spark,
        [
            ("person/name", "p:1", "Ann"),
            ("person/name", "p:2", "Bob"),
            ("person/name", "p:3", "Cy"),
            ("person/nick", "p:1", "annie"),
            ("person/age", "p:1", 30),
            ("person/age", "p:2", 41.5),
            ("person/age", "p:3", "old"),
            ("person/admin", "p:1", True),
            ("family/parent", "p:1", "p:2", "Entity"),
            ("family/parent", "p:2", "p:3", "Entity"),
            ("family/parent", "p:1", "p:3", "Entity"),
        ],
    ).cache()


def S(spark, people, *rules):
    return Session(spark, NarrowFacts(people), list(rules))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_concept_and_optional(spark, people):
    got = {r["this"]: r["nick"] for r in S(spark, people).query(MAYBE).collect()}
    assert got == {"p:1": "annie", "p:2": None, "p:3": None}


def test_optional_pinned_drops_misses(spark, people):
    assert rows(S(spark, people).query(MAYBE, this="?p", nick="annie")) == [("p:1",)]
    assert rows(S(spark, people).query(MAYBE, this="?p", nick="other")) == []


def test_typed_scan_filters_other_types(spark, people):
    assert rows(S(spark, people).query(C(age="person/age:Text"))) == [("p:3", "old")]
    assert [r["this"] for r in S(spark, people).query(C(age="person/age:UnsignedInteger")).collect()] == ["p:1"]


def test_any_typed_values_compare_by_type(spark, people):
    s = S(spark, people)
    age = C(age="person/age:Any")
    assert rows(s.rows([P(age, this="?p", age="?a"), P(">", of="?a", with_=29)], select=["p"])) == [("p:1",), ("p:2",)]
    assert rows(s.rows([P(age, this="?p", age="?a"), P("type", of="?a", is_="number")], select=["p"])) == [("p:1",), ("p:2",)]
    assert rows(s.rows([P(age, this="?p", age=Const("old", "Text"))], select=["p"])) == [("p:3",)]


def test_negation_keeps_what_cannot_be_ordered(spark, people):
    s = S(spark, people)
    got = s.rows([P(C(age="person/age:Any"), this="?p", age="?a")], unless=[P("<", of="?a", with_=35)], select=["p"])
    assert rows(got) == [("p:2",), ("p:3",)]


def test_coalesce(spark, people):
    got = S(spark, people).rows([P(MAYBE, this="?p", nick="?n"), P("coalesce", source="?n", fallback="none", is_="?s")], select=["p", "s"])
    assert rows(got) == [("p:1", "annie"), ("p:2", "none"), ("p:3", "none")]


def test_equality_of_absent(spark, people):
    other = C(name="person/name:Text", also="person/nick:Text?")
    s = S(spark, people)
    got = s.rows([P(MAYBE, this="?p", nick="?n"), P(other, this="?q", also="?m"), P("==", this="?n", is_="?m")], select=["p", "q"])
    assert rows(got) == [("p:1", "p:1"), ("p:2", "p:2"), ("p:2", "p:3"), ("p:3", "p:2"), ("p:3", "p:3")]


def test_unless_concept_and_nothing_in_common(spark, people):
    s = S(spark, people)
    assert rows(s.rows([P(PERSON, this="?p", name="_")], unless=[P(C(n="person/nick:Text"), this="?p", n="_")], select=["p"])) == [("p:2",), ("p:3",)]
    assert rows(s.rows([P(PERSON, this="?p", name="_")], unless=[P(C(n="person/nick:Text"), n="annie")], select=["p"])) == []
    assert len(rows(s.rows([P(PERSON, this="?p", name="_")], unless=[P(C(n="person/nick:Text"), n="x")], select=["p"]))) == 3


def ancestors():
    return [Rule(ANCESTOR, (P(PARENT, this="?this", to="?to"),)), Rule(ANCESTOR, (P(PARENT, this="?this", to="?m"), P(ANCESTOR, this="?m", to="?to")))]


def test_recursion_dedups_diamonds(spark, people):
    assert rows(S(spark, people, *ancestors()).query(ANCESTOR)) == [("p:1", "p:2"), ("p:1", "p:3"), ("p:2", "p:3")]


def test_recursion_on_a_cycle_ends(spark):
    own = facts(spark, [("family/parent", "a:1", "a:2", "Entity"), ("family/parent", "a:2", "a:1", "Entity")])
    assert rows(S(spark, own, *ancestors()).query(ANCESTOR)) == [("a:1", "a:1"), ("a:1", "a:2"), ("a:2", "a:1"), ("a:2", "a:2")]


def test_derived_edge_recursion(spark, people):
    edge = Concept.of(to=Attribute("derived/parent", "Entity", "many"))
    far = Concept.of(to=Attribute("derived/ancestor", "Entity", "many"))
    rules = [Rule(edge, (P(PARENT, this="?this", to="?to"),)), Rule(far, (P(edge, this="?this", to="?to"),)), Rule(far, (P(far, this="?this", to="?m"), P(edge, this="?m", to="?to")))]
    assert len(rows(S(spark, people, *rules).query(far))) == 3


def test_stratification(spark, people):
    a, b = C(x="q/a:Entity"), C(x="q/b:Entity")
    bad = [Rule(a, (P(PARENT, this="?this", to="?x"),), (P(b, this="?this", x="?x"),)), Rule(b, (P(a, this="?this", x="?x"),))]
    with pytest.raises(QueryError, match="NegationThroughRecursion"):
        S(spark, people, *bad).query(a)
    n = C(x="q/n:UnsignedInteger")
    bad = [Rule(n, (P(n, this="?this", x="?y"),), reduce=folds(x=("count", "y")))]
    with pytest.raises(QueryError, match="AggregationThroughRecursion"):
        S(spark, people, *bad).query(n)
    assert len(rows(S(spark, people, *bad).query(PERSON))) == 3  # only queries that touch it


def test_folds(spark):
    own = facts(spark, [("m/dept", f"e:{i}", "d:1" if i < 3 else "d:2", "Entity") for i in range(5)] + [("m/pay", "e:0", 10), ("m/pay", "e:1", 20), ("m/pay", "e:3", 7)])
    pay = C(dept="m/dept:Entity", pay="m/pay:UnsignedInteger?")
    head = C(total="d/total:UnsignedInteger", n="d/n:UnsignedInteger")
    r = Rule(head, (P(pay, dept="?this", pay="?p"),), reduce=folds(total=("sum", "p"), n=("count", "p")))
    assert rows(S(spark, own, r).query(head)) == [("d:1", 30, 2), ("d:2", 7, 1)]
    low = C(low="d/low:UnsignedInteger?", k="d/k:UnsignedInteger")
    r = Rule(low, (P(pay, dept="?this", pay="?p"),), reduce=folds(low=("min", "p"), k=("count", "p")))
    assert rows(S(spark, own, r).query(low)) == [("d:1", 10, 2), ("d:2", 7, 1)]
    with pytest.raises(QueryError, match="RequiredHeadFromOptional"):
        bad = C(low="d/low2:UnsignedInteger")
        S(spark, own, Rule(bad, (P(pay, dept="?this", pay="?p"),), reduce=folds(low=("min", "p")))).query(bad)


def test_fold_of_mixed_bands_fails(spark, people):
    head = C(total="q/total:Float")
    r = Rule(head, (P(C(age="person/age:Any"), this="?p", age="?a"),), reduce=folds(total=("sum", "a")))
    with pytest.raises(Exception, match="integers and floats"):
        S(spark, people, r).query(head).collect()


def test_count_distinct_merges_integers_only(spark):
    own = facts(spark, [("v/x", "e:1", 1, "UnsignedInteger"), ("v/x", "e:2", 1, "SignedInteger"), ("v/x", "e:3", "1"), ("v/x", "e:4", 1.0)])
    head = C(n="q/n:UnsignedInteger")
    r = Rule(head, (P(C(x="v/x:Any"), this="?e", x="?v"),), reduce=folds(n=("count-distinct", "v")))
    assert [x["n"] for x in S(spark, own, r).query(head).collect()] == [3]


def test_checks():
    with pytest.raises(QueryError, match="EmptyConcept"):
        C(x="a/b:Text?")
    with pytest.raises(QueryError, match="InvalidAttributeSyntax"):
        Attribute("nodomain")
    with pytest.raises(QueryError, match="NonEntityConformance"):
        Attribute("a/b", "Text", conforms=PERSON)


def test_head_checks(spark, people):
    head = C(x="q/x:Text")
    for rule, code in (
        (Rule(head, (P(PERSON, this="?this", name="?y"),)), "UnboundVariable"),
        (Rule(head, (P(MAYBE, this="?this", nick="?x"),)), "RequiredHeadFromOptional"),
        (Rule(head, (P(PERSON, this="?this", name="?x"),), reduce=folds(x=("count", "x"))), "ReducedFieldCollision"),
        (Rule(head, (P(PERSON, this="?this", name="?x"),), reduce=folds(z=("count", "x"))), "ReducedFieldNotInHead"),
        (Rule(head, (P(PERSON, this="?this", name="?x"),), (P(head, this="?this", x="?x"),)), "SelfNegation|NegationThroughRecursion"),
        (Rule(head, (P(PERSON, this="?this", name="?n"), P("text/upper-case", of="?zz", is_="?x"))), "RequiredBindings"),
    ):
        with pytest.raises(QueryError, match=code):
            S(spark, people, rule).query(head)


def test_notation_round_trip():
    text = {"deduce": {"with": {"n": {"the": "q/n", "as": "UnsignedInteger"}}}, "when": [{"assert": {"with": {"name": {"the": "person/name", "as": "Text"}}, "maybe": {}}, "where": {"this": {"?": {"name": "p"}}, "name": {"?": {}}}}], "unless": [{"assert": "==", "where": {"this": {"?": {"name": "p"}}, "is": "p:1"}}], "reduce": {"n": {"apply": "count", "of": {"?": {"name": "p"}}}}}
    r = notation.rule(text)
    assert notation.rule(notation.to_json(r)) == r
    with pytest.raises(QueryError, match="RuleHead"):
        notation.rule({"when": []})


def test_formulas(spark):
    own = facts(spark, [("f/a", "e:1", 7), ("f/b", "e:1", 2), ("f/x", "e:1", 1e20), ("f/t", "e:1", " 42 "), ("f/u", "e:1", "1d")])
    s = S(spark, own)
    base = P(C(a="f/a:UnsignedInteger", b="f/b:UnsignedInteger", x="f/x:Float", t="f/t:Text", u="f/u:Text"), a="?a", b="?b", x="?x", t="?t", u="?u")
    one = lambda *p: [tuple(r) for r in s.rows([base, *p], select=["r"]).collect()]
    assert one(P("math/quotient", of="?a", by="?b", is_="?r")) == [(3,)]
    assert one(P("math/quotient", of=-7, by="?b", is_="?r")) == []  # a negative literal is no unsigned value
    assert one(P("math/quotient", of="?a", by=0, is_="?r")) == []
    assert one(P("math/modulo", of="?a", by="?b", is_="?r")) == [(1,)]
    assert one(P("math/difference", of="?b", subtract="?a", is_="?r")) == []
    assert one(P("math/sum", of="?a", with_="?x", is_="?r")) == []
    assert one(P("text/from", value="?x", is_="?r")) == [("100000000000000000000",)]
    assert one(P("unsigned-integer/parse", text="?t", is_="?r")) == [(42,)]
    assert one(P("float/parse", text="?u", is_="?r")) == []
    assert one(P("text/like", text="?t", pattern="*4?*", is_="?r")) == [(" 42 ",)]
    assert one(P("order/position", member="m", after="", before="", is_="?r"))[0][0].startswith("N")
    assert len(one(P("boolean/not", value=True, is_="?r"))) == 1


def test_positions_sort():
    from tessera.functions.position import insert, valid

    order = [insert("a")]
    for i in range(60):
        order.append(insert(f"m{i}", after=order[-1]))
        order.insert(1, insert(f"k{i}", order[0], order[1]))
    assert all(valid(p) for p in order) and order == sorted(order) and len(set(order)) == len(order)


def test_positions_of_random_insertions():
    import random

    from tessera.functions import position as pos

    assert pos.insert("member-1").startswith("N0") and len(pos.insert("member-1")) <= 2 + pos.BIAS
    assert pos.digits(0) == "0" and pos.identity("\0\0") == "00" and pos.insert("m", "N", "N") == "N"
    rng = random.Random(5)
    for far in (0.0, 0.4):
        order: list[str] = []
        for i in range(600):
            at = rng.choice([0, len(order)]) if rng.random() < far else rng.randrange(len(order) + 1)
            p = pos.insert(f"m:{i}", order[at - 1] if at else "", order[at] if at < len(order) else "")
            assert p is not None and pos.valid(p)
            order.insert(at, p)
        assert order == sorted(order) and len(set(order)) == len(order)
    # Appending grows with the logarithm only; both orders of the ends are the same.
    line = ["N"]
    for i in range(4000):
        line.append(pos.insert(f"m:{i}", after=line[-1]))
    assert line == sorted(line) and max(map(len, line)) <= 4 + pos.BIAS
    assert pos.insert("x", line[5], line[9]) == pos.insert("x", line[9], line[5])


def test_election(spark):
    own = facts(spark, [("a/x", "e:1", "old"), ("a/x", "e:1", "new", "Text", b"\x01"), ("a/x", "e:1", "newer", "Text", b"\x02")])
    assert elect(own).first()["vs"] == "newer"
    assert elect(own.orderBy(F.desc("vs"))).first()["vs"] == "newer"
    s = Session(spark, NarrowFacts(own))
    assert rows(s.query(C(x="a/x:Text"), this="?e", x="old")) == []  # a loser never matches
    many = Concept.of(x=Attribute("a/x", "Text", "many"))
    assert len(rows(s.query(many))) == 3


def test_selectors(spark, people):
    assert select(people, domain="person", name="name").count() == 3
    assert select(people, of_prefix="p:", name="admin").count() == 1
    assert select(people, is_prefix="ann").count() == 1
    assert select(people, the="person/age", at_least=30).count() == 1
    with pytest.raises(QueryError, match="EmptySelector"):
        select(people)


def test_overlay_and_union(spark, people):
    gone = select(people, the="person/name", of="p:1")
    assert without(people, gone).count() == people.count() - 1
    assert overlaid(people, gone, gone).count() == people.count()  # retracted, then asserted
    assert union(people, people).count() == people.count()


def test_negative_zero_is_another_value(spark):
    own = facts(spark, [("z/x", "e:1", 0.0), ("z/y", "e:2", -0.0), ("z/y", "e:3", 0.0)])
    s = S(spark, own)
    got = s.rows([P(C(x="z/x:Float"), this="?a", x="?v"), P(C(y="z/y:Float"), this="?b", y="?v")], select=["b"])
    assert rows(got) == [("e:3",)]


def test_variables_meet_types(spark, people):
    with pytest.raises(QueryError, match="TypeInference"):
        S(spark, people).rows([P(PERSON, this="?p", name="?x"), P(PARENT, this="?x", to="_")])
    assert Var("x") != Const("x")


def test_sources_that_share_an_attribute(spark):
    from tessera.sources.facts import Many
    from tessera.sources.wide import simple

    first, second = (NarrowFacts(facts(spark, x)) for x in ([("a/x", "e:1", "one"), ("a/x", "e:3", "low", "Text", b"\x01")], [("a/x", "e:2", "two"), ("a/x", "e:3", "high", "Text", b"\x02"), ("a/x", "e:1", "one")]))
    s = Session(spark, Many([first, second]))
    assert rows(s.query(C(x="a/x:Text"))) == [("e:1", "one"), ("e:2", "two"), ("e:3", "high")]
    table = simple(spark.createDataFrame([(4, "four")], "k int, x string"), "a", "k", "")
    assert rows(Session(spark, Many([table, first])).query(C(x="a/x:Text"))) == [("a:4", "four"), ("e:1", "one"), ("e:3", "low")]
    bag = simple(spark.createDataFrame([(4, "four")], "k int, x string"), "b", None, "")
    with pytest.raises(QueryError, match="RowIdentity"):
        Session(spark, Many([bag, first])).rows([P(Attribute("any/any"), the="?the", of="?of", is_="_")])


def test_choices_and_conformance_tell_concepts_apart(spark):
    own = facts(spark, [("a/x", "e:1", "x", "Symbol"), ("a/x", "e:2", "y", "Symbol"), ("a/to", "e:1", "e:2", "Entity"), ("a/to", "e:2", "e:9", "Entity")])
    s = S(spark, own)
    one = lambda *of: Concept.of(x=Attribute("a/x", "Symbol", one_of=of))
    assert rows(s.query(one("x"))) == [("e:1", "x")] and rows(s.query(one("y"))) == [("e:2", "y")] and len(rows(s.query(one("x", "y")))) == 2
    plain, strict = C(to="a/to:Entity"), Concept.of(to=Attribute("a/to", "Entity", conforms=one("y")))
    assert rows(s.query(strict)) == [("e:1", "e:2")] and len(rows(s.query(plain))) == 2
    assert plain != strict and Rule(plain, ()) != Rule(strict, ())


def test_any_typed_folds_keep_their_type(spark):
    own = facts(spark, [("v/x", "e:1", 2**70), ("v/x", "e:2", 3), ("w/x", "e:1", "b"), ("w/x", "e:2", "a")])
    for name, apply, kind, want in (("v", "sum", "Any", 2**70 + 3), ("v", "max", "UnsignedInteger", 2**70), ("w", "min", "Any", "a"), ("w", "max", "Text", "b")):
        head = Concept.of(v=Attribute("q/v", kind))
        got = S(spark, own, Rule(head, (P(C(x=f"{name}/x:Any"), this="?e", x="?x"),), reduce=folds(v=(apply, "x")))).query(head).collect()
        v = got[0]["v"]
        assert (v["vn"] if kind == "Any" and name == "v" else v["vs"] if kind == "Any" else v) == want


def test_negated_formulas(spark, people):
    got = S(spark, people).rows([P(PERSON, this="?p", name="?n")], unless=[P("text/like", text="?n", pattern="*n*", is_="_")], select=["p"])
    assert rows(got) == [("p:2",), ("p:3",)]
    got = S(spark, people).rows([P(PERSON, this="?p", name="?n"), P("text/upper-case", of="?n", is_="?u")], unless=[P("text/concatenate", first="BO", second="B", is_="?u")], select=["p"])
    assert rows(got) == [("p:1",), ("p:3",)]


def test_formula_names_are_exact(spark, people):
    from tessera.functions import formulas

    with pytest.raises(QueryError, match="UnknownFormula"):
        formulas.formula("nonsense/position")
    formulas.use_namespace("theirs")
    assert formulas.formula("theirs/position") is formulas.formula("order/position")


def test_types_are_inferred(spark, people):
    from tessera.plans.types import infer

    age, head = C(age="person/age:Any"), C(x="q/x:Text")
    for when, code in (
        ((P(PERSON, this="?this", name="?x"), P("math/sum", of="?x", with_=1, is_="?y")), "TypeInference"),
        ((P(PERSON, this="?this", name="?x"), P("==", this="?x", is_="?b"), P("boolean/not", value="?b", is_="?n")), "TypeInference"),
        ((P(PARENT, this="?this", to="?x"), P("type", of="?x", is_="number")), "TypeInference"),
        ((P(PERSON, this="?this", name="_"), P(C(n="person/n:Float"), this="?this", n="?x")), "TypeInference"),
    ):
        with pytest.raises(QueryError, match=code):
            S(spark, people, Rule(head, when)).query(head)
    found = infer(Rule(head, (P(age, this="?this", age="?x"), P("type", of="?x", is_="textual"), P("text/upper-case", of="?x", is_="?u"))))
    assert found.kinds["x"] == {"Text"} and ("Narrowing", "x") in {(c, v) for c, v, _ in found.lints}
    found = infer(Rule(head, (P(MAYBE, this="?this", nick="?n"), P("text/upper-case", of="?n", is_="?x"))))
    assert [(c, v) for c, v, _ in found.lints] == [("DeadOptionality", "n")]


def test_entities_as_classes(spark, people):
    from dataclasses import dataclass

    from tessera.schema import attribute, concept

    @concept("person")
    @dataclass
    class Person:
        name: str
        nick: str | None = None
        tags: list[str] = attribute(the="person.extra/tag", default_factory=list)

    assert Person.concept == Concept.of(name=Attribute("person/name", "Text"), nick=Attribute("person/nick", "Text", optional=True), tags=Attribute("person.extra/tag", "Text", "many")) or Person.concept.attributes["tags"].cardinality == "many"
    made = Person.written("p:9", Person("Zed", None, ["a", "b"]))
    assert [(r[0], r[1], r[2]) for r in made.rows] == [("replace", "person/name", "p:9"), ("assert", "person.extra/tag", "p:9"), ("assert", "person.extra/tag", "p:9")]
    s = S(spark, people)
    got = s.query(Concept(tuple((n, a) for n, a in Person.concept.fields if n != "tags")))
    assert {r["this"]: r["nick"] for r in got.collect()}["p:1"] == "annie"


def test_absent_values_meet_optional_fields(spark):
    own = facts(spark, [("t/name", f"p:{i}", f"n{i}") for i in range(4)] + [("t/a", "p:0", "x"), ("t/a", "p:1", "x"), ("t/b", "p:0", "x"), ("t/b", "p:2", "x"), ("t/b", "p:1", "y")])
    a, b = C(n="t/name:Text", a="t/a:Text?"), C(n="t/name:Text", b="t/b:Text?")
    # Present meets an equal value; absent passes only where there is no fact.
    got = S(spark, own).rows([P(a, this="?p", n="_", a="?v"), P(b, this="?p", n="_", b="?v")], select=["p", "v"])
    assert rows(got.fillna("-")) == [("p:0", "x"), ("p:3", "-")]
    # A derived field that no premise binds is absent, and no constant meets it.
    head = C(n="q/n:Text", extra="q/extra:Text?")
    r = Rule(head, (P(a, this="?this", n="?n"),))
    assert {x["extra"] for x in S(spark, own, r).query(head).collect()} == {None}
    assert rows(S(spark, own, r).query(head, this="?p", extra="x")) == []


def test_more_checks(spark, people, monkeypatch):
    from tessera.plans import compile as compiler

    head, named = C(x="q/x:Text"), P(PERSON, this="?this", name="?n")
    for when, unless, code in (
        ((named, P("coalesce", source="?n", fallback="none", is_="?x")), (), "CoalesceTypeMismatch"),
        ((P(MAYBE, this="?this", nick="?k"), P("coalesce", source="?k", fallback=3, is_="?x")), (), "CoalesceTypeMismatch"),
        ((P(PERSON, this="?this", name="?x"),), (P(MAYBE, this="?this", nick="?k"),), "NegatedOptional"),
        ((named, P("text/upper-case", is_="?x")), (), "OmittedCell"),
        ((named, P("text/upper-case", of="_", is_="?x")), (), "BlankCell"),
    ):
        with pytest.raises(QueryError, match=code):
            S(spark, people, Rule(head, when, unless)).query(head)
    chain = facts(spark, [("family/parent", f"n:{i}", f"n:{i + 1}", "Entity") for i in range(8)])
    monkeypatch.setattr(compiler, "MAX_ROUNDS", 2)
    with pytest.raises(QueryError, match="FixpointDivergence"):
        S(spark, chain, *ancestors()).query(ANCESTOR)


def test_mutual_and_linear_recursion_that_shrinks(spark):
    """Entities that a removed edge can reach, through the recursion in either form."""
    from tessera.plans.delta import affected

    edge, path = Concept.of(to=Attribute("g/edge", "Entity", "many")), Concept.of(to=Attribute("g/path", "Entity", "many"))
    base = Rule(path, (P(edge, this="?this", to="?to"),))
    right = Rule(path, (P(edge, this="?this", to="?m"), P(path, this="?m", to="?to")))
    left = Rule(path, (P(path, this="?this", to="?m"), P(edge, this="?m", to="?to")))
    own = facts(spark, [("g/edge", f"n:{i}", f"n:{i + 1}", "Entity") for i in range(5)])
    changed = spark.createDataFrame([("g/edge", "n:2")], "the string, of string")
    sessions = [S(spark, own, base, right), S(spark, own.where("of <> 'n:2'"), base, right)]
    assert rows(affected(sessions, path, changed, {"g/edge"})) == [("n:0",), ("n:1",), ("n:2",)]
    assert affected([S(spark, own, base, left)] * 2, path, changed, {"g/edge"}) is None  # the body doesn't tell
    assert rows(affected(sessions, path, changed, {"other/x"})) == []


def test_shorthand(spark):
    from tessera.shorthand import expand, read, small

    assert small("RecipeStep") == "recipe-step"
    doc = {
        "home": {
            "unit": {"as": [":tsp", ":mls"]},
            "amount-int": {"the": "./amount", "as": "UnsignedInteger"},
            "amount": {"the": "far.away/.", "as": "Float"},
            "Ingredient": {"with": {"name": {"as": "Text"}, "quantity": ".amount", "kind": "home/unit", "of": "else.where/of"}, "maybe": {"after": {"as": ".Ingredient"}}},
            "Double": {"with": {"quantity": {"as": "UnsignedInteger"}}},
            "doubled": {
                "deduce": {"Double": {"quantity": "?doubled"}},
                "when": [{"home/amount-int": {"this": "?this", "is": "?quantity"}}, {"math/sum": {"of": "?quantity", "with": "?quantity", "is": "?doubled"}}, {">": {"of": "?doubled", "with": 4}}],
                "unless": [{"home/Spoilt": {"this": "?this", "since": "_"}}],
            },
        }
    }
    got = expand(doc)
    assert got["home/unit"] == {"the": "home/unit", "cardinality": "one", "as": ["home/tsp", "home/mls"]}
    assert got["home/amount"]["the"] == "far.away/amount" and got["home/amount-int"]["the"] == "home/amount"
    fields = got["home/Ingredient"]["with"]
    assert fields["quantity"] == {"the": "home.ingredient/amount"} and fields["of"] == {"the": "else.where/of"} and fields["kind"] == got["home/unit"]
    assert fields["name"] == {"the": "home.ingredient/name", "cardinality": "one", "as": "Text"} and fields["after"]["optional"]
    assert got["home/doubled"]["unless"][0]["assert"] == {"with": {"since": {"the": "home.spoilt/since"}}}
    assert fields["after"] == {"the": "home.ingredient/after", "cardinality": "one", "as": "Entity", "optional": True}
    doc["home"]["Step"] = {"with": {"uses": {"as": ".Double"}, "next": {"as": ".Step"}}}
    steps = expand(doc)["home/Step"]["with"]
    assert steps["uses"]["as"]["with"]["quantity"]["the"] == "home.double/quantity" and steps["next"]["as"] == "Entity"
    made = read(doc)
    own = facts(spark, [("home/amount", "i:1", 2), ("home/amount", "i:2", 3), ("home/amount", "i:3", 9), ("home.spoilt/since", "i:3", "may")])
    assert [(r["this"], int(r["quantity"])) for r in S(spark, own, made["home/doubled"]).query(made["home/Double"]).collect()] == [("i:2", 6)]


def test_single_attributes(spark, people):
    s = S(spark, people)
    name = Attribute("person/name", "Text")
    assert rows(s.rows([P(name, of="?p", is_="Bob")], select=["p"])) == [("p:2",)]
    assert rows(s.rows([P(name, of="?p", is_="?n"), P(Attribute("person/nick"), of="?p", is_="?k"), P("type", of="?k", is_="text")], select=["n"])) == [("Ann",)]
    assert rows(s.rows([P(Attribute("person/age", "Float"), the="person/age", of="?p", is_="?a")], select=["p", "a"])) == [("p:2", 41.5)]
