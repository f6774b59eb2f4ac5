"""What a change of facts can reach: rule bodies evaluated from the changed entities on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import Attribute, Blank, Concept, Premise, Rule, Var
from tessera.plans import analyze
from tessera.plans.compile import Session
from tessera.sources.base import Relation, Slot


def subject(p: Premise):
    """The term that stands for the premise's entity."""
    return p.terms.get("this" if isinstance(p.what, Concept) else "of")


def own_attributes(what: Concept | Attribute, p: Premise | None = None) -> set[str]:
    """Attributes that a premise reads itself; '*' for all."""
    if isinstance(what, Concept):
        return {a.the for _, a in what.fields}
    return {"*"} if p is not None and isinstance(p.terms.get("the"), Var | Blank) else {what.the}


def attributes_read(c: Concept, rules: list[Rule]) -> set[str]:
    """Attributes whose facts can change the concept's rows: the demand of its plan."""
    out: set[str] = set()
    seen: set[str] = set()
    todo = [c]
    while todo:
        x = todo.pop()
        out |= own_attributes(x)
        if x.identity in seen:
            continue
        seen.add(x.identity)
        todo += [a.conforms for _, a in x.fields if a.conforms]
        for r in rules:
            if r.deduce.identity == x.identity:
                for p in (*r.when, *r.unless):
                    if isinstance(p.what, Concept):
                        todo.append(p.what)
                    elif isinstance(p.what, Attribute):
                        out |= own_attributes(p.what, p)
    return out


def met(wanted: set[str], touched: set[str]) -> bool:
    return bool(touched) and ("*" in wanted or bool(wanted & touched))


def entities(changed: DataFrame, wanted: set[str]) -> DataFrame:
    """Entities of ``changed`` (the, of) under some attributes."""
    own = changed if "*" in wanted else changed.where(F.col("the").isin(*sorted(wanted)))
    return own.select(F.col("of").alias("this")).distinct()


def _any(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def seeded(session: Session, when, unless, var: str, seeds: DataFrame):
    """Rows of a body whose ``var`` is one of the entities."""
    return session.body(when, unless, seed=Relation(seeds.select(F.col("this").alias(var)), {var: Slot("Entity")}))


def derivations(session: Session, rule: Rule, changed: DataFrame, touched: set[str]) -> list | None:
    """Bodies of a rule, each from the changed entities of one premise on; None if only the
    whole body will do."""
    out = []
    for p in rule.unless:
        if not isinstance(p.what, str) and met(attributes_read(p.what, _rules(session)) if isinstance(p.what, Concept) else own_attributes(p.what, p), touched):
            return None
    for p in rule.when:
        if isinstance(p.what, str):
            continue
        own = own_attributes(p.what, p)
        whole = attributes_read(p.what, _rules(session)) if isinstance(p.what, Concept) else own
        if not met(whole, touched):
            continue
        if met(whole - own, touched) or not isinstance(subject(p), Var) or (isinstance(p.what, Concept) and p.what.identity in session.rules):
            return None  # through a derived concept
        out.append(seeded(session, rule.when, rule.unless, subject(p).name, entities(changed, own)))
    return out


def _rules(session: Session) -> list[Rule]:
    return [r for own in session.rules.values() for r in own]


def affected(sessions: list[Session], concept: Concept, changed: DataFrame, touched: set[str]) -> DataFrame | None:
    """(this): entities whose rows of the concept a change can alter, perhaps more; None if
    that can't be told. ``sessions``: before and after the change, as what is gone is only
    reached before it."""
    rules = _rules(sessions[0])
    graph = analyze.dependencies(rules)
    memo: dict[str, DataFrame | None] = {}

    def of(c: Concept) -> DataFrame | None | str:
        """Entities, 'none' if nothing can have changed, or None."""
        if not met(attributes_read(c, rules), touched):
            return "none"
        if c.identity in memo:
            return memo[c.identity]
        group = analyze.components(graph).get(c.identity, frozenset())
        recursive = len(group) > 1 or c.identity in graph.get(c.identity, {})
        if recursive and len(group) > 1:
            return None  # mutual recursion
        parts = [entities(changed, own_attributes(c))] if met(own_attributes(c), touched) else []
        for n, a in c.fields:
            if a.conforms is not None:
                far = of(a.conforms)
                if far is None:
                    return None
                if not isinstance(far, str):
                    parts += [s.step(_seed(far, n), Premise.of(Concept(((n, Attribute(a.the, a.kind, a.cardinality)),)), this="?this", **{n: f"?{n}"})).df.select(F.col("this").cast("string").alias("this")) for s in sessions]
        loops = []
        for r in rules:
            if r.deduce.identity != c.identity:
                continue
            inner = [i for i, p in enumerate(r.when) if isinstance(p.what, Concept) and p.what.identity == c.identity]
            rest = tuple(p for i, p in enumerate(r.when) if i not in inner)
            for p in (*r.when, *r.unless):
                if isinstance(p.what, str):
                    continue
                again = isinstance(p.what, Concept) and p.what.identity == c.identity
                if again:
                    loops.append((rest, subject(p)))
                    continue
                far = of(p.what) if isinstance(p.what, Concept) else (entities(changed, own_attributes(p.what, p)) if met(own_attributes(p.what, p), touched) else "none")
                if far is None:
                    return None
                if isinstance(far, str):
                    continue
                got = _reach(rest, subject(p), far)
                if got is None:
                    return None
                parts += got
        out = _any(parts)
        if out is None:
            return "none"
        if loops:  # entities that reach these through the recursion, whatever its rows are
            out = out.checkpoint()
            while True:
                more = []
                for rest, term in loops:
                    got = _reach(rest, term, out)
                    if got is None:
                        return None
                    more += got
                new = _any(more).join(out, "this", "left_anti").checkpoint()
                if new.isEmpty():
                    break
                out = out.unionByName(new).checkpoint()
        memo[c.identity] = out
        return out

    def _seed(far: DataFrame, name: str):
        from tessera.plans.compile import State

        return State(far.select(F.col("this").alias(name)), {name: Slot("Entity")})

    def _reach(body, term, far: DataFrame) -> list[DataFrame] | None:
        """this of a rule's body from the entities on; None if the body doesn't tell it."""
        if not isinstance(term, Var):
            return None
        if term == Var("this"):
            return [far]
        if "this" not in set().union(*(analyze.outputs(p) for p in body)) or not any(term.name in p.variables for p in body):
            return None
        out = []
        for s in sessions:
            state = seeded(s, body, (), term.name, far)
            out.append(state.df.select(state.slots["this"].shown(F.col("this")).alias("this")))
        return out

    got = of(concept)
    return changed.select(F.col("of").alias("this")).limit(0) if isinstance(got, str) else got
