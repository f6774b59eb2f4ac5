"""The JSON notation of attributes, concepts, premises and rules."""

from __future__ import annotations

import json

from tessera.model import ANY, Attribute, Blank, Concept, Const, Fold, Premise, QueryError, Rule, Term, Var, term


def attribute(x: dict) -> Attribute:
    kind, one_of, conforms = x.get("as", ANY), (), None
    if isinstance(kind, list):
        kind, one_of = "Symbol", tuple(kind)
    elif isinstance(kind, dict):
        kind, conforms = "Entity", concept(kind)
    return Attribute(x["the"], kind, x.get("cardinality", "one"), bool(x.get("optional", False)), conforms, one_of)


def concept(x: dict) -> Concept:
    """Fields under ``maybe`` are metadata and ignored; optional ones say so themselves."""
    if not x.get("with"):
        raise QueryError("EmptyConcept", x.get("description", ""))
    return Concept(tuple((n, attribute(a)) for n, a in x["with"].items()), x.get("description", ""))


def premise(x: dict) -> Premise:
    what = x["assert"]
    if isinstance(what, dict):
        what = attribute(what) if "the" in what else concept(what)
    return Premise(what, tuple((k, term(v)) for k, v in x["where"].items()))


def rule(x: dict | str) -> Rule:
    x = json.loads(x) if isinstance(x, str) else x
    heads = [h for h in ("deduce", "assert!", "retract!") if h in x]
    if len(heads) != 1:
        raise QueryError("RuleHead", f"exactly one head is needed, not {heads}")
    reduce = tuple((n, Fold(f["apply"], term(f["of"]))) for n, f in x.get("reduce", {}).items())
    return Rule(
        concept(x[heads[0]]),
        tuple(premise(p) for p in x.get("when", ())),
        tuple(premise(p) for p in x.get("unless", ())),
        reduce,
        None if heads[0] == "deduce" else heads[0][:-1],
    )


def _term(t: Term):
    if isinstance(t, Var):
        return {"?": {"name": t.name}}
    return {"?": {}} if isinstance(t, Blank) else t.value


def _attribute(a: Attribute) -> dict:
    kind = list(a.one_of) if a.one_of else _concept(a.conforms) if a.conforms else a.kind
    out = {"the": a.the} | ({"as": kind} if kind != ANY else {})
    return out | ({"cardinality": "many"} if a.cardinality == "many" else {}) | ({"optional": True} if a.optional else {})


def _concept(c: Concept) -> dict:
    return ({"description": c.name} if c.name else {}) | {"with": {n: _attribute(a) for n, a in c.fields}}


def _premise(p: Premise) -> dict:
    what = _concept(p.what) if isinstance(p.what, Concept) else _attribute(p.what) if isinstance(p.what, Attribute) else p.what
    return {"assert": what, "where": {k: _term(t) for k, t in p.where}}


def to_json(r: Rule) -> dict:
    """The inverse of ``rule``."""
    head = "deduce" if r.head is None else f"{r.head}!"
    out: dict = {head: _concept(r.deduce), "when": [_premise(p) for p in r.when]}
    if r.unless:
        out["unless"] = [_premise(p) for p in r.unless]
    if r.reduce:
        out["reduce"] = {n: {"apply": f.apply, "of": _term(f.of)} for n, f in r.reduce}
    return out


__all__ = ["Const", "attribute", "concept", "premise", "rule", "to_json"]
