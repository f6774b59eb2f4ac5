"""Commit-time rules: what a commit touches triggers rules that assert or retract more."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import ANY, VALUE, Attribute, Concept, QueryError, Rule
from tessera.plans.compile import Session, State, ensure_checkpoints, tagged
from tessera.plans.delta import attributes_read, derivations, met, own_attributes
from tessera.sources.facts import FACT, NarrowFacts, without

if TYPE_CHECKING:
    from tessera.store import Branch

MAX_ROUNDS = 16


def triggers(rule: Rule, deductive: list[Rule]) -> set[str]:
    """Attributes that the rule's body reads, through deductive rules too; '*' for all."""
    out: set[str] = set()
    for p in (*rule.when, *rule.unless):
        if isinstance(p.what, Concept):
            out |= attributes_read(p.what, deductive)
        elif isinstance(p.what, Attribute):
            out |= own_attributes(p.what, p)
    return out


def _heads(rule: Rule, body: State) -> list[DataFrame]:
    """What a body has its rule write: (op, fact)."""
    out = []
    for n, a in rule.deduce.fields:
        if n not in body.slots or "this" not in body.slots:
            raise QueryError("UnboundVariable", n)
        slot = body.slots[n]
        c = slot.shown(F.col(f"`{n}`"))
        v = c if slot.kind == ANY else tagged(c, slot.kind if a.kind == ANY else a.kind)
        op = "retract" if rule.head == "retract" else "replace" if a.cardinality == "one" else "assert"
        own = body.df.select(F.lit(op).alias("op"), F.lit(a.the).alias("the"), body.slots["this"].shown(F.col("this")).alias("of"), v.alias("_v"))
        out.append(own.where("_v is not null and of is not null").select("op", "the", "of", *(F.col("_v")[f.name].alias(f.name) for f in VALUE)))
    return out


def induce(branch: Branch, changes: DataFrame, transient: DataFrame, rules: list[Rule], fresh: set[str] = frozenset()) -> DataFrame:
    """The batch with all that commit-time rules add to it.

    In each round all triggered rules read the same view; what is new joins the batch and
    may trigger the next round. A rule starts from the entities that changed where each of
    its premises reads facts of its own; one whose negations or derived premises were
    touched, and one of ``fresh`` in the first round, runs over everything. What rules derive
    stays a frame. Dispatched facts live for one round. Rules that never rest are an error.
    """
    from tessera.store import applied

    spark = branch.spark
    ensure_checkpoints(spark)
    inductive = list({r.id: r for r in rules if r.head}.values())
    deductive = list({r.id: r for r in rules if r.head is None}.values())
    base = branch.view()
    out, passing, news, whole = changes, transient, changes.unionByName(transient), set(fresh)
    step = (out.agg(F.max("seq").alias("n")).first()["n"] or 0) + 1
    for _ in range(MAX_ROUNDS):
        touched = {r["the"] for r in news.select("the").distinct().collect()}  # attributes, not facts
        due = [r for r in inductive if r.id in whole or met(triggers(r, deductive), touched)]
        if not due:
            return out
        view = applied(applied(base, out), passing)
        session = Session(spark, NarrowFacts(view), deductive)
        changed = news.select("the", "of").distinct()
        found = []
        for r in due:
            bodies = None if r.id in whole else derivations(session, r, changed, touched)
            found += [h for body in (bodies if bodies is not None else [session.body(r.when, r.unless)]) for h in _heads(r, body)]
        if not found:
            return out
        said = reduce(DataFrame.unionByName, found).distinct()
        said = said.checkpoint()
        attributes = sorted({a.the for r in due for _, a in r.deduce.fields})
        there = view.where(F.col("the").isin(*attributes)).select(*FACT)
        # Asserting what is there, or retracting what isn't, is nothing new.
        adds, takes = said.where("op <> 'retract'"), said.where("op = 'retract'")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACT))
        held = there.select(*(F.col(c).alias(f"_{c}") for c in FACT)).distinct()
        news = without(adds, there, FACT).unionByName(takes.join(held, same, "left_semi"))
        news = news.select(F.lit(step).cast("long").alias("seq"), *said.columns).checkpoint()
        if news.isEmpty():
            return out
        out, passing, whole = out.unionByName(news).checkpoint(), transient.limit(0), set()
        step += 1
    raise QueryError("InductionDivergence", f"over {MAX_ROUNDS} rounds")
