"""Premises to DataFrames: conjunction joins, alternatives union, absence is null.

One column a variable; its slot is known when the plan is built. Relations are memoised by
concept, so that a concept that is used twice is planned once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.formulas import formula
from tessera.model import ANY, PAYLOAD, TAGS, VALUE, Attribute, Blank, Concept, Const, Premise, QueryError, Rule, Var
from tessera.operators import constraints as con
from tessera.operators import reduce as red
from tessera.plans import analyze, types
from tessera.sources.base import Relation, Slot
from tessera.sources.facts import NarrowFacts, elect, packed

MAX_ROUNDS = 1000


@dataclass
class State:
    """Rows so far. ``maybe`` holds the variables that may be absent."""

    df: DataFrame | None = None
    slots: dict[str, Slot] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)


def tagged(c: Column, kind: str) -> Column:
    """A value of a known type as a tagged struct."""
    parts = {f.name: F.lit(None).cast(f.dataType) for f in VALUE}
    parts["vt"] = F.lit(TAGS[kind]).cast("byte")
    parts[PAYLOAD[kind]] = c.cast(VALUE[PAYLOAD[kind]].dataType)
    return F.when(c.isNotNull(), F.struct(*(parts[f.name].alias(f.name) for f in VALUE)))


class Session:
    """Queries over a source under a set of rules."""

    def __init__(self, spark: SparkSession, source, rules: list[Rule] = (), revisions: DataFrame | None = None, tables: dict[str, Relation] | None = None):
        self.spark, self.source, self.tables = spark, source, tables or {}
        self.rules: dict[str, list[Rule]] = {}
        self.revisions = revisions
        self.known: dict[str, Relation] = {}
        self.rounds = 0
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        """Takes any rule; checks come when a query touches it."""
        own = self.rules.setdefault(rule.deduce.identity, [])
        if rule not in own:
            own.append(rule)
            self.known.clear()

    # --- relations of concepts

    def relation(self, concept: Concept) -> Relation:
        """Rows (this, field...) of a concept: what its attributes say and what rules derive."""
        key = concept.identity
        if key not in self.known:
            rules = [r for own in self.rules.values() for r in own]
            group = analyze.check_strata(key, analyze.dependencies(rules))
            for r in self.rules.get(key, ()):
                analyze.check_rule(r)
            if group:
                self._fixpoint(group, concept)
            else:
                self.known[key] = self._union(concept, [self._stored(concept), *(self.derive(r) for r in self.rules.get(key, ()))])
        own = self.known[key]
        return self._named(own, concept)

    def _named(self, own: Relation, concept: Concept) -> Relation:
        """Columns are held by attribute; a concept has names of its own for them."""
        names = {a.the: n for n, a in concept.fields}
        columns = [F.col("this"), *(F.col(f"`{the}`").alias(n) for the, n in names.items())]
        return Relation(own.df.select(*columns), {"this": own.slots["this"]} | {n: own.slots[the] for the, n in names.items()})

    def _by_the(self, rel: Relation, concept: Concept) -> Relation:
        columns = [F.col("this"), *(F.col(f"`{n}`").alias(a.the) for n, a in concept.fields)]
        return Relation(rel.df.select(*columns), {"this": rel.slots["this"]} | {a.the: rel.slots[n] for n, a in concept.fields})

    def _stored(self, concept: Concept) -> Relation | None:
        fields = concept.attributes
        need = [a for a in fields.values() if not a.optional]
        if not all(self.source.knows(a.the) for a in need):
            return None
        there = {n: a for n, a in fields.items() if self.source.knows(a.the)}
        parts = self.source.fields({n: a for n, a in there.items()})
        parts.sort(key=lambda p: all(fields[n].optional for n in p[0]))
        out: Relation | None = None
        for names, rel in parts:
            maybe = all(fields[n].optional for n in names)
            if out is None:
                out = rel
                continue
            left, right = self._aligned(out, rel, "this")
            r = right.df.withColumnRenamed("this", "_this")
            df = left.df.join(r, left.df["this"] == r["_this"], "left" if maybe else "inner").drop("_this")
            out = Relation(df, left.slots | {n: right.slots[n] for n in names})
        df, slots = out.df, dict(out.slots)
        for n, a in fields.items():
            if n not in slots:
                df = df.withColumn(n, F.lit(None).cast("string"))
                slots[n] = Slot(a.kind if a.kind != ANY else "Text")
        for n, a in fields.items():
            if a.conforms is not None:  # a join, so that a target with several rows multiplies
                target = self.relation(a.conforms)
                left, right = self._aligned(Relation(df, slots), Relation(target.df.select(F.col("this").alias("_target")), {"_target": target.slots["this"]}), n, "_target")
                df, slots = left.df.join(right.df, left.df[n] == right.df["_target"]).drop("_target"), left.slots
        return self._by_the(Relation(df, slots), concept)

    def _aligned(self, a: Relation, b: Relation, on: str, on_b: str | None = None) -> tuple[Relation, Relation]:
        """Raw keys on both sides if they share a prefix, names on both otherwise."""
        on_b = on_b or on
        if a.slots[on] == b.slots[on_b]:
            return a, b
        show = lambda r, n: Relation(r.df.withColumn(n, r.slots[n].shown(F.col(f"`{n}`"))), r.slots | {n: Slot(r.slots[n].kind)})
        return show(a, on), show(b, on_b)

    def _union(self, concept: Concept, parts: list[Relation | None]) -> Relation:
        """All rows of all parts: alternatives aren't deduplicated."""
        parts = [p for p in parts if p is not None]
        names = ["this", *(a.the for _, a in concept.fields)]
        if not parts:
            kinds = {"this": "Entity"} | {a.the: a.kind for _, a in concept.fields}
            types = {"Boolean": "boolean", "Float": "double", "Bytes": "binary", "Record": "binary", "UnsignedInteger": red.INT, "SignedInteger": red.INT, ANY: VALUE.simpleString()}
            schema = ", ".join(f"`{n}` {types.get(kinds[n], 'string')}" for n in names)
            return Relation(self.spark.createDataFrame([], schema), {n: Slot(kinds[n]) for n in names})
        slots = {}
        for n in names:
            own = {p.slots[n] for p in parts}
            kinds = {s.kind for s in own}
            slots[n] = own.pop() if len(own) == 1 else Slot(kinds.pop() if len(kinds) == 1 else ANY)
        out = None
        for p in parts:
            columns = []
            for n in names:
                c, s = F.col(f"`{n}`"), p.slots[n]
                if s != slots[n]:
                    c = s.shown(c)
                    if slots[n].kind == ANY and s.kind != ANY:
                        c = tagged(c, s.kind)
                columns.append(c.alias(n))
            df = p.df.select(*columns)
            out = df if out is None else out.unionByName(df)
        return Relation(out, slots)

    def derive(self, rule: Rule, relation=None) -> Relation:
        """Head rows of one rule."""
        analyze.check_rule(rule)
        types.check(rule)
        body = self.body(rule.when, rule.unless, relation=relation)
        head = rule.deduce.attributes
        if rule.reduce:
            keys = {n: (F.col(f"`{n}`"), body.slots[n].kind) for n in ["this", *head] if n not in rule.folds and n in body.slots}
            folds, slots = {}, {n: body.slots[n] for n in keys}
            for n, f in rule.reduce:
                if isinstance(f.of, Var):
                    c, kind = F.col(f"`{f.of.name}`"), body.slots[f.of.name].kind
                else:
                    c, kind = con.literal(f.of)
                out = red.output_kind(f.apply, kind)
                folds[n] = red.fold(f.apply, c, kind)
                slots[n] = Slot(out)
            df = red.reduced(body.df, keys, folds)
            for n, _f in rule.reduce:
                want = head[n].kind
                if slots[n].kind == ANY and want != ANY:  # a value of another type is no row's
                    v = F.col(f"`{n}`")
                    tags = [TAGS[k] for k in ((*con.INTS,) if want in con.INTS else (want,))]
                    df = df.where(v.isNull() | v["vt"].isin(*tags)).withColumn(n, v[PAYLOAD[want]])
                    slots[n] = Slot(want)
        else:
            df, slots = body.df, dict(body.slots)
        if "this" not in slots:  # an anonymous head
            df, slots = df.withColumn("this", F.lit(None).cast("string")), slots | {"this": Slot("Entity")}
        for n, a in head.items():
            if n not in slots:
                df, slots[n] = df.withColumn(n, F.lit(None).cast("string")), Slot(a.kind if a.kind != ANY else "Text")
        names = ["this", *head]
        return self._by_the(Relation(df.select(*(F.col(f"`{n}`") for n in names)), {n: slots[n] for n in names}), rule.deduce)

    # --- bodies

    def body(self, when, unless=(), seed: Relation | None = None, relation=None) -> State:
        """Rows of variables that satisfy all of ``when`` and none of ``unless``."""
        state = State() if seed is None else State(seed.df, dict(seed.slots))
        for p in analyze.ordered(self._merged(when), set(state.slots)):
            state = self.step(state, p, relation)
        if state.df is None:
            raise QueryError("RequiredBindings", "an empty body")
        for p in unless:
            state = self.negated(state, p, relation)
        return state

    def _merged(self, when) -> list[Premise]:
        """Premises on stored attributes of one entity variable are read in one pass."""
        out: list[Premise] = []
        for p in when:
            if isinstance(p.what, Concept) and self._plain(p.what) and isinstance(p.terms.get("this"), Var):
                for i, q in enumerate(out):
                    if isinstance(q.what, Concept) and self._plain(q.what) and q.terms.get("this") == p.terms["this"]:
                        mine = {a.the for _, a in q.what.fields}
                        if all(a.the not in mine for _, a in p.what.fields) and self._single([*q.what.fields, *p.what.fields]):
                            fields, where = list(q.what.fields), list(q.where)
                            for n, a in p.what.fields:
                                new = f"{n}~{len(fields)}"
                                fields.append((new, a))
                                if n in p.terms:
                                    where.append((new, p.terms[n]))
                            out[i] = Premise(Concept(tuple(fields)), tuple(where))
                            break
                else:
                    out.append(p)
                continue
            out.append(p)
        return out

    def _plain(self, c: Concept) -> bool:
        return c.identity not in self.rules and not any(a.conforms for _, a in c.fields)

    def _single(self, fields) -> bool:
        return all(a.cardinality == "one" for _, a in fields) and all(self.source.knows(a.the) for _, a in fields)

    def step(self, state: State, p: Premise, relation=None) -> State:
        if isinstance(p.what, Concept):
            rel = (relation or self.relation)(p.what)
            maybe = {n for n, a in p.what.fields if a.optional}
            unknown = set(p.terms) - set(rel.slots)
            if unknown:
                raise QueryError("UnknownField", ", ".join(sorted(unknown)))
            return self.join(state, rel, p.terms, maybe)
        if isinstance(p.what, Attribute):
            return self.join(state, self._scan(p), p.terms, set())
        if p.what in con.CONSTRAINTS:
            return self.constrain(state, p)
        if analyze.is_table(p.what):
            return self.join(state, self._revisions(p.what), p.terms, set())
        return self.compute(state, p)

    def _revisions(self, name: str) -> Relation:
        """Revision records, or a row for each of a revision's parents; or a table of the layout."""
        if name in analyze.TREE:
            if name not in self.tables:
                raise QueryError("NoTable", name)
            return self.tables[name]
        if self.revisions is None:
            raise QueryError("NoRevisions", name)
        own = self.revisions
        if name.endswith("/revision-parent"):
            df = own.select(F.col("id").alias("of"), F.col("id").alias("this"), F.explode(F.array_distinct("parents")).alias("parent"))
            return Relation(df, {n: Slot("Text") for n in df.columns})
        writer = {n: F.col("origin").alias(n) for n in ("branch", "issuer", "authority")}  # there are no signatures
        df = own.select(F.col("id").alias("of"), F.col("id").alias("this"), *writer.values(), F.col("edition").cast(red.INT).alias("edition"))
        return Relation(df, {n: Slot("Text") for n in ("of", "this", *writer)} | {"edition": Slot("UnsignedInteger")})

    def _scan(self, p: Premise) -> Relation:
        the = p.terms.get("the")
        out = self.source.any_attribute() if isinstance(the, Var | Blank) else self._attribute(p.what)
        return Relation(out.df.withColumn("cause", F.coalesce("cause", F.unhex(F.lit("00" * 32)))), out.slots)

    def _attribute(self, a: Attribute) -> Relation:
        if isinstance(self.source, NarrowFacts):
            own = self.source.scan(a)
            v = packed() if a.kind == ANY else F.col(PAYLOAD[a.kind])
            df = own.select("the", "of", v.alias("is"), "cause")
            return Relation(df, {"the": Slot("Symbol"), "of": Slot("Entity"), "is": Slot(a.kind), "cause": Slot("Bytes")})
        (_, rel), *_rest = self.source.fields({"is": a})
        return Relation(rel.df.select(F.lit(a.the).alias("the"), F.col("this").alias("of"), "is", F.lit(None).cast("binary").alias("cause")), {"the": Slot("Symbol"), "of": rel.slots["this"], "is": rel.slots["is"], "cause": Slot("Bytes")})

    def _constant(self, c: Column, slot: Slot, t: Const) -> Column:
        """Column equals constant."""
        if slot.prefix is not None:
            text = str(t.value)
            return c.cast("string") == text[len(slot.prefix) :] if text.startswith(slot.prefix) else F.lit(False)
        if slot.kind == ANY:
            out = F.lit(False)
            for k in TAGS:
                lit = con.adapted(t, k)
                if lit is not None and not (t.kind == "Text" and k == "Symbol"):
                    out = out | ((c["vt"] == TAGS[k]) & F.coalesce(con.equal(c[PAYLOAD[k]], k, lit, k), F.lit(False)))
            return out
        if slot.kind == "Entity" and t.kind == "Text":
            return c == F.lit(t.value)
        lit = con.adapted(t, slot.kind)
        return F.lit(False) if lit is None else con.equal(c, slot.kind, lit, slot.kind)

    def join(self, state: State, rel: Relation, where: dict, maybe: set[str], how: str = "inner") -> State:
        df = rel.df
        at: dict[str, str] = {}
        for n, t in where.items():
            if n not in rel.slots:
                raise QueryError("UnknownField", n)
            if isinstance(t, Const):
                df = df.where(self._constant(F.col(f"`{n}`"), rel.slots[n], t))
            elif isinstance(t, Var):
                if t.name in at:  # the same variable in two places
                    a, b = at[t.name], n
                    x, y = rel.slots[a], rel.slots[b]
                    same = F.col(f"`{a}`") == F.col(f"`{b}`") if x == y and x.kind != "Float" else con.equal(x.shown(F.col(f"`{a}`")), x.kind, y.shown(F.col(f"`{b}`")), y.kind)
                    df = df.where(same)
                else:
                    at[t.name] = n
        # Names of their own, as variables may be called like columns of the other side.
        mark = uuid.uuid4().hex[:8]
        df = df.select(*(F.col(f"`{n}`").alias(f"{v}.{mark}") for v, n in at.items()))
        shared = [v for v in at if v in state.slots]
        if state.df is None:
            out = df.select(*(F.col(f"`{v}.{mark}`").alias(v) for v in at))
            return State(out, {v: rel.slots[n] for v, n in at.items()}, {v for v, n in at.items() if n in maybe})
        on, slots = None, dict(state.slots)
        left = state.df
        for v in shared:
            a, b = slots[v], rel.slots[at[v]]
            x, y = left[f"`{v}`"], F.col(f"`{v}.{mark}`")
            null_safe = v in state.maybe and at[v] in maybe
            if a.kind != b.kind and ANY not in (a.kind, b.kind) and {a.kind, b.kind} != set(con.INTS):
                raise QueryError("TypeInference", f"{v} is {a.kind} and {b.kind}")
            if a == b and a.kind not in ("Float", ANY):
                c = x.eqNullSafe(y) if null_safe else x == y
            else:
                x, y = a.shown(x), b.shown(y)
                c = con.equal(x, a.kind, y, b.kind)
                if a.kind == b.kind == "Float":  # an equality that can be hashed, and the bits
                    c = (x == y) & c
                if null_safe:
                    c = F.coalesce(c, F.lit(False)) | (x.isNull() & y.isNull())
            on = c if on is None else on & c
        out = left.crossJoin(df) if on is None else left.join(df, on, how)
        if how == "left_anti":
            return State(out, slots, state.maybe)
        new = [v for v in at if v not in state.slots]
        out = out.select(*(left[f"`{v}`"] for v in state.slots), *(F.col(f"`{v}.{mark}`").alias(v) for v in new))
        slots |= {v: rel.slots[at[v]] for v in new}
        gone = {v for v in shared if at[v] not in maybe}
        return State(out, slots, (state.maybe - gone) | {v for v in new if at[v] in maybe})

    def _side(self, state: State, t) -> tuple[Column | Const, str]:
        if isinstance(t, Const):
            return t, t.kind
        if isinstance(t, Var) and t.name in state.slots:
            s = state.slots[t.name]
            return s.shown(F.col(f"`{t.name}`")), s.kind
        raise QueryError("RequiredBindings", str(t))

    def predicate(self, state: State, p: Premise) -> Column:
        """The constraint as a condition; null counts as no match."""
        t = p.terms
        if p.what == "==":
            a, b = t["this"], t["is"]
            if isinstance(a, Const):
                a, b = b, a
            (x, kx), (y, ky) = self._side(state, a), self._side(state, b)
            if isinstance(y, Const):
                if isinstance(x, Const):
                    return F.lit(x == y)
                return self._constant(x, Slot(kx), y)
            maybe = {a.name, b.name} <= state.maybe
            same = con.equal(x, kx, y, ky)
            return F.coalesce(same, F.lit(False)) | (x.isNull() & y.isNull()) if maybe else same
        if p.what == "starts-with":
            c, kind = self._side(state, t.get("of", t.get("this")))
            prefix = t.get("prefix", t.get("with", t.get("is")))
            px, _ = self._side(state, prefix)
            if isinstance(c, Const):
                c, kind = con.literal(c)
            return con.starts_with(c, kind, px.value if isinstance(px, Const) else px)
        if p.what == "type":
            c, kind = self._side(state, t.get("of", t.get("this")))
            if isinstance(c, Const):
                c, kind = con.literal(c)
            return con.type_of(c, kind, t.get("is", t.get("as")).value)
        (x, kx), (y, ky) = self._side(state, t["of"]), self._side(state, t["with"])
        return con.compare(p.what, x, kx, y, ky)

    def constrain(self, state: State, p: Premise) -> State:
        t = p.terms
        if state.df is None:
            state = State(self.spark.range(1).select(), state.slots, state.maybe)
        if p.what == "==":
            free = [n for n in ("this", "is") if isinstance(t[n], Var) and t[n].name not in state.slots]
            if len(free) == 2:
                raise QueryError("RequiredBindings", "== with neither side bound")
            if free:  # it binds
                other = t["is" if free[0] == "this" else "this"]
                if isinstance(other, Const):
                    c, kind = con.literal(other)
                    slot, absent = Slot(kind), False
                else:
                    c, slot, absent = F.col(f"`{other.name}`"), state.slots[other.name], other.name in state.maybe
                name = t[free[0]].name
                df = state.df.withColumn(name, c)
                return State(df, state.slots | {name: slot}, state.maybe | ({name} if absent else set()))
        if p.what == "coalesce":
            c, kind = self._side(state, t["source"])
            if isinstance(t["source"], Var) and t["source"].name not in state.maybe:
                raise QueryError("CoalesceTypeMismatch", f"{t['source'].name} is never absent")
            fallback = t["fallback"]
            if isinstance(fallback, Const):
                y = con.adapted(fallback, kind)
                if y is None and kind == "Entity" and fallback.kind == "Text":
                    y = F.lit(fallback.value)
                ky = kind if y is not None else None
            else:
                y, ky = self._side(state, fallback)
            if ky != kind:
                raise QueryError("CoalesceTypeMismatch", f"{kind} and {ky}")
            out = F.coalesce(c, y)
            if isinstance(t["is"], Const):
                return State(state.df.where(self._constant(out, Slot(kind), t["is"])), state.slots, state.maybe)
            name = t["is"].name
            if name in state.slots:
                x, kx = self._side(state, t["is"])
                return State(state.df.where(con.equal(x, kx, out, kind)), state.slots, state.maybe)
            df = state.df.withColumn(name, out).where(F.col(f"`{name}`").isNotNull())
            return State(df, state.slots | {name: Slot(kind)}, state.maybe)
        drops = {x.name for x in t.values() if isinstance(x, Var)} if p.what not in ("==", "type") else set()
        return State(state.df.where(self.predicate(state, p)), state.slots, state.maybe - drops)

    def compute(self, state: State, p: Premise) -> State:
        f, t = formula(p.what), p.terms
        columns, kinds, constants = {}, {}, {}
        df = state.df if state.df is not None else self.spark.range(1).select()
        for n in f.inputs:
            x, k = self._side(state, t[n])
            if isinstance(x, Const):
                constants[n] = x.value
                columns[n], kinds[n] = F.lit(x.value), x.kind
            else:
                columns[n], kinds[n] = x, k
        slots, maybe = dict(state.slots), set(state.maybe)
        for n in f.inputs:
            if isinstance(t[n], Var):
                df = df.where(F.col(f"`{t[n].name}`").isNotNull())
                maybe.discard(t[n].name)
        if f.many:
            rows, outputs = f.run(columns, kinds, constants)
            one = f"_{uuid.uuid4().hex[:8]}"
            df = df.withColumn(one, F.explode(rows))
            got = {n: (F.col(one)[n], kind) for n, kind in outputs.items()}
        else:
            one, got = None, f.run(columns, kinds, constants)
        for n, (c, kind) in got.items():
            want = t.get(n, Blank())
            if isinstance(want, Const):
                df = df.where(self._constant(c, Slot(kind), want))
            elif isinstance(want, Var) and want.name in slots:
                x, kx = self._side(State(df, slots), want)
                df = df.where(con.equal(x, kx, c, kind))
                maybe.discard(want.name)
            elif isinstance(want, Var):
                df = df.withColumn(want.name, c).where(F.col(f"`{want.name}`").isNotNull())
                slots[want.name] = Slot(kind)
            else:
                df = df.where(c.isNotNull())
        return State(df.drop(one) if one else df, slots, maybe)

    def _yields(self, state: State, p: Premise) -> Column:
        """Whether a formula has a result on the row: its inputs are there, and so is every
        output, equal to what it is bound to."""
        f, t = formula(p.what), p.terms
        columns, kinds, constants, there = {}, {}, {}, F.lit(True)
        for n in f.inputs:
            x, kinds[n] = self._side(state, t[n])
            if isinstance(x, Const):
                constants[n], columns[n] = x.value, F.lit(x.value)
            else:
                columns[n], there = x, there & x.isNotNull()

        def fits(got: dict[str, tuple[Column, str]]) -> Column:
            out = F.lit(True)
            for n, (c, kind) in got.items():
                want = t.get(n, Blank())
                if isinstance(want, Const):
                    out = out & self._constant(c, Slot(kind), want)
                elif isinstance(want, Var) and want.name in state.slots:
                    x, kx = self._side(state, want)
                    out = out & con.equal(x, kx, c, kind)
                else:
                    out = out & c.isNotNull()
            return out

        if f.many:
            rows, outputs = f.run(columns, kinds, constants)
            return there & F.exists(rows, lambda r: F.coalesce(fits({n: (r[n], kind) for n, kind in outputs.items()}), F.lit(False)))
        return there & fits(f.run(columns, kinds, constants))

    def negated(self, state: State, p: Premise, relation=None) -> State:
        """Rows for which the premise yields nothing."""
        if isinstance(p.what, str) and p.what in con.CONSTRAINTS:
            hit = F.coalesce(self.predicate(state, p), F.lit(False))
            return State(state.df.where(~hit), state.slots, state.maybe)
        if isinstance(p.what, str):
            return State(state.df.where(~F.coalesce(self._yields(state, p), F.lit(False))), state.slots, state.maybe)
        if isinstance(p.what, Concept):
            rel, maybe = (relation or self.relation)(p.what), {n for n, a in p.what.fields if a.optional}
        else:
            rel, maybe = self._scan(p), set()
        terms = {n: (Blank() if isinstance(t, Var) and t.name not in state.slots else t) for n, t in p.terms.items()}
        if not any(isinstance(t, Var) for t in terms.values()):  # nothing in common: all rows go, or none
            there = self.join(State(), rel, {"this" if "this" in rel.slots else "of": Var("_any")} | {n: t for n, t in terms.items() if isinstance(t, Const)}, maybe)
            flag = there.df.limit(1).select(F.lit(1).alias("_hit"))
            return State(state.df.join(flag, F.lit(True), "left_anti"), state.slots, state.maybe)
        return self.join(state, rel, terms, maybe, "left_anti")

    # --- recursion

    def recursive(self, concept: Concept) -> bool:
        rules = [r for own in self.rules.values() for r in own]
        return bool(analyze.check_strata(concept.identity, analyze.dependencies(rules)))

    def resumed(self, concept: Concept, rows: DataFrame) -> DataFrame:
        """A recursive concept's rows from some of them that are known to hold.

        The rules start from those and all base rows; a round joins them all once, and then
        only what is new. So rows that were taken out and still hold come back.
        """
        rules = [r for own in self.rules.values() for r in own]
        group = analyze.check_strata(concept.identity, analyze.dependencies(rules))
        slots = {"this": Slot("Entity")} | {a.the: Slot(a.kind) for _, a in concept.fields}
        columns = [F.col("this"), *(F.col(f"`{n}`").alias(a.the) for n, a in concept.fields)]
        self._fixpoint(group, concept, Relation(rows.select(*columns), slots))
        return self._named(self.known[concept.identity], concept).shown()

    def _fixpoint(self, group: frozenset[str], concept: Concept, known: Relation | None = None) -> None:
        """Semi-naive: each round joins what is new with all there is, for the whole component.

        Rows are a set. Each round is checkpointed to the shared folder, so lineage doesn't
        grow and a lost executor costs no more than its tasks. ``known`` rows of ``concept``
        are there from the start.
        """
        ensure_checkpoints(self.spark)
        heads = {r.deduce.identity: r.deduce for own in self.rules.values() for r in own if r.deduce.identity in group}
        heads.setdefault(concept.identity, concept)
        rules = [r for k in group for r in self.rules.get(k, ())]
        for r in rules:
            analyze.check_rule(r)
        reads = lambda r: [i for i, p in enumerate(r.when) if isinstance(p.what, Concept) and p.what.identity in group]
        total: dict[str, Relation] = {}
        delta: dict[str, Relation] = {}
        for k, c in heads.items():
            parts = [self._stored(c), *(self.derive(r) for r in self.rules.get(k, ()) if not reads(r))]
            if known is not None and k == concept.identity:
                parts.append(known)
            own = self._settled(self._union(c, parts))
            first = self._distinct(own).df.checkpoint()
            total[k] = delta[k] = Relation(first, own.slots)
        for self.rounds in range(1, MAX_ROUNDS + 1):
            found: dict[str, list[Relation]] = {k: [] for k in heads}
            for r in rules:
                where = reads(r)
                for turn in where:
                    if delta[r.when[turn].what.identity] is None:
                        continue
                    # Marked, so that one of several premises on a concept reads what is new.
                    marked = [Premise(_Marked(p.what, "delta" if i == turn else "total"), p.where) if i in where else p for i, p in enumerate(r.when)]

                    def relation(c: Concept) -> Relation:
                        if isinstance(c, _Marked):
                            return self._named((delta if c.mark == "delta" else total)[c.of.identity], c.of)
                        return self.relation(c)

                    found[r.deduce.identity].append(self.derive(Rule(r.deduce, tuple(marked), r.unless, r.reduce), relation))
            new: dict[str, Relation | None] = dict.fromkeys(heads)
            for k, parts in found.items():
                if not parts:
                    continue
                own = self._distinct(self._settled(self._union(heads[k], parts)))
                if own.slots != total[k].slots:
                    raise QueryError("TypeInference", f"recursive rows of {heads[k].name} change type")
                keys = [red.identity(F.col(f"`{n}`"), s.kind) for n, s in own.slots.items()]
                old = total[k].df.select(*(c.alias(f"_k{i}") for i, c in enumerate(keys)))
                on = F.lit(True)
                for i, c in enumerate(keys):
                    on = on & c.eqNullSafe(F.col(f"_k{i}"))
                fresh = own.df.join(old, on, "left_anti").checkpoint()
                if not fresh.isEmpty():
                    new[k] = Relation(fresh, own.slots)
            for k, d in new.items():
                if d is not None:
                    df = total[k].df.unionByName(d.df)
                    total[k] = Relation(df.checkpoint() if self.rounds % 8 == 0 else df, total[k].slots)
            delta = new
            if all(d is None for d in delta.values()):
                break
        else:
            raise QueryError("FixpointDivergence", f"over {MAX_ROUNDS} rounds")
        self.known |= total

    def _settled(self, rel: Relation) -> Relation:
        """Integers as one type and entities by name, so that rounds agree on columns."""
        columns, slots = [], {}
        for n, s in rel.slots.items():
            c = s.shown(F.col(f"`{n}`")) if s.prefix is not None else F.col(f"`{n}`")
            kind = "SignedInteger" if s.kind in con.INTS else s.kind
            columns.append((c.cast(red.INT) if kind == "SignedInteger" else c).alias(n))
            slots[n] = Slot(kind)
        return Relation(rel.df.select(*columns), slots)

    def _distinct(self, rel: Relation) -> Relation:
        if all(s.kind not in (ANY, "Float") for s in rel.slots.values()):
            return Relation(rel.df.distinct(), rel.slots)
        keys = {f"_k{i}": red.identity(F.col(f"`{n}`"), s.kind) for i, (n, s) in enumerate(rel.slots.items())}
        return Relation(rel.df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys), rel.slots)

    # --- queries

    def query(self, concept: Concept, **where) -> DataFrame:
        """Rows of a concept under terms: constants filter, a variable in two places joins.

        Without terms, this and all fields. Blanks bind nothing. A bag: no distinct.
        """
        from tessera.model import term

        terms = {k.rstrip("_"): term(v) for k, v in where.items()} or {n: Var(n) for n in ["this", *concept.attributes]}
        out = self.step(State(), Premise(concept, tuple(terms.items())))
        return Relation(out.df, out.slots).shown()

    def rows(self, when, unless=(), select: list[str] | None = None) -> DataFrame:
        """Variables of a body."""
        out = self.body(tuple(when), tuple(unless))
        return Relation(out.df, out.slots).shown(select)

    def variants(self, *concepts: Concept) -> DataFrame:
        """First to conform: rows of the second for entities that aren't the first, and so on."""
        out, before = None, []
        for c in concepts:
            rel = self.relation(c)
            own = rel.shown()
            for b in before:
                own = own.join(b, "this", "left_anti")
            before.append(rel.shown(["this"]))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


@dataclass(frozen=True)
class _Marked(Concept):
    """A concept whose rows come from this round or from all rounds."""

    def __init__(self, of: Concept, mark: str):
        object.__setattr__(self, "fields", of.fields)
        object.__setattr__(self, "name", of.name)
        object.__setattr__(self, "of", of)
        object.__setattr__(self, "mark", mark)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; where none is set, to a folder for tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise QueryError("NoCheckpointDir", "set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="tessera-"))


__all__ = ["Session", "State", "elect"]
