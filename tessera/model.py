"""Values, terms, attributes, concepts, premises and rules."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Value types by their tag in ``vt``; fixed values.
TAGS = {"Bytes": 0, "Entity": 1, "Boolean": 2, "Text": 3, "UnsignedInteger": 4, "SignedInteger": 5, "Float": 6, "Record": 7, "Symbol": 8}
KINDS = {v: k for k, v in TAGS.items()}
#: The payload column of the facts layout that holds each type.
PAYLOAD = {"Bytes": "vb", "Record": "vb", "Entity": "vs", "Text": "vs", "Symbol": "vs", "Boolean": "vbool", "UnsignedInteger": "vn", "SignedInteger": "vn", "Float": "vf"}
NUMERIC = ("UnsignedInteger", "SignedInteger", "Float")
TEXTUAL = ("Text", "Symbol", "Entity")
COMPARABLE = (*NUMERIC, *TEXTUAL, "Bytes")
#: Types that are one value when grouped, counted as distinct or deduplicated by recursion.
IDENTITY = {0: 0, 7: 0, 1: 1, 3: 1, 8: 1, 2: 2, 4: 4, 5: 4, 6: 6}
ANY = "Any"

VALUE = T.StructType(
    [
        T.StructField("vt", T.ByteType()),
        T.StructField("vs", T.StringType()),
        T.StructField("vn", T.DecimalType(38, 0)),
        T.StructField("vf", T.DoubleType()),
        T.StructField("vb", T.BinaryType()),
        T.StructField("vbool", T.BooleanType()),
    ]
)

_DOMAIN = re.compile(r"[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)*")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


class QueryError(ValueError):
    """A query, rule or write that can't be; ``code`` names the check."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object
    kind: str | None = None

    def __post_init__(self):
        if self.kind is None:
            v = self.value
            kind = "Boolean" if isinstance(v, bool) else "Integer" if isinstance(v, int) else "Float" if isinstance(v, float) else "Bytes" if isinstance(v, bytes) else "Text"
            object.__setattr__(self, "kind", kind)


@dataclass(frozen=True)
class Blank:
    pass


Term = Var | Const | Blank
_ = Blank()


def term(x) -> Term:
    if isinstance(x, Var | Const | Blank):
        return x
    if isinstance(x, str) and x.startswith("?") and len(x) > 1:
        return Var(x[1:])
    if x == "_":
        return Blank()
    if isinstance(x, dict) and set(x) == {"?"}:
        name = (x["?"] or {}).get("name")
        return Var(name) if name else Blank()
    return Const(x)


def check_the(the: str) -> str:
    domain, slash, name = the.partition("/")
    if not slash or len(the.encode()) > 64 or not _DOMAIN.fullmatch(domain) or not _NAME.fullmatch(name):
        raise QueryError("InvalidAttributeSyntax", the)
    return the


@dataclass(frozen=True)
class Attribute:
    the: str
    kind: str = ANY
    cardinality: str = "one"
    optional: bool = False
    conforms: Concept | None = None
    #: Symbols that the value must be one of.
    one_of: tuple[str, ...] = ()

    def __post_init__(self):
        check_the(self.the)
        if self.kind != ANY and self.kind not in TAGS:
            raise QueryError("UnknownType", self.kind)
        if self.cardinality not in ("one", "many"):
            raise QueryError("UnknownCardinality", self.cardinality)
        if self.conforms is not None and self.kind not in ("Entity", ANY):
            raise QueryError("NonEntityConformance", self.the)
        if self.conforms is not None and self.optional:
            raise QueryError("OptionalConformance", self.the)


@dataclass(frozen=True)
class Concept:
    fields: tuple[tuple[str, Attribute], ...]
    name: str = field(default="", compare=False)

    @staticmethod
    def of(called: str = "", /, **fields: Attribute) -> Concept:
        return Concept(tuple(fields.items()), called)

    def __post_init__(self):
        if any(n == "this" for n, _ in self.fields):
            raise QueryError("ReservedField", "this")
        if not any(not a.optional for _, a in self.fields):
            raise QueryError("EmptyConcept", self.name)

    @property
    def attributes(self) -> dict[str, Attribute]:
        return dict(self.fields)

    @property
    def identity(self) -> str:
        """Structural: what the attributes are, whatever the fields are called."""
        own = sorted((a.the, a.kind, a.cardinality, a.optional, list(a.one_of), a.conforms.identity if a.conforms else "") for _, a in self.fields)
        return hashlib.sha256(json.dumps(own).encode()).hexdigest()[:24]

    def by_the(self) -> dict[str, str]:
        return {a.the: n for n, a in self.fields}


@dataclass(frozen=True)
class Premise:
    """What to match, and the terms of its parameters.

    ``what`` is a concept, an attribute, or the name of a constraint, formula or resolver.
    An attribute's parameters are the, of, is and cause.
    """

    what: Concept | Attribute | str
    where: tuple[tuple[str, Term], ...]

    @staticmethod
    def of(what, /, **where) -> Premise:
        return Premise(what, tuple((k.rstrip("_"), term(v)) for k, v in where.items()))

    @property
    def terms(self) -> dict[str, Term]:
        return dict(self.where)

    @property
    def variables(self) -> set[str]:
        return {t.name for _, t in self.where if isinstance(t, Var)}


@dataclass(frozen=True)
class Fold:
    apply: str
    of: Term


@dataclass(frozen=True)
class Rule:
    deduce: Concept
    when: tuple[Premise, ...]
    unless: tuple[Premise, ...] = ()
    reduce: tuple[tuple[str, Fold], ...] = ()
    #: For commit-time rules: "assert" or "retract"; None for deductive ones.
    head: str | None = None

    @property
    def folds(self) -> dict[str, Fold]:
        return dict(self.reduce)

    @property
    def id(self) -> str:
        """Of what the rule says, in whatever order its fields and terms are written."""

        def plain(x):
            if isinstance(x, Concept):
                return sorted((n, plain(a)) for n, a in x.fields)
            if isinstance(x, Attribute):
                return (x.the, x.kind, x.cardinality, x.optional, plain(x.conforms) if x.conforms else None, x.one_of)
            if isinstance(x, Premise):
                return (plain(x.what), sorted((n, repr(t)) for n, t in x.where))
            return x

        own = (plain(self.deduce), [plain(p) for p in self.when], [plain(p) for p in self.unless], sorted((n, repr(f)) for n, f in self.reduce), self.head)
        return hashlib.sha256(repr(own).encode()).hexdigest()[:24]
