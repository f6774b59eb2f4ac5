"""Facts in the narrow layout, with elections, selectors, overlays and unions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import ANY, KINDS, PAYLOAD, TAGS, VALUE, Attribute, Const, QueryError, check_the
from tessera.sources.base import Relation, Slot

SCHEMA = T.StructType([T.StructField("the", T.StringType()), T.StructField("of", T.StringType()), *VALUE.fields, T.StructField("cause", T.BinaryType())])
#: What makes two facts the same but for their cause.
FACT = ["the", "of", "vt", "vs", "vn", "vf", "vb", "vbool"]
LIMIT = 10**38 - 1


def value(v, kind: str | None = None) -> tuple:
    """Payload columns (vt, vs, vn, vf, vb, vbool) of a Python value."""
    if kind is None:
        kind = "Boolean" if isinstance(v, bool) else ("UnsignedInteger" if v >= 0 else "SignedInteger") if isinstance(v, int) else "Float" if isinstance(v, float) else "Bytes" if isinstance(v, bytes | bytearray) else "Text"
    out = dict.fromkeys(("vt", "vs", "vn", "vf", "vb", "vbool"))
    out["vt"] = TAGS[kind]
    slot = PAYLOAD[kind]
    if slot == "vn":
        if abs(int(v)) > LIMIT or (kind == "UnsignedInteger" and v < 0):
            raise QueryError("ValueRange", str(v))
        v = Decimal(int(v))
    out[slot] = bytes(v) if slot == "vb" else float(v) if slot == "vf" else v
    return tuple(out.values())


def facts(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A frame of (the, of, is[, kind[, cause]]) rows."""
    out = []
    for row in rows:
        the, of, v, kind, cause = (*row, *(None,) * (5 - len(row)))
        out.append((check_the(the), of, *value(v, kind), cause))
    return spark.createDataFrame(out, SCHEMA)


def packed() -> Column:
    return F.struct(*(F.col(f.name) for f in VALUE))


def fact_hash() -> Column:
    """Orders facts that a cause can't: a hash of all that makes the fact."""
    bits = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("the", "of", "vt", "vs", "vn", "vf", "vbool")]
    return F.sha2(F.concat_ws("\x1f", *bits, F.coalesce(F.hex("vb"), F.lit(""))), 256)


def elect(df: DataFrame) -> DataFrame:
    """One fact for each (the, of): caused before uncaused, the higher cause, then the higher hash.

    A maximum of structs, so it is aggregated before the shuffle.
    """
    rank = F.struct(F.col("cause").isNotNull().alias("c"), F.hex("cause").alias("x"), fact_hash().alias("h"))
    best = F.max_by(F.struct(*(F.col(c) for c in (*FACT[2:], "cause"))), rank).alias("w")
    return df.groupBy("the", "of").agg(best).select("the", "of", "w.*")


def select(
    df: DataFrame,
    the: str | None = None,
    of: str | None = None,
    is_: Const | None = None,
    domain: str | None = None,
    the_prefix: str | None = None,
    name: str | None = None,
    name_shape: str | None = None,
    of_prefix: str | None = None,
    is_prefix: str | None = None,
    at_least=None,
    above=None,
    at_most=None,
    below=None,
) -> DataFrame:
    """Facts by selector. At least one of the, of, is, a prefix or a bound must be given.

    Plain comparisons of columns, so they reach the scan. Bounds are typed constants or
    Python values and hold within one type.
    """
    given = (the, of, is_, domain, the_prefix, of_prefix, is_prefix, at_least, above, at_most, below)
    if all(x is None for x in given):
        raise QueryError("EmptySelector")
    where = []
    if the is not None:
        where.append(F.col("the") == the)
    if domain is not None:
        where.append(F.col("the").startswith(f"{domain}/"))
    if the_prefix is not None:
        where.append(F.col("the").startswith(the_prefix))
    if name is not None:
        where.append(F.substring_index("the", "/", -1) == name)
    if name_shape is not None:
        where.append(F.substring_index("the", "/", -1).rlike({"position": "^[A-Z]", "symbol": "^[a-z]"}[name_shape]))
    if of is not None:
        where.append(F.col("of") == of)
    if of_prefix is not None:
        where.append(F.col("of").startswith(of_prefix))
    if is_prefix is not None:
        where.append((F.col("vt") == TAGS["Text"]) & F.col("vs").startswith(is_prefix))
    ops = (("__eq__", is_), ("__ge__", at_least), ("__gt__", above), ("__le__", at_most), ("__lt__", below))
    for op, bound in ops:
        if bound is not None:
            kind = bound.kind if isinstance(bound, Const) and bound.kind != "Integer" else None
            own = value(bound.value if isinstance(bound, Const) else bound, kind)
            slot = PAYLOAD[KINDS[own[0]]]
            where.append((F.col("vt") == own[0]) & getattr(F.col(slot), op)(F.lit(own[VALUE.names.index(slot)])))
    for w in where:
        df = df.where(w)
    return df


def union(*parts: DataFrame) -> DataFrame:
    """All facts of several sources; one that is the same in several, cause included, once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([*FACT, "cause"]) if len(parts) > 1 else out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def without(df: DataFrame, gone: DataFrame, keys: list[str] = FACT) -> DataFrame:
    """Facts of ``df`` that ``gone`` doesn't name."""
    gone = gone.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(gone, on, "left_anti")


def overlaid(df: DataFrame, asserted: DataFrame, retracted: DataFrame) -> DataFrame:
    """Retractions hide facts of the source only; what the overlay asserts is there."""
    return union(without(df, retracted), asserted)


@dataclass
class NarrowFacts:
    df: DataFrame
    #: Whether (the, of) is known to be unique, so that elections can be left out.
    elected: bool = False

    def knows(self, the: str) -> bool:
        return True

    def facts(self) -> DataFrame:
        return self.df.select(*SCHEMA.names)

    def scan(self, a: Attribute, kind_filter: bool = True, elect_first: bool = True) -> DataFrame:
        """Facts of an attribute. One winner an entity if the cardinality is one: elected
        among all types, and only then filtered by type, so a loser never matches."""
        own = select(self.df, the=a.the)
        if a.cardinality == "one" and not self.elected and elect_first:
            own = elect(own)
        if kind_filter and a.kind != ANY:
            own = own.where(F.col("vt") == TAGS[a.kind])
        if a.one_of:
            own = own.where(F.col("vs").isin(*a.one_of))
        return own

    def fields(self, attributes: dict[str, Attribute]) -> list[tuple[list[str], Relation]]:
        ones = {n: a for n, a in attributes.items() if a.cardinality == "one" and not a.one_of}
        out = []
        if len(ones) > 1 and len({a.the for a in ones.values()}) == len(ones):
            out.append((list(ones), self._together(ones)))
        else:
            ones = {}
        for n, a in attributes.items():
            if n not in ones:
                v = packed() if a.kind == ANY else F.col(PAYLOAD[a.kind])
                rel = Relation(self.scan(a).select(F.col("of").alias("this"), v.alias(n)), {"this": Slot("Entity"), n: Slot(a.kind)})
                out.append(([n], rel))
        return out

    def _together(self, ones: dict[str, Attribute]) -> Relation:
        """All single-valued fields in one aggregation by entity, instead of a join for each."""
        rank = F.struct(F.col("cause").isNotNull().alias("c"), F.hex("cause").alias("x"), fact_hash().alias("h"))
        won = [F.max_by(packed(), F.when(F.col("the") == a.the, rank)).alias(n) for n, a in ones.items()]
        held = [F.max(F.col("the") == a.the).alias(f"_{n}") for n, a in ones.items()]
        df = self.df.where(F.col("the").isin(*(a.the for a in ones.values()))).groupBy(F.col("of").alias("this")).agg(*won, *held)
        columns, slots = [F.col("this")], {"this": Slot("Entity")}
        for n, a in ones.items():
            fits = F.col(f"_{n}") & (F.lit(True) if a.kind == ANY else F.col(n)["vt"] == TAGS[a.kind])
            if not a.optional:
                df = df.where(fits)
            v = F.col(n) if a.kind == ANY else F.col(n)[PAYLOAD[a.kind]]
            columns.append(F.when(fits, v).alias(n))
            slots[n] = Slot(a.kind)
        return Relation(df.select(*columns), slots)

    def any_attribute(self) -> Relation:
        out = self.df.select("the", "of", packed().alias("is"), "cause")
        return Relation(out, {"the": Slot("Symbol"), "of": Slot("Entity"), "is": Slot(ANY), "cause": Slot("Bytes")})


@dataclass
class Many:
    """Several sources as one: the facts of all, each once, elected among all."""

    parts: list

    def knows(self, the: str) -> bool:
        return any(p.knows(the) for p in self.parts)

    def _of(self, parts: list) -> NarrowFacts:
        return NarrowFacts(union(*(p.facts() for p in parts)))

    def fields(self, attributes: dict[str, Attribute]) -> list[tuple[list[str], Relation]]:
        """An attribute that one source knows is read there; one that several know from their union."""
        groups: dict[tuple[int, ...], dict[str, Attribute]] = {}
        for n, a in attributes.items():
            who = tuple(i for i, p in enumerate(self.parts) if p.knows(a.the))
            if not who:
                raise QueryError("UnknownAttribute", a.the)
            groups.setdefault(who, {})[n] = a
        out = []
        for who, own in groups.items():
            parts = [self.parts[i] for i in who]
            out += (parts[0] if len(parts) == 1 else self._of(parts)).fields(own)
        return out

    def facts(self) -> DataFrame:
        return self._of(self.parts).df

    def any_attribute(self) -> Relation:
        return self._of(self.parts).any_attribute()
