"""Constraints: predicates and equality over bound columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import ANY, COMPARABLE, KINDS, NUMERIC, PAYLOAD, TAGS, TEXTUAL, Const, QueryError
from tessera.sources.base import Slot

CONSTRAINTS = ("==", "coalesce", "type", "starts-with", "<", "<=", ">", ">=")
INTS = ("UnsignedInteger", "SignedInteger")
#: What a kind word covers.
TYPES = {"text": ("Text",), "textual": TEXTUAL, "number": NUMERIC, "entity": ("Entity",), "symbol": ("Symbol",), "boolean": ("Boolean",), "bytes": ("Bytes",)}


def literal(c: Const) -> tuple[Column, str]:
    if c.kind == "Integer":
        return F.lit(c.value), "SignedInteger"
    return F.lit(c.value), c.kind


def _bits(c: Column) -> Column:
    """Tells -0.0 from 0.0."""
    return c.cast("string")


def equal(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Variant-sensitive equality of two present values; floats by their bits."""
    if ka == ANY and kb == ANY:
        return (a["vt"] == b["vt"]) & (a == b) & F.coalesce(_bits(a["vf"]) == _bits(b["vf"]), F.lit(True))
    if ka == ANY or kb == ANY:
        a, b, k = (a, b, kb) if ka == ANY else (b, a, ka)
        return (a["vt"] == TAGS[k]) & equal(a[PAYLOAD[k]], k, b, k)
    if ka == kb or {ka, kb} == set(INTS):
        return (a == b) & (_bits(a) == _bits(b)) if ka == "Float" else a == b
    return F.lit(False)


def adapted(c: Const, kind: str) -> Column | None:
    """The constant as a value of ``kind``, if that loses nothing."""
    v = c.value
    if kind == ANY:
        return None
    if c.kind in ("Integer", *NUMERIC) and not isinstance(v, bool):
        if kind == "Float":
            return F.lit(float(v)) if float(v) == v else None
        if kind in INTS:
            return F.lit(int(v)) if v == v and abs(v) != float("inf") and int(v) == v and (v >= 0 or kind == "SignedInteger") else None
        return None
    if c.kind == kind or (c.kind == "Text" and kind in ("Symbol",)):
        return F.lit(v)
    return None


_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def compare(op: str, a: Column | Const, ka: str, b: Column | Const, kb: str) -> Column:
    """Never an error: what can't be ordered doesn't match."""
    def one(x: Column, y: Column, kind: str) -> Column:
        out = _OPS[op](x, y)
        return out & ~F.isnan(x) & ~F.isnan(y) if kind == "Float" else out

    if isinstance(a, Const) and isinstance(b, Const):
        a, ka = literal(a)
    if isinstance(a, Const) or isinstance(b, Const):
        col, kind, const = (b, kb, a) if isinstance(a, Const) else (a, ka, b)
        if kind == ANY:
            out = F.lit(False)
            for k in COMPARABLE:
                lit = adapted(const, k)
                if lit is not None:
                    x = col[PAYLOAD[k]]
                    out = out | ((col["vt"] == TAGS[k]) & F.coalesce(one(lit, x, k) if isinstance(a, Const) else one(x, lit, k), F.lit(False)))
            return out
        lit = adapted(const, kind)
        if lit is None or kind not in COMPARABLE:
            return F.lit(False)
        return one(lit, col, kind) if isinstance(a, Const) else one(col, lit, kind)
    if ANY in (ka, kb):
        out = F.lit(False)
        for k in COMPARABLE:
            mine = [x if kx != ANY else x[PAYLOAD[k]] for x, kx in ((a, ka), (b, kb)) if kx in (ANY, k)]
            if len(mine) == 2:
                there = F.lit(True)
                for x, kx in ((a, ka), (b, kb)):
                    if kx == ANY:
                        there = there & (x["vt"] == TAGS[k])
                out = out | (there & F.coalesce(one(mine[0], mine[1], k), F.lit(False)))
        return out
    if ka not in COMPARABLE or (ka != kb and {ka, kb} != set(INTS)):
        return F.lit(False)
    return one(a, b, ka)


def starts_with(c: Column, kind: str, prefix: Column | str) -> Column:
    if kind == ANY:
        return c["vt"].isin(*(TAGS[k] for k in TEXTUAL)) & c["vs"].startswith(prefix)
    return c.startswith(prefix) if kind in TEXTUAL else F.lit(False)


def type_of(c: Column, kind: str, wanted: str) -> Column:
    """Membership in a kind word or a type; an absent value passes only for 'nothing' kinds."""
    optional = wanted.endswith("?")
    kinds = TYPES.get(wanted.rstrip("?")) or ((wanted.rstrip("?"),) if wanted.rstrip("?") in TAGS else None)
    if kinds is None:
        raise QueryError("UnknownType", wanted)
    if kind == ANY:
        hit = c["vt"].isin(*(TAGS[k] for k in kinds))
    else:
        hit = F.lit(kind in kinds)
    return F.when(c.isNull(), F.lit(optional)).otherwise(hit)


def shown(slot: Slot, c: Column) -> Column:
    return slot.shown(c)


__all__ = ["CONSTRAINTS", "KINDS", "adapted", "compare", "equal", "literal", "shown", "starts_with", "type_of"]
