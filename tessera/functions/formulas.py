"""Scalar formulas. An absent or ill-typed input, or a result that doesn't exist, drops the row."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import position
from tessera.model import ANY, KINDS, NUMERIC, PAYLOAD, QueryError
from tessera.sources.base import Slot

INT = "decimal(38,0)"


@dataclass(frozen=True)
class Formula:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    #: (columns, kinds, constants) -> output columns and kinds; a null output drops the row.
    run: Callable[[dict[str, Column], dict[str, str], dict[str, object]], dict[str, tuple[Column, str]]]
    #: Whether there may be any number of rows: ``run`` then gives an array of structs of the
    #: outputs, and the outputs' kinds.
    many: bool = False


def _no_row() -> Column:
    return F.lit(None)


def _math(second: str, ints: Callable[[Column, Column], Column], floats: Callable[[Column, Column], Column], unsigned: bool = False):
    def run(c, kinds, constants):
        a, b = kinds["of"], kinds[second]
        x, y = c["of"], c[second]
        # A constant takes the other side's type if it can without loss.
        for name, other in (("of", b), (second, a)):
            if name in constants and kinds[name] != other:
                v = constants[name]
                if isinstance(v, bool) or not isinstance(v, int | float):
                    return {"is": (_no_row().cast(INT), "SignedInteger")}
                if other == "Float" and float(v) == v:
                    v = F.lit(float(v))
                elif other in ("UnsignedInteger", "SignedInteger") and int(v) == v and (v >= 0 or other == "SignedInteger"):
                    v = F.lit(int(v))
                else:
                    return {"is": (_no_row().cast("double"), "Float")}
                if name == "of":
                    x, a = v, other
                else:
                    y, b = v, other
        if "Integer" in (a, b):
            a, b = (k if k != "Integer" else "SignedInteger" for k in (a, b))
        if a != b or a not in NUMERIC:
            return {"is": (_no_row().cast(INT), "SignedInteger")}
        if a == "Float":
            return {"is": (floats(x, y), "Float")}
        out = ints(x.cast(INT), y.cast(INT))
        if unsigned and a == "UnsignedInteger":
            out = F.when(out >= 0, out)
        return {"is": (out.cast(INT), a)}

    return Formula(("of", second), ("is",), run)


def _int_quotient(x: Column, y: Column) -> Column:
    """Towards zero. Through longs where they do: decimal division keeps 32 digits only."""
    small = (F.abs(x) < 2**62) & (F.abs(y) < 2**62)
    whole = F.when(small & (y != 0), F.expr("1")).isNotNull()
    by_long = F.when(whole, F.floor(F.try_divide(F.abs(x).cast("decimal(19,0)"), F.abs(y).cast("decimal(19,0)"))) * F.signum(x.cast("double") * F.signum(y.cast("double"))).cast("int"))
    return F.coalesce(by_long.cast(INT), F.try_divide(x - F.try_mod(x, y), y).cast(INT))


def _float_quotient(x: Column, y: Column) -> Column:
    zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when((x > 0) == (y.cast("string") == "0.0"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def _float_mod(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y))


def _typed(inputs: dict[str, tuple[str, ...]], out: str, f: Callable[..., Column]) -> Formula:
    def run(c, kinds, constants):
        ok = all(kinds[n] in ks for n, ks in inputs.items())
        return {"is": (f(*(c[n] for n in inputs)) if ok else _no_row().cast({"Boolean": "boolean", "UnsignedInteger": INT}.get(out, "string")), out)}

    return Formula(tuple(inputs), ("is",), run)


def glob(pattern: str) -> str:
    """A regular expression of a glob: * any run, ? one character, backslash takes the next as it is."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "".join(out) + "$"


@F.pandas_udf(T.BooleanType())
def _glob_match(text: pd.Series, pattern: pd.Series) -> pd.Series:
    known: dict[str, re.Pattern] = {}
    return pd.Series([None if t is None or p is None else bool(known.setdefault(p, re.compile(glob(p)[:-1] + r"\Z")).match(t)) for t, p in zip(text, pattern, strict=True)])


def _like(c, kinds, constants):
    if kinds["text"] != "Text" or kinds["pattern"] != "Text":
        return {"is": (_no_row().cast("string"), "Text")}
    if "pattern" in constants:
        hit = c["text"].rlike(glob(constants["pattern"])[:-1] + r"\z")
    else:
        hit = _glob_match(c["text"], c["pattern"])
    return {"is": (F.when(hit, c["text"]), "Text")}


def float_text(x: Column) -> Column:
    """Shortest digits without an exponent; whole floats without a point."""
    s = x.cast("string")
    whole = s.try_cast(INT).cast("string")
    broken = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", "")
    plain = F.when(s.contains("E"), F.when(x == F.rint(x), whole).otherwise(broken)).otherwise(F.regexp_replace(s, r"\.0$", ""))
    return F.when(F.isnan(x), "NaN").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(s == "-0.0", "-0").otherwise(F.coalesce(plain, s))


def text_of(c: Column, kind: str) -> Column:
    if kind == "Float":
        return float_text(c)
    if kind in ("Bytes", "Record"):
        return F.concat(F.lit(f"{kind}("), F.octet_length(c).cast("string"), F.lit(" bytes)"))
    if kind == ANY:
        out = F.lit(None).cast("string")
        for tag, k in KINDS.items():
            out = F.when(c["vt"] == tag, text_of(c[PAYLOAD[k]], k)).otherwise(out)
        return out
    return c.cast("string")


def _parse(rule: str, to: str, kind: str):
    def run(c, kinds, constants):
        if kinds["text"] != "Text":
            return {"is": (_no_row().cast(to), kind)}
        t = F.trim(c["text"])
        return {"is": (F.when(t.rlike(rule), F.regexp_replace(t, r"^\+", "").try_cast(to)), kind)}

    return Formula(("text",), ("is",), run)


def _parse_float(c, kinds, constants):
    if kinds["text"] != "Text":
        return {"is": (_no_row().cast("double"), "Float")}
    t = F.trim(c["text"])
    plain = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    named = F.when(t.rlike(r"(?i)^\+?(inf|infinity)$"), F.lit(float("inf"))).when(t.rlike(r"(?i)^-(inf|infinity)$"), F.lit(float("-inf"))).when(t.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
    return {"is": (F.coalesce(plain, named), "Float")}


@F.pandas_udf(T.StringType())
def _insert(member: pd.Series, after: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([None if None in x else position.insert(*x) for x in zip(member, after, before, strict=True)])


def _position(c, kinds, constants):
    return {"is": (_insert(c["member"].cast("string"), c["after"], c["before"]), "Text")}


def _parts(c, kinds, constants):
    name = F.substring_index(c["of"], "/", -1)
    ok = name.rlike(r"^[A-Z][0-9A-Za-z]*$") & ~name.rlike(r"^.+0$")
    return {"namespace": (F.when(ok, F.substring_index(c["of"], "/", 1)), "Text"), "position": (F.when(ok, name), "Text")}


_KEY = ("attribute", "entity", "vtype", "value")
_PART = {"at": "UnsignedInteger", "kind": "Text", "text": "Text", "bytes": "Bytes"}


def _part(at: Column, kind: Column, text: Column) -> Column:
    return F.struct(at.cast(INT).alias("at"), kind.alias("kind"), text.alias("text"), F.encode(text, "UTF-8").alias("bytes"))


def _key_parts(c, kinds, constants):
    """A row a component of a whole key; one ``opaque`` row if it isn't one."""
    text = F.decode(c["of"], "UTF-8")
    parts = F.split(text, "\x1f", len(_KEY))
    own = F.transform(parts, lambda x, i: _part(i, F.element_at(F.array(*map(F.lit, _KEY)), i + 1), x))
    if kinds["of"] != "Bytes":
        return F.array(_part(F.lit(0), F.lit("opaque"), F.lit(None).cast("string"))), _PART
    whole = F.size(parts) == len(_KEY)
    return F.when(whole, own).when(F.octet_length(c["of"]) > 0, F.array(_part(F.lit(0), F.lit("opaque"), text))), _PART


def _separator_parts(c, kinds, constants):
    """What a separator, the beginning of a key, tells; ``min`` for an open bound."""
    text = F.decode(c["of"].cast("binary"), "UTF-8")
    kind = F.when(F.octet_length(c["of"]) > 0, "prefix").otherwise("min")
    return F.array(_part(F.lit(0), kind, text)), _PART


TEXT, BOOL = ("Text",), ("Boolean",)
FORMULAS: dict[str, Formula] = {
    "math/sum": _math("with", F.try_add, lambda a, b: a + b),
    "math/difference": _math("subtract", F.try_subtract, lambda a, b: a - b, unsigned=True),
    "math/product": _math("times", F.try_multiply, lambda a, b: a * b),
    "math/quotient": _math("by", _int_quotient, _float_quotient),
    "math/modulo": _math("by", F.try_mod, _float_mod),
    "text/concatenate": _typed({"first": TEXT, "second": TEXT}, "Text", F.concat),
    "text/length": _typed({"of": TEXT}, "UnsignedInteger", lambda x: F.octet_length(x).cast(INT)),
    "text/upper-case": _typed({"of": TEXT}, "Text", F.upper),
    "text/lower-case": _typed({"of": TEXT}, "Text", F.lower),
    "text/like": Formula(("text", "pattern"), ("is",), _like),
    "boolean/and": _typed({"left": BOOL, "right": BOOL}, "Boolean", lambda a, b: a & b),
    "boolean/or": _typed({"left": BOOL, "right": BOOL}, "Boolean", lambda a, b: a | b),
    "boolean/not": _typed({"value": BOOL}, "Boolean", lambda a: ~a),
    "text/from": Formula(("value",), ("is",), lambda c, kinds, _: {"is": (text_of(c["value"], kinds["value"]), "Text")}),
    "unsigned-integer/parse": _parse(r"^\+?[0-9]+$", INT, "UnsignedInteger"),
    "signed-integer/parse": _parse(r"^[+-]?[0-9]+$", INT, "SignedInteger"),
    "float/parse": Formula(("text",), ("is",), _parse_float),
    "order/position": Formula(("member", "after", "before"), ("is",), _position),
    "order/position-parts": Formula(("of",), ("namespace", "position"), _parts),
    "order/key-part": Formula(("of",), tuple(_PART), _key_parts, many=True),
    "order/separator-part": Formula(("of",), tuple(_PART), _separator_parts, many=True),
}


#: Namespaces under which the engine's own premises on order and revisions are found.
NAMESPACES = {"order", "history"}


def use_namespace(name: str) -> None:
    """Have the premises on order and revisions found under another namespace too."""
    NAMESPACES.add(name)


def own_name(what: str) -> str | None:
    """The part after the slash, if the namespace is one of the engine's own."""
    space, _, part = what.partition("/")
    return part if space in NAMESPACES else None


def formula(name: str) -> Formula:
    """By its whole name, or by the part after a namespace of the engine's own."""
    found = FORMULAS.get(name) or FORMULAS.get(f"order/{own_name(name)}")
    if found is None:
        raise QueryError("UnknownFormula", name)
    return found


def register(name: str, inputs: tuple[str, ...], outputs: tuple[str, ...], run, many: bool = False) -> None:
    """Add a formula of one's own: ``run`` and ``many`` as in ``Formula``."""
    FORMULAS[name] = Formula(inputs, outputs, run, many)


__all__ = ["FORMULAS", "Formula", "Slot", "formula", "register"]
