"""The six folds, grouped by the head fields that aren't reduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import ANY, COMPARABLE, IDENTITY, NUMERIC, TAGS, VALUE, QueryError

FOLDS = ("count", "count-distinct", "sum", "min", "max", "avg")
INT = "decimal(38,0)"


def identity(c: Column, kind: str) -> Column:
    """What grouping, distinct counts and recursion take a value to be."""
    if kind != ANY:
        return c.cast("string") if kind == "Float" else c
    cls = F.lit(None).cast("int")
    for tag, k in IDENTITY.items():
        cls = F.when(c["vt"] == tag, F.lit(k)).otherwise(cls)
    return F.when(c.isNotNull(), F.struct(cls.alias("k"), c["vs"].alias("s"), c["vn"].alias("n"), c["vf"].cast("string").alias("f"), c["vb"].alias("b"), c["vbool"].alias("o")))


def check(apply: str, kind: str) -> None:
    if apply not in FOLDS:
        raise QueryError("ReduceInput", apply)
    if apply in ("sum", "avg") and kind not in (*NUMERIC, ANY):
        raise QueryError("ReduceInput", f"{apply} of {kind}")
    if apply in ("min", "max") and kind not in (*COMPARABLE, ANY):
        raise QueryError("ReduceInput", f"{apply} of {kind}")


def _value(tag: Column, **payload: Column) -> Column:
    """A tagged value of a computed type."""
    parts = payload | {"vt": tag}
    return F.struct(*(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE))


def output_kind(apply: str, kind: str) -> str:
    return {"count": "UnsignedInteger", "count-distinct": "UnsignedInteger", "avg": "Float"}.get(apply, kind)


def fold(apply: str, c: Column, kind: str) -> Column:
    check(apply, kind)
    if apply == "count":
        return F.count(c)
    if apply == "count-distinct":
        return F.countDistinct(F.when(c.isNotNull(), F.struct(identity(c, kind))))
    if apply == "avg":
        return F.avg(F.coalesce(c["vn"].cast("double"), c["vf"]) if kind == ANY else c.cast("double"))
    if apply == "sum":
        if kind == "Float":
            return F.coalesce(F.sum(c), F.lit(0.0))
        if kind != ANY:
            return F.coalesce(F.sum(c.cast(INT)), F.lit(0).cast(INT))
        mixed = (F.count(c["vn"]) > 0) & (F.count(c["vf"]) > 0)
        whole = F.coalesce(F.sum(c["vn"]), F.lit(0).cast(INT)).cast(INT)
        kind = F.when(F.count(c["vf"]) > 0, F.lit(TAGS["Float"])).when(whole < 0, F.lit(TAGS["SignedInteger"])).otherwise(F.lit(TAGS["UnsignedInteger"]))
        own = _value(kind, vn=F.when(F.count(c["vf"]) == 0, whole), vf=F.sum(c["vf"]))
        return F.when(mixed, F.raise_error(F.lit("sum of integers and floats in one group")).cast(VALUE)).otherwise(own)
    best = F.min if apply == "min" else F.max
    if kind == "Float":
        odd = (F.count(c) > 1) & F.coalesce(F.max(F.isnan(c)), F.lit(False))
        return F.when(odd, F.raise_error(F.lit(f"{apply} over NaN")).cast("double")).otherwise(best(c))
    if kind == ANY:
        odd = (F.count(c) > 1) & ((F.min(c["vt"]) != F.max(c["vt"])) | F.coalesce(F.max(F.isnan(c["vf"])), F.lit(False)))
        own = _value(F.min(c["vt"]), vs=best(c["vs"]), vn=best(c["vn"]), vf=best(c["vf"]), vb=best(c["vb"]))
        return F.when(odd, F.raise_error(F.lit(f"{apply} over values that can't be ordered")).cast(VALUE)).otherwise(F.when(F.count(c) > 0, own))
    return best(c)


def reduced(df: DataFrame, keys: dict[str, tuple[Column, str]], folds: dict[str, Column]) -> DataFrame:
    """A row a group. Absent keys group together; no rows make no groups, even without keys."""
    names = list(keys)
    by = [identity(c, k).alias(f"_k{i}") for i, (c, k) in enumerate(keys.values())]
    any_key = any(k == ANY for _, k in keys.values())
    if not names:
        return df.groupBy(F.lit(1).alias("_one")).agg(*(c.alias(n) for n, c in folds.items())).drop("_one")
    if not any_key:
        return df.groupBy(*(c.alias(n) for n, (c, _) in keys.items())).agg(*(c.alias(n) for n, c in folds.items()))
    firsts = [F.min(c).alias(n) for n, (c, _) in keys.items()]
    return df.groupBy(*by).agg(*firsts, *(c.alias(n) for n, c in folds.items())).drop(*(f"_k{i}" for i in range(len(by))))
