"""Relational tables seen as facts: a column an attribute, a row an entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import ANY, PAYLOAD, TAGS, VALUE, Attribute, QueryError
from tessera.sources.base import Relation, Slot


def kind_of(spark_type: str) -> str:
    if spark_type in ("tinyint", "smallint", "int", "bigint") or spark_type.startswith("decimal"):
        return "SignedInteger"
    if spark_type in ("float", "double"):
        return "Float"
    return {"boolean": "Boolean", "binary": "Bytes"}.get(spark_type, "Text")


@dataclass
class WideTable:
    """``key`` names an entity ``prefix`` + key; ``attributes`` maps the to a column.

    ``entities`` maps an attribute to the prefix of the entities that it refers to. Without
    a key each row is an entity of its own that nothing can refer to: rows stay a bag.
    """

    df: DataFrame
    prefix: str
    key: str | None
    attributes: dict[str, str]
    entities: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def knows(self, the: str) -> bool:
        return the in self.attributes

    def kind(self, the: str) -> str:
        if the in self.entities:
            return "Entity"
        return self.kinds.get(the) or kind_of(dict(self.df.dtypes)[self.attributes[the]])

    def _entity(self):
        return F.col(self.key) if self.key else F.lit(None).cast("string")

    def fields(self, attributes: dict[str, Attribute]) -> list[tuple[list[str], Relation]]:
        """One projection of the table: Catalyst prunes it to the columns in use."""
        columns, slots, where = [self._entity().alias("this")], {"this": Slot("Entity", self.prefix)}, []
        for name, a in attributes.items():
            own = self.kind(a.the)
            want = own if a.kind == ANY else a.kind
            c = F.col(self.attributes[a.the])
            if want != own and not ({want, own} == {"UnsignedInteger", "SignedInteger"}) and not ({want, own} <= {"Text", "Symbol"}):
                c = F.lit(None).cast("string")  # no fact of the asked type
                where.append(F.lit(bool(a.optional)))
            elif a.one_of:
                c = F.when(c.isin(*a.one_of), c)
                where.append(c.isNotNull() | F.lit(bool(a.optional)))
            elif not a.optional:
                where.append(c.isNotNull())
            if want == "UnsignedInteger" and own == "SignedInteger":
                where.append((c >= 0) | (c.isNull() if a.optional else F.lit(False)))
            columns.append(c.alias(name))
            slots[name] = Slot(want, self.entities.get(a.the))
        df = self.df
        if self.key:
            df = df.where(F.col(self.key).isNotNull())
        for w in where:
            df = df.where(w)
        return [(list(attributes), Relation(df.select(*columns), slots))]

    def facts(self) -> DataFrame:
        """Every value as a fact in the narrow layout: a union of one projection an attribute.

        A filter on ``the`` leaves out the other attributes' branches when the plan is made,
        and a branch reads its own column and the key.
        """
        if not self.key:
            raise QueryError("RowIdentity", f"rows of {self.prefix.rstrip(':')} have no key that names an entity")
        of = Slot("Entity", self.prefix).shown(F.col(self.key))
        out = None
        for the, column in self.attributes.items():
            kind, c = self.kind(the), F.col(column)
            payload = {f.name: F.lit(None).cast(f.dataType) for f in VALUE}
            payload["vt"] = F.lit(TAGS[kind]).cast("byte")
            slot = PAYLOAD[kind]
            payload[slot] = Slot(kind, self.entities.get(the)).shown(c).cast(VALUE[slot].dataType)
            own = self.df.where(F.col(self.key).isNotNull() & c.isNotNull())
            own = own.select(F.lit(the).alias("the"), of.alias("of"), *(payload[f.name].alias(f.name) for f in VALUE), F.lit(None).cast("binary").alias("cause"))
            out = own if out is None else out.unionByName(own)
        return out

    def any_attribute(self) -> Relation:
        out = self.facts().select("the", "of", F.struct(*(f.name for f in VALUE)).alias("is"), "cause")
        return Relation(out, {"the": Slot("Symbol"), "of": Slot("Entity"), "is": Slot(ANY), "cause": Slot("Bytes")})


def simple(df: DataFrame, name: str, key: str | None, strip: str, entities: dict[str, str] | None = None) -> WideTable:
    """``name``/column-without-``strip`` for every column; ``entities`` by those short names."""
    short = {c.removeprefix(strip): c for c in df.columns}
    fix = lambda s: s.replace("_", "-")
    attributes = {f"{name}/{fix(s)}": c for s, c in short.items()}
    return WideTable(df, f"{name}:", key, attributes, {f"{name}/{fix(s)}": p for s, p in (entities or {}).items()})
