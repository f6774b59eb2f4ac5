"""What a source of facts offers to the compiler."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Attribute


@dataclass(frozen=True)
class Slot:
    """The compile-time type of a column. An entity with a prefix is held as its raw key."""

    kind: str
    prefix: str | None = None

    def shown(self, c: Column) -> Column:
        return c if self.prefix is None else F.concat(F.lit(self.prefix), c.cast("string"))


@dataclass
class Relation:
    """A frame with a slot for every column that a query may use."""

    df: DataFrame
    slots: dict[str, Slot]

    def shown(self, names: list[str] | None = None) -> DataFrame:
        return self.df.select(*(self.slots[n].shown(F.col(f"`{n}`")).alias(n) for n in names or self.slots))


class Source(Protocol):
    def knows(self, the: str) -> bool: ...

    def fields(self, attributes: dict[str, Attribute]) -> list[tuple[list[str], Relation]]:
        """Rows (this, field...) of attributes that can be read together, by field names."""
        ...

    def facts(self) -> DataFrame:
        """Every fact in the narrow layout (the, of, payload columns, cause)."""
        ...

    def any_attribute(self) -> Relation:
        """Every fact as (the, of, is, cause)."""
        ...


class Importer(Protocol):
    """Where facts come from."""

    def read(self, spark: SparkSession) -> DataFrame:
        """Facts in the narrow layout."""
        ...


class Exporter(Protocol):
    """Where facts go to."""

    def write(self, facts: DataFrame) -> None:
        """All facts, or none if it fails."""
        ...


@dataclass(frozen=True)
class ParquetFacts:
    """Importer and exporter of a folder of Parquet files."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def write(self, facts: DataFrame) -> None:
        facts.write.mode("overwrite").parquet(self.path)
