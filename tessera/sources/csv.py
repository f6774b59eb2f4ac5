"""Facts as CSV (the, of, as, is, cause), and transaction logs (txn, at, the, of, as, is)."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.formulas import float_text
from tessera.model import TAGS

#: The type column's words by type: fixed values.
WORDS = {"bytes": "Bytes", "entity": "Entity", "boolean": "Boolean", "text": "Text", "natural": "UnsignedInteger", "integer": "SignedInteger", "float": "Float", "record": "Record", "attribute": "Symbol"}
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def to_base58(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def from_base58(text: str | None) -> bytes | None:
    if text is None:
        return None
    n = 0
    for c in text:
        i = ALPHABET.find(c)
        if i < 0:
            return None
        n = n * 58 + i
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return b"\0" * (len(text) - len(text.lstrip("1"))) + body


@F.pandas_udf(T.StringType())
def _encode(x: pd.Series) -> pd.Series:
    return x.map(lambda v: to_base58(v), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _decode(x: pd.Series) -> pd.Series:
    return x.map(lambda v: from_base58(v), na_action="ignore")


def typed(df: DataFrame) -> DataFrame:
    """Columns as and is to payload columns; rows whose value doesn't parse are dropped."""
    kind, v = F.col("as"), F.col("is")
    tag = F.lit(None).cast("byte")
    for word, k in WORDS.items():
        tag = F.when(kind == word, F.lit(TAGS[k]).cast("byte")).otherwise(tag)
    whole = F.when(kind.isin("natural", "integer") & v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("decimal(38,0)"))
    out = df.withColumns(
        {
            "vt": tag,
            "vs": F.when(kind.isin("entity", "text", "attribute"), F.coalesce(v, F.lit(""))),
            "vn": F.when((kind == "integer") | (whole >= 0), whole),
            "vf": F.when(kind == "float", F.when(F.lower(v) == "inf", F.lit(float("inf"))).when(F.lower(v) == "-inf", F.lit(float("-inf"))).otherwise(v.try_cast("double"))),
            "vb": F.when(kind.isin("bytes", "record"), _decode(F.coalesce(v, F.lit("")))),
            "vbool": F.when(kind == "boolean", v.try_cast("boolean")),
        }
    )
    return out.where(F.col("vt").isNotNull() & F.coalesce(*(F.col(c).cast("string") for c in ("vs", "vn", "vf", "vbool")), F.hex("vb")).isNotNull())


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="the string, of string, as string, is string, cause string")
    out = typed(raw).withColumn("cause", _decode("cause"))
    return out.select("the", "of", "vt", "vs", "vn", "vf", "vb", "vbool", "cause")


def write_facts(facts: DataFrame, path: str) -> None:
    word = F.lit(None).cast("string")
    for w, k in WORDS.items():
        word = F.when(F.col("vt") == TAGS[k], w).otherwise(word)
    shown = F.coalesce("vs", F.col("vn").cast("string"), F.when(F.col("vt") == TAGS["Float"], float_text(F.col("vf"))), F.col("vbool").cast("string"), F.when(F.col("vt").isin(TAGS["Bytes"], TAGS["Record"]), _encode("vb")))
    out = facts.select("the", "of", word.alias("as"), shown.alias("is"), _encode("cause").alias("cause"))
    out.write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="")


@dataclass(frozen=True)
class CsvFacts:
    """Importer and exporter of a folder or file of CSV facts."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return read_facts(spark, self.path)

    def write(self, facts: DataFrame) -> None:
        write_facts(facts, self.path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A transaction log: facts with the number and time of their transaction."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="txn long, at string, the string, of string, as string, is string")
    return typed(raw).select("txn", "at", "the", "of", "vt", "vs", "vn", "vf", "vb", "vbool")


def replayed(log: DataFrame, many: set[str] = frozenset()) -> DataFrame:
    """The state after all transactions: of a single-valued attribute the last one's value."""
    rank = F.struct("txn", F.coalesce(F.col("vs"), F.col("vn").cast("string"), F.col("vf").cast("string"), F.col("vbool").cast("string")).alias("v"))
    own = F.struct("vt", "vs", "vn", "vf", "vb", "vbool")
    last = log.where(~F.col("the").isin(*many) if many else F.lit(True)).groupBy("the", "of").agg(F.max_by(own, rank).alias("w")).select("the", "of", "w.*")
    if not many:
        return last
    rest = log.where(F.col("the").isin(*many)).select("the", "of", "vt", "vs", "vn", "vf", "vb", "vbool").distinct()
    return last.unionByName(rest)
