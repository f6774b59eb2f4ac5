"""The files behind a branch as relations: folders, the spans of keys they hold, entries.

A revision's snapshot or log is a folder (an ``index``); the files in it are ``segment``s. A
key is an attribute, an entity, a type tag and a value, joined by the unit separator; files
of a snapshot hold ranges of it. All of this is read with the columns that Spark gives for a
file, and a premise on one of these tables must say which folder or file it means.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import files
from tessera.functions.formulas import text_of
from tessera.model import ANY
from tessera.sources.base import Relation, Slot
from tessera.sources.facts import packed

if TYPE_CHECKING:
    from tessera.store import Branch

VERSION = 1
UNIT = "\x1f"


def key():
    """The bytes that order a fact among all."""
    return F.encode(F.concat_ws(UNIT, "the", "of", F.col("vt").cast("string"), F.coalesce(text_of(packed(), ANY), F.lit(""))), "UTF-8")


def _entries(branch: Branch) -> DataFrame:
    """Every entry of every file of the head's line, with its folder and file."""
    from tessera.history import RECORD

    out = None
    for id, rev in branch.ancestry(branch._head).items():
        own = [(f"log-{id}", branch.spark.read.schema(RECORD).parquet(f"{branch.folder}/log-{id}"))]
        if not rev["logs"] and files.exists(branch.spark, f"{branch.folder}/snapshot-{id}"):
            own.append((f"snapshot-{id}", branch.spark.read.parquet(f"{branch.folder}/snapshot-{id}")))
        for folder, df in own:
            there = set(df.columns)
            column = lambda n, kind, there=there: F.col(n) if n in there else F.lit(None).cast(kind)
            part = df.select(
                F.lit(folder).alias("folder"),
                F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("_metadata.file_path"), f"{folder}/"), -1)).alias("file"),
                F.col("_metadata.file_size").alias("bytes"),
                key().alias("key"),
                F.coalesce(column("polarity", "string"), F.lit("assert")).alias("polarity"),
                F.coalesce(column("origin", "string"), F.lit("")).alias("origin"),
                F.coalesce(column("edition", "long"), F.lit(0)).alias("edition"),
                F.col("cause").isNotNull().cast("int").alias("cause"),
                F.col("vb").alias("vb"),
            )
            out = part if out is None else out.unionByName(part)
    return out


def tables(branch: Branch, blobs: DataFrame | None = None) -> dict[str, Relation]:
    """The ``tree/`` tables of a branch's head, for ``Session(tables=...)``."""
    kinds = {"of": "Text", "kind": "Text", "node": "Text", "state": "Text", "origin": "Text", "spill": "Text", "key": "Bytes", "separator": "Bytes", "until": "Bytes", "bytes": "Bytes", "blob": "Bytes", "retraction": "Boolean"}
    relation = lambda df: Relation(df, {c: Slot(kinds.get(c, "UnsignedInteger")) for c in df.columns})
    number = lambda c: F.lit(c).cast("decimal(38,0)") if isinstance(c, int) else c.cast("decimal(38,0)")
    out: dict[str, Relation] = {}
    if branch._head is not None:
        own = _entries(branch)
        spans = own.groupBy("folder", "file", "bytes").agg(F.min("key").alias("separator"), F.count("*").alias("n"))
        scale = lambda n: number(F.floor(F.log2(n + 1)))
        segments = spans.select(F.col("file").alias("of"), F.lit("segment").alias("kind"), number(F.col("bytes")).alias("size"), number(F.col("n")).alias("count"), scale(F.col("n")).alias("scale"), number(0).alias("novelty"))
        index = spans.groupBy(F.col("folder").alias("of")).agg(F.lit("index").alias("kind"), number(F.sum("bytes")).alias("size"), number(F.count("*")).alias("count"), scale(F.sum("n")).alias("scale"), number(0).alias("novelty"))
        out["tree/node"] = relation(index.unionByName(segments))
        line = Window.partitionBy("folder").orderBy("separator", "file")
        out["tree/span"] = relation(
            spans.select(
                F.col("folder").alias("of"), number(F.row_number().over(line) - 1).alias("at"), F.col("file").alias("node"), "separator",
                F.coalesce(F.lead("separator").over(line), F.lit(b"")).alias("until"), scale(F.col("n")).alias("scale"), number(0).alias("rank"), number(0).alias("novelty"),
            )
        )
        place = number(F.row_number().over(Window.partitionBy("file").orderBy("key", "polarity")) - 1)
        entries = own.withColumn("at", place)
        out["tree/key"] = relation(entries.select(F.col("file").alias("of"), "at", "key", number(0).alias("rank")))
        spill = F.when(F.col("vb").isNotNull(), F.sha2("vb", 256)).otherwise("")
        out["tree/entry"] = relation(
            entries.select(
                F.col("file").alias("of"), "at", "key", F.when(F.col("polarity") == "assert", "asserted").otherwise("removed").alias("state"), (F.col("polarity") == "retract").alias("retraction"),
                "origin", number(F.col("edition")).alias("edition"), number(F.col("cause")).alias("cause"), number(0).alias("collapsed"), number(0).alias("supersedes"), spill.alias("spill"),
            )
        )
        values = own.where("vb is not null").select(F.sha2("vb", 256).alias("of"), number(F.octet_length("vb")).alias("size"), F.col("vb").alias("bytes"))
        out["tree/value"] = relation(values.distinct())
        out["tree/manifest"] = relation(index.select("of", number(VERSION).alias("version")))
    if blobs is not None:
        place = number(F.row_number().over(Window.orderBy("hash")) - 1)
        out["tree/blob"] = relation(blobs.select(F.lit("blobs").alias("of"), place.alias("at"), F.col("hash").alias("blob"), number(F.col("version")).alias("version"), number(F.col("size")).alias("size")))
    return out


__all__ = ["key", "tables"]
