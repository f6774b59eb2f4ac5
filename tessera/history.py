"""Versions: records of what revisions did, ancestry, causality and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.facts import FACT, SCHEMA, fact_hash, packed, without

RECORD = T.StructType([*SCHEMA.fields, T.StructField("polarity", T.StringType()), T.StructField("revision", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("edition", T.LongType())])
#: A fact with the version that wrote it.
STATE = T.StructType([*SCHEMA.fields, T.StructField("origin", T.StringType()), T.StructField("edition", T.LongType())])
REVISION = "id string, origin string, edition long, parents array<string>"


def record(before: DataFrame, after: DataFrame, revision: dict) -> DataFrame:
    """What changed between two states, as assert and retract records of a revision."""
    stamp = lambda df, polarity: df.select(*SCHEMA.names, F.lit(polarity).alias("polarity"), F.lit(revision["id"]).alias("revision"), F.lit(revision["origin"]).alias("origin"), F.lit(revision["edition"]).cast("long").alias("edition"))
    key = [*FACT, "cause"]
    return stamp(without(after, before, key), "assert").unionByName(stamp(without(before, after, key), "retract"))


def revisions(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["id"], r["origin"], r["edition"], r["parents"]) for r in rows], REVISION)


def parents(revs: DataFrame) -> DataFrame:
    """(this, parent), each parent once."""
    return revs.select(F.col("id").alias("this"), F.explode(F.array_distinct("parents")).alias("parent"))


def above(revs: DataFrame, head: str) -> DataFrame:
    """(id): the head's revision and all its ancestors, by steps that double.

    After k rounds all ancestors within 2^k - 1 steps are there; what is kept beside them is
    where 2^k steps lead, so a long line of revisions takes few rounds and no closure.
    """
    from tessera.plans.compile import ensure_checkpoints

    ensure_checkpoints(revs.sparkSession)
    jumps = parents(revs).checkpoint()
    found = revs.where(F.col("id") == head).select("id").checkpoint()
    n = found.count()
    while n:
        more = found.join(jumps, found["id"] == jumps["this"]).select(F.col("parent").alias("id"))
        found = found.unionByName(more).distinct().checkpoint()
        m = found.count()
        if m == n:
            break
        n = m
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.parent") == F.col("b.this"))
        jumps = twice.select(F.col("a.this").alias("this"), F.col("b.parent").alias("parent")).distinct().checkpoint()
    return found


def log(revs: DataFrame, head: str) -> DataFrame:
    """The head's revision and all its ancestors, latest edition first to be sorted by."""
    return revs.join(above(revs, head), "id", "left_semi")


def ancestors(revs: DataFrame) -> DataFrame:
    """(this, ancestor), each revision its own: the closure of the parent edges by doubling."""
    from tessera.plans.compile import ensure_checkpoints

    ensure_checkpoints(revs.sparkSession)
    own = revs.select(F.col("id").alias("this"), F.col("id").alias("ancestor"))
    reach = own.unionByName(parents(revs).withColumnRenamed("parent", "ancestor")).distinct().checkpoint()
    n = reach.count()
    while True:
        more = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.this")).select(F.col("a.this").alias("this"), F.col("b.ancestor").alias("ancestor")).distinct().checkpoint()
        m = more.count()
        if m == n:
            return more
        reach, n = more, m


def causality(revs: DataFrame, a: str, b: str) -> str:
    """equal, supersedes, superseded or concurrent."""
    if a == b:
        return "equal"
    if not above(revs, a).where(F.col("id") == b).isEmpty():
        return "supersedes"
    return "concurrent" if above(revs, b).where(F.col("id") == a).isEmpty() else "superseded"


def common_ancestor(revs: DataFrame, a: str, b: str) -> str | None:
    """The nearest shared revision: of the highest edition, then the greatest id."""
    both = revs.join(above(revs, a), "id", "left_semi").join(above(revs, b), "id", "left_semi")
    return both.agg(F.max_by("id", F.struct("edition", "id")).alias("id")).first()["id"]


def context(revs: DataFrame, head: str) -> DataFrame:
    """The head's version vector: (origin, edition)."""
    return log(revs, head).groupBy("origin").agg(F.max("edition").alias("edition"))


def merged(base: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge of facts.

    What both have stays. A fact that one side removed since the base goes, unless the other
    changed its cause since; what either side added stays, so concurrent values both live
    and readers elect one. Facts that are the same but for their cause keep the higher.
    """
    added = lambda side: without(side, base)
    kept = without(without(base, without(base, mine)), without(base, theirs))
    out = kept.unionByName(added(mine)).unionByName(added(theirs))
    value = packed()
    rank = F.struct(F.col("cause").isNotNull().alias("c"), F.hex("cause").alias("x"))
    best = out.withColumn("_v", value).groupBy("the", "of", "_v").agg(F.max_by("cause", rank).alias("cause"))
    return best.select("the", "of", "_v.*", "cause")


def screened(mine: DataFrame, theirs: DataFrame, seen_here: dict[str, int], seen_there: dict[str, int], revision: dict) -> DataFrame:
    """The records that merging two states (``STATE``) adds to mine, by version vectors.

    A fact that one side alone has, in a version that the other has seen, was removed there,
    and goes; one that the other hasn't seen stays or comes, in the version that wrote it, so
    that whoever removes it later is believed. Facts that are the same but for their cause
    keep the higher. No base is needed: sides that have merged before merge alike.
    """

    def unseen(side: str, seen: dict[str, int]):
        known = F.lit(None).cast("long")
        for origin, edition in seen.items():  # as many as there are writers
            known = F.when(F.col(f"{side}.origin") == origin, F.lit(edition)).otherwise(known)
        return F.coalesce(F.col(f"{side}.edition") > known, F.lit(True))

    same = reduce(lambda a, b: a & b, (F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in FACT))
    both = mine.alias("m").join(theirs.alias("t"), same, "full_outer")
    here, there = F.col("m.the").isNotNull(), F.col("t.the").isNotNull()
    higher = here & there & (F.coalesce(F.hex("t.cause"), F.lit("")) > F.coalesce(F.hex("m.cause"), F.lit("")))
    adds = both.where((~here & unseen("t", seen_here)) | higher).select("t.*", F.lit("assert").alias("polarity"))
    takes = both.where((~there & ~unseen("m", seen_there)) | higher).select("m.*", F.lit("retract").alias("polarity"))
    takes = takes.withColumns({"origin": F.lit(revision["origin"]), "edition": F.lit(revision["edition"]).cast("long")})
    return adds.unionByName(takes).withColumn("revision", F.lit(revision["id"])).select(*RECORD.names)


def live(history: DataFrame) -> DataFrame:
    """Facts whose last record, by edition then hash, asserts them."""
    rank = F.struct("edition", "revision", (F.col("polarity") == "assert").alias("a"), fact_hash().alias("h"))
    last = history.withColumn("_v", packed()).groupBy("the", "of", "_v").agg(F.max_by(F.struct("polarity", "cause"), rank).alias("r"))
    return last.where("r.polarity = 'assert'").select("the", "of", "_v.*", "r.cause")


__all__ = ["FACT", "ancestors", "causality", "common_ancestor", "context", "live", "log", "merged", "record"]
