"""Standing queries: what a concept's rows gained and lost since the last poll."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera import files
from tessera.model import Concept, Rule
from tessera.operators import zset
from tessera.plans.compile import Session, ensure_checkpoints
from tessera.plans.delta import affected, attributes_read
from tessera.sources.facts import FACT, NarrowFacts, without
from tessera.store import Branch


@dataclass
class Delta:
    asserted: DataFrame
    retracted: DataFrame


class Subscription:
    """A concept's rows, kept up to date.

    ``facts`` is a branch, or gives the present facts. A poll asks what changed under the
    attributes in demand: a branch's own records since the last poll, or else a comparison
    with the last poll's facts. If nothing did there is nothing to do. Else the entities
    whose rows the change can reach, through joins, negations and recursion, are derived
    anew; where that can't be told, all are.
    """

    def __init__(self, spark: SparkSession, facts: Callable[[], DataFrame] | Branch, concept: Concept, rules: list[Rule] = ()):
        ensure_checkpoints(spark)
        self.spark, self.concept, self.rules = spark, concept, list(rules)
        self.branch = facts if isinstance(facts, Branch) else None
        self.facts = None if self.branch else facts
        self.demand = attributes_read(concept, self.rules)
        self.before: DataFrame | None = None
        self.revision: str | None = None
        self.rows: DataFrame | None = None
        self.recomputes = self.maintenances = 0

    def _wanted(self, df: DataFrame) -> DataFrame:
        return df if "*" in self.demand else df.where(F.col("the").isin(*sorted(self.demand)))

    def _session(self, facts: DataFrame) -> Session:
        return Session(self.spark, NarrowFacts(facts), self.rules)

    def _derive(self, facts: DataFrame) -> DataFrame:
        return self._session(facts).query(self.concept)

    def poll(self) -> Delta | None:
        """All rows on the first call; None if nothing changed."""
        if self.branch:
            self.branch.refresh()
            head = self.branch._head
            if self.rows is not None and head == self.revision:
                return None
            now = self._wanted(self.branch.facts())
            records = self.branch.changes_since(self.revision) if self.rows is not None else None
            before = self._wanted(self.branch.facts(self.revision)) if records is not None and self.revision else None
            if records is not None:
                changed = self._wanted(records).select("the", "of").distinct().checkpoint()
            else:
                changed = None
            if before is None and records is not None:
                before = now.limit(0)
            self.revision = head
            return self._update(before, now, changed)
        now = self._wanted(self.facts()).checkpoint()
        before, self.before = self.before, now
        if self.rows is None:
            return self._update(None, now, None)
        keys = [*FACT, "cause"]
        changed = without(now, before, keys).unionByName(without(before, now, keys)).select("the", "of").distinct().checkpoint()
        return self._update(before, now, changed)

    def _update(self, before: DataFrame | None, now: DataFrame, changed: DataFrame | None) -> Delta | None:
        """Rows after a change of facts; ``changed`` (the, of), or None if it isn't known."""
        reach = None
        if self.rows is not None and changed is not None:
            touched = {r["the"] for r in changed.select("the").distinct().collect()}  # attributes, not facts
            if not touched:
                return None
            reach = affected([self._session(before), self._session(now)], self.concept, changed, touched)
        if reach is None:
            rows, old = self._derive(now).checkpoint(), self.rows
            self.recomputes += 1
            if old is None:
                self.rows = rows
                return Delta(rows, rows.limit(0))
            change = zset.changes(old, rows).checkpoint()
        else:
            reach = reach.distinct().checkpoint()
            session = self._session(now)
            kept = self.rows.join(reach, "this", "left_anti")
            if session.recursive(self.concept):
                rows = session.resumed(self.concept, kept)
                fresh = rows.join(reach, "this", "left_semi")
                change = zset.changes(self.rows, rows).checkpoint()
            else:
                fresh = session.query(self.concept).join(reach, "this", "left_semi").checkpoint()
                rows = kept.unionByName(fresh)
                change = zset.changes(self.rows.join(reach, "this", "left_semi"), fresh).checkpoint()
            rows = rows.checkpoint()
            self.maintenances += 1
        self.rows = rows
        if change.isEmpty():
            return None
        return Delta(zset.expanded(change), zset.expanded(zset.scaled(change, -1)))


def standing(stream: DataFrame, concept: Concept, rules: list[Rule], folder: str, sink: Callable[[Delta, int], None]) -> StreamingQuery:
    """Subscribe to a stream of facts (Structured Streaming): a delta for each micro-batch.

    Everything is kept in ``folder``, a shared one: facts and rows by batch, and the stream's
    own checkpoint. So a query that is started again goes on where it was, and a batch that
    runs again overwrites itself. A batch only reads the facts in demand of the entities
    that it can reach, and its delta reaches the sink at least once.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def batch(df: DataFrame, number: int) -> None:
        facts, rows = f"{folder}/facts", f"{folder}/rows"
        df.write.mode("overwrite").parquet(f"{facts}/batch={number}")
        done = [int(x[6:]) for x in files.names(spark, rows) if x.startswith("batch=") and int(x[6:]) < number and files.exists(spark, f"{rows}/{x}/_SUCCESS")]
        sub = Subscription(spark, lambda: None, concept, rules)
        now = spark.read.schema(schema).parquet(*(f"{facts}/{x}" for x in files.names(spark, facts) if int(x[6:]) <= number)).distinct()
        earlier = [f"{facts}/{x}" for x in files.names(spark, facts) if int(x[6:]) < number]
        if done:
            sub.rows = spark.read.parquet(f"{rows}/batch={max(done)}")
            before = spark.read.schema(schema).parquet(*earlier).distinct()
            changed = sub._wanted(df).select("the", "of").distinct().checkpoint()
            delta = sub._update(sub._wanted(before), sub._wanted(now), changed)
        else:
            delta = sub._update(None, sub._wanted(now), None)
        if delta is not None:
            sink(delta, number)
        if delta is not None or not done:
            sub.rows.write.mode("overwrite").parquet(f"{rows}/batch={number}")
            for old in done[:-1]:
                files.delete(spark, f"{rows}/batch={old}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/stream").start()


__all__ = ["Delta", "Subscription", "standing"]
