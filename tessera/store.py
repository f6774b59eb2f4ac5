"""Writes: batches of changes, transactions that read their own writes, and branches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import files, notation
from tessera import history as H
from tessera.model import Concept, QueryError, Rule, check_the
from tessera.plans.compile import Session, ensure_checkpoints
from tessera.sources.base import Exporter, Importer
from tessera.sources.facts import FACT, SCHEMA, NarrowFacts, elect, overlaid, union, value, without

#: Attribute domains that applications may not write, but for the two below it.
RESERVED = "system"
OPEN = ("system.rule/", "system.concept/")
#: A batch as a frame: ops in the order of ``seq``.
BATCH = "seq long, op string, the string, of string, vt byte, vs string, vn decimal(38,0), vf double, vb binary, vbool boolean"
#: Logs that are read on top of a snapshot before the next snapshot is written.
LOGS = 16


def check_writable(the: str) -> str:
    check_the(the)
    if (the.startswith((f"{RESERVED}.", f"{RESERVED}/"))) and not the.startswith(OPEN):
        raise QueryError("ReservedNamespace", the)
    return the


@dataclass
class Changes:
    """A small batch in order: (op, the, of, payload...); op is assert, replace or retract.

    A later write of a value overrides an earlier one, and a replacement all that came before
    it for its entity and attribute.
    """

    rows: list[tuple] = field(default_factory=list)

    def assert_(self, the: str, of: str, is_, kind: str | None = None) -> Changes:
        self.rows.append(("assert", check_writable(the), of, *value(is_, kind)))
        return self

    def replace(self, the: str, of: str, is_, kind: str | None = None) -> Changes:
        self.rows.append(("replace", check_writable(the), of, *value(is_, kind)))
        return self

    def retract(self, the: str, of: str, is_, kind: str | None = None) -> Changes:
        self.rows.append(("retract", check_writable(the), of, *value(is_, kind)))
        return self

    def concept(self, c: Concept, this: str, op: str | None = None, **fields) -> Changes:
        """A concept's fields as facts: single-valued ones replace, others are added."""
        for n, v in fields.items():
            a = c.attributes[n]
            kind = a.kind if a.kind != "Any" else None
            own = op or ("replace" if a.cardinality == "one" else "assert")
            self.rows.append((own, check_writable(a.the), this, *value(v, kind)))
        return self

    def reverted(self) -> Changes:
        """Retractions of what is asserted."""
        return Changes([("retract", *r[1:]) for r in self.rows if r[0] != "retract"])

    def retain(self, entities: Iterable[str]) -> Changes:
        keep = set(entities)
        return Changes([r for r in self.rows if r[2] in keep])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], BATCH)


def settled(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch without order: the last op of each fact, as (op, fact), and the (the, of) that
    a replacement cleared. What came before a replacement is left out."""
    cleared = changes.where("op = 'replace'").groupBy("the", "of").agg(F.max("seq").alias("_since"))
    own = changes.join(cleared, ["the", "of"], "left").where("_since is null or seq >= _since")
    last = own.groupBy(*FACT).agg(F.max_by("op", "seq").alias("op"))
    return last, cleared.select("the", "of")


def applied(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts after a batch (``BATCH``).

    A replacement drops all other values of (the, of); its own, if it wasn't there, takes the
    identity of the value that stood there as its cause. What is asserted and already there
    stays as it was.
    """
    last, cleared = settled(changes)
    said = last.select("op", *(F.col(c).alias(f"_{c}") for c in FACT))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACT))
    gone = cleared.select(F.col("the").alias("_ct"), F.col("of").alias("_co"))
    kept = df.join(said, same, "left").join(gone, (F.col("the") == F.col("_ct")) & (F.col("of") == F.col("_co")), "left")
    kept = kept.where("coalesce(op, '') <> 'retract' and (_ct is null or op is not null)").select(df.columns)
    written = last.where("op <> 'retract'")
    there = df.select(*(F.col(c).alias(f"_{c}") for c in FACT)).distinct()
    fresh = written.join(there, same, "left_anti")
    prior = elect(df.join(cleared, ["the", "of"], "left_semi").select(df.columns))
    cause = F.unhex(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f"p.{c}").cast("string"), F.lit("")) for c in FACT)), 256))
    on = (F.col("a.the") == F.col("p.the")) & (F.col("a.of") == F.col("p.of")) & (F.col("a.op") == "replace")
    new = fresh.alias("a").join(prior.alias("p"), on, "left")
    return kept.unionByName(new.select(*(F.col(f"a.{c}") for c in FACT), F.when(F.col("p.the").isNotNull(), cause).alias("cause")))


class Branch:
    """A line of revisions in a shared folder, found again by its name.

    A commit writes the records of what it changed, in proportion to the batch; every
    ``LOGS`` commits a snapshot is written, by attribute and in order of entities. The head is
    a small file: the highest number stands, and a number can be taken once, so of two
    writers that move the same head one is told to read again.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "main", origin: str | None = None):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.origin = origin or name
        self.rules: list[Rule] = []
        self.asserted: list[tuple] = []  # the overlay: never committed
        self.retracted: list[tuple] = []
        self.epoch = 0
        self.upstream: Branch | None = None
        self._known: dict[str, dict] = {}
        ensure_checkpoints(spark)
        self.refresh()

    # --- revisions

    def refresh(self) -> None:
        """Read the head anew."""
        own = [x for x in files.names(self.spark, f"{self.folder}/branches/{self.name}") if x.startswith("head-")]
        self._number = int(own[-1][5:-5]) if own else 0
        state = json.loads(files.read(self.spark, f"{self.folder}/branches/{self.name}/{own[-1]}")) if own else {}
        self._head, self.induced = state.get("revision"), state.get("induced")

    def _move(self, revision: str | None, induced: str | None = None) -> None:
        at = f"{self.folder}/branches/{self.name}/head-{self._number + 1:012d}.json"
        if not files.create(self.spark, at, json.dumps({"revision": revision, "induced": induced or self.induced})):
            raise QueryError("HeadMoved", self.name)
        self._number += 1
        self._head, self.induced = revision, induced or self.induced

    def revision(self, id: str) -> dict:
        if id not in self._known:
            at = f"{self.folder}/revisions/{id}.json"
            if not files.exists(self.spark, at):
                raise QueryError("UnknownRevision", id)
            self._known[id] = json.loads(files.read(self.spark, at))
        return self._known[id]

    @property
    def head(self) -> dict | None:
        return self.revision(self._head) if self._head else None

    def ancestry(self, id: str | None) -> dict[str, dict]:
        """A revision and all before it."""
        out: dict[str, dict] = {}
        todo = [id] if id else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = self.revision(x)
                todo += out[x]["parents"]
        return out

    @property
    def revisions(self) -> list[dict]:
        return sorted(self.ancestry(self._head).values(), key=lambda r: (r["edition"], r["id"]))

    def _next(self, parents: list[str]) -> dict:
        known = [self.revision(p) for p in parents]
        return {"id": uuid.uuid4().hex, "origin": self.origin, "edition": 1 + max((r["edition"] for r in known), default=0), "parents": parents, "logs": 1 + (known[0]["logs"] if known else 0)}

    def _store(self, rev: dict) -> dict:
        """The revision's record, and a snapshot if logs have piled up."""
        if rev["logs"] >= LOGS:
            self._known[rev["id"]] = rev
            own = self._state(rev["id"])
            own = own.repartitionByRange("the", "of").sortWithinPartitions("the", "of")
            own.write.mode("overwrite").partitionBy("the").parquet(f"{self.folder}/snapshot-{rev['id']}")
            rev["logs"] = 0
        files.create(self.spark, f"{self.folder}/revisions/{rev['id']}.json", json.dumps(rev))
        self._known[rev["id"]] = rev
        return rev

    def _log(self, id: str) -> DataFrame:
        return self.spark.read.schema(H.RECORD).parquet(f"{self.folder}/log-{id}")

    def facts(self, revision: str | None = None) -> DataFrame:
        """The facts at a revision, the head's by default."""
        return self._state(revision).select(*SCHEMA.names)

    def _state(self, revision: str | None = None) -> DataFrame:
        """Facts with the versions that wrote them: a snapshot and the logs after it."""
        at = revision or self._head
        if at is None:
            return self.spark.createDataFrame([], H.STATE)
        logs: list[str] = []
        rev = self.revision(at)
        while rev["logs"]:
            logs.append(rev["id"])
            if not rev["parents"]:
                rev = None
                break
            rev = self.revision(rev["parents"][0])
        base = self.spark.read.schema(H.STATE).parquet(f"{self.folder}/snapshot-{rev['id']}").select(*H.STATE.names) if rev else None
        if not logs:
            return base
        own = [self._log(x).withColumn("_at", F.lit(-i)) for i, x in enumerate(logs)]
        key = [*FACT, "cause"]
        newest = F.max_by(F.struct("polarity", "origin", "edition"), "_at").alias("r")
        last = reduce(DataFrame.unionByName, own).groupBy(*key).agg(newest).select(*key, "r.*") if len(own) > 1 else own[0]
        live = last.where("polarity = 'assert'").select(*H.STATE.names)
        return live if base is None else without(base, last, key).unionByName(live)

    def history(self) -> DataFrame:
        """All records of all revisions: asserted and retracted facts with their versions."""
        out = self.spark.createDataFrame([], H.RECORD)
        for id in self.ancestry(self._head):
            out = out.unionByName(self._log(id))
        return out

    def changes_since(self, revision: str | None) -> DataFrame | None:
        """The records of what led from a revision to the head; None if it isn't on the head's line."""
        out, at = [], self._head
        while at != revision:
            if at is None:
                return None
            out.append(self._log(at))
            parents = self.revision(at)["parents"]
            at = parents[0] if parents else None
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], H.RECORD)

    # --- what queries see

    def overlay(self, asserted: Changes | None = None, retracted: Changes | None = None) -> None:
        """Facts of this branch alone that no commit stores."""
        self.asserted += (asserted or Changes()).rows
        self.retracted += (retracted or Changes()).rows
        self.epoch += 1

    def clear_overlay(self) -> None:
        self.asserted, self.retracted = [], []
        self.epoch += 1

    def view(self) -> DataFrame:
        """The head's facts under the overlay, with facts about the branch itself."""
        own = self.facts()
        if self.asserted or self.retracted:
            plus, minus = (Changes(r).frame(self.spark).drop("op", "seq") for r in (self.asserted, self.retracted))
            own = overlaid(own, plus.withColumn("cause", F.lit(None).cast("binary")).select(own.columns), minus)
        return own.unionByName(self.metadata())

    def metadata(self) -> DataFrame:
        """Made up when a query runs, never stored."""
        of, replica = f"branch:{self.name}", f"replica:{self.origin}"
        rows = [(f"{RESERVED}.branch/name", of, *value(self.name), None), (f"{RESERVED}.replica/name", replica, *value(self.origin), None), (f"{RESERVED}.replica/branch", replica, *value(of, "Entity"), None)]
        if self._head:
            rows.append((f"{RESERVED}.branch/head", of, *value(self._head), None))
        return self.spark.createDataFrame(rows, SCHEMA)

    def session(self, *others: Branch) -> Session:
        """Queries over this branch, and others beside it: facts once each, rules of all."""
        views = [b.view() for b in (self, *others)]
        rules = [r for b in (self, *others) for r in [*b.rules, *b.installed()] if r.head is None]
        return Session(self.spark, NarrowFacts(union(*views)), rules)

    def installed(self, facts: DataFrame | None = None) -> list[Rule]:
        """Rules asserted as facts, the overlay's too. One whose body can't be read, or whose
        entity isn't the hash of its body, is left out."""
        out = []
        own = (self.view() if facts is None else facts).where(F.col("the") == f"{RESERVED}.rule/source")
        for r in own.select("of", "vs").collect():  # rules, not facts
            try:
                rule = notation.rule(r["vs"])
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
            if r["of"] == f"rule:{rule.id}":
                out.append(rule)
        return out

    # --- writing

    def transaction(self) -> Transaction:
        return Transaction(self)

    def commit(self, changes: Changes | DataFrame, allow_empty: bool = False) -> dict | None:
        """A revision that holds what the batch changes; the head as it was if that is nothing."""
        batch = changes.frame(self.spark) if isinstance(changes, Changes) else changes
        batch = batch.checkpoint() if not isinstance(changes, Changes) else batch
        the = [r["the"] for r in batch.select("the").distinct().collect()]  # attributes, not facts
        # Only the entities and attributes of the batch are read.
        before = self.facts().where(F.col("the").isin(*the)) if the else self.facts().limit(0)
        before = before.join(batch.select("the", "of").distinct(), ["the", "of"], "left_semi").select(*SCHEMA.names)
        rev = self._next([self._head] if self._head else [])
        return self._write(H.record(before, applied(before, batch), rev), rev, allow_empty)

    def _write(self, log: DataFrame, rev: dict, allow_empty: bool) -> dict | None:
        at = f"{self.folder}/log-{rev['id']}"
        log.write.parquet(at)
        if not allow_empty and self._log(rev["id"]).isEmpty():
            files.delete(self.spark, at)
            return self.head
        self._store(rev)
        self._move(rev["id"])
        return rev

    def induce(self) -> dict | None:
        """Run all installed commit-time rules over the facts as they are, as after a pull."""
        from tessera.streaming.induction import induce

        rules = [*self.rules, *self.installed()]
        none = Changes().frame(self.spark)
        rev = self.commit(induce(self, none, none, rules, {r.id for r in rules}))
        if rev and self.induced != rev["id"]:
            self._move(rev["id"], rev["id"])
        return rev

    def export(self, sink: Exporter, revision: str | None = None) -> None:
        """All facts of a revision to a sink."""
        sink.write(self.facts(revision))

    def import_(self, source: Importer) -> dict | None:
        """The facts of a source as one commit."""
        own = source.read(self.spark)
        reserved = own.where(F.col("the").startswith(f"{RESERVED}.") & ~F.col("the").startswith(OPEN[0]) & ~F.col("the").startswith(OPEN[1]))
        if not reserved.isEmpty():
            raise QueryError("ReservedNamespace", reserved.first()["the"])
        return self.commit(own.select(F.lit(0).cast("long").alias("seq"), F.lit("assert").alias("op"), *FACT))

    # --- between branches

    def reset(self, revision: str | None) -> None:
        """Point the head at a revision that is known here."""
        if revision is not None:
            self.revision(revision)
        self._move(revision)

    def set_upstream(self, other: Branch) -> None:
        self.upstream = other

    def _upstream(self, other: Branch | None) -> Branch:
        if other is None and self.upstream is None:
            raise QueryError("NoUpstream", self.name)
        return other or self.upstream

    def fetch(self, other: Branch | None = None) -> dict | None:
        """Copy what the other's head needs into this folder; this head stays."""
        other = self._upstream(other)
        theirs = other.ancestry(other._head)
        if other.folder != self.folder:
            for rev in sorted(theirs.values(), key=lambda r: r["edition"]):
                if files.exists(self.spark, f"{self.folder}/revisions/{rev['id']}.json"):
                    continue
                other._log(rev["id"]).write.mode("overwrite").parquet(f"{self.folder}/log-{rev['id']}")
                if not rev["logs"]:
                    own = self.spark.read.schema(H.STATE).parquet(f"{other.folder}/snapshot-{rev['id']}")
                    own.repartitionByRange("the", "of").sortWithinPartitions("the", "of").write.mode("overwrite").partitionBy("the").parquet(f"{self.folder}/snapshot-{rev['id']}")
                files.create(self.spark, f"{self.folder}/revisions/{rev['id']}.json", json.dumps(rev))
        return other.head

    def pull(self, other: Branch | None = None) -> dict | None:
        """Adopt, fast-forward or merge (``history.screened``) another branch's head into this one."""
        other = self._upstream(other)
        other.refresh()
        theirs = self.fetch(other)
        mine = self.ancestry(self._head)
        if theirs is None or theirs["id"] in mine:
            return self.head
        above = self.ancestry(theirs["id"])
        if self._head is None or self._head in above:
            self._move(theirs["id"])
            return self.head

        def vector(revs: dict[str, dict]) -> dict[str, int]:
            out: dict[str, int] = {}
            for r in revs.values():
                out[r["origin"]] = max(out.get(r["origin"], 0), r["edition"])
            return out

        rev = self._next([self._head, theirs["id"]])
        log = H.screened(self._state(), self._state(theirs["id"]), vector(mine), vector(above), rev)
        return self._write(log, rev, True)

    def push(self, other: Branch | None = None) -> dict | None:
        """Move another branch to this head; refused if that branch has revisions of its own."""
        other = self._upstream(other)
        other.refresh()
        if other._head is not None and other._head not in self.ancestry(self._head):
            raise QueryError("NotFastForward", other.name)
        if self._head != other._head:
            other.fetch(self)
            other._move(self._head)
        return other.head


@dataclass
class Transaction:
    """Changes that queries of the transaction see before they are committed."""

    branch: Branch
    changes: Changes = field(default_factory=Changes)
    transient: Changes = field(default_factory=Changes)
    fresh: list[Rule] = field(default_factory=list)

    def assert_(self, *a, **k) -> Transaction:
        self.changes.assert_(*a, **k)
        return self

    def replace(self, *a, **k) -> Transaction:
        self.changes.replace(*a, **k)
        return self

    def retract(self, *a, **k) -> Transaction:
        self.changes.retract(*a, **k)
        return self

    def integrate(self, changes: Changes) -> Transaction:
        """Another batch after what there is."""
        self.changes.rows += changes.rows
        return self

    def dispatch(self, *a, **k) -> Transaction:
        """A fact that rules of this commit see and nothing stores."""
        self.transient.assert_(*a, **k)
        return self

    def install(self, rule: Rule) -> Transaction:
        """The rule as facts under its own content hash. A commit-time rule also runs over the
        facts that are there already."""
        self.fresh.append(rule)
        return self._rule("assert_", rule)

    def uninstall(self, rule: Rule) -> Transaction:
        """What the rule derived before stays."""
        self.fresh = [r for r in self.fresh if r != rule]
        return self._rule("retract", rule)

    def _rule(self, op: str, rule: Rule) -> Transaction:
        from tessera.streaming.induction import triggers

        write, of = getattr(self.changes, op), f"rule:{rule.id}"
        write(f"{RESERVED}.rule/source", of, json.dumps(notation.to_json(rule), sort_keys=True))
        write(f"{RESERVED}.rule/{'induces' if rule.head else 'conclusion'}", of, f"concept:{rule.deduce.identity}", "Entity")
        for the in sorted(triggers(rule, [])):
            write(f"{RESERVED}.rule/on", of, the, "Symbol")
        for p in {f"concept:{p.what.identity}" for p in (*rule.when, *rule.unless) if isinstance(p.what, Concept)}:
            write(f"{RESERVED}.rule/reads", of, p, "Entity")
        return self

    def view(self) -> DataFrame:
        spark = self.branch.spark
        return applied(applied(self.branch.view(), self.changes.frame(spark)), self.transient.frame(spark))

    def session(self) -> Session:
        own = self.view()
        rules = [r for r in [*self.branch.rules, *self.branch.installed(own)] if r.head is None]
        return Session(self.branch.spark, NarrowFacts(own), rules)

    def query(self, concept: Concept, **where) -> DataFrame:
        return self.session().query(concept, **where)

    def commit(self, rules: Iterable[Rule] = (), allow_empty: bool = False) -> dict | None:
        """Run the commit-time rules, those installed and those given, then store what was
        written and what they add."""
        from tessera.streaming.induction import induce

        branch, spark = self.branch, self.branch.spark
        batch = self.changes.frame(spark)
        held = branch.facts().where(F.col("the") == f"{RESERVED}.rule/source")
        known = [*branch.rules, *branch.installed(applied(held, batch.where(F.col("the") == f"{RESERVED}.rule/source"))), *rules]
        if not any(r.head for r in known):
            return branch.commit(self.changes, allow_empty)
        out = induce(branch, batch, self.transient.frame(spark), known, {r.id for r in self.fresh if r.head})
        return branch.commit(out, allow_empty)


__all__ = ["Branch", "Changes", "Transaction", "applied", "union"]
