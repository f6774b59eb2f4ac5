"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; bounds a worker's memory when texts are long.
BATCH_ROWS = 1000
#: The same where much is made of each text.
FEW_ROWS = 500
#: Links (16 bytes each) up to which components may be found on the driver.
FEW_LINKS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none (tests, a single machine), one is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: By session: the batch size it came with, and the one that was set here last.
_BATCHES: dict[str, tuple[int, int]] = {}


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have Arrow batches of at most ``rows`` rows, or as few as the session itself asks for.

    What an earlier operator asked for doesn't count.
    """
    key, session = "spark.sql.execution.arrow.maxRecordsPerBatch", spark._jsparkSession.sessionUUID()
    now = int(spark.conf.get(key, "10000"))
    own, last = _BATCHES.get(session, (now, 0))
    if now != last:
        own = now
    want = min(own, rows) if own > 0 else rows
    if now != want:
        spark.conf.set(key, str(want))
    _BATCHES[session] = own, want


#: Paths of what was written here and not discarded, in order.
_MADE: list[str] = []


def made() -> list[str]:
    """Paths of what was written here and not discarded, in order."""
    return list(_MADE)


def remove(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> list[str]:
    """Delete written paths, but those that ``reader`` still reads; these are given back."""
    held = tuple(reader.inputFiles()) if reader is not None and paths else ()
    kept = [p for p in paths if any(f.startswith(p) or f.removeprefix("file://").startswith(p.removeprefix("file://").rstrip("/")) for f in held)]
    for path in paths:
        if path not in kept:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            if path in _MADE:
                _MADE.remove(path)
    return kept


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here.

    The files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(spark: SparkSession) -> None:
    """Have Spark clear away the shuffles that nothing refers to any more: it does so as the
    driver's garbage goes, which may take half an hour otherwise."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` frame that nothing reads any more, and ``release``."""
    path = getattr(df, "_tessera_path", None)
    if path:
        release(df.sparkSession)
        remove(df.sparkSession, [path])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def splittable(df: DataFrame, merge: bool = False) -> DataFrame:
    """Deal the rows out evenly, so that a join on their key shuffles them anew.

    Straight after an aggregation a join would reuse its hash partitions, and then
    adaptive execution can't split a hot key of the other side. ``merge`` keeps the join
    from turning into a broadcast one once the other side is dealt out: that one reads hot
    partitions whole.
    """
    out = df.repartition(shuffle_partitions(df.sparkSession))
    return out.hint("merge") if merge else out


def fresh(name: str, taken) -> str:
    """``name``, with as many underscores before it as make it no column of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strung(own: list[bytes], index: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Runs of 32-bit ids: ``own[i]`` for each of ``index``, cut at ``offsets`` into it."""
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
    ids = np.frombuffer(b"".join(own), dtype="<u4")
    n = size[index]
    total = np.cumsum(n)
    place = np.repeat((np.cumsum(size) - size)[index] - (total - n), n)
    place += np.arange(len(place))
    out = ids[place].tobytes()
    cuts = (4 * np.r_[0, total][offsets]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield out[a:b]


def as_long(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs, bit for bit."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a[i]``-``b[i]`` as stars: each node with the least node of its component.

    Roots aren't listed, so there are fewer links than nodes.
    """
    if not len(a):
        return a[:0], b[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def gathered(links: DataFrame) -> DataFrame:
    """``components`` of links that the driver holds at once."""
    own = links.select("u", "v").toArrow()
    node, root = forest(own["u"].to_numpy(), own["v"].to_numpy())
    table = pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})
    return written(links.sparkSession.createDataFrame(table, "node long, root long").coalesce(1), "links")


def components(links: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Connected components of ``links`` (u long, v long) as (node, root), root the least node.

    Alternating large-star and small-star steps: each round every node hands its
    neighbours to the least of them. No node's neighbours meet in one task: minima are
    aggregated before the shuffle, joins can be split, and each round is written to the
    shared folder. Self links only name their node. ``links`` that are written already and
    no more than ``few`` are ``gathered`` instead: rounds take seconds each, however few.
    """
    if few and links.count() <= few:
        return gathered(links)
    edges = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"
    )
    before = _summary(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(splittable(low), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(splittable(low), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = written(small, "small")
        after = _summary(small)
        discard(large)
        discard(edges)
        edges, same = small, after == before
        before = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._tessera_path = edges._tessera_path  # for ``discard``
    return out


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b) if a else 0
