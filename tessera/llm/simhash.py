"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits must agree on one of ``radius + 1`` blocks of bits,
so only fingerprints that share a block are compared. Within a block's bucket they are
tiled by population count: two fingerprints whose counts differ beyond the radius can't
link, so a tile meets only the tiles up to ``radius`` below it. Tiles are compared by
numpy exclusive-or and bit counts. Each tile task reports a spanning forest, never all
of its pairs, and components come from distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import FEW_ROWS, as_long, components, forest, fresh, mixed, small_batches, splittable, text_bytes, written

BITS = 64
#: Rows of a tile beyond which it is split into square sub-tiles.
TILE_ROWS = 8192
#: Groups up to this size are compared by shifted arrays, larger ones by square tiles.
SMALL = 48
SQUARE = 1024


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text.

    A-Z are lower-cased; words are what ASCII white space leaves; shingles are ``width``
    words, repeats included. Fewer words make one shingle; no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[at : at + (1 << 15)]
        raw = np.frombuffer(b"".join([xxhash.xxh64_digest(x, seed) for x in part]), dtype=np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def wide(own: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes, ``words`` longs of it: a bit is 1 if over half
    of the set's members have it.

    Members are extended by mixing and counted bit by bit in planes: three rows of one
    weight become one of that weight and one of twice it.
    """
    planes: list[np.ndarray] = []
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 2048):
        level, k = mixed(own[at : at + 2048, None] + steps), 0
        while len(level):
            level = np.concatenate([level, *(x[None] for x in planes[k : k + 1])])
            carried = []
            while len(level) > 1:
                if len(level) == 2:
                    level = np.concatenate([level, np.zeros((1, words), np.uint64)])
                t = len(level) // 3
                a, b, c = level[:t], level[t : 2 * t], level[2 * t : 3 * t]
                odd = a ^ b
                carried.append((a & b) | (c & odd))
                level = np.concatenate([odd ^ c, level[3 * t :]])
            planes[k : k + 1] = [level[0]]
            level, k = np.concatenate(carried) if carried else level[:0], k + 1
    half, over, even = len(own) // 2, np.zeros(words, np.uint64), np.full(words, np.iinfo(np.uint64).max)
    for k in reversed(range(len(planes))):
        if half >> k & 1:
            even &= planes[k]
        else:
            over |= even & planes[k]
            even &= ~planes[k]
    return over


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): each row's fingerprint, as the long with the same bits."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in text_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_long(fps))], ["id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(each, "id long, fp long")


def _pairs(tile: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``tile``, at least one side at home."""
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    sizes = np.diff(np.r_[starts, len(tile)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    little = np.repeat(sizes <= SMALL, sizes)
    t, f, h = tile[little], fp[little], home[little]
    for k in range(1, SMALL):
        near = np.flatnonzero(t[:-k] == t[k:]) if k < len(t) else np.empty(0, np.int64)
        if not len(near):
            break
        hit = near[(np.bitwise_count(f[near] ^ f[near + k]) <= radius) & (h[near] | h[near + k])]
        found.append((f[hit], f[hit + k]))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        f, h = fp[s : s + n], home[s : s + n]
        f, h = np.concatenate([f[h], f[~h]]), int(h.sum())
        links = (f[:0], f[:0])
        for i in range(0, h, SQUARE):
            for j in range(i, n, SQUARE):
                a, b = f[i : min(i + SQUARE, h)], f[j : j + SQUARE]
                x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                other = a[x] != b[y]
                if other.any():
                    links = forest(np.concatenate([links[0], a[x[other]]]), np.concatenate([links[1], b[y[other]]]))
        found.append(links)
    return forest(np.concatenate([x for x, _ in found] or [fp[:0]]), np.concatenate([y for _, y in found] or [fp[:0]]))


def tile_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Forest links of batches (tile, fp, home) that are sorted by tile."""
    rest: list[pa.RecordBatch] = []

    def flush(part: pa.Table) -> pa.RecordBatch:
        u, v = _pairs(
            part["tile"].to_numpy(),
            part["fp"].to_numpy().view(np.uint64),
            part["home"].to_numpy(),
            radius,
        )
        return pa.RecordBatch.from_arrays([pa.array(as_long(u)), pa.array(as_long(v))], ["u", "v"])

    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        held += b.num_rows
        if held < 200_000:
            continue
        all_ = pa.Table.from_batches(rest)
        tile = all_["tile"].to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield flush(all_.slice(0, cut))
        rest = all_.slice(cut).combine_chunks().to_batches()
        held = sum(x.num_rows for x in rest)
    if rest:
        yield flush(pa.Table.from_batches(rest))


def links(fps: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within ``radius`` bits.

    ``fps`` holds distinct longs ``fp``. Every pair within the radius is joined by a
    chain of links; pairs beyond it are never linked.
    """
    spark = fps.sparkSession
    blocks = radius + 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    count = F.bit_count("fp").cast("int")
    tiles = []
    for b in range(blocks):
        size = edges[b + 1] - edges[b]
        key = F.shiftrightunsigned("fp", edges[b]).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        for up in range(radius + 1):
            if size <= 48:  # block, key and population count fit a long
                tile = F.lit(b).cast("long") * F.lit(1 << 57) + key * F.lit(256) + count + F.lit(up)
            else:
                tile = F.xxhash64(F.lit(b), key, count + F.lit(up))
            tiles.append(F.struct(tile.cast("long").alias("tile"), F.lit(up == 0).alias("home")))
    rows = fps.select("fp", F.explode(F.array(*tiles)).alias("t")).select("t.tile", "fp", "t.home")
    sizes = rows.groupBy("tile").count().where(F.col("count") > tile_rows)
    parts = splittable(sizes.select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(parts, "tile", "left").select("tile", "fp", "home", own.alias("own"), other.alias("other"))
    sub = F.when(F.col("other") < 0, F.col("tile")).otherwise(
        F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other"))
    )
    rows = rows.select(sub.alias("tile"), "fp", "home")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return (
        rows.repartition(n, "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(lambda it: tile_links(it, radius), "u long, v long")
    )


def _roots(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root): each fingerprint, its least id and its component's least fingerprint."""
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    return classes.join(splittable(roots), classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, then text.

    Null ids come last. Fingerprints and links are those of ``near_duplicates``.
    """
    small_batches(docs.sparkSession, FEW_ROWS)
    at = docs.columns.index(text_col)
    columns, mark = docs.columns, fresh("_fp", docs.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in text_bytes(b.column(at))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(as_long(fps))], [*columns, mark])

    marked = docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(mark, LongType())]))
    own = lambda c: F.col(f"`{c}`")
    whole = F.struct(*(own(c) for c in columns))
    order = F.struct(own(id_col).isNull(), own(id_col), own(text_col))
    firsts = written(marked.groupBy(own(mark).alias("fp")).agg(F.min_by(whole, order).alias("row"), F.min(order).alias("order")), "firsts")
    fps = firsts.select("fp", F.col("row")[id_col].cast("long").alias("id"))
    roots = written(_roots(fps, radius).select("fp", "root"), "roots")
    found = firsts.join(splittable(roots), "fp").groupBy("root").agg(F.min_by("row", "order").alias("row"))
    return found.select("row.*")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and component.

    Rows link when their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest id reachable, the row's own included. Null and empty texts have the
    fingerprint zero and link like any other; repeated rows stay repeated; rows with a
    null id link as others do, and name a component only if no id is there (then null).
    An empty table gives an empty one; extra columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    classes = _roots(fps, radius)
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(classes.join(splittable(whole), "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
