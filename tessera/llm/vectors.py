"""Largest inner products of a stated query set against all rows, in blocks.

The vectors are written once and stay where they are. Queries come to them in blocks of a
bounded size, broadcast one after the other; nothing else is shuffled but what is found. A
pilot, a few of the rows and a bounded number, gives each query of a block a score that its
kth best reaches at least. The rows then take turns, each some times larger than all before
it, and after each turn the kth best scores found so far are passed on, so a turn reports
little that can't stand.

``one_bit_search``: randomly rotated one-bit codes. Inner products are estimated from
packed bits and two correction scalars; error bounds choose what is computed exactly.

``kd_search``: a KD-tree per shard of integer vectors. Tight boxes, those of inner nodes
first, tell which leaves can hold a score that counts; a query's leaves are visited best
first, and its kth score is carried from leaf to leaf, shard to shard and turn to turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ceil_div, shared_dir, shuffle_partitions, small_batches

#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 8 << 20
#: A turn is so many times larger than all before it; the pilot, the first of them, has at
#: most so many rows.
GROWTH, PILOT = 16, 8192
#: Rows of an Arrow batch, and of queries compared with it at once.
BATCH, TILE = 4096, 256
#: The error bound's width, in standard deviations of the rotation: of the rows that just
#: reach a query's kth score one in ten is taken for one that can't, of better rows fewer.
EPSILON = 1.28
#: Bits a query component is rounded to.
PLANES = 4
SEED = 20240229
LEAF = 64
SHARD = 16384


def dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products, components added in order: equal vectors score equally."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def _by_rank(query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by query, best score, id, row; scores may be whole numbers of any size."""
    order = np.lexsort((rows, ids))
    order = order[np.argsort(-score[order], kind="stable")]
    return order[np.argsort(query[order], kind="stable")]


class Best:
    """The ``k`` best of each query so far, and what its kth best reaches at least."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        none = np.empty(0, np.int64)
        self.held = (none, none.astype(np.float64), none, none)  # query, score, id, row

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = [np.concatenate(x) for x in zip(self.held, (query, score, ids, rows), strict=True)]
        order = _by_rank(*own)
        q = own[0][order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.held = tuple(x[order[place < self.k]] for x in own)
        last = order[place == self.k - 1]
        at, value = own[0][last], own[1][last].astype(np.float64)
        if own[1].dtype == object:
            value = np.nextafter(value, -np.inf)
        self.least[at] = np.maximum(self.least[at], value)


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for a width."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    own = np.packbits(bits, axis=-1)
    out = np.zeros((*own.shape[:-1], -(-own.shape[-1] // 8) * 8), dtype=np.uint8)
    out[..., : own.shape[-1]] = own
    return out.view(np.uint64)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the two scalars: norm, and the inner
    product of a unit vector with its own code."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    unit = (vectors / norm[:, None]) @ rotation(vectors.shape[1])
    return packed(unit > 0), norm, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


class OneBitScan:
    """A block of queries of one width, met with batches of coded vectors."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.rows, self.queries, self.best = rows, queries, Best(least, k)
        self.single = queries.astype(np.float32)
        self.d = d = queries.shape[1]
        self.size = np.sqrt((queries * queries).sum(axis=1))
        unit = (queries / self.size[:, None]) @ rotation(d)
        low = unit.min(axis=1)
        self.step = np.maximum(unit.max(axis=1) - low, 1e-30) / ((1 << PLANES) - 1)
        whole = np.rint((unit - low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [packed((whole >> b & 1).astype(bool)) for b in range(PLANES)]
        rounded = low[:, None] + self.step[:, None] * whole
        missed = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
        half = np.sqrt(d) / (2 * self.step)
        # What the sum over a code's ones must reach, as a product: see ``meet``.
        self.terms = np.stack([half / self.size, -half, rounded.sum(axis=1) / (2 * self.step) - half * missed, -low / self.step], axis=1)
        self.seen = self.scored = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, words: np.ndarray, norm: np.ndarray, align: np.ndarray) -> None:
        """Score what the estimates leave.

        The estimate of an inner product is size * norm * along / align, where ``along`` is the
        rotated, rounded query's product with the code; its error is bounded by size * norm *
        (EPSILON * spread + missed / align). That both reach the kth best score is solved for
        the sum of the rounded query over the code's ones, so a tile takes bit counts and one
        small matrix product.
        """
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        spread = EPSILON * np.sqrt(np.maximum(0, 1 - align * align) / max(1, self.d - 1))
        right = np.stack([align / norm, spread, np.ones(len(rows)), ones]).astype(np.float32)
        single = vectors.astype(np.float32)
        columns = np.ascontiguousarray(words.T)
        found = []
        for at in range(0, len(self.rows), TILE):
            part = slice(at, min(at + TILE, len(self.rows)))
            shape = (part.stop - at, len(rows))
            both, count, total = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.zeros(shape, np.int32 if self.d > 2000 else np.int16)
            for plane in reversed(self.planes):
                np.add(total, total, out=total)
                for w, column in enumerate(columns):
                    np.bitwise_and(plane[part, w, None], column, out=both)
                    np.bitwise_count(both, out=count)
                    np.add(total, count, out=total)
            left = self.terms[part].copy()
            left[:, 0] *= np.maximum(self.best.least[part], -1e25)
            left[:, 2] -= 0.05  # single precision may be off by less
            near = np.flatnonzero(total >= left.astype(np.float32) @ right)
            self.seen += total.size
            self.scored += len(near)
            for j in range(0, len(near), 1 << 14):
                x, y = np.divmod(near[j : j + (1 << 14)], len(rows))
                x += at
                guess = np.einsum("ij,ij->i", self.single[x], single[y])
                close = (guess >= self.best.least[x] - 1e-5 * self.size[x] * norm[y]) & (self.rows[x] != rows[y])
                found.append((x[close], y[close]))
        x, y = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        for j in range(0, len(x), 1 << 18):
            a, b = x[j : j + (1 << 18)], y[j : j + (1 << 18)]
            self.best.add(a, dots(self.queries[a], vectors[b]), ids[b], rows[b])


class KdTree:
    """Median splits of the widest side; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = [(0, len(points))]
        self.kids: list[int] = []  # the first of a node's two children, 0 for a leaf
        low, high = [], []
        at = 0
        while at < len(self.spans):
            a, b = self.spans[at]
            rows = self.order[a:b]
            own = points[rows]
            lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            side = int(np.argmax(hi - lo))
            if b - a <= leaf or lo[side] == hi[side]:
                self.kids.append(0)
            else:
                half = (b - a) // 2
                self.order[a:b] = rows[np.argsort(own[:, side], kind="stable")]
                self.kids.append(len(self.spans))
                self.spans += [(a, a + half), (a + half, b)]
            at += 1
        self.low, self.high = np.array(low), np.array(high)
        self.first = np.array(self.kids)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The most that any point of a node's box can score, by query and node."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T


class KdScan:
    """A block of integer queries of one width, met with shards of integer vectors."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.rows, self.queries, self.best = rows, queries, Best(least, k)
        self.leaves = self.visited = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        queries = self.queries
        most = max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0))
        if most * most * points.shape[1] >= 2**53:  # beyond doubles: whole numbers of any size
            queries, points = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (queries, points))
        elif points.dtype == object:
            queries, points = queries.astype(float), points.astype(float)
        tree = KdTree(points)
        for at in range(0, len(queries), 4 * TILE):
            part = np.arange(at, min(at + 4 * TILE, len(queries)))
            self._tile(tree, part, queries, rows, ids, points)

    def _tile(self, tree: KdTree, part: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        """Down the tree with the queries that a node may still serve, then best leaves first."""
        level, found = np.array([0]), []
        alive = np.ones((len(part), 1), dtype=bool)
        while len(level):
            bound = tree.bounds(queries[part], level)
            alive &= bound >= self.best.least[part][:, None]
            leaf = tree.first[level] == 0
            q, n = np.nonzero(alive[:, leaf])
            found.append((q, level[leaf][n], bound[:, leaf][q, n]))
            inner = ~leaf & alive.any(axis=0)
            level, alive = np.repeat(tree.first[level[inner]], 2), np.repeat(alive[:, inner], 2, axis=1)
            level[1::2] += 1
        q, leaf, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        self.leaves += len(part) * int((tree.first == 0).sum())
        order = np.argsort(-bound, kind="stable")
        order = order[np.argsort(q[order], kind="stable")]
        q, leaf, bound = q[order], leaf[order], bound[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        # Waves of 1, 2, 4... of each query's best leaves; a wave goes leaf by leaf.
        wave = np.frexp(place + 1.0)[1]
        for turn in np.unique(wave):
            now = np.flatnonzero((wave == turn) & (bound >= self.best.least[part[q]]))
            now = now[np.argsort(leaf[now], kind="stable")]
            self.visited += len(now)
            cuts = np.flatnonzero(np.r_[True, leaf[now][1:] != leaf[now][:-1], True]) if len(now) else []
            got = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                who = part[q[now[a:b]]]
                x, y = tree.spans[leaf[now[a]]]
                held = tree.order[x:y]
                score = queries[who] @ points[held].T
                i, j = np.nonzero((score >= self.best.least[who][:, None]) & (rows[held][None, :] != self.rows[who][:, None]))
                got.append((who[i], score[i, j], ids[held[j]], rows[held[j]]))
            if got:
                self.best.add(*(np.concatenate(x) for x in zip(*got, strict=True)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of one width as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _piloted(queries: np.ndarray, own: np.ndarray, pilot: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Best:
    """Each query's best of the pilot; the kth score is taken a little lower, for rounding."""
    best = Best(np.full(len(queries), -np.inf), k)
    for at in range(0, len(queries), TILE):
        score = queries[at : at + TILE] @ pilot.T
        score[own[at : at + TILE, None] == rows[None, :]] = -np.inf
        m = min(k, len(rows))
        kth = np.partition(score, len(rows) - m, axis=1)[:, len(rows) - m]
        x, y = np.nonzero((score >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & (score > -np.inf))
        for j in range(0, len(x), 1 << 16):
            a, b = x[j : j + (1 << 16)] + at, y[j : j + (1 << 16)]
            best.add(a, dots(queries[a], pilot[b]), ids[b], rows[b])
    best.least -= 1e-9 * (1 + np.abs(best.least))
    return best


def _search(
    table: DataFrame,
    every: int,
    k: int,
    usable,
    shaped: Callable[[np.ndarray], np.ndarray],
    coded: Callable[[DataFrame], DataFrame],
    piloted: Callable[..., Best],
    scan: Callable[[dict, Iterator[pa.RecordBatch]], Iterator[Best]],
    kind: pa.DataType,
    id_col: str,
    vec_col: str,
) -> DataFrame:
    """Write the vectors, bring the queries to them block by block and turn by turn, and rank.

    The pilot's rows are scored at once and take no turn.
    """
    spark = table.sparkSession
    small_batches(spark, BATCH)
    score_type = "long" if kind == pa.int64() else "double"
    wide = "array<float>" if dict(table.dtypes)[vec_col] == "array<float>" else "array<double>"
    own = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(wide).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).where(usable(F.col("v")))
    asks = F.col("id") % every == 0
    n, nq, widest = own.agg(F.count("*"), F.count(F.when(asks, 1)), F.max(F.size("v"))).first()
    if not nq:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    first = min(PILOT, ceil_div(n, GROWTH))
    ends = [first * GROWTH]
    while ends[-1] < n:
        ends.append(ends[-1] * GROWTH)
    chance = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) * (float(n) / (1 << 30))
    turn = sum((F.when(chance >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    at = f"{shared_dir(spark)}/tessera-vectors-{uuid.uuid4().hex}"
    # A number for each row, for good once written: rows of the same id stay apart.
    placed = own.repartition(shuffle_partitions(spark), "id").withColumn("row", F.monotonically_increasing_id())
    coded(placed.withColumn("turn", turn)).write.partitionBy("turn").parquet(f"{at}/rows")
    whole = spark.read.parquet(f"{at}/rows")
    pilot = whole.select("row", "id", "v").orderBy(F.xxhash64("row"), "row").limit(first).toArrow()  # at most PILOT rows
    spent = np.sort(pilot["row"].to_numpy())
    blocks = max(1, ceil_div(nq * 8 * (widest or 1), QUERY_BYTES))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("row")), F.lit(blocks))

    def apart(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
        size = pa.compute.list_value_length(rows["v"])
        for d in sorted(x for x in pa.compute.unique(size).to_pylist() if x):
            part = rows.filter(pa.compute.equal(size, d)).combine_chunks()
            yield d, shaped(_matrix(part["v"].combine_chunks(), d)), part

    known = {d: (m, t["id"].to_numpy(), t["row"].to_numpy()) for d, m, t in apart(pilot)}
    result = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", kind)])
    schema = f"query long, query_id long, id long, row long, score {score_type}"

    def reported(rows: np.ndarray, query_ids: np.ndarray, best: Best) -> pa.RecordBatch:
        q, score, ids, held = best.held
        if kind == pa.int64():
            score = np.array([min(2**63 - 1, max(-(2**63), int(x))) for x in score], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(query_ids[q]), pa.array(ids), pa.array(held), pa.array(score, kind)], schema=result)

    for b in range(blocks):
        asked, begun = {}, []
        for d, m, t in apart(whole.where(asks & (block == b)).select("row", "id", "v").toArrow()):  # about QUERY_BYTES
            rows, ids = t["row"].to_numpy(), t["id"].to_numpy()
            best = piloted(m, rows, *known[d], k) if d in known else Best(np.full(len(rows), -np.inf), k)
            begun.append(reported(rows, ids, best))
            asked[d] = (rows, ids, m, best.least)
        if not asked:
            continue
        spark.createDataFrame(pa.Table.from_batches(begun), schema).write.parquet(f"{at}/found/block={b}/number=0")
        for number in range(len(ends)):
            sent = spark.sparkContext.broadcast((asked, spent))

            def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                asked, spent = sent.value
                fresh = (b.filter(pa.array(~np.isin(b["row"].to_numpy(), spent))) for b in batches)
                for d, best in scan(asked, fresh):
                    yield reported(*asked[d][:2], best)

            whole.where(F.col("turn") == number).drop("turn").mapInArrow(each, schema).write.parquet(f"{at}/found/block={b}/number={number + 1}")
            sent.destroy()
            if number + 1 < len(ends):  # pass on what is known of the kth best
                so_far = spark.read.schema(schema).parquet(*(f"{at}/found/block={b}/number={i}" for i in range(number + 2)))
                place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
                kth = so_far.select("query", "score", place.alias("place")).where(F.col("place") == k).select("query", "score").toArrow()  # a row a query of the block
                passed = {int(q): x for q, x in zip(kth["query"].to_numpy(), kth["score"].to_pylist(), strict=True)}
                asked = {d: (r, i, m, np.array([max(x, passed.get(int(q), x)) for q, x in zip(r, least, strict=True)])) for d, (r, i, m, least) in asked.items()}
    found = spark.read.schema(schema).parquet(*(f"{at}/found/block={b}/number=*" for b in range(blocks)))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def one_bit_search(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    the query's own, so rows of the same id are queries and candidates of their own. Scores
    are exact, in double precision; which rows are scored is chosen by error bounds that
    hold with high probability, but for the pilot's, which all are. Rows with a null id take no part, nor do vectors that are
    null, empty, zero or hold null or non-finite components; vectors of different widths
    don't meet. Ties go to the smaller id. Without queries the result is empty; extra
    columns are ignored.
    """

    def coded(rows: DataFrame) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = b["v"].value_lengths()
                for d in pa.compute.unique(size).to_pylist():
                    part = b.filter(pa.compute.equal(size, d))
                    words, norm, align = codes(_matrix(part["v"], d))
                    raw = pa.array([x.tobytes() for x in words], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, raw, pa.array(norm), pa.array(align)], [*part.schema.names, "code", "norm", "align"])

        wide = dict(rows.dtypes)["v"]
        return rows.mapInArrow(each, f"id long, v {wide}, row long, turn int, code binary, norm double, align double")

    def scan(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Best]]:
        held = {d: OneBitScan(rows, m, least, k) for d, (rows, _, m, least) in asked.items()}
        for b in batches:
            size = b["v"].value_lengths()
            for d in pa.compute.unique(size).to_pylist():
                if d in held:
                    own = b.filter(pa.compute.equal(size, d))
                    words = np.frombuffer(b"".join(own["code"].to_pylist()), dtype=np.uint64).reshape(own.num_rows, -1)
                    held[d].meet(own["row"].to_numpy(), own["id"].to_numpy(), _matrix(own["v"], d), words, own["norm"].to_numpy(), own["align"].to_numpy())
        for d, x in held.items():
            yield d, x.best

    some = lambda v: F.exists(v, lambda x: x != 0)
    return _search(table, every, k, some, lambda m: m, coded, _piloted, scan, pa.float64(), id_col, vec_col)


def kd_search(table: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products.

    A component x counts as floor(``scale`` * x). Queries are the rows whose id is divisible
    by ``every``; candidates are all rows but the query's own, so rows of the same id are
    queries and candidates of their own. Rows with a null id take no part, nor do vectors
    that are null, empty or hold null or non-finite components; zero vectors do, and vectors
    of different widths don't meet. Ties go to the smaller id, and scores beyond a long are
    cut to it. Without queries the result is empty; extra columns are ignored.
    """
    shaped = lambda m: np.floor(m * scale)

    def piloted(queries: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Best:
        first = KdScan(own, queries, np.full(len(own), -np.inf), k)
        first.meet(rows, ids, points)
        return first.best

    def scan(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Best]]:
        held = {d: KdScan(rows, m, least, k) for d, (rows, _, m, least) in asked.items()}
        shard: dict[int, list] = {d: [] for d in held}

        def meet(d: int) -> None:
            if shard[d]:
                held[d].meet(*(np.concatenate(x) for x in zip(*shard[d], strict=True)))
                shard[d] = []

        for b in batches:
            size = b["v"].value_lengths()
            for d in pa.compute.unique(size).to_pylist():
                if d in held:
                    own = b.filter(pa.compute.equal(size, d))
                    shard[d].append((own["row"].to_numpy(), own["id"].to_numpy(), shaped(_matrix(own["v"], d))))
                    if sum(len(x[0]) for x in shard[d]) >= SHARD:
                        meet(d)
        for d, x in held.items():
            meet(d)
            yield d, x.best

    return _search(table, every, k, lambda v: F.size(v) > 0, shaped, lambda rows: rows.select("id", "v", "row", "turn"), piloted, scan, pa.int64(), id_col, vec_col)
