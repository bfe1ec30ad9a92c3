"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is padded with zeros to a power of two, normalised and rotated at random (sign flips and Hadamard transforms). Its code keeps the sign of
each coordinate, and with it a correction factor, the inner product of the vector and its own code. For the other side of a pair the rotated vector is kept in
4 bits a coordinate. Code times 4-bit vector over the factor is an unbiased estimate of the cosine; its confidence bound (``WIDTH`` standard
deviations of a pair at the limit, rounding included) rules a pair out or sends it on to be computed exactly from the stored vectors in double precision. Only pairs computed exactly, or
implied by exact cosines (below), are links.

Candidates share one of ``bands`` keys: the largest coordinates, with sign, of a few more random rotations (cross-polytope hashing). The number of rotations in
a key follows the number of vectors, and there are as many bands as it takes for a pair just at the limit to share none with a probability of ``MISS`` (found by a simulation with
a fixed seed); pairs above the limit are missed less often. A pair is compared in its first common band only.

Equal vectors collapse first. Keys with more than ``BLOCK`` members are cut into blocks by a hash, and pairs of blocks are compared in tasks of their own. So
that a large group of near copies does not cost its square, each member of such a key may belong to the ball of a pivot: all vectors within half the limit's angle of
it (exact). Two members of one ball are always within the limit, so they are counted, not compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component;
vectors of different lengths never link; ``component_id`` ignores null vec_ids and is null if a component has no other, ``kept`` is then true for null ids;
repeated rows and repeated vec_ids each get a row and count as vectors; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import if_small, small_batches
from tablewright.llm.neardup import components
from tablewright.session import durable

LIMIT, MISS, WIDTH, SEED = 0.9, 0.0005, 5.0, 42
BLOCK = 128
FILL = 4  # vectors that share a key by chance, about
PAIRS = 1 << 17  # pairs estimated at a time
LEAST = 64  # coordinates of a code
CODES = "node long, dim int, code binary, factor float, low float, step float, query binary, keys binary, parts array<long>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """The rows after random rotation ``number``: three rounds of sign flips and transforms."""
    flips = np.random.default_rng((seed, number)).integers(0, 2, (3, x.shape[1])).astype(x.dtype) * 2 - 1
    for f in flips:
        x = hadamard(x * f)
    return x


def corner(x: np.ndarray) -> np.ndarray:
    """Number of the signed axis nearest to each row."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def settings(vectors: int, width: int, limit: float = LIMIT, miss: float = MISS) -> tuple[int, int]:
    """Rotations in a key, and bands."""
    rotations = max(1, round(math.log(max(vectors, 2) / FILL) / math.log(2 * width)))
    r = np.random.default_rng(SEED)
    x, y = r.standard_normal((20_000, width)), r.standard_normal((20_000, width))
    share = float(np.mean(corner(x) == corner(limit * x + math.sqrt(1 - limit * limit) * y)))
    return rotations, math.ceil(math.log(miss) / math.log1p(-share**rotations))


def key_type(rotations: int, width: int) -> str:
    bits = rotations * math.log2(2 * width)
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


def encoded(x: np.ndarray, rotations: int, bands: int) -> dict[str, np.ndarray]:
    """Code, factor, 4-bit vector and band keys of the rows, which are unit vectors of full width."""
    n, width = x.shape
    turned = rotated(x, 0)
    positive = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(width)  # with the code's signs over sqrt(width), its unit vector
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    shift = np.random.default_rng((SEED, -1 % (1 << 32))).random(width)  # rounded up or down at random, the same way on every run
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + shift), 0, 15).astype(np.uint8)
    kind = key_type(rotations, width)
    keys = np.zeros((n, bands), dtype=np.uint64)
    half = x.astype(np.float32)
    for band in range(bands):
        for i in range(rotations):
            keys[:, band] = keys[:, band] * np.uint64(2 * width) + corner(rotated(half, 1 + band * rotations + i)).astype(np.uint64)
    return {"code": np.packbits(positive, axis=1, bitorder="little"), "factor": factor.astype(np.float32), "low": low.astype(np.float32), "step": step.astype(np.float32),
            "query": levels[:, ::2] | levels[:, 1::2] << 4, "keys": keys.astype(kind), "parts": keys.view(np.int64)}


def bound(factor: np.ndarray, step: np.ndarray, width: int, limit: float = LIMIT) -> np.ndarray:
    """Half-width of the estimate's confidence interval for pairs at or above the limit: code with this factor, 4-bit vector with this step.

    The error comes from the part of the second vector that is orthogonal to the first, so it shrinks with the sine of their angle."""
    spread = (1 - limit * limit) * np.maximum(1 - factor * factor, 0) / (factor * factor * (width - 1)) + (step / 2) ** 2 / (factor * factor)
    return WIDTH * np.sqrt(spread)


class Side:
    """Unpacked rows of a batch: signs of the code over sqrt(width), and the 4-bit vector."""

    def __init__(self, rows: dict[str, np.ndarray], width: int):
        self.sign = (np.unpackbits(rows["code"], axis=1, bitorder="little").astype(np.float32) * 2 - 1) / np.float32(math.sqrt(width))
        levels = np.empty((len(self.sign), width), dtype=np.float32)
        levels[:, ::2], levels[:, 1::2] = rows["query"] & 15, rows["query"] >> 4
        self.vector = rows["low"][:, None] + rows["step"][:, None] * levels
        self.factor, self.step, self.width = rows["factor"], rows["step"], width

    def estimate(self, code: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Estimated cosine for pairs of row numbers."""
        return np.einsum("ij,ij->i", self.sign[code], self.vector[query]) / self.factor[code]

    def upper(self, code: np.ndarray, query: np.ndarray, limit: float = LIMIT) -> np.ndarray:
        return self.estimate(code, query) + bound(self.factor[code], self.step[query], self.width, limit)


def _fixed(column: pa.Array, kind: str = "u1") -> np.ndarray:
    """Rows of a binary column of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "u1")[start[0]:start[-1]]
    return data.view(kind).reshape(len(column), -1)


def candidates(rows: dict[str, np.ndarray], width: int, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs of whole groups, in order of group and side, whose cosine may reach the limit."""
    n = len(rows["node"])
    group, second = rows["group"], rows["side"] == 1
    new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
    size = np.diff(np.append(new, n))
    end = np.repeat(np.append(new[1:], n), size)
    seconds = np.repeat(np.add.reduceat(second.astype(np.int64), new), size)
    # one block with itself: all rows behind; two blocks: rows of the first with all of the second
    start = np.where(seconds > 0, end - seconds, np.arange(n) + 1)
    crossed = np.repeat(rows["group"][new, 2] != rows["group"][new, 3], size)
    count = np.where(crossed, np.where(second, 0, seconds), end - np.arange(n) - 1)
    start = np.where(crossed, start, np.arange(n) + 1)
    side, found = Side(rows, width), []
    total = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:to]
        a = np.repeat(np.arange(at, to), c)
        b = np.repeat(start[at:to] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        at = to
        use = (rows["dim"][a] == rows["dim"][b]) & ((rows["ball"][a] < 0) | (rows["ball"][a] != rows["ball"][b]))
        a, b = a[use], b[use]
        earlier = (rows["keys"][a] == rows["keys"][b]) & (np.arange(rows["keys"].shape[1]) < rows["group"][a, 0][:, None])
        use = ~earlier.any(axis=1)
        a, b = a[use], b[use]
        use = np.minimum(side.upper(a, b, limit), side.upper(b, a, limit)) >= limit
        found.append((rows["node"][a[use]], rows["node"][b[use]]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (na * nb)


def distinct(vectors: DataFrame) -> DataFrame:
    """node, vec, v (double, scaled by a power of two), norm, copies and first (smallest vec_id) of every usable vector, copies collapsed."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    once = usable.groupBy(F.col("embedding").alias("vec")).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    wide = F.transform("vec", lambda x: x.cast("double"))
    # scaling by a power of two changes no digit, and keeps squares within range
    scale = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(F.array_max(F.transform(wide, F.abs)))).cast("double"))))
    out = once.withColumn("v", wide).withColumn("_scale", scale).withColumn("v", F.transform("v", lambda x: x / F.col("_scale")))
    return durable(out.select("vec", "v", "copies", "first").withColumn("norm", _norm(F.col("v"))).withColumn("node", F.monotonically_increasing_id()))


def codes(nodes: DataFrame, width: int, rotations: int, bands: int) -> DataFrame:
    """The code table: one row for each node."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(dims), width))
            owner = np.repeat(np.arange(len(dims)), dims)
            x[owner, np.arange(len(owner)) - np.repeat(np.cumsum(dims) - dims, dims)] = lists.flatten().to_numpy()
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            made = encoded(x, rotations, bands)
            binary = [pa.array([r.tobytes() for r in made[c]], pa.binary()) for c in ("code", "query", "keys")]
            starts = pa.array(np.arange(len(dims) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims.astype(np.int32)), binary[0], *[pa.array(made[c]) for c in ("factor", "low", "step")], binary[1], binary[2],
                 pa.ListArray.from_arrays(starts, pa.array(made["parts"].reshape(-1)))],
                ["node", "dim", "code", "factor", "low", "step", "query", "keys", "parts"])

    with small_batches(nodes.sparkSession, 4_000):
        return durable(nodes.select("node", "v").mapInArrow(rows, CODES))


def exact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their cosine from the stored vectors."""
    left = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.size("va") == F.size("vb")).select("a", "b", _cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")).alias("cosine"))


def balls(index: DataFrame, nodes: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame | None:
    """node and ball (its pivot): members of crowded keys within half the limit's angle of a key's smallest member; of several the
    pivot with most members. None without crowded keys."""
    crowded = durable(index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where(F.col("n") > block))
    if not crowded.limit(1).count():
        return None
    tried = index.join(if_small(crowded.select("band", "key", "pivot")), ["band", "key"]).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = math.sqrt((1 + limit) / 2) + 1e-9
    inside = durable(exact(tried, nodes).where(F.col("cosine") >= near).select("a", "b"))
    sizes = inside.groupBy("b").agg(F.count(F.lit(1)).alias("members"))
    best = inside.join(if_small(sizes), "b").groupBy("a").agg(F.max(F.struct("members", "b")).alias("m"))
    return durable(best.select(F.col("a").alias("node"), F.col("m.b").alias("ball")))


def _dealt(index: DataFrame, ball: DataFrame | None, block: int) -> DataFrame:
    """node, band, key, p, q, side and ball: every pair of members that needs comparing meets in one group (band, key, p, q).

    The members of a crowded key's largest ball are not compared with each other: their blocks meet only the blocks of the others."""
    plain = {"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)}
    if ball is None:
        return index.withColumns(plain).withColumn("ball", F.lit(-1).cast("bigint"))
    counts = index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    members = index.join(if_small(counts.select("band", "key")), ["band", "key"]).join(ball, "node", "left")
    per = durable(members.groupBy("band", "key", "ball").agg(F.count(F.lit(1)).alias("n")))
    main = per.groupBy("band", "key").agg(F.max(F.when(F.col("ball").isNotNull(), F.struct("n", "ball"))).alias("m"), F.sum("n").alias("n"))
    main = durable(main.select("band", "key", F.coalesce("m.ball", F.lit(-1)).alias("main"), "n", F.coalesce("m.n", F.lit(0)).alias("in"))
                   .select("band", "key", "main", F.ceil((F.col("n") - F.col("in")) / block).cast("int").alias("others"), F.ceil(F.col("in") / block).cast("int").alias("mains")))
    joined = index.join(ball, "node", "left").join(if_small(main), ["band", "key"], "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("bigint")))
    few = joined.where("main IS NULL").select("node", "band", "key", *[v.alias(c) for c, v in plain.items()], "ball")
    own = F.pmod(F.xxhash64("node", "band"), F.when(F.col("ball").eqNullSafe(F.col("main")) & (F.col("ball") >= 0), F.col("mains")).otherwise(F.col("others"))).cast("int")
    is_main = (F.col("ball") >= 0) & (F.col("ball") == F.col("main"))
    many = joined.where("main IS NOT NULL AND others > 0").withColumn("_own", F.when(is_main, F.col("others") + own).otherwise(own))
    meets = F.when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    many = many.withColumn("_with", F.explode(meets)).withColumns({"p": F.least("_own", "_with"), "q": F.greatest("_own", "_with")})
    return few.unionByName(many.withColumn("side", F.when(F.col("_own") == F.col("p"), 0).otherwise(1)).select(few.columns))


def links(nodes: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, cosine) with a < b of linked nodes found, those of one ball left out; and node, ball of the balls' members."""
    size = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(LEAST, 1 << max(0, (size[1] or 1) - 1).bit_length())
    rotations, bands = settings(size[0], width, limit)
    table = codes(nodes, width, rotations, bands)
    index = table.select("node", F.posexplode("parts").alias("band", "key"))
    ball = balls(index, nodes, limit, block)
    # the packed rows are narrow: a code, four bits a coordinate and the keys
    payload = table.drop("parts").join(_dealt(index, ball, block), "node")
    order = ["band", "key", "p", "q", "side", "node"]
    ready = payload.repartition("band", "key", "p", "q").sortWithinPartitions(*order)
    kind = key_type(rotations, width)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(whole: pa.Table) -> pa.RecordBatch:
            cols = {c: whole.column(c) for c in whole.column_names}
            rows = {c: cols[c].to_numpy() for c in ("node", "dim", "factor", "low", "step", "ball", "side")}
            rows |= {"code": _fixed(cols["code"]), "query": _fixed(cols["query"]), "keys": _fixed(cols["keys"], kind)}
            rows["group"] = np.stack([cols[c].to_numpy().astype(np.int64) for c in ("band", "key", "p", "q")], axis=1)
            a, b = candidates(rows, width, limit)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in parts:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            last = [now.column(c)[-1].as_py() for c in order[:4]]
            same = np.logical_and.reduce([now.column(c).to_numpy() == v for c, v in zip(order, last)])
            cut = int(np.argmax(same))  # rows are in order: from here on the last group, which may go on
            if cut:
                yield done(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield done(held)

    with small_batches(nodes.sparkSession, 20_000):
        close = durable(ready.mapInArrow(compare, "a long, b long"))
    return durable(exact(close, nodes).where(F.col("cosine") >= limit)), ball


def report(vectors: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    nodes = distinct(vectors)
    found, ball = links(nodes, limit, block)
    weight = nodes.select("node", "copies")
    sides = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = sides.join(weight.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
    edges = found.select("a", "b")
    if ball is not None:
        held = ball.join(weight, "node")
        sizes = held.groupBy("ball").agg(F.sum("copies").alias("_all"))
        count = count.unionByName(held.join(if_small(sizes), "ball").select("node", (F.col("_all") - F.col("copies")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
        edges = edges.unionByName(ball.select(F.col("node").alias("a"), F.col("ball").alias("b")).where("a <> b"))
    roots = components(edges).select(F.col("node").alias("_node"), "root")
    placed = nodes.select("vec", "node", "copies", "first").join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    placed = durable(placed.join(count, "node", "left").select("vec", "root", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.join(smallest, "root").select("vec", "n_links", "component_id", F.lit(True).alias("_usable"))
    out = vectors.select("vec_id", F.col("embedding").alias("vec")).join(member, "vec", "left")
    of = F.when(F.col("_usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), of.alias("component_id"), F.col("vec_id").eqNullSafe(of).alias("kept"))
