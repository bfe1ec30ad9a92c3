"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``bits // 2 + 1`` segments, so of two fingerprints that differ in at most ``bits`` bits at
least one segment pair differs in at most one. Each fingerprint is indexed once under every segment, and once for each bit
of a segment with that bit as a wildcard. Equal variants are joined and the pairs verified on all 64 bits.

Copies collapse first: the work is on distinct fingerprints. A variant shared by more than ``BUCKET`` fingerprints is never
paired. Its members are linked exactly through balls instead: fingerprints within 2 bits of each other have a common
point at most 1 bit away from both, so each member is listed under itself and its 64 one-bit neighbours, and the members of
one point (at most 65 exist) are joined to the smallest. This holds for ``bits`` of 2, the contract; for 1 the links are verified
again; larger values are refused. Components come from alternating star contractions, whose groups are combined before the shuffle.

Defined cases: null text is empty text; texts without words have fingerprint 0 and link like any other; fewer words than a shingle
are one shingle; repeated rows and rows with the same doc_id each get a row; component_id ignores null doc_ids and is null if a
component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import if_small, small_batches
from tablewright.session import durable

SHINGLE, BITS, SEED = 3, 2, 42
BUCKET = 32
CHUNK = 1 << 15  # shingle hashes unpacked at a time


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash; ``bytes.split`` and ``bytes.lower`` know exactly the ASCII white space and letters meant."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at:at + CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, th (hash of the text) and fp of every row."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return docs.select("doc_id", F.xxhash64("text").alias("th"), fp("text").alias("fp"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _variants(points: DataFrame, segments: int) -> DataFrame:
    """fp and key: segment number, wildcard place and remaining bits in one number."""
    width = 64 // segments

    def of(s: int) -> list[Column]:
        bits = width if s < segments - 1 else 64 - width * (segments - 1)
        value = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        place = F.lit(s * 65).cast("bigint")
        hole = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.struct((place + 1 + i).alias("at"), value.bitwiseAND(F.bitwise_not(_bit(i))).alias("v")))
        return [F.array(F.struct(place.alias("at"), value.alias("v"))), hole]

    keys = [k for s in range(segments) for k in of(s)]
    return points.select("fp", F.explode(F.concat(*keys)).alias("k")).select("fp", "k.at", "k.v")


def links(points: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: enough links between distinct fingerprints ``fp`` to keep every component whole.

    Each link is between fingerprints at most ``bits`` apart, and each pair that near is connected by links."""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    # one row becomes 66: spread the few input files first, so that no task's map-side groups are large
    spread = points.select("fp").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = _variants(spread, bits // 2 + 1)
    groups = durable(index.groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = groups.where("n = 2").select("a", "b").where(near)
    more = index.join(if_small(groups.where("n > 2").select("at", "v", "n")), ["at", "v"])
    more = durable(more)
    some = more.where(F.col("n") <= bucket)
    verified = some.select("at", "v", F.col("fp").alias("a")).join(some.select("at", "v", F.col("fp").alias("b")), ["at", "v"]).where(F.col("a") < F.col("b")).where(near)
    crowd = more.where(F.col("n") > bucket).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i)))
    balls = crowd.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("_all"))
    starred = balls.where(F.size("_all") > 1).select("a", F.explode("_all").alias("b")).where(F.col("a") < F.col("b")).where(near)
    return pairs.union(verified.select("a", "b")).union(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (a, b)."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:  # every node hangs on its root
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, th, fp, root (the component's fingerprint) and component_id of every row."""
    with small_batches(docs.sparkSession):
        rows = durable(fingerprints(docs, shingle))
    points = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = durable(components(links(points, bits)))
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(member, F.col("fp") == F.col("_fp")).drop("_fp")


def report(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id."""
    out = grouped(docs, shingle, bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id (of rows alike in it the smallest text hash; null
    comes last), once."""
    out = durable(grouped(docs, shingle, bits).select("doc_id", "th", "root"))
    stay = durable(out.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("th").alias("h"))).alias("s")).select("s.d", "s.h"))
    # columns are named through their tables: docs may hold columns of any name
    kept = docs.join(if_small(stay), docs["doc_id"].eqNullSafe(stay["d"]) & (F.xxhash64(docs["text"]) == stay["h"]), "left_semi")
    twice = out.join(if_small(stay), out["doc_id"].eqNullSafe(stay["d"]) & (out["th"] == stay["h"]), "left_semi")
    twice = durable(twice.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).count().where("count > 1"))
    if not twice.limit(1).count():
        return kept
    repeated = docs["doc_id"].eqNullSafe(twice["d"]) & (F.xxhash64(docs["text"]) == twice["h"])
    mark = if_small(twice)
    once = kept.join(mark, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(mark, repeated, "left_anti").unionByName(once)
