"""Embedding near-duplicates: random-hyperplane sign hashing.

Each of ``tables`` tables gives a vector the signs of its products with ``bits`` fixed random
planes; vectors of one label with equal signs in a table share a bucket. Pairs in a bucket are
compared by exact cosine in double precision, and components are formed from the links.

Equal vectors are one class, compared once. A bucket of any size is split into blocks by a hash of
the id, and each pair of blocks is a unit of work of bounded size: it yields one row for each
linked vector (how many vectors it is linked with there, and the smallest it is connected to), so
no pair list is ever written. A pair that meets in several tables counts in the first of them.

At cosine 0.98 two vectors agree in a sign with probability 0.936. The number of bits follows the
size of the largest label and the number of tables the bits, so that a pair at the threshold is
missed with probability 1e-5 at most, closer pairs far more rarely.

Edge cases: rows with a null label or id, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different lengths are never compared; repeated
rows (same id) are equal vectors and count as vectors; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import Scratch, connected_components, groups_of, seal, sized

THRESHOLD, LEAST_BITS, MISSED, BLOCK = 0.98, 12, 1e-5, 512


def planes(dim: int, n: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def signatures(m: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Signs of each row in each table, as integers (rows x tables)."""
    on = (m @ planes(m.shape[1], bits * tables) >= 0).reshape(len(m), tables, bits)
    return on @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def parameters(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for n vectors of one label.

    Bits grow with log2(n), so that unrelated vectors share a bucket about as often at any size; tables
    follow, so that a pair at the threshold is missed with probability MISSED at most.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n))) + 3)
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - met))


def missed(cosine: float, bits: int, tables: int) -> float:
    """Probability that a pair of this cosine meets in no table."""
    return (1 - (1 - math.acos(cosine) / math.pi) ** bits) ** tables


def _scaled(v: np.ndarray) -> np.ndarray:
    """The vector times a power of two, so that its largest component is near 1: exact, and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _signed(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, n, pool, signs, vec) with packed doubles from (id, n, pool, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_scaled(np.array(x, np.float64)) for x in batch.column(3).to_pylist()]
            signs: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i, row in zip(at, signatures(np.stack([vectors[i] for i in at]), bits, tables)):
                    signs[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(signs, pa.list_(pa.int64())), pa.array([v.tobytes() for v in vectors], pa.binary())], ["id", "n", "pool", "signs", "vec"])

    return rows.select("id", "n", "pool", "vec").mapInArrow(run, "id long, n long, pool long, signs array<long>, vec binary")


def _compare(ids: np.ndarray, n: np.ndarray, signs: np.ndarray, vectors: np.ndarray, block: np.ndarray, table: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, smallest id connected, linked vectors) of the members of a unit of work that have links."""
    length = np.sqrt((vectors * vectors).sum(1))
    linked = vectors @ vectors.T / np.outer(length, length) >= threshold
    np.fill_diagonal(linked, False)
    if not same:
        linked &= block[:, None] != block[None, :]
    for t in range(table):
        if not linked.any():
            break
        linked &= signs[:, t][:, None] != signs[:, t][None, :]
    links = linked @ n
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (low == root).all():
            break
        root = low
    has = links > 0
    return ids[has], root[has], links[has]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, bits: int | None = None, tables: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("valid", valid)
    rows = rows.withColumn("h1", F.when(F.col("valid"), F.xxhash64("label", "vec")))
    with Scratch(spark) as scratch:
        # a class is known by the hash of its vector, so that rows that repeat an id with another vector stay apart
        classes = rows.where("valid").groupBy(F.col("h1").alias("id")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        classes = scratch.save(classes.withColumn("pool", F.xxhash64("label", F.size("vec"))))
        if bits is None or tables is None:
            largest = classes.groupBy("pool").count().agg(F.max("count")).first()[0]
            bits, tables = parameters(largest or 0, threshold)
        signed = scratch.save(_signed(classes, bits, tables))
        slots = signed.select("id", "n", "signs", "vec", F.posexplode("signs").alias("t", "sign"), "pool").withColumn("bucket", F.xxhash64("pool", "t", "sign"))
        sizes = signed.select("pool", F.posexplode("signs").alias("t", "sign")).groupBy(F.xxhash64("pool", "t", "sign").alias("bucket")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sizes = scratch.save(sizes.select("bucket", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
        work = slots.join(sized(sizes), "bucket")
        own = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")
        work = work.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        work = work.withColumn("unit", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).withColumn("same", F.col("own") == F.col("other"))
        work = work.select("unit", "t", "own", "id", "n", "signs", "vec", (F.size(F.array_distinct(F.array("own", "other"))) == 1).alias("same"))
        # a unit of two blocks gets its rows from both; in a unit of one block all rows have same = true
        width = work.sparkSession.conf.get("spark.sql.shuffle.partitions")
        work = work.repartition(int(width), "unit").sortWithinPartitions("unit")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def unit(part: pa.Table) -> pa.RecordBatch | None:
                if part.num_rows < 2:
                    return None
                raw = part.column("vec").combine_chunks()
                m = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in raw])
                signs = np.array(part.column("signs").to_pylist(), np.int64)
                got = _compare(*(part.column(c).to_numpy() for c in ("id", "n")), signs, m, part.column("own").to_numpy(), part.column("t")[0].as_py(), part.column("same")[0].as_py(), threshold)
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["id", "root", "links"]) if len(got[0]) else None

            for part in groups_of(batches, "unit"):
                if (out := unit(part)) is not None:
                    yield out

        found = scratch.save(work.mapInArrow(run, "id long, root long, links long"))
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        components = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
        merged = classes.select("id", "first", "n").join(counts, "id", "left").join(components, "id", "left").where("n > 1 or links is not null")
        merged = scratch.save(merged.select("id", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("group")))
        lead = merged.groupBy("group").agg(F.min("first").alias("component"))
        merged = scratch.save(merged.join(lead, "group").select(F.col("id").alias("h1"), "n_links", "component"))
        out = rows.select("id", "h1").alias("r").join(sized(merged, 1_000_000).alias("m"), F.expr("r.h1 = m.h1"), "left")
        component = F.coalesce("component", "id")
        out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
        return seal(out).withColumnRenamed("id", id_col)
