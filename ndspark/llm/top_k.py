"""Exact top-k search by inner product, block at a time.

Components become whole numbers, floor(scale * x). Vectors are ordered by the signs of a few fixed
random projections (similar ones lie together), and each range of the order is a shard: blocks of
``BLOCK`` vectors, stored as packed rows (the forward index), with the largest and the smallest value
of each component (term) in a block. For a query q a block's bound is the sum over its terms of the
larger of q_t * max_t and q_t * min_t: no vector of the block scores more.

A query visits the blocks of a shard in the order of their bounds, in steps of 1, 2, 4, ... blocks,
scores them through the packed rows and stops once the next bound is below its k-th score so far (equal
bounds are visited, as ties go to the smaller id). It begins with the shard whose range it falls into, while that is
packed; the k-th score found there goes with it to all other shards, which are units of bounded work:
one shard and a group of queries. Units return scores that reach the k-th one, at most k a query, and the best of them remain.

Scores are exact: products are summed as doubles where they stay below 2**53, else as Python integers;
values or scores beyond the range of a long are the nearest long.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; vectors of different lengths are never compared; vectors of no components score 0; a candidate with the query's id is the query
itself; rows that repeat id and vector are one query, and each counts as a candidate of other ids; with fewer
than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ndspark.llm.common import Scratch, rows_of, seal, sized

K, SCALE = 5, 256
#: Vectors of a block and of a shard, queries of a unit of work, bits of the order's key.
BLOCK, SHARD, QUERIES, KEY_BITS = 32, 4096, 4096, 16
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact; those that a long doesn't hold are the nearest one."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if (np.abs(x).max(0) * np.abs(y).max(0)).sum() < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LEAST, _MOST).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no vector of a block exceeds, for each query and block."""
    both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    return products(both, np.concatenate([high, low], axis=1))


class Best:
    """The k best (score, id) of each query so far; equal scores by id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), _LEAST), np.full((n, k), _MOST), k
        self.found = np.zeros((n, k), bool)

    @property
    def kth(self) -> np.ndarray:
        return np.where(self.found[:, -1], self.scores[:, -1], _LEAST)

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of queries ``who``."""
        some = np.unique(who)
        old = np.nonzero(self.found[some])
        who = np.concatenate([some[old[0]], who])
        scores = np.concatenate([self.scores[some][old], scores])
        ids = np.concatenate([self.ids[some][old], ids])
        order = np.lexsort((ids, np.invert(scores), who))
        who, scores, ids = who[order], scores[order], ids[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = place < self.k
        self.found[some] = False
        at = who[first], place[first]
        self.scores[at], self.ids[at], self.found[at] = scores[first], ids[first], True


def search(q: np.ndarray, own: np.ndarray, shard: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int, least: np.ndarray | None = None, block: int = BLOCK) -> tuple[Best, int]:
    """The best of a shard (ids, rows, high, low) for each query, none below ``least``; and the number of blocks scored, over all queries."""
    ids, rows, high, low = shard
    best, scored = Best(len(q), k), 0
    least = np.full(len(q), _LEAST) if least is None else least
    bound = bounds(q, high, low)
    order = np.argsort(np.invert(bound), axis=1, kind="stable")
    at, step = 0, 1
    while at < bound.shape[1]:
        columns = order[:, at : at + step]
        enough = np.maximum(best.kth, least)
        who, place = np.nonzero(np.take_along_axis(bound, columns, 1) >= enough[:, None])
        if not len(who):
            break
        which = columns[who, place]
        by_block = np.argsort(which, kind="stable")
        who, which = who[by_block], which[by_block]
        scored += len(who)
        hits = []
        for b, first in zip(*np.unique(which, return_index=True)):
            mine = who[first : np.searchsorted(which, b, "right")]
            s = products(q[mine], rows[b * block : (b + 1) * block])
            i, j = np.nonzero((s >= enough[mine][:, None]) & (ids[b * block : (b + 1) * block][None, :] != own[mine][:, None]))
            hits.append((mine[i], s[i, j], ids[b * block + j]))
        best.take(*(np.concatenate(x) for x in zip(*hits)))
        at, step = at + step, 2 * step
    return best, scored


def _key(m: np.ndarray) -> np.ndarray:
    """Signs of fixed random projections, as an integer."""
    if not m.shape[1]:
        return np.zeros(len(m), np.int64)
    planes = np.random.default_rng(29).standard_normal((m.shape[1], KEY_BITS))
    return (m.astype(np.float64) @ planes >= 0) @ (np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)[::-1])


_PACKED = "dim int, key long, id long, vec binary, candidate boolean, query boolean"
_UNIT = "shard long, dim int, n int, ids binary, rows binary, high binary, low binary, queries int, own binary, q binary, scores binary, found_ids binary, counts binary, scored long"


def _whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec) of the rows that take part, with whole components."""
    x = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).select("id", F.transform("x", lambda x: _floor(x * F.lit(float(scale)))).alias("vec"))


def _floor(x: Column) -> Column:
    """As a long, the nearest one beyond its range."""
    return F.when(x >= 2.0**63, F.lit(_MOST)).when(x < -(2.0**63), F.lit(_LEAST)).otherwise(F.floor(x))


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(x, np.int64) for x in batch.column("vec").to_pylist()]
            keys = np.zeros(len(vectors), np.int64)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                keys[at] = _key(np.stack([vectors[i] for i in at]))
            columns = [pa.array([len(v) for v in vectors], pa.int32()), pa.array(keys), batch.column("id"), pa.array([v.tobytes() for v in vectors], pa.binary()), batch.column("candidate"), batch.column("query")]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "key", "id", "vec", "candidate", "query"])

    return rows.select("id", "vec", "candidate", "query").mapInArrow(run, _PACKED)


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, dim)


def _shards(rows: DataFrame, k: int, size: int) -> DataFrame:
    """Shards with the queries of their range, which are searched in them at once (``_UNIT``); rows come in order."""

    def one(shard: int, dim: int, members: list[tuple[int, bytes]], asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, m = np.array([i for i, _ in members], np.int64), _matrix(b"".join(v for _, v in members), dim, len(members))
        own, q = np.array([i for i, _ in asked], np.int64), _matrix(b"".join(v for _, v in asked), dim, len(asked))
        cuts = range(0, len(m), BLOCK)
        high, low = (np.stack([f(m[c : c + BLOCK], axis=0) for c in cuts]) if len(m) else m for f in (np.max, np.min))
        best, scored = search(q, own, (ids, m, high, low), k) if len(q) and len(m) else (Best(len(q), k), 0)
        values = [shard, dim, len(m), ids.tobytes(), m.tobytes(), high.tobytes(), low.tobytes(), len(q), own.tobytes(), q.tobytes(), best.scores.tobytes(), best.ids.tobytes(), best.found.sum(1).tobytes(), scored]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 5, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in _UNIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[tuple[int, bytes]] = []
        asked: list[tuple[int, bytes]] = []
        now, shard = None, None
        for batch in batches:
            for part, dim, i, vec, candidate, query in zip(*(batch.column(c).to_pylist() for c in ("part", "dim", "id", "vec", "candidate", "query"))):
                shard = part << 32 if shard is None else shard
                if now is not None and (dim != now or len(members) >= size or len(asked) >= QUERIES):
                    yield one(shard, now, members, asked)
                    members, asked, shard = [], [], shard + 1
                now = dim
                if candidate:
                    members.append((i, vec))
                if query:
                    asked.append((i, vec))
        if now is not None:
            yield one(shard, now, members, asked)

    return rows.select(F.spark_partition_id().cast("long").alias("part"), "dim", "id", "vec", "candidate", "query").mapInArrow(run, _UNIT)


def _elsewhere(k: int):
    """Scores of a group of queries in one shard that reach the k-th score of their own shard."""

    def run(shards: pa.Table, groups: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        scored = 0
        for s in shards.to_pylist():
            dim, n = s["dim"], s["n"]
            blocks = -(-n // BLOCK)
            shard = np.frombuffer(s["ids"], np.int64), _matrix(s["rows"], dim, n), _matrix(s["high"], dim, blocks), _matrix(s["low"], dim, blocks)
            mine = [g for g in groups.to_pylist() if g["dim"] == dim and g["home"] != s["shard"]]
            if not mine or not n:
                continue
            q = np.concatenate([_matrix(g["q"], dim, g["queries"]) for g in mine])
            own = np.concatenate([np.frombuffer(g["own"], np.int64) for g in mine])
            counts = np.concatenate([np.frombuffer(g["counts"], np.int64) for g in mine])
            last = np.concatenate([_matrix(g["scores"], k, g["queries"]) for g in mine])[:, -1]
            number = np.concatenate([g["home"] * QUERIES * 2 + np.arange(g["queries"]) for g in mine])
            best, blocks_scored = search(q, own, shard, k, np.where(counts == k, last, _LEAST))
            scored += blocks_scored
            who, place = np.nonzero(best.found)
            out.append((number[who], own[who], best.ids[who, place], best.scores[who, place]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["query", "query_id", "id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of each query; without ``queries`` every vector asks."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = _whole(vectors, id_col, vec_col, scale).select("*", F.lit(True).alias("candidate"), F.lit(False).alias("query"))
        asking = _whole(vectors if queries is None else queries, id_col, vec_col, scale).distinct().select("*", F.lit(False).alias("candidate"), F.lit(True).alias("query"))
        packed = scratch.save(_packed(rows.unionByName(asking)))
        parts = max(1, -(-rows_of(packed) // size), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_of(packed) // BLOCK)))
        # repeated vectors are told apart by id and hash, so that no range holds more than its share
        order = ["dim", "key", "id", F.xxhash64("vec", "candidate")]
        shards = scratch.save(_shards(packed.repartitionByRange(parts, *order).sortWithinPartitions(*order), k, size))
        # dense numbers of shards: one row a partition is summed up
        part = F.shiftright("shard", 32)
        counts = shards.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("shards"), F.sum("queries").alias("asked"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = scratch.save(counts.select("part", "shards", "asked", F.coalesce(F.sum("shards").over(before), F.lit(0)).alias("before")))
        total, asked = counts.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
        numbered = shards.withColumn("part", part).join(sized(counts.select("part", "before")), "part").withColumn("number", F.col("before") + F.col("shard").bitwiseAND(F.lit((1 << 32) - 1))).drop("part", "before")
        groups = max(1, -(-asked // QUERIES))
        group = F.pmod(F.xxhash64("number"), F.lit(groups))
        held = numbered.where("queries > 0").select(group.alias("group"), F.col("number").alias("home"), "dim", "queries", "own", "q", "scores", "found_ids", "counts")
        asks = held.drop("found_ids")
        asks = asks.toDF(*asks.columns).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, total - 1)).cast("long"))))
        blocks = numbered.where("n > 0").select("number", F.col("number").alias("shard"), "dim", "n", "ids", "rows", "high", "low").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        away = blocks.groupBy("number", "group").cogroup(asks.groupBy("number", "group")).applyInArrow(_elsewhere(k), "query long, query_id long, id long, score long")

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.to_pylist():
                    n = g["queries"]
                    found = np.arange(k)[None, :] < np.frombuffer(g["counts"], np.int64)[:, None]
                    who, place = np.nonzero(found)
                    own, scores, ids = np.frombuffer(g["own"], np.int64), _matrix(g["scores"], k, n), _matrix(g["found_ids"], k, n)
                    columns = [g["home"] * QUERIES * 2 + who, own[who], ids[who, place], scores[who, place]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query", "query_id", "id", "score"])

        found = held.mapInArrow(home, "query long, query_id long, id long, score long").unionByName(away)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return seal(best.select("query_id", "rank", F.col("id").alias(id_col), "score"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
