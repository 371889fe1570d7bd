"""Shared pieces of the corpus operators: scratch storage, size-checked joins,
token hashing and distributed connected components.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names; it is
set here only in local mode and only where the session has none.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and has at most this many (slim) rows.
BROADCAST_ROWS = 500_000

WORD = re.compile(r"\w+")
_CACHE_WORDS = 60_000
#: Texts whose words are held as one sequence at a time.
GROUP = 64
#: Rows of a scratch file at most, where they are few; of those that cost milliseconds each.
FILE_ROWS, COSTLY_ROWS = 32_768, 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one in local mode without any."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="ndspark-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


#: Rows and bytes of an Arrow batch while operators run their own jobs: batches are held outside the heap and in Python.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for the jobs of this block; the session's settings are put back after it."""
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Written intermediate tables, removed when the block ends.

    What leaves the block must not read them any more: pass it through ``seal``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.batches = small_batches(spark)

    def __enter__(self) -> Scratch:
        self.batches.__enter__()
        return self

    def __exit__(self, *failure: object) -> None:
        self.batches.__exit__(*failure)
        self.drop(self.root)

    def save(self, df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
        """``df`` written and read again. Where it is known to have no more than ``rows`` rows, one task and file for about ``each`` of them will do."""
        few = None if rows is None else max(1, -(-rows // each))
        if few is not None and few < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(few)
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        if few == 1:
            saved = saved.coalesce(1)  # known to be one partition: what follows needs no shuffle
        saved._scratch_path = path
        return saved

    def busy(self, rows: int) -> dict[str, int]:
        """Arguments of ``save`` for at most ``rows`` rows that are costly to make: every core gets a task."""
        cores = max(1, self.spark.sparkContext.defaultParallelism)
        return {"rows": rows, "each": max(1, min(COSTLY_ROWS, -(-rows // cores)))}

    def drop(self, saved: DataFrame | str) -> None:
        path = saved if isinstance(saved, str) else saved._scratch_path
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text_col: str) -> list[Column]:
    """h and g, 128 bits of a text (also of a null one), which tell rows with one id apart."""
    return [F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g")]


def seal(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the scratch tables and lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (materialised, slim rows) with a broadcast hint if its counted size allows it.

    Otherwise the join stays a shuffled one whose large partitions Spark splits at run time.
    """
    return F.broadcast(small) if rows_of(small) <= limit else small


def rows_of(saved: DataFrame) -> int:
    """Rows of a written table, counted once."""
    if "_scratch_rows" not in saved.__dict__:
        saved._scratch_rows = saved.count()
    return saved._scratch_rows


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when it has grown past a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; none for a null text."""
    return WORD.findall(text.lower()) if text else []


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _STEP = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _C1
    x = x ^ (x >> _S33)
    x = x * _C2
    return x ^ (x >> _S33)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order; of the whole sequence if it is shorter; none if empty."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * _STEP + h[j : j + n]
    return mix(acc)


_ODD = int(_STEP)
_POWERS = [np.ones(1, np.uint64)] * 2


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, from running sums: the cost does not depend on ``k``; none if there are fewer words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if len(_POWERS[0]) < len(h):
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            x = np.full(2 * len(h), base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _POWERS[0][: len(h)])])
    return mix((sums[k:] - sums[:n]) * _POWERS[1][:n] + np.uint64(k))


def numbered(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each element occurred before in its owner's sequence."""
    if not len(x):
        return np.zeros(0, np.int64)
    order = np.lexsort((x, owner))
    s, w = x[order], owner[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])])
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(salt)) | np.uint64(1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; 1 if both are empty."""
    both = np.intersect1d(a, b, assume_unique=True).size
    total = a.size + b.size - both
    return both / total if total else 1.0


def connected_components(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges are stars around the smallest ids:
    no centre is a leaf and no leaf has two centres. Every step is a partial aggregation and a join
    with its written result (broadcast while it is small, else with partitions that Spark can
    split), so a vertex with very many neighbours is never gathered. Loops (a = b) are ignored; without
    edges there are no rows. ``most``: no more edges than these, where that is known.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = scratch.save(edges.distinct(), most)
    while n := rows_of(current):
        # large-star: the larger neighbours of each vertex move to its smallest one
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = scratch.save(both.where("v > u").join(sized(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        # small-star: the smaller neighbours of each vertex, and itself, move to the smallest
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), n)
        joined = large.join(sized(low), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        following = scratch.save(small.distinct(), 2 * n)
        scratch.drop(large)
        scratch.drop(current)
        current = following
        twice = current.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
        inner = current.select("v").join(current.select(F.col("u").alias("v")), "v", "left_semi")
        if not twice.agg(F.count(F.lit(1)).alias("n")).unionByName(inner.agg(F.count(F.lit(1)).alias("n"))).where("n > 0").count():
            break
    centres = current.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)


#: Members of a block when a group is compared pair by pair; a unit of work holds two blocks.
BLOCK = 128
#: The same where only signatures are compared (two blocks hold 2 MB), members whose signatures are spread out at a time, and bits of a signature.
SIGN_BLOCK, SIGN_TILE, SIGN_BITS = 4096, 512, 2048
#: Members of a bucket that others are compared with in turn, before all are compared.
ROUNDS = 2


def signatures(elements: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Bits (owners x SIGN_BITS, packed) on which the elements of each owner's set fall.

    A bit that only x has stands for at least one element that y lacks, so bits bound differences from below.
    """
    bits = np.zeros((owners, SIGN_BITS), bool)
    bits[owner, (elements >> np.uint64(64 - SIGN_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def _units(left: DataFrame, columns: DataFrame, run: Callable[[pa.Table], pa.RecordBatch | None], schema: str, block: int) -> DataFrame:
    """``run`` over units of two blocks of about ``block`` members of each group of ``left`` (key, id, component); columns: (id, ...) joined to it."""
    sizes = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = left.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    units = own.select(unit.alias("unit"), "key", "own", "id", "component").join(columns, "id")
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(width, "unit").sortWithinPartitions("unit", "id")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_of(batches, "unit"):
            if part.num_rows > 1 and (out := run(part)) is not None:
                yield out
        pa.default_memory_pool().release_unused()

    return units.mapInArrow(parts, schema)


def _asked(part: pa.Table) -> np.ndarray:
    """Pairs of a unit's members to look at: of different components, each pair of blocks in one unit only."""
    sides, components = (part.column(c).to_numpy() for c in ("own", "component"))
    ask = components[:, None] != components[None, :]
    if not (sides == sides[0]).all():
        ask &= sides[:, None] != sides[None, :]
    return ask


def _met_before(buckets: pa.ChunkedArray, key: int) -> np.ndarray:
    """Pairs of members that share a bucket with a smaller key: they are compared there."""
    lists = buckets.combine_chunks()
    keys = lists.flatten().to_numpy()
    who = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    who, keys = who[keys < key], keys[keys < key]
    distinct, column = np.unique(keys, return_inverse=True)
    held = np.zeros((len(lists), len(distinct)), np.float32)
    held[who, column] = 1
    return held @ held.T > 0


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint64).reshape(len(column), -1)


def link_groups(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], compare: Callable[[list, np.ndarray, np.ndarray], list[tuple[int, int]]], scratch: Scratch, block: int = BLOCK, signs: DataFrame | None = None, most: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, total: int | None = None) -> DataFrame:
    """Components of the verified links among items that share a key.

    keys: (key, id), a row for each bucket of an item. verify: takes distinct pairs (a, b) and
    returns those that are links. payload: takes (id) and returns (id, data binary). compare: takes
    the data of some items, their components so far and a matrix of the pairs to look at, and
    returns pairs of positions that are links, enough of them to connect all that are connected.
    signs: (id, n, sign), the size and the signature of each item's set; most(nx, ny) is how many
    elements x may have that y lacks, if both are linked. total: no more rows in keys than these, where that
    is known. Returns (id, component) for items with a link.

    First every item is compared with the first of each of its buckets, which joins most groups
    into one component. In buckets that still hold several, signatures (a few hundred bytes) show
    exactly which members can have a partner in another component; these are compared with another member
    of the bucket, for a few rounds, and what then stays open is compared in full. Open buckets that share their
    first member (sketches of one passage) are looked at as one where that is less work. Everything runs within
    bounded units of work (two blocks of members, chosen by a hash): a unit yields only members, or links
    that connect what was not connected, so no list of pairs is ever written and no group lands in one task.
    """
    lead = scratch.save(keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead"), None if total is None else total // 2)
    shared = scratch.save(keys.join(sized(lead), "key").distinct(), total)
    if signs is not None:
        signs = scratch.save(signs.join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), rows_of(shared), FILE_ROWS // 4)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
            n, m = batch.column("an").to_numpy(), batch.column("bn").to_numpy()
            good = (np.bitwise_count(x & ~y).sum(1) <= most(n, m)) & (np.bitwise_count(y & ~x).sum(1) <= most(m, n))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def linked(pairs: DataFrame, n: int) -> DataFrame:
        if signs is not None:
            pairs = pairs.join(signs.toDF("a", "an", "x"), "a").join(signs.toDF("b", "bn", "y"), "b")
            pairs = pairs.where(F.least("an", "bn") >= 0.5 * F.greatest("an", "bn")).select("a", "b", "an", "bn", "x", "y").mapInArrow(possible, "a long, b long")
        pairs = scratch.save(pairs, n)
        return scratch.save(verify(pairs), **scratch.busy(rows_of(pairs)))

    def partners(part: pa.Table) -> pa.RecordBatch | None:
        sides, components = part.column("own").to_numpy(), part.column("component").to_numpy()
        n, packed = part.column("n").to_numpy().astype(np.float64), _matrix(part.column("sign")).view(np.uint8)
        # a unit of two blocks compares one with the other, else the block with itself
        rows, columns = (np.flatnonzero(sides == side) for side in (sides.min(), sides.max()))
        itself = sides.min() == sides.max()
        has = np.zeros(len(n), bool)
        for i in range(0, len(rows), SIGN_TILE):
            r = rows[i : i + SIGN_TILE]
            x = np.unpackbits(packed[r], axis=1).astype(np.float32)
            for j in range(i if itself else 0, len(columns), SIGN_TILE):
                c = columns[j : j + SIGN_TILE]
                may = (components[r][:, None] != components[c][None, :]) & (np.minimum(n[r][:, None], n[c][None, :]) >= 0.5 * np.maximum(n[r][:, None], n[c][None, :]))
                if not may.any():
                    continue
                y = np.unpackbits(packed[c], axis=1).astype(np.float32)
                both, nx, ny = x @ y.T, n[r][:, None], n[c][None, :]
                may &= (x.sum(1)[:, None] - both <= most(nx, ny)) & (y.sum(1)[None, :] - both <= most(ny, nx))
                has[r] |= may.any(1)
                has[c] |= may.any(0)
        return pa.RecordBatch.from_arrays([pa.array(part.column(c).to_numpy()[has], pa.int64()) for c in ("key", "id", "component")], ["key", "id", "component"]) if has.any() else None

    def fused(left: DataFrame) -> DataFrame:
        """``left`` with buckets that have the same first member as one bucket, wherever that leaves fewer pairs to look at."""
        first = scratch.save(left.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), rows_of(left))
        alone = first.groupBy("first").agg(F.sum(F.col("n") * F.col("n").cast("double")).alias("pairs"), F.count(F.lit(1)).alias("keys")).where("keys > 1")
        members = left.join(sized(first.select("key", "first")), "key")
        together = members.select("first", "id").distinct().groupBy("first").agg(F.count(F.lit(1)).alias("n"))
        better = scratch.save(alone.join(together, "first").where(F.col("n").cast("double") * F.col("n") <= F.col("pairs")).select("first", F.xxhash64("first", F.lit(7)).alias("whole")), rows_of(first))
        return scratch.save(members.join(sized(better), "first", "left").select(F.coalesce("whole", "key").alias("key"), "id", "component").distinct(), rows_of(left))

    def still_open(members: DataFrame, label: DataFrame) -> DataFrame:
        """(key, id, component) of the members that may have a partner in another component."""
        named = members.select("key", "id").join(sized(label), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        n = rows_of(members)
        left = scratch.save(named.join(sized(scratch.save(open_, n)), "key"), n)
        if signs is None or not rows_of(left):
            return left
        return scratch.save(_units(fused(left), signs, partners, "key long, id long, component long", SIGN_BLOCK).distinct())

    def joined(label: DataFrame, links: DataFrame) -> DataFrame:
        # what is connected already goes in as stars
        stars = label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        n = rows_of(label) + rows_of(links)
        return scratch.save(connected_components(stars.unionByName(links), scratch, n), 2 * n)

    n = rows_of(shared)
    pairs = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = linked(pairs, n)
    label = scratch.save(connected_components(links, scratch, rows_of(links)), 2 * rows_of(links))
    left = still_open(shared, label)
    for turn in range(1, ROUNDS):
        if not rows_of(left):
            return label
        # another member leads: the least one after its bits are turned
        mask = F.lit(int(seeds(ROUNDS, 6)[turn].view(np.int64)))
        lead = left.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask).alias("lead"))
        pairs = left.join(lead, "key").where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
        links = linked(pairs, rows_of(left))
        if not rows_of(links):
            break
        label = joined(label, links)
        left = still_open(left, label)
    n = rows_of(left)
    if not n:
        return label
    data = scratch.save(payload(left.select("id").distinct()), **scratch.busy(n))
    data = data.join(scratch.save(left.groupBy("id").agg(F.collect_list("key").alias("buckets")), n), "id")

    def run(part: pa.Table) -> pa.RecordBatch | None:
        ask = _asked(part) & ~_met_before(part.column("buckets"), part.column("key")[0].as_py())
        at = np.flatnonzero(ask.any(0))
        if not len(at):
            return None
        data = part.column("data")
        found = compare([data[int(i)].as_buffer() for i in at], part.column("component").to_numpy()[at], np.triu(ask[np.ix_(at, at)]))
        ids = part.column("id").to_numpy()[at]
        return pa.RecordBatch.from_arrays([pa.array(ids[[p[i] for p in found]]) for i in (0, 1)], ["a", "b"]) if found else None

    more = scratch.save(_units(left, data, run, "a long, b long", block).distinct())
    return joined(label, more) if rows_of(more) else label


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of sorted batches, also where they cross batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def overlaps(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the sums of the smaller counts of equal elements of each two multisets, and their sizes."""
    sizes = np.array([len(x) for x in items])
    joined = np.concatenate(items)
    who = np.repeat(np.arange(len(items)), sizes)
    # the j-th occurrence of an element in an item is an element of its own: multisets become sets
    _, column = np.unique(mix(joined.astype(np.uint64) + numbered(joined, who).astype(np.uint64) * _STEP), return_inverse=True)
    out = np.zeros((len(items), len(items)), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for a in range(0, width, 8192):
        part = (column >= a) & (column < a + 8192)
        m = np.zeros((len(items), min(8192, width - a)), np.float32)
        m[who[part], column[part] - a] = 1
        out += m @ m.T
    return out, sizes


class Joined:
    """Union-find over positions that start in given components."""

    def __init__(self, components: np.ndarray):
        _, first, inverse = np.unique(components, return_index=True, return_inverse=True)
        self.parent = first[inverse].tolist()

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b
