"""Near-duplicate documents: Order MinHash.

The words of a text give k-mers (runs of five words), each labelled with its occurrence so far. A
sketch picks the ``picked`` k-mers with the least hashes under one hash function and keeps them in
text order, so two sketches agree only if the texts share those k-mers in the same order: the
chance follows the edit similarity, not only the overlap. Sketches are the buckets; there are as many
as find a pair at the threshold, with its edits spread at random, with probability 1 - ``missed``
(72 for 0.8 and 0.06); more similar pairs are missed far more rarely.

Texts with equal words are collapsed into one class by 128 bits of their word sequence before anything
is compared. A candidate pair is dropped if signatures of the words prove that too many differ, and is
else verified by banded alignment: the edit distance over words (32-bit hashes) within a band just wide
enough for the threshold, widened step by step, a column of the band being one integer; a link has an edit
similarity of 1 - distance / longer length of at least ``threshold``. Classes are components of links.

Edge cases: null and empty texts, and rows with a null id, have no k-mer and link with nothing;
texts shorter than k words are one k-mer; equal texts, also repeated rows, are one class, whose
id is the smallest id in it; rows that repeat an id with another text are compared by their texts, each
with the smallest id of its own class; an empty table gives an empty result; other columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import GROUP, Joined, Scratch, WordHashes, link_groups, mix, numbered, overlaps, rows_of, seal, seeds, signatures, sized, text_key, windows, words_of

K, PICKED, THRESHOLD, MISSED = 5, 2, 0.8, 0.06
_C = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(29)
#: Low bits of a value that hold a position instead of the hash.
_LOW = np.uint64((1 << 28) - 1)


def sketches_for(threshold: float = THRESHOLD, k: int = K, picked: int = PICKED, missed: float = MISSED) -> int:
    """Sketches of which a pair at the threshold, whose edits are spread at random, shares none with probability ``missed`` at most."""
    kept = threshold**k
    together = (kept / (2 - kept)) ** picked
    return math.ceil(math.log(missed) / math.log(1 - together)) if together < 1 else 1


def order_min_hashes(h: np.ndarray, ends: np.ndarray, sketches: int, k: int = K, picked: int = PICKED) -> np.ndarray:
    """Sketches (texts x sketches, int64) of texts whose word hashes are one sequence; rows of texts without words are 0."""
    lengths = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), lengths)
    out = np.zeros((len(ends), sketches), np.int64)
    # a text of fewer than k words is one k-mer: filled up with its number of words
    short = (lengths > 0) & (lengths < k)
    if short.any():
        at = np.repeat(np.where(short, k - lengths, 0), lengths)
        last = np.zeros(len(h), bool)
        last[ends[short] - 1] = True
        times = np.where(last, at + 1, 1)
        h, owner = np.repeat(h, times), np.repeat(owner, times)
        lengths = np.where(short, k, lengths)
        ends = np.cumsum(lengths)
    g = windows(h, k)
    inside = np.arange(len(g)) + k <= ends[owner[: len(g)]]
    g, owner = g[inside], owner[: len(g)][inside]
    if not len(g):
        return out
    nth = numbered(g, owner).astype(np.uint64)
    g = np.where(nth > 0, mix(g + nth * _C), g)
    full, starts = np.unique(owner, return_index=True)
    place = np.arange(len(g), dtype=np.uint64)
    kept, absent = np.append(g, np.uint64(0)), len(g)
    multipliers, salts = seeds(sketches, 1), seeds(sketches, 2)
    for i in range(sketches):
        x = (g ^ salts[i]) * multipliers[i]
        x ^= x >> _S
        x *= _C
        x &= ~_LOW
        x |= place
        at = np.empty((picked, len(full)), np.int64)
        for j in range(picked):
            at[j] = np.minimum((np.minimum.reduceat(x, starts) & _LOW).astype(np.int64), absent)
            x[at[j][at[j] < absent]] = ~np.uint64(0)
        at.sort(axis=0)
        acc = np.zeros(len(full), np.uint64)
        for j in range(picked):
            acc = mix(acc * _C + kept[at[j]] + np.uint64(1))
        out[full, i] = mix(acc ^ salts[i]).view(np.int64)
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Only cells within a band around the diagonal are computed; the band widens until the distance
    found lies within it, which proves it right.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return max(len(a), len(b)) - n
    start = int(differ[0])
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    if len(differ):
        a, b = a[: len(a) - int(differ[0])], b[: len(b) - int(differ[0])]
    else:
        return max(len(a), len(b)) - n
    if len(a) < len(b):
        a, b = b, a
    x, y = a.tolist(), b.tolist()
    band = min(most, max(32, len(a) - len(b)))
    while True:
        d = _banded(x, y, min(band, len(a)), band)
        if d <= band or band >= most:
            return min(d, most + 1)
        band = min(most, 4 * band)


def _banded(a: list[int], b: list[int], band: int, most: int) -> int:
    """Edit distance (a no shorter than b) over the cells with abs(i - j) <= band; right if it is within the band.

    A column of the band is a pair of integers whose bits say where the distance grows or falls from
    one row to the next; bit t of column j stands for row j - band + t.
    """
    m, n = len(a), len(b)
    width = 2 * band + 1
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    up, down = mask ^ ((1 << band) - 1), 0  # column 0: one more in each row from the first on
    score, low = band, m - band  # of the lowest row of the band, until that is the last row
    for j in range(1, n + 1):
        shift = j - band - 1
        same = where.get(b[j - 1], 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask | down
        flat = ((((same & up) + up) ^ up) | same) & mask  # equal to the cell before in its diagonal
        right, left = down | mask & ~(flat | up), flat & up
        if j <= low:
            score += not flat >> 2 * band
        else:
            t = m - j + band
            score += (right >> t & 1) - (left >> t & 1)
        if score - (n - max(j, low)) > most:
            return most + 1
        up, down = left | mask & ~(flat >> 1 | right), flat >> 1 & right
    return score


def edit_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """1 - distance / longer length; 0 if it is under ``threshold``; 1 for two empty sequences."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - threshold) * longer + 1e-9)
    d = edit_distance(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int | None = None, picked: int = PICKED) -> DataFrame:
    """(id, h, g, h1, h2, n, sign, keys): h and g are the text's key; h1 and h2 hash the word sequence, null without words; n words; sign has a bit for each word."""
    sketches = sketches or sketches_for(THRESHOLD, k, picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                words = [words_of(t.as_py()) for t in part.column(1)]
                h, ends = cache.of(list(chain.from_iterable(words))), np.cumsum([len(w) for w in words])
                contents = [_content(h[e - len(w) : e]) for w, e in zip(words, ends)]
                owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
                signs = signatures(mix(h + numbered(h, owner).astype(np.uint64) * _C), owner, len(words))
                keys = order_min_hashes(h, ends, sketches, k, picked)
                lists = [keys[j] if w else [] for j, w in enumerate(words)]
                columns = [part.column(0), part.column(2), part.column(3), *[pa.array([c[j] for c in contents], pa.int64()) for j in (0, 1)], pa.array([len(w) for w in words], pa.int32()), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "g", "h1", "h2", "n", "sign", "keys"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *text_key(text_col)).mapInArrow(run, "id long, h long, g long, h1 long, h2 long, n int, sign binary, keys array<long>")


def _content(h: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits of a word sequence; none without words."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()) if len(h) else (None, None)


def _tokens(rows: DataFrame) -> DataFrame:
    """(h1, h2, data) from (id, text): 32-bit word hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            hashes = [cache.of(words_of(t.as_py())) for t in batch.column(1)]
            contents, packed = [_content(h) for h in hashes], [h.astype(np.uint32).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([*[pa.array([c[j] for c in contents], pa.int64()) for j in (0, 1)], pa.array(packed, pa.binary())], ["h1", "h2", "data"])

    return rows.mapInArrow(run, "h1 long, h2 long, data binary")


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of (a, b, x, y) that are links; x and y are packed word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [edit_similarity(np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(q.as_buffer(), np.uint32), threshold) > 0 for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int | None = None, picked: int = PICKED, threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """(id, component_id, kept) of every row; kept is true for the smallest id of each class.

    ``keyed`` adds h and g, the key of the row's text, and group, which rows of one class share and no others (null without words).
    """
    spark = docs.sparkSession
    both = ["h1", "h2"]
    with Scratch(spark) as scratch:
        sketches = sketches or sketches_for(threshold, k, picked)
        rows = scratch.save(sketch(docs, id_col, text_col, k, sketches, picked))
        many = rows_of(rows)
        full = rows.where("h1 is not null and id is not null")
        # a class is known by the hashes of its words, so that rows that repeat an id with another text stay apart
        twins = scratch.save(full.groupBy(*both).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*both, "first"), many)
        # its number is h1, or h2 where another class has that h1
        clash = scratch.save(full.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo < hi").select("h1", "lo"), many)
        classes = full.join(sized(twins), both, "left").where("first is null or id = first").join(sized(clash), "h1", "left")
        classes = classes.withColumn("class", F.when(F.col("lo") < F.col("h2"), F.col("h2")).otherwise(F.col("h1"))).withColumn("copied", F.col("first").isNotNull()).withColumn("first", F.col("id"))
        keys = classes.select(F.col("class").alias("id"), F.explode("keys").alias("key"))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

        def words(wanted: DataFrame) -> DataFrame:
            # a text is read once however many pairs it is in
            wanted = scratch.save(classes.select(F.col("class").alias("id"), "first", *both).join(sized(wanted), "id", "left_semi").distinct(), many)
            held = _tokens(texts.join(sized(wanted.select(F.col("first").alias("id")).distinct()), "id", "left_semi"))
            return held.join(sized(wanted.select("id", *both)), both).select("id", "data").dropDuplicates(["id"])

        def verify(pairs: DataFrame) -> DataFrame:
            ids = scratch.save(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), min(many, 2 * rows_of(pairs)))
            held = scratch.save(words(ids), **scratch.busy(rows_of(ids)))
            both = pairs.join(held.select(F.col("id").alias("a"), F.col("data").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("data").alias("y")), "b")
            return _aligned(both.select("a", "b", "x", "y"), threshold)

        def compare(data: list, components: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
            items = [np.frombuffer(x, np.uint32) for x in data]
            both, sizes = overlaps(items)
            # an alignment keeps at most the words that both have: this bounds the edit similarity from above
            bound = both / np.maximum(1, np.maximum(sizes[:, None], sizes[None, :]))
            maybe = np.argwhere(ask & (bound >= threshold - 1e-6))
            joined, out = Joined(components), []
            for a, b in maybe[np.argsort(-bound[maybe[:, 0], maybe[:, 1]], kind="stable")].tolist():
                if joined.find(a) != joined.find(b) and edit_similarity(items[a], items[b], threshold) > 0:
                    joined.join(a, b)
                    out.append((a, b))
            return out

        def most(n: np.ndarray, m: np.ndarray) -> np.ndarray:
            # an edit takes one word of a text at most
            return (1 - threshold) * np.maximum(n, m) + 1e-6

        linked = link_groups(keys, verify, words, compare, scratch, signs=classes.select(F.col("class").alias("id"), "n", "sign"), most=most, total=sketches * many)
        merged = classes.select("class", *both, "first", "copied").join(linked.withColumnRenamed("id", "class"), "class", "left").where("copied or component is not null")
        merged = scratch.save(merged.select(*both, "first", F.coalesce("component", "class").alias("group")), many)
        lead = merged.groupBy("group").agg(F.min("first").alias("component"))
        merged = scratch.save(merged.join(lead, "group").select(*both, "group", "component").distinct(), rows_of(merged))
        out = rows.select("id", "h", "g", *both).alias("r").join(sized(merged, 1_000_000).alias("m"), F.expr("r.h1 = m.h1 and r.h2 = m.h2"), "left")
        component = F.coalesce("component", F.col("r.id"))
        named = ["h", "g", F.coalesce("group", "r.h1").alias("group")] if keyed else []
        out = out.select("id", *named, component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
        return seal(out).withColumnRenamed("id", id_col)
