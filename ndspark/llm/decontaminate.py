"""Benchmark decontamination: SimHash windows and multi-index Hamming blocks.

Windows are sized by the benchmark items: each item has the largest window of a geometric ladder
that is at most seven tenths of its length, and every such window of the item gets a 64-bit SimHash
of its words. A document is read in windows of the same sizes, half the item's slack apart, so
that a copy of an item holds two windows that start where windows of the item start. Fingerprints
are split into four blocks of 16 bits; a fingerprint within distance 7 agrees in some block up to
one bit, so probing a block's value and its 16 neighbours finds all within the radius.

A candidate fixes where in the document the item would begin. The item-sized span there is
compared with the item by weighted shingle similarity: the sum of the smaller over the sum of the
larger counts of each run of five words. Spans of at least ``threshold`` are reported.

The benchmark is read in blocks of about ``block_words`` words (some 60 MB of index; one longer item is a
block of its own size), each sent to the executors in turn: most benchmarks are one block, for which documents
are read once; documents are never shuffled, and reported rows are few. Verifying is linear in the length of
documents and items, however long.

Edge cases: null and empty texts match nothing, on either side; items of fewer than five words are
one shingle; documents shorter than an item's window can't hold it; repeated rows, and rows that repeat an id,
report the best match of each item once (``keyed``: once for each text); other columns are ignored; null ids of items and documents are skipped; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import WordHashes, mix, seal, shingles, sized, small_batches, text_key, words_of

K, THRESHOLD, RADIUS, BLOCK_WORDS = 5, 0.8, 7, 200_000
#: Words whose bit counts are held at a time, and documents read as one sequence.
CHUNK_WORDS, GROUP = 16_384, 200


def window_size(n: int) -> int:
    """The largest step of a ladder of ratio 1.25 within seven tenths of ``n`` words; ``n`` if it is short."""
    if n < 10:
        return n
    c = 7
    while (following := max(c + 1, c * 5 // 4)) <= 0.7 * n:
        c = following
    return c


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running counts of each hash bit (n + 1 rows of 64)."""
    if len(h) >= 1 << 16:
        sums = np.zeros((len(h) + 1, 64), np.uint32)
        np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint32, out=sums[1:])
        return sums
    sums = np.zeros((len(h) + 1, 64), np.uint16)
    sums[1:] = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    # four counters to a 64-bit lane: no counter of a chunk overflows into the next
    lanes = sums.view(np.uint64)
    np.cumsum(lanes, axis=0, out=lanes)
    return sums


def sim_hashes(sums: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words that start at multiples of ``stride``."""
    ones = sums[size::stride] - sums[: len(sums) - size : stride]
    return np.packbits(ones > size // 2, axis=1).view(np.uint64)[:, 0]


class HammingIndex:
    """Fingerprints by the values, and their one-bit neighbours, of each 16-bit block."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint16)
        self.start, self.entries, self.held = [], [], []
        blocks = prints.view(np.uint16).reshape(-1, 4)
        for b in range(4):
            values = (blocks[:, b][:, None] ^ near[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
            order = np.argsort(values, kind="stable")
            self.start.append(np.searchsorted(values[order], np.arange(65537)))
            self.entries.append(owner[order])
            self.held.append(np.diff(self.start[-1]) > 0)

    def probe(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, entry) with at most ``radius`` bits apart; all of them for a radius up to 7."""
        left, right = [], []
        blocks = prints.view(np.uint16).reshape(-1, 4)
        for b in range(4):
            values = blocks[:, b]
            at = np.flatnonzero(self.held[b][values])
            hit = values[at]
            lo = self.start[b][hit]
            n = self.start[b][hit.astype(np.int64) + 1] - lo
            who = np.repeat(at, n)
            entry = self.entries[b][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[who] ^ self.prints[entry]) <= radius
            left.append(who[close])
            right.append(entry[close])
        return np.concatenate(left), np.concatenate(right)


def best_span(h: np.ndarray, want: Counter, n: int, starts: list[int]) -> tuple[float, int]:
    """The largest similarity of the spans of ``n`` words from each of ``starts`` (sorted) with an item's shingles, and the first start that has it.

    From one start to the next the counts only change by what leaves and what enters: linear in the document's length, however many starts.
    """
    first, last = starts[0], starts[-1] + n
    words = min(n, len(h) - first)
    k = min(K, words)
    g, width = shingles(h[first:last], k).tolist(), words - k + 1
    total, found = sum(want.values()), (0.0, first)
    have: Counter = Counter()
    both, at = 0, None
    for start in (s - first for s in starts):
        if at is None or start - at >= width:
            have = Counter(g[start : start + width])
            both = sum((want & have).values())
        else:
            for i in range(at, start):
                x = g[i]
                both -= have[x] <= want[x]
                have[x] -= 1
                x = g[i + width]
                both += have[x] < want[x]
                have[x] += 1
        at = start
        similarity = both / (total + width - both)
        if similarity > found[0]:
            found = (similarity, start + first)
    return found


class BenchmarkIndex:
    """Items by window size: fingerprints of all their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        cache = WordHashes()
        self.items: list[tuple[int, int, Counter]] = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            h = mix(cache.of(words_of(text)))
            if len(h):
                classes.setdefault(window_size(len(h)), []).append((len(self.items), h))
                self.items.append((item_id, len(h), Counter(shingles(h, K).tolist())))
        self.classes = []
        for size, members in sorted(classes.items()):
            prints = [sim_hashes(bit_sums(h), size, 1) for _, h in members]
            owner = np.concatenate([np.full(len(p), i) for (i, _), p in zip(members, prints)])
            offset = np.concatenate([np.arange(len(p)) for p in prints])
            stride = max(1, (min(len(h) for _, h in members) - size + 1) // 2)
            self.classes.append((size, stride, HammingIndex(np.concatenate(prints)), owner, offset))

    def matches(self, docs: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int, float, int]]:
        """(document, item id, best similarity, first word of that span) of the items found in documents' word hashes.

        Documents are read as one sequence in chunks; windows that cross from one to the next are left out.
        """
        ends = np.cumsum([len(d) for d in docs])
        words = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        longest = max((size for size, *_ in self.classes), default=0)
        candidates: set[tuple[int, int, int]] = set()
        for at in range(0, len(words), CHUNK_WORDS):
            sums = bit_sums(words[at : at + CHUNK_WORDS + longest])
            for size, stride, index, owner, offset in self.classes:
                if len(sums) <= size:
                    continue
                window, entry = index.probe(sim_hashes(sums, size, stride))
                first = at + window * stride
                doc = np.searchsorted(ends, first, side="right")
                inside = first + size <= ends[doc]
                doc, entry, first = doc[inside], entry[inside], first[inside]
                candidates.update(zip(doc.tolist(), owner[entry].tolist(), (first - (ends[doc] - [len(docs[i]) for i in doc]) - offset[entry]).tolist()))
        spans: dict[tuple[int, int], set[int]] = {}
        for doc, item, start in candidates:
            # a span that runs over the document's edge is moved back into it
            spans.setdefault((doc, item), set()).add(max(0, min(start, len(docs[doc]) - self.items[item][1])))
        out = []
        for (doc, item), starts in sorted(spans.items()):
            item_id, n, want = self.items[item]
            similarity, at = best_span(docs[doc], want, n, sorted(starts))
            if similarity >= threshold:
                out.append((doc, item_id, similarity, at))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, keyed: bool = False) -> DataFrame:
    """(id, item_id, similarity, start_word): one row for each document and item found in it; ``keyed`` adds h and g, the key of the text it is in."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *text_key(text_col)).where("id is not null and text is not null")
    found = None
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        index = spark.sparkContext.broadcast(BenchmarkIndex(sorted((r["item_id"], r["text"]) for r in block.toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                texts = batch.column(1)
                for i in range(0, len(texts), GROUP):
                    got = index.value.matches([mix(cache.of(words_of(t.as_py()))) for t in texts[i : i + GROUP]], threshold)
                    at = pa.array([i + x[0] for x in got], pa.int64())
                    columns = [pa.array([x[k] for x in got], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in (0, 2, 3)], *columns], ["id", "h", "g", "item_id", "similarity", "start_word"])

        with small_batches(spark):
            part = seal(rows.mapInArrow(run, "id long, h long, g long, item_id long, similarity double, start_word long"))
        found = part if found is None else found.unionByName(part)
    key = ["h", "g"] if keyed else []
    best = found.groupBy("id", *key, "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("back"))).alias("m"))
    return best.select(F.col("id").alias(id_col), *key, "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.back")).alias("start_word"))


def without_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which nothing was found; by id and text if ``found`` is keyed, else by id."""
    keyed = "h" in found.columns and "g" in found.columns
    keys = seal(found.select(F.col(id_col).cast("long").alias("_found_id"), *([F.col("h").alias("_found_h"), F.col("g").alias("_found_g")] if keyed else [])).distinct())
    same = F.col(id_col).cast("long") == F.col("_found_id")
    if keyed:
        h, g = text_key(text_col)
        same &= (h == F.col("_found_h")) & (g == F.col("_found_g"))
    return docs.join(sized(keys), same, "left_anti")
