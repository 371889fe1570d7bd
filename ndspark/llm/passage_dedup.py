"""Substring deduplication: paragraph MinHash banding.

Paragraphs. A line of at least ``min_words`` words is a paragraph, and so is a run of shorter lines
without a blank one between them (hard-wrapped text) that has as many together. Its MinHash (over
runs of five words) is banded for high recall (6 bands of 3: at similarity 0.8 a pair is missed with
probability 0.013, at 0.9 with 0.0004); paragraphs that collide are joined, verified by exact
Jaccard similarity of at least ``threshold``, and linked into components.

Passages inside paragraphs. A passage that was pasted into other text is no paragraph of its own.
Texts are therefore also compared as sequences of words, whatever their lines and sentences. Of each
11 consecutive runs of ten words the one with the least hash is a seed, so any 20 equal words share
one. A document is aligned with the first document of each of its seeds, and of the ``run_words``
words from each seed on. What goes is a run of at least ``run_words`` words that the other document
holds word by word, or one made of exact runs of at least 20 words in the same order with edits
between them: each edit, with 20 words on both sides, and all of the run, at an edit similarity of at
least ``threshold``. Nothing else goes; a whole sentence of under six words at an end of a run stays.

Of each component, and of each passage, the copies in the document with the smallest id stay and
those in other documents are removed; of equal texts of at least ``run_words`` words all but that of the
smallest id go whole, before anything is compared. Repeats within one document are left alone.

Edge cases: null and empty texts, and rows with a null id, share nothing and are left as they are;
rows that repeat an id are one document, but each text among them is compared and cut by itself (what is
found belongs to the id and 128 bits of the text); an empty table gives an empty result; other columns are
passed through; texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import GROUP, WORD, Joined, Scratch, WordHashes, connected_components, jaccard, link_groups, mix, overlaps, rows_of, seal, seeds, shingles, sized, text_key, windows
from ndspark.llm.near_dup import edit_distance

K, BANDS, ROWS, THRESHOLD = 5, 6, 3, 0.8
MIN_WORDS, RUN_WORDS, LEAST = 50, 40, 6
#: Words of a seed, seeds of which the least is picked, and the words of an exact run in which one is sure to be picked.
SEED, PICK = 10, 11
EXACT = SEED + PICK - 1
#: Where a sentence ends: white space after a stop, or with a line break if no lower-case letter follows.
STOP = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_TAIL, _HEAD = re.compile(r"[^\w\s]*(?!\S)"), re.compile(r"(?<!\S)[^\w\s]*\Z")


def words_in(text: str) -> list[str]:
    """Lower-cased words, as many as WORD finds in the text itself."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def paragraphs_of(text: str, min_words: int = MIN_WORDS) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """All words, and the paragraphs: (start, end) in the text and among the words."""
    out, found, at = [], [], 0
    held: list[int] | None = None
    for line in [*text.split("\n"), ""]:
        w = words_in(line)
        unit = [at, at + len(line), len(out), len(out) + len(w)]
        if held and (not w or len(w) >= min_words):
            if held[3] - held[2] >= min_words:
                found.append(tuple(held))
            held = None
        if len(w) >= min_words:
            found.append(tuple(unit))
        elif w:
            held = [held[0], unit[1], held[2], unit[3]] if held else unit
        out.extend(w)
        at += len(line) + 1
    return out, found


def _hash(h: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()))))


def picked(h: np.ndarray, ends: np.ndarray, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose word hashes are one sequence: the text, hashes (int64) of its seeds, and of the ``run_words`` words from each on (0 where the text ends before).

    No more than two of the same in a text; none of texts of fewer words than a run or an exact run.
    """
    lengths = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), lengths)
    g = windows(h, SEED)
    if len(g) < PICK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(g) - PICK + 1
    whole = np.flatnonzero((np.arange(n) + EXACT <= ends[owner[:n]]) & (lengths[owner[:n]] >= run_words))
    # the least of PICK windows, the first of equal ones
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for i in range(1, PICK):
        less = g[i : n + i] < least
        np.copyto(least, g[i : n + i], where=less)
        at[less] = i
    at = np.unique(at[whole] + whole)
    owner = owner[at]
    long = np.zeros(len(at), np.uint64)
    fit = at + run_words <= ends[owner]
    long[fit] = windows(h, run_words)[at[fit]]
    seed = g[at]
    _, first, times = np.unique(mix(seed ^ mix(long + np.uint64(1)) ^ mix(owner.astype(np.uint64) + np.uint64(2))), return_index=True, return_counts=True)
    keep = np.sort(np.repeat(first, np.minimum(times, 2)))
    return owner[keep], seed[keep].view(np.int64), long[keep].view(np.int64)


def _runs(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Exact runs of at least EXACT words: (start, end) in x, (start, end) in y, in the order of x."""
    gx, gy = windows(x, EXACT), windows(y, EXACT)
    known, first = np.unique(gy, return_index=True)
    slot = np.minimum(np.searchsorted(known, gx), len(known) - 1)
    p = np.flatnonzero(known[slot] == gx)
    q = first[slot[p]]
    if len(known) < len(gy):
        # where words occur several times in y: go on from the last place, or else to the next one after it
        order = np.argsort(gy, kind="stable")
        low, high = np.searchsorted(gy[order], gx[p], "left"), np.searchsorted(gy[order], gx[p], "right")
        last = -1
        for i in range(len(p)):
            if high[i] - low[i] > 1:
                places = order[low[i] : high[i]]
                after = int(np.searchsorted(places, last + 1))
                q[i] = places[after] if after < len(places) else places[0]
            last = int(q[i])
    if not len(p):
        return []
    cuts = [0, *(np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1).tolist(), len(p)]
    return [[int(p[a]), int(p[b - 1]) + EXACT, int(q[a]), int(q[b - 1]) + EXACT] for a, b in zip(cuts, cuts[1:])]


def shared_runs(x: np.ndarray, y: np.ndarray, run_words: int = RUN_WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(start, end) of the words of x that are a passage which y holds too."""
    if min(len(x), len(y)) < max(run_words, EXACT):
        return []
    exact = np.flatnonzero(np.isin(windows(x, run_words), windows(y, run_words)))
    out = [(int(a), int(a) + run_words) for a in exact]
    chain: list[int] = []
    edits = 0
    for run in [*_runs(x, y), None]:
        if chain and run:
            over = max(0, chain[1] - run[0], chain[3] - run[2])
            a, b, c, d = run[0] + over, run[1], run[2] + over, run[3]
            if a < b:
                gap = max(a - chain[1], c - chain[3])
                # an edit may take as much of itself and 20 words on both sides as the threshold leaves
                most = int((1 - threshold) * (gap + 2 * EXACT) + 1e-9)
                more = edit_distance(x[chain[1] : a], y[chain[3] : c], most)
                if more <= most and edits + more <= (1 - threshold) * max(b - chain[0], d - chain[2]) + 1e-9:
                    chain, edits = [chain[0], b, chain[2], d], edits + more
                    continue
        if chain and chain[1] - chain[0] >= run_words:
            out.append((chain[0], chain[1]))
        if run:
            chain, edits = run, 0
    return _merged(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def min_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (paragraphs x bands, int64) of the paragraphs of at least K words that lie from ``starts`` to ``ends`` in a sequence of word hashes."""
    if not len(starts):
        return np.zeros((0, bands), np.int64)
    counts = ends - starts - K + 1
    offsets = np.cumsum(counts) - counts
    g = windows(h, K)[np.repeat(starts - offsets, counts) + np.arange(counts.sum())]
    multipliers, salts = seeds(bands * rows, 3), seeds(bands * rows, 4)
    acc = np.repeat(seeds(bands, 5)[None, :], len(starts), axis=0)
    for i in range(bands * rows):
        x = (g ^ salts[i]) * multipliers[i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        band = i // rows
        acc[:, band] = mix(acc[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, offsets))
    return acc.view(np.int64)


def _units(docs: DataFrame, bands: int, rows: int, min_words: int, run_words: int) -> DataFrame:
    """(id, h, g, n, seeds, runs, paragraphs) from (id, h, g, text): number of words, hashes of the seeds and of what follows them; hash and band keys of each paragraph."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for i in range(0, whole.num_rows, GROUP):
                batch = whole.slice(i, GROUP)
                read = [paragraphs_of(t.as_py(), min_words) for t in batch.column(3)]
                counts = np.array([len(w) for w, _ in read])
                ends, h = np.cumsum(counts), cache.of(list(chain.from_iterable(w for w, _ in read)))
                owner, seed, long = picked(h, ends, run_words)
                cuts = pa.array(np.searchsorted(owner, np.arange(len(read) + 1)), pa.int32())
                at = np.array([(j, base + a, base + b) for j, ((_, found), base) in enumerate(zip(read, ends - counts)) for _, _, a, b in found], np.int64).reshape(-1, 3)
                paragraphs: list[list[dict]] = [[] for _ in read]
                for (j, a, b), keys in zip(at.tolist(), min_hashes(h, at[:, 1], at[:, 2], bands, rows)):
                    paragraphs[j].append({"hash": _hash(h[a:b]), "keys": keys})
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (seed, long)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int32()), *lists, pa.array(paragraphs, kind)], ["id", "h", "g", "n", "seeds", "runs", "paragraphs"])

    return docs.select("id", "h", "g", "text").mapInArrow(run, "id long, h long, g long, n int, seeds array<long>, runs array<long>, paragraphs array<struct<hash: long, keys: array<long>>>")


def _paragraph_words(docs: DataFrame, min_words: int) -> DataFrame:
    """(hash, shingles): packed, sorted and distinct, of those paragraphs of (id, text, wanted) that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: dict[int, bytes] = {}
            for text, wanted in zip(batch.column(1), batch.column(2)):
                some = set(wanted.as_py())
                w, found = paragraphs_of(text.as_py(), min_words)
                h = cache.of(w)
                for _, _, a, b in found:
                    if (key := _hash(h[a:b])) in some:
                        out[key] = np.unique(shingles(h[a:b], K)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["hash", "shingles"])

    return docs.mapInArrow(run, "hash long, shingles binary")


def _tokens(docs: DataFrame) -> DataFrame:
    """(id, h, g, data) from (id, h, g, text): 32-bit word hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            packed = [cache.of(words_in(t.as_py())).astype(np.uint32).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["id", "h", "g", "data"])

    return docs.select("id", "h", "g", "text").mapInArrow(run, "id long, h long, g long, data binary")


def _aligned(pairs: DataFrame, run_words: int, threshold: float) -> DataFrame:
    """(id, h, g, first, a, b) from (id, h, g, first, x, y): the words a to b of x are held by y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = [], []
            for i, both in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(t.as_buffer(), np.uint32).astype(np.uint64) for t in both)
                found = shared_runs(x, y, run_words, threshold)
                at.extend([i] * len(found))
                spans.extend(found)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(4)], *[pa.array([x[i] for x in spans], pa.int32()) for i in (0, 1)]], ["id", "h", "g", "first", "a", "b"])

    return pairs.select("id", "h", "g", "first", "x", "y").mapInArrow(run, "id long, h long, g long, first long, a int, b int")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= threshold for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _ends(text: str, at: list[tuple[int, int]], a: int, b: int) -> tuple[int, int]:
    """The words a to b without a whole sentence of under LEAST words at either end."""

    def stop(i: int) -> bool:
        """Whether a sentence begins at word i."""
        if i in (0, len(at)):
            return True
        m = STOP.search(text[at[i - 1][1] : at[i][0]])
        return bool(m) and (m.start() > 0 and m.string[m.start() - 1] in ".!?" or not text[at[i][0]].islower())

    if stop(a):
        a = next((i for i in range(a + 1, min(a + LEAST, b)) if stop(i)), a)
    if stop(b):
        b = next((i for i in range(b - 1, max(b - LEAST, a), -1) if stop(i)), b)
    return a, b


def repeated_spans(text: str, runs: list[tuple[int, int]], paragraphs: set[int], min_words: int = MIN_WORDS, cache: WordHashes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, words) of the spans to remove, given the runs of words and the hashes of paragraphs that earlier documents hold."""
    at = [m.span() for m in WORD.finditer(text)]
    spans = []
    for a, b in _merged(runs):
        a, b = _ends(text, at, a, b)
        start, end = at[a][0], at[b - 1][1]
        # signs that touch the first and the last word go with them
        before = _HEAD.search(text, at[a - 1][1] if a else 0, start)
        after = _TAIL.match(text, end, at[b][0] if b < len(at) else len(text))
        spans.append((before.start() if before else start, after.end() if after else end))
    if paragraphs:
        w, found = paragraphs_of(text, min_words)
        h = (WordHashes() if cache is None else cache).of(w)
        spans.extend((start, end) for start, end, a, b in found if _hash(h[a:b]) in paragraphs)
    out: list[tuple[int, int]] = []
    for start, end in _merged(spans):
        if out and not text[out[-1][1] : start].strip():
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    starts = [x for x, _ in at]
    return [(start, end, bisect_left(starts, end) - bisect_left(starts, start)) for start, end in out]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space around each becomes a line break if it held one, else a space."""
    for start, end in reversed(spans):
        before, after = text[:start].rstrip(), text[end:].lstrip()
        gap = text[len(before) : start] + text[end : len(text) - len(after)]
        text = before + (("\n" if "\n" in gap else " ") if before and after else "") + after
    return text


TEXT = ["id", "h", "g"]


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, g, text) of the rows with an id and a text; h and g are 128 bits of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.select("id", *text_key("text"), "text")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """What to remove, and how documents are connected by it.

    First (id, h, g, spans: array of (start, end, words)) of the texts that lose something, known by the
    id and 128 bits of the text; then (id, component) of all documents that lose or lend a passage.
    """
    if min_words < K:
        raise ValueError(f"a paragraph has at least {K} words")
    spark = docs.sparkSession
    texts = _named(docs, id_col, text_col)
    with Scratch(spark) as scratch:
        every = scratch.save(_units(texts, bands, rows, min_words, run_words))
        many = rows_of(every)
        # equal texts: that of the smallest id is compared, the others go whole
        equal = every.groupBy("h", "g").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("h", "g", "lead")
        equal = scratch.save(equal, many)
        every = every.join(sized(equal), ["h", "g"], "left")
        copies = every.where(F.col("id") > F.col("lead")).where(F.col("n") >= run_words).select(*TEXT, F.col("lead").alias("first")).distinct()
        units = every.where(F.coalesce(F.col("id") == F.col("lead"), F.lit(True)))
        # passages: the first document of each seed that occurs in several, and of each run of words from one on
        seeded = units.select(*TEXT, F.explode(F.arrays_zip("seeds", "runs")).alias("s")).select(*TEXT, F.col("s.seeds").alias("seed"), F.col("s.runs").alias("run"))
        shared = seeded.groupBy("seed").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("seed", "first")
        shared = scratch.save(shared)
        held = scratch.save(seeded.join(sized(shared, 1_000_000), "seed").select(*TEXT, "run", "first"))
        # a passage with an edit, and one without, have two seeds at least
        pairs = held.where("id > first").groupBy(*TEXT, "first").count().where("count > 1").select(*TEXT, "first")
        verbatim = held.where("run <> 0").groupBy("run").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("run", "lead")
        verbatim = scratch.save(verbatim, rows_of(held))
        pairs = pairs.union(held.join(sized(verbatim, 1_000_000), "run").where("id > lead").select(*TEXT, "lead"))
        pairs = scratch.save(pairs.distinct(), 2 * rows_of(held))
        wanted = scratch.save(pairs.select("id").union(pairs.select("first")).distinct(), min(many, 2 * rows_of(pairs)))
        tokens = scratch.save(_tokens(texts.join(sized(wanted), "id", "left_semi")).dropDuplicates(TEXT), **scratch.busy(many))
        both = pairs.join(tokens.withColumnRenamed("data", "x"), TEXT).join(tokens.select(F.col("id").alias("first"), F.col("data").alias("y")), "first")
        runs = _aligned(both, run_words, threshold)
        marks = runs.select(*TEXT, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hash"), "first", "a", "b")
        none = [F.lit(0).alias("a"), F.lit(0).alias("b")]
        marks = marks.unionByName(copies.select(*TEXT, F.lit(2).alias("kind"), F.lit(0).cast("long").alias("hash"), "first", *none))
        # paragraphs: equal ones are one class; classes that collide in a band are compared
        paragraphs = scratch.save(units.select(*TEXT, F.explode("paragraphs").alias("p")).select(*TEXT, "p.hash", "p.keys"))
        classes = scratch.save(paragraphs.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.first("keys").alias("keys")), rows_of(paragraphs))
        keys = scratch.save(classes.select(F.col("hash").alias("id"), F.explode("keys").alias("key")), bands * rows_of(classes))
        where = classes.select(F.col("hash").alias("id"), F.col("first").alias("doc"))

        def words(wanted: DataFrame) -> DataFrame:
            by_doc = scratch.save(sized(wanted).join(where, "id").groupBy("doc").agg(F.collect_list("id").alias("wanted")), rows_of(wanted))
            held = texts.join(sized(by_doc), F.col("id") == F.col("doc")).select("id", "text", "wanted")
            return _paragraph_words(held, min_words).dropDuplicates(["hash"]).select(F.col("hash").alias("id"), F.col("shingles").alias("data"))

        def verify(pairs: DataFrame) -> DataFrame:
            held = scratch.save(words(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()), **scratch.busy(min(2 * rows_of(pairs), rows_of(classes))))
            both = pairs.join(held.select(F.col("id").alias("a"), F.col("data").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("data").alias("y")), "b")
            return _verified(both.select("a", "b", "x", "y"), threshold)

        def compare(data: list, components: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
            both, sizes = overlaps([np.frombuffer(x, np.uint64) for x in data])
            joined = Joined(components)
            linked = np.argwhere(ask & (both >= threshold * (sizes[:, None] + sizes[None, :] - both)))
            return [(a, b) for a, b in linked.tolist() if joined.join(a, b)]

        linked = link_groups(keys, verify, words, compare, scratch, total=bands * rows_of(classes))
        merged = classes.join(linked.withColumnRenamed("id", "hash"), "hash", "left").where("first < last or component is not null")
        merged = scratch.save(merged.select("hash", "first", F.coalesce("component", "hash").alias("component")), rows_of(classes))
        lead = merged.groupBy("component").agg(F.min("first").alias("lead"))
        known = scratch.save(merged.join(lead, "component").select("hash", "lead"), rows_of(merged))
        more = paragraphs.select(*TEXT, "hash").join(sized(known, 1_000_000), "hash").where("id > lead")
        marks = marks.unionByName(more.select(*TEXT, F.lit(1).alias("kind"), "hash", F.col("lead").alias("first"), *none))
        # of one text: what it repeats and from where
        marks = marks.groupBy(*TEXT).agg(F.collect_set(F.struct("kind", "hash", "first", "a", "b")).alias("marks"))
        marks = scratch.save(marks, many)
        touched = texts.join(sized(marks), TEXT).select(*TEXT, "text", "marks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                at, spans, lenders = [], [], []
                for i, (text, found) in enumerate(zip(batch.column(3), batch.column(4))):
                    text, found = text.as_py(), found.as_py()
                    if any(x["kind"] == 2 for x in found):
                        got = [(0, len(text), len(words_in(text)))]
                    else:
                        runs = [(x["a"], x["b"]) for x in found if not x["kind"]]
                        got = repeated_spans(text, runs, {x["hash"] for x in found if x["kind"]}, min_words, cache)
                    if got:
                        at.append(i)
                        spans.append([{"start": a, "end": b, "words": n} for a, b, n in got])
                        lenders.append(sorted({x["first"] for x in found}))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(3)], pa.array(spans, kind), pa.array(lenders, pa.list_(pa.int64()))], [*TEXT, "spans", "lenders"])

        schema = "id long, h long, g long, spans array<struct<start: int, end: int, words: int>>, lenders array<long>"
        removals = seal(touched.mapInArrow(run, schema).dropDuplicates(TEXT))
        edges = removals.select(F.col("id").alias("a"), F.explode("lenders").alias("b"))
        components = seal(connected_components(edges, scratch))
        return removals.select(*TEXT, "spans"), components


def report(docs: DataFrame, removals: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id, removed_words, removed_spans, kept) of every row; kept: nothing is removed from it."""
    lost = seal(removals.select(*[F.col(c).alias(f"_{c}") for c in TEXT], F.size("spans").alias("_n"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("_w")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text_col))
    out = rows.join(sized(lost, 1_000_000), F.expr("id = _id and h = _h and g = _g"), "left").join(sized(components.toDF("_doc", "component"), 1_000_000), F.expr("id = _doc"), "left")
    removed = F.coalesce("_w", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"), removed.alias("removed_words"), F.coalesce("_n", F.lit(0)).alias("removed_spans"), (removed == 0).alias("kept"))


def remove(docs: DataFrame, removals: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans cut out; a text of which nothing is left goes, all others stay."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans)], dtype=object)

    columns = docs.columns
    spans = removals.select(*[F.col(c).alias(f"_span_{c}") for c in TEXT], F.col("spans").alias("_spans"))
    keys = seal(spans.drop("_spans"))
    text = F.col(text_col)
    # a null text has hashes too, but none that is among those of the removals with the same id
    h, g = text_key(text_col)
    same = (F.col(id_col).cast("long") == F.col("_span_id")) & (h == F.col("_span_h")) & (g == F.col("_span_g")) & text.isNotNull()
    whole = docs.join(sized(keys), same, "left_anti")
    changed = docs.join(sized(spans), same).withColumn(text_col, cut(text, F.col("_spans"))).where(F.length(text_col) > 0)
    if length_col in columns:
        changed = changed.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return whole.unionByName(changed.select(*[f"`{c}`" for c in columns]))
