"""Phrase collocations by suffix arrays of word ids.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words
at spaces and tabs. A task gives the words of some documents (a shard of about ``SHARD`` words)
integers, sorts the suffixes of their sequence by prefix doubling in NumPy, and reads the counts of
all phrases of up to ``longest`` words from the intervals of common prefixes. Counts are summed by
(lang, phrase) over all shards; only phrases that occur often enough stay.

Phrases of one and two words are counted first. A phrase of three words (and so on) can only be
frequent where both phrases of two words in it are; a bit set of fixed size (2 MB to 16 MB, by hash)
of the frequent shorter phrases keeps other ones from being sorted and shuffled. A false hit there
costs a row and changes nothing: what stays is decided by the exact sum.

A candidate (2 to ``longest`` words, at least ``least`` times) is cut after each of its words; with
a, l and r the counts of it and of both parts, the cut of the smallest floor(1000000 a a / (l r))
counts (the first on ties). A candidate inside a longer one that has at least ``inside`` percent of
its count is dropped. The best ``first`` of each language are returned, by score, count and phrase.

Edge cases: a null text has no words; a null lang is ``und``; words may be of any length and hold any
other characters; a text of any length is read in slices that overlap by ``longest`` - 1 words, so
that nothing is cut off or counted twice; repeated rows count as often as they occur; ties go to the
phrase that is smaller in UTF-8; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ndspark.llm.common import Scratch, mix, rows_of, seal, sized

LONGEST, LEAST, INSIDE, FIRST = 3, 10, 50, 2000
SCALE = 1_000_000
#: Words of a shard, bytes of a text that are cut into words at a time, rows of an Arrow batch that leaves a task.
SHARD, SLICE, BATCH = 1 << 20, 1 << 22, 1 << 15
#: Bits of the set of frequent phrases (16 MB), and of one of its pieces.
SET_BITS, PIECE_BITS = 1 << 27, 1 << 15
#: Candidates of a language that are ranked in one group at a time.
RANKED = 200_000

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes, size: int = SLICE) -> Iterator[tuple[list[bytes], bool]]:
    """Words in order, an empty one after each piece, and whether the text ends here; about ``size`` bytes at a time."""
    at = 0
    while True:
        end = at + size
        if end < len(text):  # up to the next place between words
            rest = text[end:].translate(_TABLE) if len(text) - end < size else text[end : end + size].translate(_TABLE)
            gaps = [x for x in (rest.find(b" "), rest.find(b"\n")) if x >= 0]
            while not gaps and end + size < len(text):
                end += size
                rest = text[end : end + size].translate(_TABLE)
                gaps = [x for x in (rest.find(b" "), rest.find(b"\n")) if x >= 0]
            end = end + min(gaps) if gaps else len(text)
        found: list[bytes] = []
        for piece in text[at:end].translate(_TABLE).split(b"\n"):
            found += piece.split()
            found.append(b"")
        over = end >= len(text)
        if not over:
            found.pop()  # the piece may go on
        yield found, over
        if over:
            return
        at = end


class _Words(dict):
    """word -> id within a shard; the empty word is 0 and ends a piece."""

    def __init__(self, shard: _Shard, lang: str):
        super().__init__({b"": 0})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        shard = self.shard
        value = self[word] = len(shard.words)
        shard.words.append(word)
        shard.langs.append(self.lang)
        return value


class _Shard:
    """The words of some documents as one sequence of ids; ids of different languages differ."""

    def __init__(self) -> None:
        self.words, self.langs, self.ids, self.parts, self.starts, self.size = [b""], [""], {}, [], [], 0

    def add(self, lang: str, words: list[bytes], held: int) -> None:
        """``held``: so many words at the end begin no phrase here, since they come again in front of the next slice."""
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = _Words(self, lang)
        part = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        start = part > 0
        if held:
            start[-held:] = False
            part, start = np.append(part, 0), np.append(start, False)
        self.parts.append(part)
        self.starts.append(start)
        self.size += len(part)

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.parts), np.concatenate(self.starts)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: len(x) - k] = x[k:]
    return out


def suffixes(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``starts`` in the order of the (at least) ``depth`` words that follow; prefix doubling."""
    rank, sorted_by = seq, 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 1) + _ahead(rank, min(sorted_by, len(rank)))
        if 2 * sorted_by >= depth:
            return starts[np.argsort(key[starts])]
        order = np.argsort(key)
        s = key[order]
        rank = np.empty_like(order)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        sorted_by *= 2


def intervals(seq: np.ndarray, order: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length n up to depth: the first suffix and the number of suffixes of each interval of common prefix >= n that ends within its piece."""
    padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
    same, whole, out = np.ones(max(0, len(order) - 1), bool), np.ones(len(order), bool), []
    for j in range(depth):
        w = padded[order + j]
        same &= w[1:] == w[:-1]  # the common prefix of neighbours has at least j + 1 words
        whole &= w > 0
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(order)))
        first, count = first[whole[first]], count[whole[first]]
        out.append((order[first], count))
    return out


def _hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(b"%s\n%s" % (x.encode(), w)) for x, w in zip(langs, words)), np.uint64, len(words))


def _slots(parts: list[np.ndarray]) -> np.ndarray:
    """Places in the bit set of phrases given by the hashes of their words."""
    h = parts[0]
    for x in parts[1:]:
        h = mix(h * _STEP + x)
    return (h % np.uint64(SET_BITS)).astype(np.int64)


def _shard_counts(shard: _Shard, lengths: list[int], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of the given lengths and their counts; ``bits``: the frequent phrases of one word less, where only they can be extended."""
    seq, start = shard.sequence()
    depth = max(lengths)
    langs, words = pa.array(shard.langs), pa.array(shard.words, pa.binary()).view(pa.string())
    if bits is not None:
        h = _hashes(shard.langs, shard.words)[seq]
        inner = _slots([_ahead(h, j) for j in range(depth - 1)])
        known = (bits[inner >> 3] >> (inner & 7).astype(np.uint8)) & 1 == 1
        start = start & known & _ahead(known, 1)
    order = suffixes(seq, np.flatnonzero(start), depth)
    for n, (at, count) in enumerate(intervals(seq, order, depth), 1):
        if n not in lengths:
            continue
        for k in range(0, len(at), BATCH):
            some, ids = count[k : k + BATCH], [seq[at[k : k + BATCH] + j] for j in range(n)]
            phrase = words.take(pa.array(ids[0])) if n == 1 else pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in ids], " ")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[0])), pa.array(np.full(len(some), n, np.int32)), phrase, pa.array(some, pa.int64())], ["lang", "words", "phrase", "f"])
    if bits is None:  # all words of each language, as the phrase of no words
        names, where = np.unique(np.array(shard.langs), return_inverse=True)
        total = np.bincount(where[seq[start]], minlength=len(names))
        rows = [(x, int(n)) for x, n in zip(names, total) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([0] * len(rows), pa.int32()), pa.array([""] * len(rows)), pa.array([n for _, n in rows], pa.int64())], ["lang", "words", "phrase", "f"])


def shard_counts(docs: DataFrame, lengths: list[int], shared=None, shard_words: int = SHARD) -> DataFrame:
    """(lang, words, phrase, f) of each shard of ``docs`` (lang, text); without ``shared`` also the words of each language, with words = 0."""
    longest = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, held = text.as_buffer(), []
                raw = raw.to_pybytes() if raw else b""
                for some, over in tokens(raw):
                    some = held + some
                    keep = 0 if over else min(longest - 1, len(some))
                    shard.add(lang, some, keep)
                    held = some[len(some) - keep :] if keep else []
                    if shard.size >= shard_words:
                        yield from _shard_counts(shard, lengths, bits)
                        shard = _Shard()
        if shard.size:
            yield from _shard_counts(shard, lengths, bits)
        pa.default_memory_pool().release_unused()

    return docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, words int, phrase string, f long")


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """Sums over all shards. Shards are aggregates already, so rows are dealt by phrase at once."""
    summed = counts.repartition("lang", "phrase", "words").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return summed.where((F.col("f") >= least) | (F.col("words") == 0))


def _bit_set(phrases: DataFrame):
    """Broadcast bits (SET_BITS at most, whatever the number of rows) of (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            parts = [x.encode("utf-8", "surrogatepass").split(b" ") for x in batch.column(1).to_pylist()]
            if parts:
                slots = _slots([_hashes(langs, [p[j] for p in parts]) for j in range(len(parts[0]))])
                yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    slots = phrases.select("lang", "phrase").mapInArrow(run, "slot long")
    piece, place = F.call_function("div", F.col("slot"), F.lit(PIECE_BITS)), F.col("slot") % PIECE_BITS
    pieces = slots.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(place).alias("bits"))
    bits = np.zeros(SET_BITS // 8, np.uint8)
    for row in pieces.collect():  # 4,096 pieces of 4 kB at most
        at = row["piece"] * PIECE_BITS // 8
        bits[at : at + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, shard_words: int = SHARD) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times; words = 0: all words of the language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = scratch.save(_frequent(shard_counts(rows, [1, 2], None, shard_words), least))
    parts = [counts]
    for n in range(3, longest + 1):
        shared = _bit_set(parts[-1].where(F.col("words") == n - 1))
        parts.append(scratch.save(_frequent(shard_counts(rows, [n], shared, shard_words), least)))
        shared.destroy()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _scored(rows: DataFrame) -> DataFrame:
    """``score`` in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, left, right = (batch.column(c).to_pylist() for c in ("a", "l", "r"))
            yield batch.append_column("score", pa.array([SCALE * x * x // (y * z) for x, y, z in zip(a, left, right)], pa.int64()))

    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0).cast("long")).schema)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, first: int = FIRST, shard_words: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    with Scratch(docs.sparkSession) as scratch:
        counts = phrase_counts(docs, scratch, text_col, lang_col, longest, least, shard_words)
        whole = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
        units = F.split("phrase", " ")
        # pieces of longer candidates that have enough of their count
        longer = whole.where("words > 2").select("lang", "a", units.alias("u"), "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
        longer = longer.select("lang", "a", "u", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
        inner = longer.select("lang", F.array_join(F.slice("u", F.col("at"), F.col("k")), " ").alias("phrase"), "a")
        covered = scratch.save(inner.groupBy("lang", "phrase").agg(F.max("a").alias("most")))
        enough = 100 * F.col("most").cast("decimal(38,0)") >= inside * F.col("a").cast("decimal(38,0)")
        kept = whole.join(sized(covered), ["lang", "phrase"], "left").where(~F.coalesce(enough, F.lit(False)))
        cuts = kept.select("lang", "phrase", "a", units.alias("u"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("u", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("u", F.col("k") + 1, F.size("u")), " ").alias("right"))
        parts = scratch.save(counts.where(F.col("words").between(1, longest - 1)).select("lang", "phrase", "f"))
        for side, name in (("left", "l"), ("right", "r")):
            cuts = cuts.join(sized(parts).select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        scored = _scored(cuts.select("lang", "phrase", "a", "k", "l", "r"))
        lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        scored = scratch.save(lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
        # the best of parts of each language first, so that no task ranks all its candidates
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        groups = max(1, -(-rows_of(scored) // RANKED))
        place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", place).where(F.col("rank") <= first)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
        totals = scratch.save(counts.where("words = 0").select("lang", F.col("f").alias("n")))
        out = best.join(sized(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        return seal(out)


COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
u AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM u, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
inner_ AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM kept, (VALUES (1), (2)) t(j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM low)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
