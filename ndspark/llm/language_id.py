"""Language identification: word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is
scored by its character n-grams: the longest length of which some n-gram is known counts, else
the next shorter one, down to single characters.

The model is fitted on a bounded sample of the labelled rows (``docs_per_language``, picked by a
hash of the id, so that reruns agree). That sample is the only bound: every language, every word of it
that occurs twice, however long, and every n-gram of its words is in the model, whose size follows the
sample's and not the corpus; n-grams are counted by Spark, and the driver holds the model as packed strings and counts. Prediction runs over every whole text in Arrow batches without any shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows without id,
text or lang are never learned from; with nothing to learn from every text is ``und``. Repeated
rows are predicted alike, ties go to the language that sorts first, texts of any length are read whole,
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import seal

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 150_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows that a model must not learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Logs:
    """Log frequencies by language of some strings, as rows of one matrix."""

    def __init__(self, names: pa.Array, counts: np.ndarray):
        """counts: a row for each string, a column for each language."""
        self.names = names
        self.matrix = np.log((counts + 0.5) / (counts.sum(0) + 1.0 + 0.5 * len(names)))

    @cached_property
    def row(self) -> dict[str, int]:
        """Made where it is first asked for, in a task: the driver holds packed strings only."""
        return dict(zip(self.names.to_pylist(), range(len(self.names))))

    def mean(self, strings: list[str]) -> np.ndarray | None:
        """Of those that are known; None if none is."""
        rows = [i for s in strings if (i := self.row.get(s)) is not None]
        return self.matrix[rows].mean(0) if rows else None


class BackoffModel:
    """Log frequencies of words and of n-grams of each length."""

    def __init__(self, languages: list[str], words: Logs, grams: list[Logs]):
        self.languages, self.words, self.grams = languages, words, grams

    def score(self, word: str) -> np.ndarray:
        """Log likelihoods by language, of an unseen word the mean of its n-grams' of one length."""
        if (i := self.words.row.get(word)) is not None:
            return self.words.matrix[i]
        for n in range(len(self.grams), 0, -1):
            if (found := self.grams[n - 1].mean(_grams(word, n))) is not None:
                return found
        return np.zeros(len(self.languages))


class _Scores(dict):
    """word -> row of ``matrix``; row 0 is for what has no letter."""

    def __init__(self, model: BackoffModel):
        super().__init__()
        self.model = model
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.n, self.matrix = 1, np.zeros((4096, len(self.model.languages)))

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = 0
            return 0
        if self.n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.n] = self.model.score(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if self.n > _CACHE_WORDS:
            self.restart()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        rows = rows[rows > 0]
        if not len(rows) or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.bincount(rows, minlength=self.n) @ self.matrix[: self.n] if len(rows) > self.n else self.matrix[rows].sum(0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1000, longest: int = 5) -> BackoffModel:
    """Fits on about ``docs_per_language`` documents of each language, all of a rarer one."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return BackoffModel([], Logs(pa.array([], pa.string()), np.zeros((0, 0))), [])
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))])[F.col("lang")]
    sample = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share)
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for w in LETTERS.findall(text.lower()):
                    seen[w, lang] = seen.get((w, lang), 0) + 1
            columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["w", "lang", "n"])

    places = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(at[k]))])[F.col("lang")]
    counts = sample.mapInArrow(count, "w string, lang string, n long").groupBy("w", places.alias("lang")).agg(F.sum("n").alias("n"))
    counts = seal(counts)  # of the sample's words; words and n-grams are counted from it
    often = counts.groupBy("w").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by")).where("n > 1").select("w", "by")
    return BackoffModel(languages, _logs(often, len(languages)), [_logs(_counted_grams(counts, n), len(languages)) for n in range(1, longest + 1)])


def _counted_grams(counts: DataFrame, n: int) -> DataFrame:
    """(g, [(language, count)]) of what ``_grams`` gives for each word."""
    w = F.concat(F.lit("<"), "w", F.lit(">")) if n > 1 else F.col("w")
    starts = F.sequence(F.lit(1), F.length(w) - n + 1)
    grams = counts.where(F.length(w) >= n).select(F.explode(F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).alias("g"), "lang", "n")
    return grams.groupBy("g", "lang").agg(F.sum("n").alias("n")).groupBy("g").agg(F.collect_list(F.struct("lang", "n")).alias("by"))


def _logs(counted: DataFrame, languages: int) -> Logs:
    """From rows (string, [(language, count)])."""
    found = counted.toArrow()
    lists = found.column(1).combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat, matrix = lists.flatten(), np.zeros((len(lists), languages))
    matrix[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), flat.field("lang").to_numpy()] = flat.field("n").to_numpy()
    return Logs(found.column(0).combine_chunks(), matrix)


def predict(docs: DataFrame, model: BackoffModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            found = [scores.predict(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accuracy(predicted: DataFrame, truth: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> float:
    """Share of rows with a language whose prediction agrees."""
    rows = truth.where(F.col(lang_col).isNotNull()).select(id_col, lang_col).join(predicted, id_col)
    share = rows.agg(F.avg((F.col("lang_pred") == F.col(lang_col)).cast("double"))).first()[0]
    return math.nan if share is None else share
