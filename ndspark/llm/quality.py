"""Quality classifier: hierarchical empirical Bayes.

Evidence of a document: a logistic model over its shape (signs, capitals, repetition, line form)
and over how many of its words stand in a lexicon that is learned from labelled rows (words whose
documents are of one class far beyond chance). The model of each label is fitted on a
bounded sample of labelled rows (``sample_rows``, picked by a hash of the id).

Priors: the document posteriors are summed by site and by path within the site, over all
documents, in partial aggregations. A site's rate is shrunk toward the global rate and a path's
rate toward its site's, each with a strength estimated from the spread of the rates (method of
moments), so sparse sites fall back to the global prior. The final log odds of a document are its
evidence with the global prior exchanged for its path's.

For tables without addresses the site is the source and the path is the language within it.

Edge cases: null and empty texts have the shape of an empty text and are scored like others;
null sites and paths are sites and paths of their own; without labelled rows of both classes the
evidence is the prior alone (probability 0.5) and nothing is rejected; repeated rows are scored
alike; of labels that repeat an id the larger values count, of labelled documents that do the text that sorts
first is learned from; other columns are ignored, of ``labels`` too; every whole text counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.llm.common import seal, sized, small_batches, text_key

SAMPLE_ROWS = 20_000
#: How far beyond chance (log) a word must be to enter a lexicon, and the documents below which none can be (not a test).
MARGIN, TESTED = 4.0, 5
WORD = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[#$%&*@^~<>{}\[\]\\=+|_]")
LOUD = re.compile(r"[!?]")


def shape(text: str | None) -> list[float]:
    """Features of a text's form, each about between 0 and 1, for any length."""
    text = text or ""
    n = len(text) or 1
    words = text.split()
    m = len(words) or 1
    lines = text.count("\n") + 1
    upper = sum(map(str.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    letters = len(WORD.findall(text))
    return [
        min(1.0, len(SIGNS.findall(text)) / m),
        min(1.0, len(LOUD.findall(text)) / m),
        min(1.0, text.count("|") / m),
        upper / m,
        repeats / m,
        1 - len(set(words)) / m,
        min(1.0, sum(map(len, words)) / m / 20),
        min(1.0, letters / m / 2),
        min(1.0, math.log1p(m) / 12),
        min(1.0, lines / m),
        min(1.0, (text.count(".") + text.count(",")) / m),
        min(1.0, sum(map(text.count, "0123456789")) / n * 5) if n < 1_000_000 else min(1.0, len(re.findall(r"\d", text)) / n * 5),
    ]


def hits(text: str | None, lexicon: frozenset[str]) -> float:
    """Lexicon words in the text, damped."""
    return math.log1p(sum(map(lexicon.__contains__, WORD.findall(text.lower())))) if text and lexicon else 0.0


@dataclass
class Head:
    """Logistic model of one label; ``prior`` is the class's share of the sample."""

    lexicon: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))
    prior: float = 0.5

    def logits(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(rows))
        return (rows - self.mean) / self.spread @ self.weights[1:] + self.weights[0]


def _squares(x: np.ndarray) -> np.ndarray:
    """Features and their powers: a form that is odd in either direction can be told."""
    return np.concatenate([x, x * x, np.sqrt(np.abs(x))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * len(x) / 100)
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon(counts: DataFrame, zero: str, one: str, sizes: np.ndarray) -> frozenset[str]:
    """Words whose share of documents of class 1 is too high for chance, over all words tested (Chernoff bound).

    counts: (w, documents of each class). All words are judged where they lie; those that pass come to
    the driver. As each needs some documents of the bounded sample, they are few.
    """
    base = float(np.clip(sizes[1] / max(1, sizes.sum()), 1e-6, 1 - 1e-6))
    n = F.col(zero) + F.col(one)
    tested = counts.where(n >= TESTED).count()
    rows = counts.where(n > 0).select("w", zero, one, n.alias("n"), (F.col(one) / n).alias("r")).where(F.col("r") > base)
    rows = rows.where(F.log((F.col(one) + 0.5) / (F.col(zero) + 0.5)) - math.log(base / (1 - base)) >= 1.5)
    apart = F.col("r") * F.log(F.col("r") / base) + F.when(F.col("r") < 1, (1 - F.col("r")) * F.log((1 - F.col("r")) / (1 - base))).otherwise(0.0)
    return frozenset(r["w"] for r in rows.where(F.col("n") * apart > math.log(tested + 1) + MARGIN).select("w").toLocalIterator())


def fit(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, Head]:
    """A head for each label, fitted on at most about ``sample_rows`` labelled documents."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(label_cols)]).where("id is not null").groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(label_cols))])
    total = named.count()
    if not total:
        return {c: Head() for c in label_cols}
    keep = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / total) * (1 << 30)))
    chosen = seal(named.where(keep))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    marks = [f"y{i}" for i in range(len(label_cols))]
    rows = rows.groupBy("id", *marks).agg(F.min("text").alias("text")).select("text", *marks)
    rows = seal(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            ys = [batch.column(i + 1).to_pylist() for i in range(len(marks))]
            for k, text in enumerate(batch.column(0).to_pylist()):
                for w in set(WORD.findall((text or "").lower())):
                    c = seen.setdefault(w, [0] * 2 * len(marks))
                    for i, y in enumerate(ys):
                        if y[k] in (0, 1):
                            c[2 * i + y[k]] += 1
            columns = [pa.array(list(seen), pa.string())] + [pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(2 * len(marks))]
            yield pa.RecordBatch.from_arrays(columns, ["w", *[f"c{i}" for i in range(2 * len(marks))]])

    cells = [f"c{i}" for i in range(2 * len(marks))]
    counts = rows.mapInArrow(count, "w string, " + ", ".join(f"{c} long" for c in cells)).groupBy("w").agg(*[F.sum(c).alias(c) for c in cells])
    counts = seal(counts)
    sizes = np.array(rows.agg(*[F.coalesce(F.sum((F.col(y) == v).cast("long")), F.lit(0)) for y in marks for v in (0, 1)]).first())
    heads = {}
    for i, c in enumerate(label_cols):
        heads[c] = Head(_lexicon(counts, cells[2 * i], cells[2 * i + 1], sizes[2 * i : 2 * i + 2]))
    lexicons = docs.sparkSession.sparkContext.broadcast([heads[c].lexicon for c in label_cols])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shape(t) + [hits(t, x) for x in lexicons.value] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), *[batch.column(j + 1) for j in range(len(marks))]], ["x", *marks])

    sample = rows.mapInArrow(features, "x array<double>, " + ", ".join(f"{y} int" for y in marks)).toPandas()
    for i, c in enumerate(label_cols):
        part = sample[sample[marks[i]].isin([0, 1])]
        y = part[marks[i]].to_numpy(float)
        if len(y) and 0 < y.mean() < 1:
            x = _squares(np.array(part["x"].tolist()))
            mean, spread = x.mean(0), x.std(0) + 1e-9
            heads[c] = Head(heads[c].lexicon, _logistic((x - mean) / spread, y), mean, spread, float(np.clip(y.mean(), 1e-6, 1 - 1e-6)))
    return heads


def evidence(docs: DataFrame, heads: dict[str, Head], id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", keyed: bool = False) -> DataFrame:
    """(id, site, path, a logit for each head) of every row; ``keyed`` adds h and g, the key of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(list(heads.values()))
    kind, names = docs.schema[id_col].dataType.simpleString(), [f"logit_{c}" for c in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            x = np.array([shape(t) + [hits(t, h.lexicon) for h in models] for t in texts]).reshape(len(texts), -1)
            x = _squares(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], *[pa.array(h.logits(x), pa.float64()) for h in models]], ["id", "site", "path", *key, *names])

    key = ["h", "g"] if keyed else []
    picked = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"), *(text_key(text_col) if keyed else []))
    return picked.mapInArrow(run, f"id {kind}, site string, path string, " + "".join(f"{x} long, " for x in key) + ", ".join(f"{x} double" for x in names))


def _logit(p):
    return F.log(p / (1 - p))


def _shrunk(rates: DataFrame, parent: str, own: str) -> DataFrame:
    """Adds the rate ``own`` of each group, shrunk toward ``parent`` with the strength that fits the spread of the groups."""
    raw = F.col("s") / F.col("n")
    between, spread, noise = rates.agg(
        F.sum(F.col("n") * F.pow(raw - F.col(parent), 2)) / F.sum("n"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))) / F.sum("n"),
        F.count(F.lit(1)) / F.sum("n"),
    ).first()
    # the spread between groups that is more than the noise of their sizes
    true = max(between - spread * noise, spread * 1e-4, 1e-12) if spread else 1.0
    strength = float(max((spread or 0.0) / true - 1, 1.0))
    return rates.withColumn(own, (F.col("s") + F.lit(strength) * F.col(parent)) / (F.col("n") + F.lit(strength)))


def with_priors(scored: DataFrame, logit_col: str, prior: float, out: str) -> DataFrame:
    """Adds ``out``: the probability after exchanging the sample's prior for the document's path's."""
    p = 1 / (1 + F.exp(-F.col(logit_col)))
    paths = seal(scored.groupBy("site", "path").agg(F.sum(p).alias("s"), F.count(F.lit(1)).alias("n")))
    overall = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    sites = paths.groupBy("site").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("overall", F.lit(prior if overall is None else overall))
    sites = seal(_shrunk(sites, "overall", "site_rate").select("site", "site_rate"))
    rates = paths.alias("a").join(sized(sites).alias("b"), F.expr("a.site <=> b.site")).select("a.site", "a.path", "a.s", "a.n", "b.site_rate")
    rates = seal(_shrunk(rates, "site_rate", "rate").select("site", "path", "rate"))
    rate = F.least(F.greatest(F.col("rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = scored.alias("d").join(sized(rates).alias("r"), F.expr("d.site <=> r.site and d.path <=> r.path")).select("d.*", "rate")
    return joined.withColumn(out, 1 / (1 + F.exp(-(F.col(logit_col) - math.log(prior / (1 - prior)) + _logit(rate))))).drop("rate")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS, keyed: bool = False) -> DataFrame:
    """(id, p_quality, p_toxic, accepted) of every row; rejected are documents of low quality and toxic ones; ``keyed`` adds h, g, site and path."""
    with small_batches(docs.sparkSession):
        heads = fit(docs, labels, ("quality", "toxic"), id_col, text_col, sample_rows)
        scored = seal(evidence(docs, heads, id_col, text_col, site_col, path_col, keyed))
    scored = with_priors(scored, "logit_quality", heads["quality"].prior, "p_quality")
    scored = with_priors(scored, "logit_toxic", heads["toxic"].prior, "p_toxic")
    known = [len(heads[c].weights) > 0 for c in ("quality", "toxic")]
    accepted = (F.col("p_quality") >= 0.5 if known[0] else F.lit(True)) & (F.col("p_toxic") < 0.5 if known[1] else F.lit(True))
    return scored.select(F.col("id").alias(id_col), *(["h", "g", "site", "path"] if keyed else []), "p_quality", "p_toxic", accepted.alias("accepted"))
