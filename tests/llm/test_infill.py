"""Fill-in-the-middle: edge cases and exact round trips."""

import hashlib

from pyspark.sql import functions as F

from ndspark.llm import infill

TEXTS = [None, "", "a", "ab", "x<P>y", "<S>", "tail <M>", "<<<>>>", "<P", "é́\U0001f468‍👩 \r\n\t", "𝔘" * 300, "$1 \\2 $", "one two three " * 9, "word " * 40_000, "\u0000 z"]


def plainly(doc_id, text):
    """The transformation by plain string work."""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_every_row_as_by_plain_string_work(spark):
    rows = [(20 * k + i, t, 5, "clash", "clash") for i, t in enumerate(TEXTS) for k in range(12)] + [(None, "no id", 1, "x", "y"), (7, "again", 1, "x", "y"), (7, "again", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string, units string")
    made = infill.rearrange(docs).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in made), key=str)
    assert found == sorted(((i, *plainly(i, t), t or "") for i, t, *_ in rows), key=str)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert infill.rearrange(docs.limit(0)).count() == 0


def test_shares_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(400)], "doc_id long, text string")
    forms = lambda **x: {r["form"] for r in infill.rearrange(docs, **x).select("form").distinct().collect()}
    assert forms(plain=0, spm=0) == {"psm"} and forms(plain=0, spm=100) == {"spm"} and forms(plain=100) == {"plain"}
    one, other = ({r["doc_id"]: r["output"] for r in infill.rearrange(docs, seed=s).collect()} for s in (1, 2))
    assert one != other


def test_no_python_and_no_shuffle(spark):
    made = infill.rearrange(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))
    plan = made.select(infill.restored(F.col("output"), F.col("form")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
