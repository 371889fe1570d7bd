"""Fill-in-the-middle transformation, in Spark SQL functions only.

A text is an array of code points. Four numbers from the SHA-256 of the row's id cut it into
prefix, middle and suffix and pick the form of the output:

* psm ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* spm ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
* plain, the text as it is: a share of the texts, empty ones, and those that hold a sentinel.

``restored`` parses the sentinels of an output and puts the parts in their order again. Since no
sentinel begins inside another one and a text with a sentinel stays plain, the parts are exact.

Edge cases: a null text is an empty one; a null id is hashed as no digits (``1:``); repeated rows
give repeated results; combining marks, emoji and line ends are code points like any other; an empty
table gives an empty result; other columns are ignored, whatever their names. The array of a text takes some 30 bytes a
code point in the task that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20


def _number(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of 8 hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _part(units: Column, start: Column, end: Column) -> Column:
    """Units from start (from 0) up to end, as text."""
    return F.array_join(F.slice(units, start + 1, end - start), "")


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) of every row; the two lengths are null where the form is plain."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    # one projection a step, so that the array of a text is made once
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("units"), *[_number(F.col("digest"), k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.select("*", F.size("units").cast("long").alias("n"))
    first, second = (F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("id", "text", "units", "n", F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"), form.alias("form"))
    parts = {"prefix": (F.lit(0), F.col("a")), "middle": (F.col("a"), F.col("b")), "suffix": (F.col("b"), F.col("n").cast("int"))}
    rows = rows.select("id", "text", "n", "a", "b", "form", *[_part(F.col("units"), *ends).alias(name) for name, ends in parts.items()])
    p, s, m = (F.concat(F.lit(mark), F.col(name)) for mark, name in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    lengths = F.when(cut, F.col("a").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars")
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "form", *lengths, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its sentinels are parsed and the parts put in order."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


FILL_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
