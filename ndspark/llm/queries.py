"""Queries of the corpus operators over the standard tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark.llm import archives, decontaminate, embedding_dedup, html_text, infill, language_id, licenses, mixing, near_dup, passage_dedup, phrases, quality, top_k
from ndspark.llm.common import Scratch, seal


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, from a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id") & F.col("doc_id").isNotNull()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences, rules and licences of every document."""
    found = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "rules").alias("rules"), F.concat_ws(",", "licences").alias("licences"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from archives of all pages."""
    with Scratch(spark) as scratch:
        packages = scratch.save(archives.write_packages(archives.plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{scratch.root}/packages"))
        read = archives.read_packages(packages)
        return seal(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document."""
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return passage_dedup.report(docs, *passage_dedup.repeated(docs))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of each vector whose id is divisible by 50, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's output, and of the text rebuilt from it."""
    made = infill.rearrange(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language, over all documents."""
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_language_id": op2_language_id,
    "op3_html_text": op3_html_text,
    "op4_mixing": op4_mixing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_top_k": op11_top_k,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _licence_sql() -> str:
    known = ", ".join(f"('{sentence}', '{name}')" for sentence, name in licenses.KNOWN.items())
    rules = ", ".join(f"({i}, '{rule}', '{licence}', '%{''.join(f'[{x}]%' for x in ids)}')" for i, (rule, licence, ids) in enumerate(licenses.RULES))

    def replaced(x: str, pattern: str, stays: str, options: str = "") -> str:
        return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(stays.format('', chr(92) + '1', chr(92) + '2'))}{options})"

    lines = "coalesce(text, '')"
    by_line = replaced(lines, licenses.LINE, licenses.LINE_STAYS, ", 'g'")
    for pattern, stays in licenses.UNWRAP:
        lines = replaced(lines, pattern, stays, ", 'g'")
    form = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, stays in licenses.COMMON:
        form = replaced(form, pattern, stays)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rule(n, rule, licence, pattern) AS (VALUES {rules}),
doc AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
cut AS (SELECT d, 1 AS way, string_split_regex({by_line}, {_quoted(licenses.SPLIT)}) AS parts FROM doc UNION ALL SELECT d, 2, string_split_regex({lines}, {_quoted(licenses.PARAGRAPHS)}) FROM doc),
part AS (SELECT d, way, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
named AS (SELECT d, way, i, id FROM part JOIN known ON {form} = sentence),
seq AS (SELECT d, way, string_agg(id, ',' ORDER BY i) AS ids, string_agg('[' || id || ']', '' ORDER BY i) AS sequence, count(*) AS k FROM named GROUP BY d, way),
best AS (SELECT d, first(ids ORDER BY k DESC, way) AS sentence_ids FROM seq GROUP BY d),
hit AS (SELECT d, rule, licence, min(n) AS n FROM seq JOIN rule ON sequence LIKE pattern GROUP BY d, rule, licence),
rules AS (SELECT d, string_agg(rule, ',' ORDER BY n) AS rules FROM hit GROUP BY d),
lic AS (SELECT d, string_agg(licence, ',' ORDER BY n) AS licences FROM (SELECT d, licence, min(n) AS n FROM hit GROUP BY d, licence) GROUP BY d)
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM doc LEFT JOIN best USING (d) LEFT JOIN rules USING (d) LEFT JOIN lic USING (d)
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": f"WITH docs AS (SELECT doc_id, text, source FROM documents), {mixing.MIX_SQL} SELECT doc_id, size, source_size, target, taken FROM mixed_",
    "op7_licenses": _licence_sql(),
    "op8_warc": _WARC_SQL,
    "op11_top_k": top_k.TOP_K_SQL,
    "op12_fill_in_middle": infill.FILL_SQL,
    "op13_collocations": phrases.COLLOCATION_SQL,
}
