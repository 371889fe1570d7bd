"""Mixing sources to target weights: Pareto order sampling.

A source's target is a share of ``total_share`` of all sizes by its weight, stopped at
``most_copies`` times its own size; what is over goes to the other sources by weight until none
is above. A source with target / size = c + p then takes c whole copies of each document, and a
sample of the words still missing by Pareto order sampling: a document's inclusion odds are the source's
p / (1 - p) times its size over the source's mean size to the power of ``tilt`` (so longer documents, which
cost fewer cuts, come in more often; 0 would give all the same odds); documents are ranked by random odds
u / (1 - u) over inclusion odds, and taken in that order up to the words missing. The source's odds
scale all ranks alike, so the order is by the random odds over the document's own factor. u comes from a
hash of id, size and text, so reruns agree.

No source is sorted in one task: ranks are first counted in bins of rank / (1 + rank), prefix sums over the
bins find the bin in which the sample ends, and only that bin's documents are ordered one by one.

Edge cases: a null text has size 0; a null source is a source of its own, after all others; a
source of size 0 has target 0; documents of size 0 get the whole copies only; an empty table gives an empty
result; null ids are told apart by their texts; repeated rows (same id and text) have the same rank and are
taken one after the other, so which of them has a copy more is open, how many have is not; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ndspark.llm.common import seal, sized, text_key

WORDS = r"[^\x20\x09-\x0D]+"
#: Equal bins of u in each source; the last one that is needed holds about this part of its documents.
BINS = 4096


#: How much more often longer documents are sampled: the power of size over mean size in their inclusion odds.
TILT = 0.5


def uniform(id_col: Column, size: Column, text: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the id, the size and the text's MD5."""
    parts = [F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), size.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """Adds weight and target to (source, source_size); one row a source, ordered by code point, null last.

    Water filling in closed form: sources are ordered by the level at which they are full; a prefix
    of them is at its stop, the rest shares what is left by weight. Windows without a key see one row
    per source only.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))
    rows = sources.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    live = rows.where("source_size > 0")
    live = live.withColumn("cut", F.lit(total_share) * F.sum("source_size").over(every) - F.lit(most_copies) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    live = live.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # full if its stop is not above its part of what the sources before it have left
    live = live.withColumn("stopped", F.lit(most_copies) * F.col("source_size") * F.col("open") <= F.col("cut") * F.col("weight"))
    live = live.withColumn("rest", F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), "cut", "open"))).over(every))
    share = F.col("rest")["cut"] * F.col("weight") / F.col("rest")["open"]
    target = F.when(F.col("stopped"), (F.lit(most_copies) * F.col("source_size")).cast("double")).otherwise(share)
    done = live.select("source", "source_size", F.least(target, (F.lit(most_copies) * F.col("source_size")).cast("double")).alias("target"))
    return done.unionByName(rows.where("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, most_copies: int = 2, tilt: float = TILT, seed: str = "mix", keyed: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row; taken = copies * size; ``keyed`` adds h and g, the key of its text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    key = text_key(text_col) if keyed else []
    rows = seal(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col), size, F.col(text_col), seed).alias("u"), *key))
    sources = seal(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("source_docs")))
    plan = targets(sources.drop("source_docs"), weights, total_share, most_copies).alias("t").join(sized(sources.select("source", "source_docs")).alias("s"), F.expr("t.source <=> s.source"))
    plan = seal(plan.select("t.*", "source_docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(most_copies)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("p", ratio - F.col("whole"))
    plan = plan.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    # the part of the rank that differs within a source
    means = seal(plan.select("source", "source_size", "source_docs"))
    ranked = rows.where("size > 0").alias("r").join(sized(means).alias("p"), F.expr("r.source <=> p.source"))
    factor = F.pow(F.col("size") * F.col("source_docs") / F.col("source_size"), F.lit(tilt)) if tilt != 0.5 else F.sqrt(F.col("size") * F.col("source_docs") / F.col("source_size"))
    ranked = ranked.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / factor).select("r.*", "rank")
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.alias("b").join(sized(plan).alias("p"), F.expr("b.source <=> p.source")).select("b.*", "missing")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = bins.groupBy("source").agg(F.max(F.when(F.col("before") < F.col("missing"), F.struct("bin", "before"))).alias("end"))
    ends = seal(last.select("source", F.col("end")["bin"].alias("end_bin"), F.col("end")["before"].alias("end_before")))
    plan = plan.alias("p").join(F.broadcast(ends).alias("e") if ends.count() <= 500_000 else ends.alias("e"), F.expr("p.source <=> e.source"), "left")
    plan = seal(plan.select("p.*", "end_bin", "end_before"))
    ranked = ranked.unionByName(rows.where("size = 0").withColumn("rank", F.lit(None).cast("double")).withColumn("bin", F.lit(None).cast("int")))
    joined = ranked.alias("r").join(sized(plan).alias("p"), F.expr("r.source <=> p.source"))
    joined = joined.select("r.*", "source_size", "target", "whole", "p", "missing", "end_bin", "end_before")
    at = F.col("bin") == F.col("end_bin")
    inside = joined.where(at)
    running = Window.partitionBy("source", "bin").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("end_before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    # a document is in if more than half of it lies within the words still missing
    inside = inside.withColumn("more", (ahead + F.col("size") / 2.0 <= F.col("missing")).cast("long"))
    outside = joined.where(~F.coalesce(at, F.lit(False))).withColumn("more", F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)).cast("long"))
    out = inside.unionByName(outside)
    copies = F.col("whole") + F.when(F.col("p") > 0, F.col("more")).otherwise(0)
    return out.select(F.col("id").alias(id_col), *(["h", "g"] if keyed else []), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: What ``mix`` returns for a table ``docs`` (doc_id, text, source), in DuckDB's SQL: the sample is found by a
#: plain running sum over each source.
MIX_SQL = r"""
counted_ AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM docs),
rows_ AS (SELECT doc_id, source, size,
                 (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM counted_),
sources_ AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS source_docs FROM rows_ GROUP BY source),
weighed_ AS (SELECT *, CASE WHEN source_size > 0 THEN [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] ELSE 0 END AS weight FROM sources_),
live_ AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0) AS cut,
                 sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_
          FROM weighed_ WHERE source_size > 0
          WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops_ AS (SELECT *, 2 * source_size * open_ <= cut * weight AS stopped FROM live_),
rest_ AS (SELECT cut, open_ FROM stops_ WHERE NOT stopped ORDER BY source_size / weight, cut, open_ LIMIT 1),
targets_ AS (SELECT source, source_size, source_docs, least(CASE WHEN stopped THEN 2.0 * source_size ELSE (SELECT cut FROM rest_) * weight / (SELECT open_ FROM rest_) END, 2.0 * source_size)::DOUBLE AS target FROM stops_
             UNION ALL SELECT source, source_size, source_docs, 0.0 FROM weighed_ WHERE source_size = 0),
plan_ AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets_),
parts_ AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS p, target - whole * source_size AS missing FROM plan_),
odds_ AS (SELECT r.doc_id, r.source, r.size, source_size, target, whole, p, missing,
                 CASE WHEN r.size > 0 THEN (u / (1 - u)) / sqrt((r.size * source_docs)::DOUBLE / source_size::DOUBLE) ELSE 1e308 END AS rank
          FROM rows_ r JOIN parts_ p ON r.source IS NOT DISTINCT FROM p.source),
ranked_ AS (SELECT r.doc_id, r.source, r.size, source_size, target, whole, p, missing,
                   coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY rank, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM odds_ r),
mixed_ AS (SELECT doc_id, source, size, source_size::BIGINT AS source_size, target,
                  ((whole + CASE WHEN p > 0 AND ahead + size / 2.0 <= missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ranked_)
"""
