"""Named queries of generators, images and the rest of the operators, sized by the standard tables or joined to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray
from ndspark.operators import nn
from ndspark.plans.order import durable, shared_folder
from ndspark.queries import ELEMENTS, EVENTS, HOLES, KEYS, WIDTH, R, base, column, over, pair, register, rounded, vectors
from ndspark.sources import binary, create, store
from ndspark.sources.random import Generator
from ndspark.sources.records import Records, RecordType
from ndspark.streaming.scans import running

# ---- generators ---------------------------------------------------------------------------


def _with(f):
    """f(x, its size) over the events."""
    return lambda df: (lambda x: f(x, x.size))(column(df, "x"))


def _generators() -> None:
    count = "(SELECT count(*) FROM base)"
    over("source_seq", EVENTS, _with(lambda x, n: create.seq(x.spark, n, 1.0, 0.5).add(x)), R("x + 1 + i * 0.5"))
    over("source_seq_uint8", EVENTS, _with(lambda x, n: create.seq(x.spark, n, 0, 1, "UInt8").cast_to("Int64").add(x.cast_to("Int64"))), "(i % 256 + trunc(x))::BIGINT")
    over("source_logseq", EVENTS, _with(lambda x, n: create.logseq(x.spark, n, -2.0, 0.0001, 10).mul(x)), R("pow(10, -2 + i * 0.0001::DOUBLE) * x"))
    over("source_linspace", EVENTS, _with(lambda x, n: create.linspace(x.spark, 0.0, 1.0, n).add(x)), R(f"x + i / ({count} - 1)"))
    over("source_logspace", EVENTS, _with(lambda x, n: create.logspace(x.spark, 0.0, 2.0, n).div(x.abs().add(1.0))), R(f"pow(10, i * (2.0::DOUBLE / ({count} - 1))) / (abs(x) + 1)"))
    over("source_zeros", EVENTS, _with(lambda x, n: create.zeros(x.spark, n).sub(x)), R("-x"))
    over("source_ones", EVENTS, _with(lambda x, n: create.ones(x.spark, n, "Int32").add(x)), R("1 + x"))
    over("source_fill", EVENTS, _with(lambda x, n: create.full(x.spark, n, 7.5).mul(x.fill(2.0)).add(x)), R("15 + x"))
    over("source_new", EVENTS, _with(lambda x, n: create.new(x.spark, [n], "DFloat").add(create.new_like(x, 3.0)).add(x)), R("3 + x"))
    over("source_step", EVENTS, _with(lambda x, n: create.step_range(x.spark, 1.0, 1.0 + (n - 1) * 0.25, 0.25).add(x)), R("x + 1 + i * 0.25"))
    over("source_cast", EVENTS, _with(lambda x, n: (x * 7.0).cast_to("Int8")), "((trunc(x * 7)::BIGINT + 128) % 256 + 256) % 256 - 128")
    register("source_eye", lambda s, d: (lambda v: rounded(v.gemm(create.eye(s, WIDTH, WIDTH, "DFloat", 3, 2))))(vectors(s, d)), f"WITH e AS ({ELEMENTS}) SELECT a.i0, a.i1::BIGINT AS i1, {R('coalesce(3 * b.v, 0)')} AS v FROM e a LEFT JOIN e b ON a.i0 = b.i0 AND b.i1 = a.i1 - 2")
    register("source_literal", lambda s, d: rounded(vectors(s, d)[True, 0:3].gemm(create.array(s, [[1, 2, 3], [5, 7], [1.5]]))), f"WITH w AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 5.0), (1, 1, 7.0), (2, 0, 1.5)) t(k, j, w)), e AS ({ELEMENTS}) SELECT i0, j::BIGINT AS i1, {R('sum(v * w)')} AS v FROM e JOIN w ON i1 = k GROUP BY i0, j")
    register("source_parse", lambda s, d: rounded(vectors(s, d)[True, 0:2].gemm(create.parse(s, "1 2.5;3 4"))), f"WITH w AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.5), (1, 0, 3.0), (1, 1, 4.0)) t(k, j, w)), e AS ({ELEMENTS}) SELECT i0, j::BIGINT AS i1, {R('sum(v * w)')} AS v FROM e JOIN w ON i1 = k GROUP BY i0, j")
    register("source_records", _records, f"WITH base AS ({KEYS}) SELECT i AS i0, j::BIGINT AS i1, {R('CASE j WHEN 0 THEN t ELSE b * 0.5 END + a')} AS v FROM base, (VALUES (0), (1)) u(j)")
    for name, make, low, high, mean, var in (("rand", lambda g, s, n: g.rand(s, n), 0, 1, 0.5, 1 / 12), ("rand_norm", lambda g, s, n: g.rand_norm(s, n, 2.0, 0.5), -2, 6, 2.0, 0.25), ("rand_int", lambda g, s, n: g.rand(s, n, 10, dtype="Int32"), 0, 9.5, 4.5, 8.25)):
        register(f"source_{name}", lambda s, d, m=make, x=(low, high, mean, var): _drawn(s, d, m, *x), "SELECT count(*)::BIGINT AS n, true AS inside, true AS mean, true AS var, true AS again, true AS onwards FROM events")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Orders as records of a whole number and a pair; the number is added to both fields of the pair."""
    kind = RecordType().add("id", "Int64").add("x", "DFloat", [2])
    df = base(s, d, KEYS)
    records = Records(df.select(F.col("i").alias("i0"), F.struct(F.col("a").alias("id"), F.array("t", F.col("b") * 0.5).alias("x")).alias("v")), [df.count()], kind)
    return rounded(records["x"].add(records["id"].cast_to("DFloat").expand_dims(1)))


def _drawn(s: SparkSession, d: str, make, low: float, high: float, mean: float, var: float) -> DataFrame:
    """As many numbers as there are events: their range, moments within five standard errors, and what a seed gives again."""
    n = s.read.parquet(f"{d}/events.parquet").count()
    g, other = Generator(42), Generator(7)
    other.srand(42)
    first, again, second = make(g, s, n), make(other, s, n), make(g, s, n)
    rows = first.df.join(again.df.withColumnRenamed("v", "w"), "i0").join(second.df.withColumnRenamed("v", "z"), "i0")
    v = F.col("v").cast("double")
    return rows.agg(F.count(v).alias("n"), F.bool_and(v.between(low, high)).alias("inside"), (F.abs(F.avg(v) - mean) < 5 * (var / n) ** 0.5).alias("mean"), (F.abs(F.var_samp(v) / var - 1) < 10 / n**0.5).alias("var"), F.bool_and(F.col("v") == F.col("w")).alias("again"), (F.count_if(F.col("v") == F.col("z")) < 0.2 * n).alias("onwards"))


# ---- selection, options, conversion -------------------------------------------------------


def _gram(s: SparkSession, d: str) -> NDArray:
    return vectors(s, d).gram()


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The vectors, stored in chunks; a slice of them, read from its chunks."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    store.save(vectors(s, d), path, [128, 16])
    out = durable(rounded(store.load(s, path)[100:-100:3, 5:40]))
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(s._jsc.hadoopConfiguration()).delete(where, True)
    return out


def _swapped(s: SparkSession, d: str) -> DataFrame:
    """Packed in network order, as hexadecimal digits."""
    a = NDArray.from_column(base(s, d, "SELECT event_id AS i, CAST((user_id * 65536 + event_id) % 2147483647 AS INT) AS x FROM events"), "x", "i")
    packed = binary.pack(a, swap=True).select("block", F.hex("data").alias("h"))
    digits = packed.select("block", F.posexplode(F.regexp_extract_all("h", F.lit("(.{8})"), F.lit(1))).alias("k", "text"))
    return digits.select((F.col("block") * binary.BLOCK + F.col("k")).alias("i0"), "text")


def _options() -> None:
    x, y = (lambda df: column(df, "x")), (lambda df: column(df, "y"))
    e = f"WITH e AS ({ELEMENTS}), g AS (SELECT a.i1 AS i, b.i1 AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY ALL) "
    for name, where in {"triu_indices": "i <= j", "tril_indices": "i >= j", "diag_indices": "i = j"}.items():
        register(f"shape_{name}", lambda s, d, n=name: (lambda g: rounded(g[getattr(g, n)()]))(_gram(s, d)), e + f"SELECT row_number() OVER (ORDER BY i, j) - 1 AS i0, {R('v')} AS v FROM g WHERE {where}")
    register("linear_gemm_int", lambda s, d: (lambda a: rounded(a.transpose().gemm(a)))(column(base(s, d, KEYS), "b").reshape(None, 10)), f"WITH base AS ({KEYS}), m AS (SELECT i // 10 AS r, i % 10 AS c, b FROM base) SELECT p.c AS i0, q.c AS i1, sum(p.b * q.b)::BIGINT AS v FROM m p JOIN m q USING (r) GROUP BY 1, 2")
    register("store_slice", _stored, f"WITH e AS ({ELEMENTS}), n AS (SELECT count(*) AS n FROM embeddings) SELECT (i0 - 100) // 3 AS i0, (i1 - 5)::BIGINT AS i1, {R('v')} AS v FROM e, n WHERE i0 >= 100 AND i0 < n - 100 AND (i0 - 100) % 3 = 0 AND i1 BETWEEN 5 AND 39")
    register("sink_network", _swapped, "SELECT event_id AS i0, lpad(hex((user_id * 65536 + event_id) % 2147483647), 8, '0') AS text FROM events")
    register("source_format", lambda s, d: x(base(s, d, EVENTS)).format("%.3f"), f"WITH base AS ({EVENTS}) SELECT i AS i0, printf('%.3f', x) AS text FROM base")
    register("same_as", _same, "SELECT 'reversed twice' AS name, true AS v UNION ALL SELECT 'one element changed', false UNION ALL SELECT 'another type', true UNION ALL SELECT 'another shape', false")
    register("index_rest", lambda s, d: rounded(vectors(s, d).reshape(None, 8, 8)[3, "rest"]), f"WITH e AS ({ELEMENTS}) SELECT (i1 // 8)::BIGINT AS i0, (i1 % 8)::BIGINT AS i1, {R('v')} AS v FROM e WHERE i0 = 3")
    register("index_sum", lambda s, d: rounded(vectors(s, d)["sum", 4:12]), f"WITH e AS ({ELEMENTS}) SELECT (i1 - 4)::BIGINT AS i0, {R('sum(v)')} AS v FROM e WHERE i1 BETWEEN 4 AND 11 GROUP BY i1")
    register("index_axis_mask", _axis_mask, f"WITH e AS ({ELEMENTS}), k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label < 3) SELECT r AS i0, i1::BIGINT AS i1, {R('v')} AS v FROM e JOIN k ON vec_id = i0")
    register("index_keep_axis", lambda s, d: rounded(vectors(s, d).slice(-1, slice(0, 64, 7))), f"WITH e AS ({ELEMENTS}) SELECT 0::BIGINT AS i0, (i1 // 7)::BIGINT AS i1, {R('v')} AS v FROM e WHERE i0 = (SELECT max(vec_id) FROM embeddings) AND i1 % 7 = 0")
    quotient = "CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN CAST('NaN' AS DOUBLE) ELSE sign(x) * CAST('Infinity' AS DOUBLE) END ELSE x / y END"
    register("elementwise_divmod", lambda s, d: (lambda df: pair(*x(df).divmod(y(df))))(base(s, d, EVENTS)), f"WITH base AS ({EVENTS}) SELECT i AS i0, {R(quotient)} AS v, {R('CASE WHEN y = 0 THEN CAST(NULL AS DOUBLE) ELSE x - y * trunc(x / y) END')} AS w FROM base".replace("CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)"))
    for name, f in (("maximum", "greatest"), ("minimum", "least")):
        over(f"nan_{name}_flag", HOLES, lambda df, n=name: getattr(NDArray, n)(column(df, "x"), column(df, "u").cast_to("DFloat"), nan=True), R(f"CASE WHEN isnan(x) THEN x ELSE {f}(x, u) END"))
        over(f"nan_{name}_default", HOLES, lambda df, n=name: getattr(NDArray, n)(column(df, "x"), column(df, "u").cast_to("DFloat")), R(f"CASE WHEN isnan(x) THEN u ELSE {f}(x, u) END"))
    over("nan_mulsum_flag", HOLES, lambda df: column(df, "x").mulsum(column(df, "u").cast_to("DFloat"), nan=True), "SELECT round(sum(x * u) FILTER (NOT isnan(x)), 4) AS v FROM base")
    over("combine_insert_places", EVENTS, lambda df: x(df).insert(column(df, "u"), y(df)), f", p AS (SELECT u, y, row_number() OVER (ORDER BY u, i) - 1 AS r FROM base), c AS (SELECT u, count(*) AS c FROM base GROUP BY u) SELECT u + r AS i0, {R('y')} AS v FROM p UNION ALL SELECT i + (SELECT coalesce(sum(c), 0) FROM c WHERE c.u <= base.i)::BIGINT AS i0, {R('x')} AS v FROM base")
    over("combine_repeat_places", KEYS, lambda df: column(df, "t").repeat(column(df, "s")), f", p AS (SELECT t, s, sum(s) OVER (ORDER BY i) - s AS first FROM base) SELECT (first + k)::BIGINT AS i0, {R('t')} AS v FROM (SELECT first, t, unnest(range(s)) AS k FROM p WHERE s > 0)")
    over("index_delete_places", KEYS, lambda df: column(df, "t").delete(column(df, "a")), f", g AS (SELECT DISTINCT a FROM base) SELECT row_number() OVER (ORDER BY i) - 1 AS i0, {R('t')} AS v FROM base WHERE i NOT IN (SELECT a FROM g)")


def _same(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    changed = v.assign((0, 0), 9.0)
    cases = {"reversed twice": v.reverse().reverse(), "one element changed": changed, "another type": v.cast_to("SFloat"), "another shape": v.flatten()}
    rows = [v.base.sparkSession.createDataFrame([(name, v.same_as(a))], "name string, v boolean") for name, a in cases.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _axis_mask(s: SparkSession, d: str) -> DataFrame:
    labels = NDArray.from_column(base(s, d, "SELECT vec_id AS i, CAST(label AS BIGINT) AS l FROM embeddings"), "l", "i")
    return rounded(vectors(s, d)[labels.lt(3), True])


# ---- images -------------------------------------------------------------------------------


def _images(s: SparkSession, d: str, *shape: int) -> NDArray:
    v = vectors(s, d)
    return v.reshape(v.shape[0], *(shape or (1, 8, 8)))


def _part(s: SparkSession, d: str, *shape: int) -> NDArray:
    """The first elements of each vector as an image of this shape."""
    n = 1
    for m in shape:
        n *= m
    v = vectors(s, d)[True, 0:n]
    return v.reshape(v.shape[0], *shape)


def _nets() -> None:
    pixels = f"WITH e AS ({ELEMENTS}), g AS (SELECT i0 AS n, i1 // 8 AS y, i1 % 8 AS x, v FROM e)"
    weight = lambda s: create.seq(s, [2, 1, 3, 3]) % 5.0 - 2.0
    k33 = "k AS (SELECT o.range AS o, y.range AS ky, x.range AS kx, ((o.range * 3 + y.range) * 3 + x.range)::DOUBLE % 5 - 2 AS w FROM range(2) o, range(3) y, range(3) x)"
    register("nn_conv", lambda s, d: rounded(nn.conv(_images(s, d), weight(s), create.full(s, [2], 2.0), stride=[2, 1], pad=[1, 1])), f"""
{pixels}, {k33}, t AS (SELECT n, o, (y + 1 - ky) // 2 AS oy, x + 1 - kx AS ox, v * w AS p FROM g, k WHERE y + 1 - ky >= 0 AND (y + 1 - ky) % 2 = 0)
SELECT n AS i0, o AS i1, oy::BIGINT AS i2, ox::BIGINT AS i3, {R('sum(p) + 2')} AS v FROM t WHERE oy < 4 AND ox BETWEEN 0 AND 7 GROUP BY n, o, oy, ox""")
    register("nn_conv_3d", lambda s, d: rounded(nn.conv(_images(s, d, 1, 4, 4, 4), create.seq(s, [2, 1, 2, 2, 2]) % 3.0 - 1.0)), f"""
WITH e AS ({ELEMENTS}), g AS (SELECT i0 AS n, i1 // 16 AS z, i1 // 4 % 4 AS y, i1 % 4 AS x, v FROM e), k AS (SELECT range // 8 AS o, range // 4 % 2 AS kz, range // 2 % 2 AS ky, range % 2 AS kx, range::DOUBLE % 3 - 1 AS w FROM range(16)),
t AS (SELECT n, o, z - kz AS oz, y - ky AS oy, x - kx AS ox, v * w AS p FROM g, k)
SELECT n AS i0, o AS i1, oz::BIGINT AS i2, oy::BIGINT AS i3, ox::BIGINT AS i4, {R('sum(p)')} AS v FROM t WHERE oz BETWEEN 0 AND 2 AND oy BETWEEN 0 AND 2 AND ox BETWEEN 0 AND 2 GROUP BY ALL""")
    register("nn_conv_transpose", lambda s, d: rounded(nn.conv_transpose(_images(s, d), create.seq(s, [1, 2, 2, 3]) % 5.0 - 2.0, stride=2, out_size=[17, 17])), f"""
{pixels}, k AS (SELECT o.range AS o, y.range AS ky, x.range AS kx, ((o.range * 2 + y.range) * 3 + x.range)::DOUBLE % 5 - 2 AS w FROM range(2) o, range(2) y, range(3) x),
t AS (SELECT n, o, y * 2 + ky AS oy, x * 2 + kx AS ox, sum(v * w) AS p FROM g, k GROUP BY ALL), m AS (SELECT DISTINCT n FROM g)
SELECT m.n AS i0, o.range AS i1, y.range AS i2, x.range AS i3, {R('coalesce(p, 0)')} AS v FROM m, range(2) o, range(17) y, range(17) x LEFT JOIN t ON t.n = m.n AND t.o = o.range AND oy = y.range AND ox = x.range""")
    register("nn_conv_grad_w", lambda s, d: rounded(nn.conv_grad_w(_images(s, d), _part(s, d, 1, 6, 6), [1, 1, 3, 3])), f"""
{pixels}, gy AS (SELECT i0 AS n, i1 // 6 AS oy, i1 % 6 AS ox, v AS d FROM e WHERE i1 < 36)
SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, (y - oy)::BIGINT AS i2, (x - ox)::BIGINT AS i3, {R('sum(v * d)')} AS v FROM g JOIN gy USING (n) WHERE y - oy BETWEEN 0 AND 2 AND x - ox BETWEEN 0 AND 2 GROUP BY ALL""")
    pooled = f"{pixels}, o AS (SELECT n, oy.range AS oy, ox.range AS ox, v, y, x FROM g, range(4) oy, range(4) ox WHERE y BETWEEN oy.range * 2 - 1 AND oy.range * 2 + 1 AND x BETWEEN ox.range * 2 - 1 AND ox.range * 2 + 1) "
    each = "SELECT n AS i0, 0::BIGINT AS i1, oy AS i2, ox AS i3, {} AS v FROM o GROUP BY n, oy, ox"
    register("nn_max_pool", lambda s, d: rounded(nn.max_pool(_images(s, d), 3, 2, 1)), pooled + each.format(R("max(v)")))
    register("nn_avg_pool", lambda s, d: rounded(nn.avg_pool(_images(s, d), 3, 2, 1)), pooled + each.format(R("avg(v)")))
    register("nn_avg_pool_padded", lambda s, d: rounded(nn.avg_pool(_images(s, d), 3, 2, 1, pad_value=0)), pooled + each.format(R("sum(v) / 9")))
    back = pooled + ", gy AS (SELECT i0 AS n, i1 // 4 AS oy, i1 % 4 AS ox, v AS d FROM e WHERE i1 < 16), q AS (SELECT o.*, {} AS share FROM o), s AS (SELECT n, y, x, sum(share * d) AS v FROM q JOIN gy USING (n, oy, ox) GROUP BY ALL) SELECT g.n AS i0, 0::BIGINT AS i1, g.y::BIGINT AS i2, g.x::BIGINT AS i3, " + R("coalesce(s.v, 0)") + " AS v FROM g LEFT JOIN s USING (n, y, x)"
    register("nn_max_pool_backward", lambda s, d: rounded(nn.max_pool_backward(_images(s, d), _part(s, d, 1, 4, 4), 3, 2, 1)), back.format("(row_number() OVER (PARTITION BY n, oy, ox ORDER BY v DESC, y, x) = 1)::INT"))
    register("nn_avg_pool_backward", lambda s, d: rounded(nn.avg_pool_backward(_images(s, d), _part(s, d, 1, 4, 4), 3, 2, 1)), back.format("1.0 / count(*) OVER (PARTITION BY n, oy, ox)"))
    # the whole table as one image: kernels of any size take the same work
    for k in (3, 31):
        w = f"ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING"
        for name, f in (("max", "max"), ("avg", "avg")):
            register(f"nn_{name}_pool_{k}", lambda s, d, k=k, n=name: rounded(getattr(nn, f"{n}_pool")((lambda v: v.reshape(1, 1, *v.shape))(vectors(s, d)), k, 1)), f"WITH e AS ({ELEMENTS}), r AS (SELECT i0, i1, {f}(v) OVER (PARTITION BY i0 ORDER BY i1 {w}) AS v FROM e), c AS (SELECT i0, i1, {f}(v) OVER (PARTITION BY i1 ORDER BY i0 {w}) AS v FROM r WHERE i1 <= {WIDTH - k}) SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, i0 AS i2, i1::BIGINT AS i3, {R('v')} AS v FROM c WHERE i0 <= (SELECT max(vec_id) FROM embeddings) - {k - 1}")
    stats = f"WITH e AS ({ELEMENTS}), m AS (SELECT i1, avg(v) AS mean, var_pop(v) AS var, count(*) AS n FROM e GROUP BY i1) "
    ones = lambda s: create.ones(s, [1, WIDTH])
    register("nn_batch_norm", lambda s, d: rounded(nn.batch_norm(vectors(s, d), ones(s) * 2.0, ones(s))[0]), stats + f"SELECT i0, i1::BIGINT AS i1, {R('(v - mean) / sqrt(var + 2e-5) * 2 + 1')} AS v FROM e JOIN m USING (i1)")
    register("nn_batch_norm_running", lambda s, d: (lambda r: pair(r[3], r[4]))(nn.batch_norm(vectors(s, d), ones(s) * 2.0, ones(s), ones(s) * 0.5, ones(s) * 3.0, decay=0.8)), stats + f"SELECT 0::BIGINT AS i0, i1::BIGINT AS i1, {R('0.4 + mean * 0.2')} AS v, {R('2.4 + var * 0.2 * n / (n - 1)')} AS w FROM m")
    sums = stats + ", b AS (SELECT i1, sum(v * v) AS gb, sum(v * v * (v - mean) / sqrt(var + 2e-5)) AS gg, count(*) AS n FROM e JOIN m USING (i1) GROUP BY i1) "
    slope = lambda s, d: (lambda x: nn.batch_norm_backward(x, ones(s) * 2.0, x.square()))(vectors(s, d))
    register("nn_batch_norm_backward", lambda s, d: rounded(slope(s, d)[0]), sums + f"SELECT i0, i1::BIGINT AS i1, {R('(v * v - gb / b.n - (v - mean) / sqrt(var + 2e-5) * gg / b.n) / sqrt(var + 2e-5) * 2')} AS v FROM e JOIN m USING (i1) JOIN b USING (i1)")
    register("nn_batch_norm_gradients", lambda s, d: pair(*slope(s, d)[1:]), sums + f"SELECT 0::BIGINT AS i0, i1::BIGINT AS i1, {R('gg')} AS v, {R('gb')} AS w FROM b")


_generators()
_options()
_nets()


# ---- streams ------------------------------------------------------------------------------


def _running(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream into files: running sums and differences by type, of all rows that the watermark has passed in the end."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    path = f"{shared_folder(s)}/running-{uuid.uuid4().hex}"
    rows = running(stream, "value", ["event_type"], "ts", "event_id", "1 hour")
    query = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    out = durable(s.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("event_type").alias("k"), "event_id", F.round("cumsum", 4).alias("total"), (F.round("diff", 6) + F.lit(0.0)).alias("step")))
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(s._jsc.hadoopConfiguration()).delete(where, True)
    return out


register("stream_running", _running, """
WITH r AS (SELECT event_type AS k, event_id, ts, round(sum(value) OVER w, 4) AS total, round(value - lag(value) OVER w, 6) + 0.0 AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT k, event_id, total, step FROM r WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
