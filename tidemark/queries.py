"""The registered queries of the time-series engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .model import Collection, Series
from .operators import intervals, maps, resample, windows
from .plans.evaluate import Evaluator, query, result_json
from .sources.catalog import Catalog
from .sources.ingest import block_info, bucketed, fetch_exact, fetch_rows, json_cells, last_write_wins, series_frame, spans, upsert, with_blocks
from .sources.scratch import scratch_path
from .streaming.append import append_stream, session_spans, tumbling_last

START = datetime(2024, 1, 1)
D = {"value": "double"}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _of(spark, sf, kind: str, freq: int = 60, limit: int | None = 600) -> Series:
    rows = _events(spark, sf).where(F.col("event_type") == kind).select("ts", "value")
    return Series(series_frame(rows, "ts", D, START, freq, limit), START, freq, "double", kind)


def _text(spark, sf, kind: str = "click") -> Series:
    rows = _events(spark, sf).where(F.col("event_type") == kind).select("ts", F.concat(F.col("user_id").cast("string"), F.lit(";")).alias("value"))
    return Series(series_frame(rows, "ts", {"value": "string"}, START, 3600, None), START, 3600, "string", kind)


def _ints(spark, sf, kind: str = "click", freq: int = 60, limit: int | None = 600) -> Series:
    rows = _events(spark, sf).where(F.col("event_type") == kind).select("ts", F.col("user_id").alias("value"))
    return Series(series_frame(rows, "ts", {"value": "int"}, START, freq, limit), START, freq, "int", kind)


def _catalog(spark, sf) -> Catalog:
    """Collections Click and View with the column v, and Both with click and view."""
    out = Catalog(spark)
    click, view = _of(spark, sf, "click"), _of(spark, sf, "view")
    for name, s in (("Click", click), ("View", view)):
        out.register(name, s.df.withColumnRenamed("value", "v"), {"v": "double"}, START, 60, 600)
    both = maps.joined([click, view]).withColumnsRenamed({"v0": "click", "v1": "view"})
    out.register("Both", both, {"click": "double", "view": "double"}, START, 60, 600)
    return out


def _rounded(s: Series | DataFrame) -> DataFrame:
    df = s.df if isinstance(s, Series) else s
    return df.withColumn("value", F.round("value", 6))


def _scalar(spark, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v).alias(k) for k, v in values.items()]).toDF(*values)


# --- SQL pieces
def _slot(freq: int) -> str:
    return f"(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // {freq * 1_000_000}"


def _series_sql(name: str, kind: str, freq: int = 60, limit: int | None = 600, value: str = "value", zero: str = "CAST(0 AS DOUBLE)", more: str = "") -> str:
    lo = "prev + 1" if limit is None else f"CASE WHEN (row_idx - prev - 1) * {freq} > {limit} THEN row_idx ELSE prev + 1 END"
    return f"""{name}_a AS (SELECT {_slot(freq)} AS row_idx, arg_max({value}, ts) AS value FROM events WHERE event_type = '{kind}'{more} GROUP BY 1),
{name}_b AS (SELECT *, coalesce(lag(row_idx) OVER (ORDER BY row_idx), -1) AS prev FROM {name}_a),
{name}_c AS (SELECT unnest(generate_series({lo}, row_idx)) AS slot, row_idx, value FROM {name}_b),
{name} AS (SELECT CAST(slot AS BIGINT) AS row_idx, CASE WHEN slot = row_idx THEN value ELSE {zero} END AS value FROM {name}_c)"""


CLICK, VIEW, BUY = _series_sql("click", "click"), _series_sql("vw", "view"), _series_sql("buy", "purchase")
_SPANS = "(SELECT min(row_idx) AS s, max(row_idx) + 1 AS e FROM (SELECT row_idx, row_idx - row_number() OVER (ORDER BY row_idx) AS g FROM {0}) GROUP BY g)"
_FRAME = "OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING)"


def _window_sql(expr: str, k: int, head: str = CLICK) -> str:
    w = _FRAME.format(k - 1)
    return f"WITH {head} SELECT row_idx, value FROM (SELECT row_idx, {expr.replace('@', w)} AS value, count(*) {w} AS n FROM click) WHERE n = {k}"


_Q: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


@_query(f"WITH {CLICK} SELECT row_idx, value FROM click")
def series_span_fill(spark, sf):
    return _of(spark, sf, "click").df


@_query(f"WITH {_series_sql('click', 'click', 3600, None)} SELECT row_idx, value FROM click")
def series_default_fill(spark, sf):
    return _of(spark, sf, "click", 3600, None).df


@_query(f"WITH {CLICK}, sp AS {_SPANS.format('click')} SELECT s AS \"start\", e AS \"end\" FROM sp")
def spans_of_series(spark, sf):
    return spans(_of(spark, sf, "click").df)


@_query(f"SELECT {_slot(3600)} AS row_idx, arg_max(value, ts) AS value FROM events GROUP BY 1")
def last_write_wins_slots(spark, sf):
    return last_write_wins(bucketed(_events(spark, sf), "ts", START, 3600), "ts", ["value"])


@_query("WITH a AS (SELECT epoch_us(o_orderdate) // 86400000000 AS row_idx, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT epoch_us(o_orderdate) // 86400000000 AS row_idx, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.row_idx, b.row_idx) AS row_idx, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.row_idx = b.row_idx")
def upsert_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    day = bucketed(orders, "o_orderdate", datetime(1970, 1, 1), 86400)
    batch = lambda s: day.where(F.col("o_orderstatus") == s).groupBy("row_idx").agg(F.max("o_totalprice").alias("value"))
    return upsert(batch("F"), batch("O"), ["value"])


@_query(f"WITH {CLICK} SELECT row_idx, value FROM click WHERE row_idx BETWEEN 100 AND 999 OR row_idx BETWEEN 20000 AND 20999")
def fetch_row_ranges(spark, sf):
    return fetch_rows(with_blocks(_of(spark, sf, "click").df), [(100, 1000), (20000, 21000)], ["value"])


@_query(f"WITH {_series_sql('click', 'click', 1, None)} SELECT row_idx // 65536 AS block_id, min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) AS rows FROM click GROUP BY 1")
def block_info_rows(spark, sf):
    return block_info(_of(spark, sf, "click", 1, None).df)


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, vw.value AS value FROM click JOIN vw USING (row_idx)")
def project_column(spark, sf):
    return _catalog(spark, sf).collection("Both").column("view").df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, vw.value AS view, click.value AS click FROM click JOIN vw USING (row_idx)")
def project_subcollection(spark, sf):
    out = Evaluator(_catalog(spark, sf)).run("#Both:view:click")
    assert isinstance(out, Collection)
    return out.df


@_query(f"WITH {CLICK} SELECT 'Click' AS name, 60 AS frequency, epoch_us(TIMESTAMP '2024-01-01') // 1000000 AS start_time, max(row_idx) + 1 AS length FROM click")
def metadata_fields(spark, sf):
    c = _catalog(spark, sf)
    run = lambda f: Evaluator(c).run(f"#Click.{f}")
    return spark.createDataFrame([(run("name"), run("dataFrequency"), run("startTime"), run("length"))], "name string, frequency int, start_time bigint, length bigint")


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, click.value + vw.value AS value FROM click JOIN vw USING (row_idx)")
def map_sum(spark, sf):
    return maps.map_sum(_of(spark, sf, "click"), _of(spark, sf, "view")).df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, click.value * vw.value AS value FROM click JOIN vw USING (row_idx)")
def map_product(spark, sf):
    return maps.map_product(_of(spark, sf, "click"), _of(spark, sf, "view")).df


@_query(f"WITH {CLICK} SELECT row_idx, value + CAST(2.5 AS DOUBLE) AS value FROM click")
def map_add_constant(spark, sf):
    return maps.add_constant(_of(spark, sf, "click"), 2.5).df


@_query(f"WITH {_series_sql('click', 'click', value='user_id', zero='0')} SELECT row_idx, CAST(value * 3 AS BIGINT) AS value FROM click")
def map_scale_int(spark, sf):
    return maps.scale(_ints(spark, sf), 3).df


@_query(f"WITH {CLICK}, {VIEW}, {BUY} SELECT row_idx, click.value + vw.value + buy.value AS value FROM click JOIN vw USING (row_idx) JOIN buy USING (row_idx)")
def map_nway(spark, sf):
    return maps.map_sum(*[_of(spark, sf, k) for k in ("click", "view", "purchase")]).df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, click.value * 2 - vw.value AS value FROM click JOIN vw USING (row_idx)")
def map_udf(spark, sf):
    return query(r"mapTS (\x y -> x * 2.0 - y) (#Click:v) (#View:v)", _catalog(spark, sf)).df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, (click.value + vw.value) + vw.value AS value FROM click JOIN vw USING (row_idx)")
def map_udf_recursive(spark, sf):
    program = r"let { go I0 acc y = acc; go n acc y = go (n - I1) (acc + y) y; f x y = if (x == 0.0) (go I2 x y) (go I2 x y) } in mapTS f (#Click:v) (#View:v)"
    return query(program, _catalog(spark, sf)).df


@_query(f"WITH {CLICK}, {VIEW}, a AS {_SPANS.format('click')}, b AS {_SPANS.format('vw')} SELECT greatest(a.s, b.s) AS \"start\", least(a.e, b.e) AS \"end\" FROM a JOIN b ON a.s < b.e AND b.s < a.e")
def align_intersection(spark, sf):
    side = lambda k: spans(_of(spark, sf, k).df).withColumn("value", F.lit(1))
    return intervals.intersect_join(side("click"), side("view")).select("start", "end")


@_query(f"WITH {CLICK}, {VIEW}, a AS {_SPANS.format('click')} SELECT vw.row_idx AS k, a.s AS left_bound, a.e AS value FROM vw JOIN a ON vw.row_idx >= a.s AND vw.row_idx < a.e")
def lookup_with_left_bound(spark, sf):
    points = _of(spark, sf, "view").df.select(F.col("row_idx").alias("k"))
    return intervals.lookup(points, spans(_of(spark, sf, "click").df).withColumn("value", F.col("end")))


@_query(f"WITH {CLICK}, {VIEW}, a AS {_SPANS.format('click')}, b AS {_SPANS.format('vw')}, p AS (SELECT unnest(generate_series(s, e - 1)) AS r, 1 AS v FROM a), q AS (SELECT unnest(generate_series(s, e - 1)) AS r FROM b), m AS (SELECT coalesce(p.r, q.r) AS r, CASE WHEN q.r IS NULL THEN 1 ELSE 2 END AS v FROM p FULL JOIN q ON p.r = q.r), g AS (SELECT r, v, r - row_number() OVER (PARTITION BY v ORDER BY r) AS k FROM m) SELECT min(r) AS \"start\", max(r) + 1 AS \"end\", v AS value FROM g GROUP BY v, k")
def interval_insert(spark, sf):
    side = lambda k, v: spans(_of(spark, sf, k).df).withColumn("value", F.lit(v))
    return intervals.insert(side("click", 1), side("view", 2))


@_query(f"WITH {CLICK}, {VIEW}, a AS {_SPANS.format('click')}, b AS {_SPANS.format('vw')}, p AS (SELECT unnest(generate_series(s, e - 1)) AS r FROM a), q AS (SELECT unnest(generate_series(s, e - 1)) AS r FROM b), m AS (SELECT r FROM p WHERE r NOT IN (SELECT r FROM q)), g AS (SELECT r, r - row_number() OVER (ORDER BY r) AS k FROM m) SELECT min(r) AS \"start\", max(r) + 1 AS \"end\", 1 AS value FROM g GROUP BY k")
def interval_delete(spark, sf):
    side = lambda k, v: spans(_of(spark, sf, k).df).withColumn("value", F.lit(v))
    return intervals.delete(side("click", 1), side("view", 2))


@_query(f"WITH {CLICK}, a AS {_SPANS.format('click')} SELECT count(*) AS size, min(s) AS lower, max(e) AS upper FROM a")
def interval_bounds(spark, sf):
    return intervals.bounds(spans(_of(spark, sf, "click").df))


@_query(_window_sql("round(sum(value) @, 6)", 60))
def window_sum(spark, sf):
    return _rounded(windows.collapse(_of(spark, sf, "click"), "sum", 60))


@_query(_window_sql("CAST(sum(value) @ AS BIGINT)", 7, _series_sql("click", "click", value="user_id", zero="0")))
def window_sum_int(spark, sf):
    return windows.collapse(_ints(spark, sf), "sum", 7, block_rows=512).df


@_query(_window_sql("round(product(value) @, 6)", 2))
def window_product(spark, sf):
    return _rounded(windows.collapse(_of(spark, sf, "click"), "product", 2))


@_query(_window_sql("string_agg(value, '') @", 3, _series_sql("click", "click", 3600, None, "user_id || ';'", "''")))
def window_concat(spark, sf):
    return windows.collapse(_text(spark, sf), "sum", 3).df


@_query(f"WITH {CLICK} SELECT row_idx, value FROM (SELECT row_idx, round(0.5 * value + 0.25 * lead(value, 1) OVER (ORDER BY row_idx) + 0.25 * lead(value, 2) OVER (ORDER BY row_idx), 6) AS value FROM click) WHERE value IS NOT NULL")
def window_convolve(spark, sf):
    return _rounded(windows.collapse(_of(spark, sf, "click"), "convolve", 3, [0.5, 0.25, 0.25]))


@_query(f"WITH {CLICK} SELECT row_idx, value FROM (SELECT row_idx, value - lead(value) OVER (ORDER BY row_idx) AS value FROM click) WHERE value IS NOT NULL")
def differentiate(spark, sf):
    return windows.differentiate(_of(spark, sf, "click")).df


@_query("SELECT o_orderkey, CAST(floor((o_custkey - 1000) / CAST(7 AS DOUBLE)) AS BIGINT) AS q FROM orders")
def floor_div(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalars.floor_div(F.col("o_custkey") - 1000, F.lit(7).cast("bigint")).alias("q"))


@_query("SELECT p_partkey, CAST(power(CAST(p_size AS HUGEINT), 3) AS BIGINT) AS cube, -CAST(p_size AS BIGINT) AS negative FROM part")
def int_pow_negate(spark, sf):
    size = F.col("p_size").cast("bigint")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", scalars.int_pow(size, F.lit(3)).alias("cube"), (-size).alias("negative"))


@_query("SELECT p_partkey, repeat(p_brand, p_size % 4) AS repeated, p_brand || p_type AS joined FROM part")
def string_repeat_concat(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", scalars.repeat(F.col("p_brand"), F.col("p_size") % 4).alias("repeated"), scalars.concat(F.col("p_brand"), F.col("p_type")).alias("joined"))


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, CASE WHEN click.value = 0 THEN vw.value ELSE click.value END AS value FROM click JOIN vw USING (row_idx)")
def if_literal_pattern(spark, sf):
    return query("let { pick 0.0 y = y; pick x y = x } in mapTS pick (#Click:v) (#View:v)", _catalog(spark, sf)).df


@_query(f"WITH {CLICK}, {VIEW}, m AS (SELECT row_idx, click.value + vw.value AS value FROM click JOIN vw USING (row_idx)) SELECT row_idx, value FROM (SELECT row_idx, value - lead(value) OVER (ORDER BY row_idx) AS value FROM m) WHERE value IS NOT NULL")
def lang_sum_differentiate(spark, sf):
    return query("-- changes of the sum\nlet { both = #Click:v + #View:v; unused = error 'never' } in differentiate both", _catalog(spark, sf)).df


@_query("SELECT CAST(-4 AS BIGINT) AS floor_div, CAST(4052555153018976267 AS BIGINT) AS power, 'ababab' AS repeated, CAST(120 AS BIGINT) AS factorial, CAST(6 AS BIGINT) AS total")
def lang_scalars(spark, sf):
    run = query
    programs = ["I-7 / I2", "I3 ** I39", "'ab' * I3", "let { f I0 = I1; f n = n * f (n - I1) } in f I5", "let { sum (Null) = I0; sum (Cons x r) = x + sum r } in sum (Cons I1 (Cons I2 (Cons I3 Null)))"]
    return spark.createDataFrame([tuple(run(p) for p in programs)], "floor_div bigint, power bigint, repeated string, factorial bigint, total bigint")


@_query(f"WITH {CLICK} SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(row_idx * 60), '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM click")
def result_rows(spark, sf):
    return _of(spark, sf, "click").rendered()


@_query(f"WITH {CLICK} SELECT CAST(row_idx // 10 AS BIGINT) AS row_idx, round(avg(value), 6) AS value FROM click GROUP BY 1")
def sample_avg(spark, sf):
    return _rounded(resample.sample(_of(spark, sf, "click"), 600))


@_query(f"WITH {CLICK} SELECT row_idx, value FROM click WHERE row_idx >= (SELECT max(row_idx) FROM click) - 1440")
def take_last(spark, sf):
    return query("take @-1d (#Click:v)", _catalog(spark, sf)).df


_HOURS = _series_sql("h", "view", 3600, None)
_LERP = "SELECT 3600 AS z, p.row_idx * 60 + i AS row_idx, p.value + (n.value - p.value) * (i / CAST(60 AS DOUBLE)) AS value FROM h p JOIN h n ON n.row_idx = p.row_idx + 1, (SELECT unnest(generate_series(0, 59)) AS i) UNION ALL SELECT 3600, row_idx * 60, value FROM h WHERE row_idx = (SELECT max(row_idx) FROM h)"


@_query(f"WITH {CLICK}, {_HOURS}, f AS ({_LERP}) SELECT click.row_idx, round(click.value, 6) AS a, round(f.value, 6) AS b FROM click JOIN f ON click.row_idx = f.row_idx")
def align_lerp(spark, sf):
    a, b = resample.align(_of(spark, sf, "click"), _of(spark, sf, "view", 3600, None))
    return maps.joined([a, b]).select("row_idx", F.round("v0", 6).alias("a"), F.round("v1", 6).alias("b"))


@_query(f"WITH {CLICK}, {VIEW} SELECT round(corr(click.value, vw.value), 6) AS correlation FROM click JOIN vw USING (row_idx)")
def correlation(spark, sf):
    return resample.correlation(_of(spark, sf, "click"), _of(spark, sf, "view")).select(F.round("correlation", 6).alias("correlation"))


@_query(f"WITH {CLICK} SELECT TIMESTAMP '2024-01-03' + to_seconds(((row_idx * 60 - 172800) // 7200) * 7200) AS ts, round(avg(value), 6) AS value FROM click WHERE row_idx * 60 >= 172800 AND row_idx * 60 < 864000 GROUP BY 1")
def range_download(spark, sf):
    return _rounded(resample.download(_of(spark, sf, "click"), datetime(2024, 1, 3), datetime(2024, 1, 11), 7200))


@_query("SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS value, event_type AS kind FROM events WHERE event_type <> 'view'")
def json_rows(spark, sf):
    made = _events(spark, sf).select("event_id", F.to_json(F.struct("user_id", "value", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))).alias("body"))
    return json_cells(made, "body", {"user_id": "int", "value": "int", "kind": "string"}).select("event_id", "user_id", "value", "kind")


# --- the language's further parts
def _stored(spark, sf) -> Catalog:
    """Collections Click and View with the column v and no filled slot."""
    out = Catalog(spark)
    for name, kind in (("Click", "click"), ("View", "view")):
        out.register(name, _of(spark, sf, kind, 60, 0).df.withColumnRenamed("value", "v"), {"v": "double"}, START, 60, 0)
    return out


_PAIR = f"{_series_sql('click', 'click', 60, 0)}, {_series_sql('vw', 'view', 60, 0)}, pair AS (SELECT row_idx, click.value AS a, vw.value AS b FROM click JOIN vw USING (row_idx))"
_RATIO = "CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN CAST('Infinity' AS DOUBLE) WHEN a < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END ELSE a / b END"


@_query(f"WITH {_PAIR} SELECT CAST(row_idx // 6 AS BIGINT) AS row_idx, round(avg(a / b), 6) AS value FROM pair GROUP BY 1")
def lang_ratio_sampled(spark, sf):
    return _rounded(query("sample @6m (#Click:v / #View:v)", _stored(spark, sf)))


@_query(f"WITH {_PAIR}, six AS (SELECT CAST(row_idx // 6 AS BIGINT) AS row_idx, avg(a / b) AS value FROM pair GROUP BY 1) SELECT row_idx, round(value, 6) AS value FROM six WHERE row_idx >= (SELECT max(row_idx) FROM six) - 240")
def lang_ratio_taken(spark, sf):
    return _rounded(query("take (@-1d) (sample @6m (#Click:v / #View:v))", _stored(spark, sf)))


@_query(f"WITH {CLICK}, {VIEW}, pair AS (SELECT row_idx, click.value AS a, vw.value AS b FROM click JOIN vw USING (row_idx)) SELECT row_idx, {_RATIO} AS value FROM pair")
def map_quotient(spark, sf):
    return query("#Click:v / #View:v", _catalog(spark, sf)).df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, click.value - vw.value AS value FROM click JOIN vw USING (row_idx)")
def map_difference(spark, sf):
    return query("#Click:v - #View:v", _catalog(spark, sf)).df


@_query(f"WITH {_series_sql('click', 'click', 3600, None, 'user_id', '0')}, {_series_sql('vw', 'view', 3600, None, 'user_id + 7', '7')} SELECT row_idx, CAST(floor(click.value / CAST(-vw.value AS DOUBLE)) AS BIGINT) AS value FROM click JOIN vw USING (row_idx)")
def map_quotient_int(spark, sf):
    below = maps.scale(maps.add_constant(_ints(spark, sf, "view", 3600, None), 7), -1)
    return maps.map_quotient(_ints(spark, sf, "click", 3600, None), below).df


@_query(f"WITH {CLICK}, {_HOURS}, f AS ({_LERP}) SELECT round(corr(click.value, f.value), 6) AS correlation FROM click JOIN f ON click.row_idx = f.row_idx")
def lang_align_correlation(spark, sf):
    c = _catalog(spark, sf)
    c.register("Hours", _of(spark, sf, "view", 3600, None).df.withColumnRenamed("value", "v"), {"v": "double"}, START, 3600)
    program = """
let correlated ts1 ts2 =
       let (aligned1, aligned2) = align Average Lerp Discard ts1 ts2
       in correlation aligned1 aligned2
in correlated #Click:v #Hours:v"""
    return _scalar(spark, correlation=round(query(program, c), 6))


@_query(_window_sql("round(sum(value) @, 6)", 5))
def lang_window_sum(spark, sf):
    return _rounded(query("windowSum I5 (#Click:v)", _catalog(spark, sf)))


@_query(_window_sql("round(product(value) @, 6)", 2, _series_sql("click", "view")))
def lang_window_product(spark, sf):
    """Of two rows: their product has four decimals, so that rounding can't differ."""
    return _rounded(query("windowProduct I2 (#View:v)", _catalog(spark, sf)))


@_query(f"WITH {CLICK} SELECT row_idx, value FROM (SELECT row_idx, round(0.75 * value - 0.5 * lead(value, 1) OVER (ORDER BY row_idx), 6) AS value FROM click) WHERE value IS NOT NULL")
def lang_convolve(spark, sf):
    return _rounded(query("convolve (Cons 0.75 (Cons (0.0 - 0.5) Null)) (#Click:v)", _catalog(spark, sf)))


@_query(f"WITH {CLICK} SELECT row_idx, value * 2 + 1 AS value FROM click")
def lang_scale_shift(spark, sf):
    return query("shiftTS 1.0 (scaleTS 2.0 (#Click:v))", _catalog(spark, sf)).df


@_query(f"WITH {CLICK} SELECT row_idx, value FROM click WHERE value = 0")
def lang_filter(spark, sf):
    return query(r"filterTS (\x -> x == 0.0) (#Click:v)", _catalog(spark, sf)).df


@_query(f"WITH {CLICK}, {VIEW} SELECT row_idx, CASE WHEN click.value = 0 THEN vw.value ELSE click.value - vw.value END AS value FROM click JOIN vw USING (row_idx)")
def lang_lazy_if(spark, sf):
    """No row has the value -1, so none takes the branch with the error."""
    program = r"mapTS (\x y -> if (x == 0.0) y (if (x == 0.0 - 1.0) (error 'below zero') (x - y))) (#Click:v) (#View:v)"
    return query(program, _catalog(spark, sf)).df


@_query("SELECT CAST(7 AS BIGINT) AS total, 'ab' AS text, CAST(24 AS BIGINT) AS product")
def lang_tuples(spark, sf):
    programs = ["let (a, b) = (I3, I4) in a + b", "let f (x, (y, z)) = x + z in f ('a', (I1, 'b'))", "let a = I2; b = a * I3; c = b * I4 / a in c * a"]
    return spark.createDataFrame([tuple(query(p) for p in programs)], "total bigint, text string, product bigint")


@_query(f"""WITH {_series_sql('click', 'click', 3600, None, 'user_id', '0')} SELECT row_idx, '["' || strftime(TIMESTAMP '2024-01-01' + to_seconds(row_idx * 3600), '%Y-%m-%d %H:%M:%S.%f') || '",' || value || ']' AS json FROM click""")
def result_json_rows(spark, sf):
    return result_json(_ints(spark, sf, "click", 3600, None))


@_query(f"WITH {_series_sql('click', 'click', 3600, None)} SELECT CAST(0 AS INTEGER) AS request, row_idx, value FROM click WHERE row_idx BETWEEN 300 AND 399 UNION ALL SELECT 1, row_idx, value FROM click WHERE row_idx BETWEEN 20 AND 29 UNION ALL SELECT 2, row_idx, value FROM click WHERE row_idx BETWEEN 25 AND 34")
def fetch_in_order(spark, sf):
    return fetch_exact(_of(spark, sf, "click", 3600, None).df, [(300, 400), (20, 30), (25, 35)], ["value"])


# --- interval maps
@_query(f"WITH {CLICK}, a AS {_SPANS.format('click')} SELECT s AS \"start\", e AS \"end\" FROM a")
def interval_keys(spark, sf):
    return intervals.keys(spans(_of(spark, sf, "click").df).withColumn("value", F.lit(1)))


@_query(f"WITH {CLICK}, a AS {_SPANS.format('click')} SELECT e - s AS value FROM a")
def interval_elems(spark, sf):
    return intervals.elems(spans(_of(spark, sf, "click").df).withColumn("value", F.col("end") - F.col("start")))


@_query("SELECT false AS mapped_empty, true AS deleted_empty")
def interval_null(spark, sf):
    one = spans(_of(spark, sf, "click").df).withColumn("value", F.lit(1))
    gone = intervals.delete(one, one.agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return intervals.is_empty(one).select(F.col("empty").alias("mapped_empty")).join(intervals.is_empty(gone).select(F.col("empty").alias("deleted_empty")))


# --- the append path and the catalog
def _collection(spark, freq: int, limit: int | None, **columns: str) -> Catalog:
    """A catalog in a folder of its own with the collection T."""
    out = Catalog(spark, scratch_path(spark, "catalog"))
    out.create("T", freq, limit, START)
    for name, dtype in (columns or {"value": "double"}).items():
        out.add_column("T", name, dtype)
    return out


def _clicks(spark, sf, where: str = "true") -> DataFrame:
    return _events(spark, sf).where(F.col("event_type") == "click").where(where).select("ts", "value")


@_query(f"WITH {CLICK} SELECT row_idx, value FROM click")
def append_batches(spark, sf):
    c = _collection(spark, 60, 600)
    edges = ["2024-01-01", "2024-01-08", "2024-01-08 12:00:00", "2024-01-20", "2100-01-01"]
    for a, b in zip(edges, edges[1:]):
        c.append("T", _clicks(spark, sf, f"ts >= timestamp_ntz'{a}' AND ts < timestamp_ntz'{b}'"))
    return Catalog(spark, c.root).frame("T")


@_query(f"WITH {_series_sql('f', 'click', more=' AND user_id % 2 = 0')}, late AS (SELECT {_slot(60)} AS row_idx, arg_max(value, ts) AS value FROM events WHERE event_type = 'click' AND user_id % 2 = 1 AND ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT count(*) AS refused FROM late WHERE row_idx NOT IN (SELECT row_idx FROM f)) SELECT f.row_idx, coalesce(late.value, f.value) AS value, refused FROM f LEFT JOIN late USING (row_idx), n")
def late_write_refused(spark, sf):
    c = _collection(spark, 60, 600)
    rows = _events(spark, sf).where(F.col("event_type") == "click")
    c.append("T", rows.where("user_id % 2 = 0").select("ts", "value"))
    told = c.append("T", rows.where("user_id % 2 = 1 AND ts < timestamp_ntz'2024-01-20'").select("ts", "value"))
    return c.frame("T").withColumn("refused", F.lit(told["refused"]).cast("bigint"))


_TENS = _series_sql("click", "click", 10, None)


@_query(f"WITH {_TENS} SELECT row_idx, value FROM click WHERE row_idx // 65536 NOT IN (1, (SELECT max(row_idx) // 65536 FROM click))")
def delete_block(spark, sf):
    c = _collection(spark, 10, None)
    c.append("T", _clicks(spark, sf))
    c.delete_block("T", 1)
    c.delete_block("T", (c.describe("T")["length"] - 1) // 65536)
    return Catalog(spark, c.root).frame("T")


@_query(f"WITH {_series_sql('click', 'click', 3600, None)} SELECT row_idx, value FROM click UNION ALL SELECT 131072 + i, CAST(0 AS DOUBLE) FROM (SELECT unnest(generate_series(5, 99)) AS i)")
def new_block(spark, sf):
    c = _collection(spark, 3600, None)
    c.append("T", _clicks(spark, sf))
    c.new_block("T", 2, 131077, 131172)
    return c.frame("T")


@_query(f"WITH {_series_sql('click', 'click', 3600, None)} SELECT row_idx, CASE WHEN row_idx % 50 = 3 THEN -1 ELSE value END AS value, CAST(0 AS BIGINT) AS extra FROM click")
def update_stored_rows(spark, sf):
    c = _collection(spark, 3600, None, value="double", gone="string")
    c.append("T", _clicks(spark, sf).withColumn("gone", F.lit("x")))
    c.drop_column("T", "gone")
    c.add_column("T", "extra", "int")
    there = c.frame("T").where("row_idx % 50 = 3")
    c.update_rows("T", there.select("row_idx", F.lit(-1.0).alias("value"), "extra"))
    return c.frame("T")


@_query("SELECT * FROM (VALUES ('T', 'value', CAST(2 AS BIGINT), 'double', CAST(60 AS BIGINT)), ('T', 'again', 4, 'int', 60)) AS t(collection, name, column_id, type, frequency)")
def catalog_columns(spark, sf):
    c = _collection(spark, 60, 600, value="double", note="string")
    c.drop_column("T", "note")
    c.add_column("T", "again", "int")
    c.create("T", 5)
    d = Catalog(spark, c.root).describe("T")
    return spark.createDataFrame([("T", x["name"], x["columnId"], x["type"], d["dataFrequency"]) for x in d["columns"]], "collection string, name string, column_id bigint, type string, frequency bigint")


@_query(f"WITH {_series_sql('click', 'click', 3600, None)} SELECT row_idx, value FROM click")
def stream_append(spark, sf):
    """Micro-batches of a file each, whatever their order: no slot is in two files."""
    files, c = scratch_path(spark, "stream"), _collection(spark, 3600, None)
    rows = bucketed(_clicks(spark, sf), "ts", START, 3600)
    rows.repartitionByRange(3, "row_idx").select("ts", "value").write.parquet(files)
    arriving = spark.readStream.schema("ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(files)
    append_stream(c, "T", arriving, scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return c.frame("T")


@_query(f"SELECT {_slot(3600)} AS row_idx, arg_max(value, ts) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def tumbling_last_values(spark, sf):
    return tumbling_last(_clicks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["value"], START, 3600)


@_query("WITH m AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'click'), g AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(ts) AS first, max(ts) AS last, count(*) AS rows FROM g GROUP BY k")
def session_spans_of_clicks(spark, sf):
    out = session_spans(_clicks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", 600)
    return out.select(F.col("start").cast("timestamp_ntz").alias("first"), F.expr("timestampadd(SECOND, -600, end)").cast("timestamp_ntz").alias("last"), "rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
