"""Hand-worked cases, interval properties, the language and its errors, catalog and streaming."""

import base64
import gzip
import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.model import EngineError, Series
from tidemark.operators import intervals, maps, resample, windows
from tidemark.plans.evaluate import Evaluator, Value, query, result_json
from tidemark.sources import catalog as catalog_module
from tidemark.sources import scratch
from tidemark.sources.blocks import read_block_files, slotted
from tidemark.sources.catalog import Catalog
from tidemark.sources.ingest import fetch_exact, json_cells, last_write_wins, series_frame, spans, upsert
from tidemark.streaming.append import append_stream, session_spans, tumbling_last

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def ab(spark):
    def make(slots, limit):
        r = spark.createDataFrame([(T0 + timedelta(seconds=60 * s + 1), float(v)) for s, v in slots], "ts timestamp_ntz, v double")
        return series_frame(r, "ts", {"v": "double"}, T0, 60, limit)

    c = Catalog(spark)
    c.register("A", make([(0, 10), (1, 20), (5, 50), (30, 300)], 600), {"v": "double"}, T0, 60, 600)
    c.register("B", make([(1, 1), (4, 4), (5, 5)], 60), {"v": "double"}, T0, 60, 60)
    return c


def col(c, name):
    return c.collection(name).column("v")


def test_series(ab):
    assert rows(col(ab, "A").df) == [(0, 10), (1, 20), (2, 0), (3, 0), (4, 0), (5, 50), (30, 300)]
    assert rows(col(ab, "B").df) == [(0, 0), (1, 1), (4, 4), (5, 5)]
    assert rows(spans(col(ab, "B").df)) == [(0, 2), (4, 6)]


def test_maps_and_windows(ab):
    a, b = col(ab, "A"), col(ab, "B")
    assert rows(maps.map_sum(a, b).df) == [(0, 10), (1, 21), (4, 4), (5, 55)]
    assert rows(maps.map_product(a, b).df) == [(0, 0), (1, 20), (4, 0), (5, 250)]
    assert rows(windows.differentiate(a).df) == [(0, -10), (1, 20), (2, 0), (3, 0), (4, -50), (5, -250)]
    assert rows(windows.collapse(a, "sum", 3).df) == [(0, 30), (1, 20), (2, 0), (3, 50), (4, 350)]
    assert rows(windows.collapse(a, "product", 2).df) == [(0, 200), (1, 0), (2, 0), (3, 0), (4, 0), (5, 15000)]
    assert rows(windows.collapse(a, "convolve", 2, [2.0, 1.0]).df) == [(0, 40), (1, 40), (2, 0), (3, 0), (4, 50), (5, 400)]
    with pytest.raises(EngineError):
        maps.add_constant(a, 1)
    with pytest.raises(EngineError):
        maps.map_sum(a, resample.sample(a, 120))


def test_halo_equals_global(spark):
    rng = random.Random(3)
    slots = sorted(rng.sample(range(3000), 900))
    s = Series(spark.createDataFrame([(x, x % 17) for x in slots], "row_idx bigint, value bigint"), T0, 60, "int")
    got = rows(windows.collapse(s, "sum", 5, block_rows=64).df)
    assert got == [(slots[i], sum(x % 17 for x in slots[i : i + 5])) for i in range(len(slots) - 4)]


def test_interval_properties(spark):
    rng = random.Random(5)
    base, point = [], {}
    for seq in range(12):
        s = rng.randrange(0, 60)
        e = s + rng.randrange(1, 15)
        v = rng.randrange(3)
        base.append((s, e, v, seq))
        point.update(dict.fromkeys(range(s, e), v))
    empty = spark.createDataFrame([], "start bigint, end bigint, value int")
    out = intervals.insert(empty, spark.createDataFrame(base, "start bigint, end bigint, value int, seq int"))
    got = rows(out)
    assert all(s < e for s, e, _ in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert {k: v for s, e, v in got for k in range(s, e)} == point
    assert all(a[1] < b[0] or a[2] != b[2] for a, b in zip(got, got[1:]))
    hole = rows(intervals.delete(out, spark.createDataFrame([(10, 30)], "start bigint, end bigint")))
    assert {k for s, e, _ in hole for k in range(s, e)} == {k for k in point if not 10 <= k < 30}
    pts = spark.createDataFrame([(k,) for k in range(-3, 80)], "k bigint")
    assert {k: v for k, _, v in rows(intervals.lookup(pts, out, width=8).select("k", "left_bound", "value"))} == point


def test_documented_insert(spark):
    base = spark.createDataFrame([(1, 5, 10), (9, 15, 11)], "start bigint, end bigint, value int")
    new = spark.createDataFrame([(3, 10, 12)], "start bigint, end bigint, value int")
    assert rows(intervals.insert(base, new)) == [(1, 3, 10), (3, 10, 12), (10, 15, 11)]


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("I1 + I2", 3),
        ('"a" + "b"', "ab"),
        ('"ab" * I3', "ababab"),
        ("'ab' * I0", ""),
        ("I7 / I-2", -4),
        ("let { f x = x * I2; g y = f y + I1 } in g I5", 11),
        ('let { f I0 = "zero"; f x = "other" } in f I0', "zero"),
        (r"(\x y -> x - y) I5 I3", 2),
        ("let { unused = error 'no' } in I5", 5),
        ("if True I1 I2", 1),
        ("import HeadWater as H; H.negate I5", -5),
        ("#A.dataFrequency", 60),
        ("(.name) #A", "A"),
        ("I2 ** I3 ** I2", 64),
        ("{- a {- nested -} comment -} I7 % I3", 1),
        ("if (I1 == I1 && False) I1 I2", 2),
        ("let { (Cons a b) = Cons I4 Null; } in { I1; a }", 4),
        ("let { x :: Integer; x = I3 } in x :: Integer", 3),
        ("'''two\nlines'''", "two\nlines"),
        ("let { fact I0 = I1; fact n = n * fact (n - I1) } in fact I10", 3628800),
        ("let { f n = if (n == I0) I0 (f (n - I1)) } in f I20", 0),
        ("let f x = x * I2 in f I4", 8),
        ("let a = I1; b = a + I1 in let c = b in a + b + c", 5),
        ("let (a, b) = (I1, (I2, I3)) in let (c, d) = b in a + c * d", 7),
        ("let (a, b) = Cons I4 (Cons I5 Null) in b - a", 1),
        ("let f (x, y) = x in f (I6, error 'unused')", 6),
        ("timeDiff @2024-01-02 @2024-01-01 == @1d", None),
    ],
)
def test_programs(ab, program, want):
    if want is None:
        assert Evaluator(ab).run(program).name == "True"
    else:
        assert query(program, ab) == want


@pytest.mark.parametrize("program", ["1.0 / 2.0", "I1 + 1.0", "#Nope", "#A:nope", "nope", "I9223372036854775808", "let { f I0 = I1 } in f I2", "True", "I2 ** I-1", "if I1 I2 I3", "I1 :: String", r"mapTS (\x y -> I1) (#A:v) (#B:v)", "I9223372036854775807 + I1", "'open", "import Other; I1", "let (a, b) = I3 in a", "let (a, b) = (I1, I2, I3) in a", "(I1, I2)", "windowSum 1.0 (#A:v)", "convolve Null (#A:v)", "convolve (Cons I1 Null) (#A:v)", "scaleTS I2 (#A:v)", r"filterTS (\x -> x) (#A:v)", "I1 / I0", "#A:v / I1", "sample @7s (#A:v)"])
def test_errors(ab, program):
    with pytest.raises(EngineError):
        query(program, ab)


def test_series_programs(ab):
    assert rows(query("#A:v + #B:v", ab).df) == [(0, 10), (1, 21), (4, 4), (5, 55)]
    assert rows(query(r"mapTS (\x y -> x - y) (#A:v) (#B:v)", ab).df) == [(0, 10), (1, 19), (4, -4), (5, 45)]
    program = "let { loop x y = if (x == 0.0) y (loop (x - x) (y + 1.0)) } in mapTS loop (#A:v) (#B:v)"
    assert rows(query(program, ab).df) == [(0, 1), (1, 2), (4, 4), (5, 6)]
    assert rows(query("#A:v", ab).rendered())[0] == ("2024-01-01 00:00:00.000000", 10.0)
    assert query("let { (Cons x (Cons y Null)) = align Average Lerp Discard (#A:v) (#B:v) } in correlation x y", ab) == pytest.approx(70 / (1400 * 17) ** 0.5)  # of (10, 0) (20, 1) (0, 4) (50, 5)
    ev = Evaluator(ab)
    ev.register("twice", 1, lambda x: 2 * x)
    assert ev.run("twice I4") == 8


def test_series_arithmetic(ab, spark):
    assert rows(query("#A:v - #B:v", ab).df) == [(0, 10), (1, 19), (4, -4), (5, 45)]
    assert rows(query("#A:v * #B:v", ab).df) == [(0, 0), (1, 20), (4, 0), (5, 250)]
    assert rows(query("#A:v / #B:v", ab).df) == [(0, float("inf")), (1, 20), (4, 0), (5, 10)]
    assert rows(query("windowSum I2 (#A:v)", ab).df) == rows(windows.collapse(col(ab, "A"), "sum", 2).df)
    assert rows(query("windowProduct I2 (#B:v)", ab).df) == [(0, 0), (1, 4), (4, 20)]
    assert rows(query("convolve (Cons 0.5 (Cons 0.25 Null)) (#B:v)", ab).df) == [(0, 0.25), (1, 1.5), (4, 3.25)]
    assert rows(query("shiftTS 1.0 (scaleTS 2.0 (#B:v))", ab).df) == [(0, 1), (1, 3), (4, 9), (5, 11)]
    assert rows(query(r"filterTS (\x -> x == 50.0) (#A:v)", ab).df) == [(5, 50)]
    ints = lambda v: Series(spark.createDataFrame(v, "row_idx bigint, value bigint"), T0, 60, "int")
    x, y = ints([(0, 7), (1, -7), (2, 9)]), ints([(0, 2), (1, 2), (2, -4)])
    assert rows(maps.map_quotient(x, y).df) == [(0, 3), (1, -4), (2, -3)]
    assert rows(windows.collapse(x, "product", 2).df) == [(0, -49), (1, -63)]
    assert rows(windows.collapse(x, "convolve", 2, [3, 1, 5]).df) == [(0, 14), (1, -12)]
    assert rows(windows.differentiate(x).df) == [(0, 14), (1, -16)] and rows(windows.differentiate(x, negate=True).df) == [(0, -14), (1, 16)]
    with pytest.raises(Exception):
        maps.map_quotient(x, ints([(0, 0)])).df.collect()


def test_start_of_the_first_series(spark):
    """Starts may differ by less than a slot; the first series' counts. Further apart, series aren't on one grid."""
    make = lambda seconds: Series(spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_idx bigint, value double"), T0 + timedelta(seconds=seconds), 60, "double")
    assert maps.map_sum(make(20), make(0)).start == T0 + timedelta(seconds=20)
    assert rows(maps.map_sum(make(20), make(79)).df) == [(0, 2), (1, 4)]
    with pytest.raises(EngineError):
        maps.map_sum(make(0), make(60))


def test_strings_and_kernels(spark):
    text = Series(spark.createDataFrame([(0, "a"), (1, "b")], "row_idx bigint, value string"), T0, 60, "string")
    number = Series(spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_idx bigint, value double"), T0, 60, "double")
    assert rows(windows.collapse(text, "sum", 2).df) == [(0, "ab")]
    wrong = [lambda: windows.collapse(text, "product", 2), lambda: windows.collapse(text, "convolve", 2, [1.0]), lambda: windows.differentiate(text), lambda: maps.map_difference(text, text)]
    wrong += [lambda: windows.collapse(number, "convolve", 2, [1, 2]), lambda: windows.collapse(number, "convolve", 2, [True]), lambda: windows.collapse(number, "sum", 0), lambda: windows.collapse(number, "median", 2)]
    wrong += [lambda: maps.map_sum(number, text), lambda: resample.sample(text, 120), lambda: resample.correlation(text, number)]
    for f in wrong:
        with pytest.raises(EngineError):
            f()
    for how, want in (("first", 1.0), ("last", 2.0), ("min", 1.0), ("max", 2.0), ("sum", 3.0), ("avg", 1.5)):
        assert rows(resample.sample(number, 120, how).df) == [(0, want)]


def test_lazy_branches(ab, spark):
    """An error in a branch is an error of the rows that take it."""
    fine = [r"\x y -> if (x == 99.0) (error 'bad') (x - y)", r"\x y -> if (x == 99.0 && error 'no') 1.0 (x - y)"]
    for f in fine:
        assert rows(query(f"mapTS ({f}) (#A:v) (#B:v)", ab).df) == [(0, 10), (1, 19), (4, -4), (5, 45)]
    assert rows(query("let { f 7.0 y = error 'seven'; f x y = x } in mapTS f (#B:v) (#A:v)", ab).df) == [(0, 0), (1, 1), (4, 4), (5, 5)]
    mixed = r"mapTS (\x y -> if (x == 99.0) (x + 'text') (x - y)) (#A:v) (#B:v)"  # a wrong type that no row meets
    assert rows(query(mixed, ab).df) == [(0, 10), (1, 19), (4, -4), (5, 45)]
    for f in (r"\x y -> if (x == 10.0) (error 'bad') (x - y)", r"\x y -> error 'always'"):
        with pytest.raises(Exception, match="bad|always"):
            query(f"mapTS ({f}) (#A:v) (#B:v)", ab).df.collect()


class Money(Value):
    type_name, constructor = "Money", "Money"

    def __init__(self, cents):
        self.cents = cents

    def parts(self):
        return (self.cents,)

    def fields(self):
        return {"cents": self.cents}

    def combine(self, name, other, swapped):
        return Money(self.cents + other.cents) if name == "add" and isinstance(other, Money) else NotImplemented


def test_host_values(ab):
    ev = Evaluator(ab)
    ev.register("money", 1, Money)
    assert ev.run("(.cents) (money I3 + money I4)") == 7
    assert ev.run("let { (Money n) = money I9 } in n") == 9
    for program in ("money I1 + I2", "money I1 * money I2", "(.price) (money I1)"):
        with pytest.raises(EngineError, match="Money"):
            ev.run(program)


def test_result_json(ab):
    assert [result_json(x) for x in (5, 1.5, 'a"b')] == ["5", "1.5", '"a\\"b"']
    got = [json.loads(r.json) for r in result_json(query("#B:v", ab)).orderBy("row_idx").collect()]
    assert got == [["2024-01-01 00:00:00.000000", 0.0], ["2024-01-01 00:01:00.000000", 1.0], ["2024-01-01 00:04:00.000000", 4.0], ["2024-01-01 00:05:00.000000", 5.0]]


def test_ties(spark):
    """Of rows of one time one is taken whole, whatever the order they come in."""
    same = [(1, T0, "a", 5), (1, T0, "b", 1), (1, T0, "b", 3)]
    for order in (same, same[::-1]):
        df = spark.createDataFrame(order, "row_idx bigint, ts timestamp_ntz, x string, y int").repartition(3)
        assert rows(last_write_wins(df, "ts", ["x", "y"])) == [(1, "b", 3)]
    base = spark.createDataFrame([(1, "z", 0), (2, "y", 0)], "row_idx bigint, x string, y int")
    new = spark.createDataFrame([(1, "p", 1, 7), (1, "q", 2, 7), (1, "r", 3, 6)], "row_idx bigint, x string, y int, seq int")
    assert rows(upsert(base, new, ["x", "y"])) == [(1, "q", 2), (2, "y", 0)]


def test_fetch_exact(ab):
    df = col(ab, "A").df
    got = [tuple(r) for r in fetch_exact(df, [(2, 4), (0, 2), (1, 3), (9, 9)], ["value"]).collect()]
    assert got == [(0, 2, 0), (0, 3, 0), (1, 0, 10), (1, 1, 20), (2, 1, 20), (2, 2, 0)]
    assert fetch_exact(df, [], ["value"]).count() == 0
    for ranges, columns in (([(4, 8)], ["value"]), ([(0, 2)], ["value", "no"])):
        with pytest.raises(EngineError):
            fetch_exact(df, ranges, columns)


def test_long_intervals(spark, monkeypatch):
    """Intervals of more than LONG bins meet short ones, long ones and points as all pairs say."""
    monkeypatch.setattr(intervals, "LONG", 4)
    rng = random.Random(4)
    make = lambda n, at: [(s := rng.randrange(0, 3000), s + rng.choice([1, 5, 40, 200, 900]), at + i) for i in range(n)]
    a, b = make(40, 0), make(40, 100)
    df = lambda x: spark.createDataFrame(x, "start bigint, end bigint, value int")
    want = sorted((max(s, t), min(e, f), v, w) for s, e, v in a for t, f, w in b if max(s, t) < min(e, f))
    assert rows(intervals.intersect_join(df(a), df(b), 16)) == want
    points = spark.createDataFrame([(k,) for k in range(0, 4000, 7)] + [(None,)], "k bigint")
    assert rows(intervals.lookup(points, df(a), width=16).select("k", "left_bound", "value")) == sorted((k, s, v) for k in range(0, 4000, 7) for s, e, v in a if s <= k < e)
    none = df([])
    assert rows(intervals.is_empty(none)) == [(True,)] and rows(intervals.is_empty(df(a))) == [(False,)]
    some = df([(5, 9, 2), (1, 3, 1)])
    assert [tuple(r) for r in intervals.keys(some).collect()] == [(1, 3), (5, 9)] and [r[0] for r in intervals.elems(some).collect()] == [1, 2]
    assert [tuple(r) for r in intervals.assocs(some).collect()] == [(1, 3, 1), (5, 9, 2)]


def test_json_cells(spark):
    body = [{"a": 1.5, "b": 2, "s": "x", "more": 1}, {"a": "1", "b": 2, "s": "x"}, {"a": 1, "b": -2.5, "s": "y"}, {"a": 1, "b": 2}, {"a": 1, "b": 2, "s": 3}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(body)] + [(9, "{"), (10, None)], "i int, body string")
    assert rows(json_cells(df, "body", {"a": "double", "b": "int", "s": "string"})) == [(0, 1.5, 2, "x"), (2, 1.0, -3, "y")]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    assert c.create("T", 60, 600, T0)["tableId"] == 2
    assert c.create("T", 5)["dataFrequency"] == 60
    assert c.add_column("T", "v", "double")["columnId"] == 2 and c.add_column("T", "v", "int")["type"] == "double"
    mk = lambda *x: spark.createDataFrame([(T0 + timedelta(seconds=s), float(v)) for s, v in x], "ts timestamp_ntz, v double")
    c.append("T", mk((0, 1), (30, 2), (120, 3)))
    c.append("T", mk((180, 4), (3600, 5)))
    assert rows(c.frame("T")) == [(0, 2), (1, 0), (2, 3), (3, 4), (60, 5)]
    c.add_column("T", "s", "string")
    again = Catalog(spark, f"file://{tmp_path}/c")
    assert again.list() == ["T"] and again.describe("T")["length"] == 61
    assert again.describe_column("T", "v")["rowMappings"] == [(0, 4), (60, 61)]
    again.update_rows("T", spark.createDataFrame([(1, 9.0, "z", 1), (1, 8.0, "y", 0)], "row_idx bigint, v double, s string, seq int"))
    assert rows(again.frame("T"))[1] == (1, 9.0, "z")
    again.drop_column("T", "s")
    assert again.frame("T").columns == ["row_idx", "v"]
    again.delete_block("T", 0)
    assert rows(again.frame("T")) == [] and again.describe("T")["length"] == 0
    assert rows(Catalog(spark, f"file://{tmp_path}/c").frame("T")) == []
    for bad in (lambda: again.create("_x", 1), lambda: again.add_column("T", "q", "float"), lambda: again.describe("no")):
        with pytest.raises(EngineError):
            bad()


def _stored(spark, path, limit=600, frequency=60):
    c = Catalog(spark, f"file://{path}/c")
    c.create("T", frequency, limit, T0)
    c.add_column("T", "v", "double")
    return c, lambda *x: c.append("T", spark.createDataFrame([(T0 + timedelta(seconds=frequency * s), float(v)) for s, v in x], "ts timestamp_ntz, v double"))


def test_late_writes(spark, tmp_path):
    c, put = _stored(spark, tmp_path)
    assert put((0, 1), (2, 2), (100, 3)) == {"written": 3, "refused": 0}
    assert put((50, 9), (1, 8), (101, 4)) == {"written": 2, "refused": 1}
    assert put((40, 9), (60, 9)) == {"written": 0, "refused": 2}
    assert rows(c.frame("T")) == [(0, 1), (1, 8), (2, 2), (100, 3), (101, 4)]
    assert put() == {"written": 0, "refused": 0}
    assert put((112, 7)) == {"written": 1, "refused": 0}  # a gap of 600 s, no more than the limit
    assert rows(c.frame("T"))[5:] == [(k, 0) for k in range(102, 112)] + [(112, 7)]


def test_blocks_and_layers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_module, "BLOCK_ROWS", 10)
    monkeypatch.setattr("tidemark.model.BLOCK_ROWS", 10)
    monkeypatch.setattr(catalog_module, "LAYERS", 4)
    c, put = _stored(spark, tmp_path, None)
    want = {}
    for lo in range(0, 90, 9):
        put(*((k, k) for k in range(lo, lo + 9)))
        want |= {k: float(k) for k in range(lo, lo + 9)}
    assert len(c.entries["T"]["layers"]) <= 4 and dict(rows(c.frame("T"))) == want
    layers = [x for x in c.entries["T"]["layers"] if x[1] < 8]
    put((85, -1))
    assert [x for x in c.entries["T"]["layers"] if x[1] < 8] == layers  # only the touched block was written
    c.delete_block("T", 3)
    want = {k: v for k, v in (want | {85: -1.0}).items() if not 30 <= k < 40}
    assert dict(rows(c.frame("T"))) == want and c.describe("T")["length"] == 90
    with pytest.raises(EngineError):
        c.new_block("T", 2)
    c.new_block("T", 3, 32, 35)
    c.new_block("T", 20)
    want |= dict.fromkeys([*range(32, 35), *range(200, 210)], 0.0)
    assert dict(rows(c.frame("T"))) == want and c.describe("T")["length"] == 210
    c.update_rows("T", spark.createDataFrame([(33, 5.0), (205, 6.0), (300, 7.0)], "row_idx bigint, v double"))
    want |= {33: 5.0, 205: 6.0, 300: 7.0}
    c.vacuum()
    again = Catalog(spark, c.root)
    assert dict(rows(again.frame("T"))) == want and again.describe("T")["length"] == 301
    folders = {p.name for p in (tmp_path / "c" / "data" / "T").iterdir() if p.is_dir()}
    assert len(folders) <= 4 * catalog_module.STATES


def test_states_of_the_catalog(spark, tmp_path):
    c, put = _stored(spark, tmp_path)
    put((0, 1))
    other = Catalog(spark, c.root)
    put((1, 2))
    with pytest.raises(EngineError, match="another writer"):
        other.add_column("T", "w", "int")
    other.restore()
    assert rows(other.frame("T")) == [(0, 1), (1, 2)]
    (tmp_path / "c" / "catalog" / f"{other.state + 1}.json").write_text('{"entries": {"T"')  # a writer that has died
    third = Catalog(spark, c.root)
    assert rows(third.frame("T")) == [(0, 1), (1, 2)]
    third.add_column("T", "w", "int")
    third.drop_column("T", "w")
    third.add_column("T", "w", "string")
    assert rows(Catalog(spark, c.root).frame("T")) == [(0, 1, ""), (1, 2, "")]


def test_scratch(spark):
    since = scratch.mark()
    a, b = scratch.written(spark.range(3), "first"), scratch.written(spark.range(4), "second")
    scratch.release(spark, since, keep=("second",))
    assert b.count() == 4 and scratch.mark() == since + 1
    with pytest.raises(Exception):
        a.count()
    scratch.release(spark, since)
    assert scratch.mark() == since


def _block_bytes(kind, cells):
    """A block's data by the format's description."""
    n8 = lambda x: x.to_bytes(8, "big", signed=True)

    def double(x):
        m, e = math.frexp(x)
        m, e = (int(m * 2**53), e - 53) if x else (0, 0)
        if abs(m) < 2**31:
            return b"\0" + m.to_bytes(4, "big", signed=True) + n8(e)
        raw = abs(m).to_bytes((abs(m).bit_length() + 7) // 8, "little")
        return b"\1" + (1 if m > 0 else 255).to_bytes(1, "big") + n8(len(raw)) + raw + n8(e)

    one = {"int": n8, "double": double, "string": lambda t: n8(len(t)) + t.encode()}[kind]
    return base64.b64encode(gzip.compress(n8(len(cells)) + b"".join(map(one, cells)))).decode()


def test_block_files(spark, tmp_path):
    blocks = {(2, 2, 1): ("int", 0, [1, -2, 2**62]), (2, 3, 1): ("double", 0, [0.0, 1.5, -0.1, 1e300, -5e-324]), (2, 3, 2): ("double", 5, [2.0]), (3, 4, 1): ("string", 7, ["", "añ中😀", "x"]), (9, 9, 9): ("int", 0, [5])}
    for (t, c, b), (kind, start, cells) in blocks.items():
        (tmp_path / f"blk_{t}_{c}_{b}").write_text(json.dumps({"tableId": t, "columnId": c, "blockId": b, "startRow": start, "endRow": start + len(cells) - 1, "data": _block_bytes(kind, cells), "type": kind}))
    (tmp_path / "tables").write_text(json.dumps([list(k) for k in blocks if k[0] != 9]))
    got = read_block_files(spark, f"file://{tmp_path}").collect()
    pick = lambda r: {"int": r.int_value, "double": r.double_value, "string": r.string_value}[r.type]
    assert sorted((r.table_id, r.column_id, r.block_id, r.type, r.row, pick(r)) for r in got) == sorted((*k, kind, start + i, v) for k, (kind, start, cells) in blocks.items() if k[0] != 9 for i, v in enumerate(cells))
    spans = spark.createDataFrame([(2, 3, 10, 12, 0), (2, 3, 100, 104, 2)], "table_id bigint, column_id bigint, start bigint, end bigint, base bigint")
    placed = slotted(read_block_files(spark, f"file://{tmp_path}"), spans)
    assert rows(placed.select("row_idx", "double_value")) == [(10, 0.0), (11, 1.5), (100, -0.1), (101, 1e300), (102, -5e-324), (103, 2.0)]


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([(T0 + timedelta(seconds=s), float(s)) for s in (0, 10, 70, 5000)], "ts timestamp, v double")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("S", 60, None, T0)
    c.add_column("S", "v", "double")
    read = lambda: spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = append_stream(c, "S", read().withColumn("ts", F.col("ts").cast("timestamp_ntz")), f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = dict(rows(c.frame("S")))
    assert got[0] == 10 and got[1] == 70 and got[83] == 5000 and len(got) == 84
    last = tumbling_last(src, "ts", ["v"], T0, 60)
    assert rows(last) == [(0, 10.0), (1, 70.0), (83, 5000.0)]
    assert [r[2] for r in sorted(session_spans(src, "ts", 600).collect())] == [3, 1]
