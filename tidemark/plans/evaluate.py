"""Lazy evaluation of programs: scalars on the driver, series as lazy frames.

Arguments are thunks, evaluated once and only if needed. A function given to ``mapTS`` is first applied to columns, which
makes it a native expression; if it needs values that a column doesn't have (recursion on data, say), it runs row by row in
a pandas UDF.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import Collection, EngineError, Series, ntz
from ..operators import maps, resample, windows
from .syntax import TUPLE, Ap, Block, Duration, Lam, Let, Lit, Moment, PCon, PLit, PVar, Tuple, Typed, Var, parse

DEPTH = 900
#: Calls inside one another while a function is lifted; deeper ones are recursion on data.
LIFT_DEPTH = 40


class NotLiftable(EngineError):
    """A function that can't be one column expression."""


class Failed(EngineError):
    """An error of a value (``error``, overflow, division by zero): only whoever needs the value meets it.

    ``message``: text, or a column of it while a function is lifted.
    """

    def __init__(self, message):
        super().__init__("an error of a row's values" if isinstance(message, Lifted) else message)
        self.message = message


@dataclass(frozen=True)
class Data:
    """A constructor with its arguments (thunks): True, False, Null, Cons."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Lifted:
    """A value that stands for a column of values while a function is lifted."""

    column: Column
    dtype: str  # int, double, string, bool


class Value:
    """What a host's own values are made of: subclass it, and programs can build, match, read and combine them.

    ``type_name`` is the name in messages; ``constructor`` and ``parts()`` are what patterns see; ``fields()`` is what
    ``.field`` reads; ``combine(name, other, swapped)`` is an operator's result (names: add, subtract, multiply, divide),
    or NotImplemented.
    """

    type_name = "Value"
    constructor: str | None = None

    def parts(self) -> tuple:
        return ()

    def fields(self) -> dict[str, object]:
        return {}

    def combine(self, name: str, other, swapped: bool):
        return NotImplemented


@dataclass
class Fn:
    arity: int
    call: Callable
    args: tuple = ()


class Thunk:
    __slots__ = ("make", "value", "busy")

    def __init__(self, make=None, value=None):
        self.make, self.value, self.busy = make, value, False

    def force(self):
        if self.make is not None:
            if self.busy:
                raise EngineError("a value that depends on itself")
            self.busy = True
            try:
                self.value = self.make()
            finally:
                self.busy = False
            self.make = None
        return self.value


TRUE, FALSE, NULL = Data("True"), Data("False"), Data("Null")


def kind(v) -> str:
    if isinstance(v, Lifted):
        return {"int": "Int", "double": "Double", "string": "String", "bool": "Bool"}[v.dtype]
    if isinstance(v, Value):
        return v.type_name
    if isinstance(v, Data):
        return "Bool" if v.name in ("True", "False") else "Tuple" if v.name == TUPLE else "List"
    for t, name in ((bool, "Bool"), (int, "Int"), (float, "Double"), (str, "String"), (Series, "TimeSeries"), (Collection, "TimeSeriesCollection"), (Fn, "Function"), (Duration, "Duration"), (Moment, "DateTime")):
        if isinstance(v, t):
            return name
    return type(v).__name__


def _in_range(v):
    if isinstance(v, int) and not -(2**63) <= v < 2**63:
        raise Failed("integer overflow")
    return v


def _column(v) -> Column:
    if isinstance(v, Lifted):
        return v.column
    if isinstance(v, Data):
        return F.lit(v.name == "True")
    return F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)


def _lift(dtype: str, f: Callable, *args) -> Lifted:
    return Lifted(f(*map(_column, args)), dtype)


_DTYPES = {"Int": "int", "Double": "double", "String": "string", "Bool": "bool"}


def _arith(name: str, plain: Callable, column: Callable, kinds: dict[tuple[str, str], str], series: Callable | None = None):
    def run(x, y):
        x, y = x.force(), y.force()
        pair = (kind(x), kind(y))
        if pair == ("TimeSeries", "TimeSeries") and series:
            return series(x, y)
        for a, b, swapped in ((x, y, False), (y, x, True)):
            if isinstance(a, Value) and (out := a.combine(name, b, swapped)) is not NotImplemented:
                return out
        if pair not in kinds:
            raise EngineError(f"cannot {name} {pair[0]} and {pair[1]} objects")
        if isinstance(x, Lifted) or isinstance(y, Lifted):
            return _lift(_DTYPES[kinds[pair]], column, x, y)
        try:
            return _in_range(plain(x, y))
        except ZeroDivisionError:
            raise Failed("division by zero") from None

    return Fn(2, run)


def _multiply(x, y):
    a, b = x.force(), y.force()
    pair = (kind(a), kind(b))
    if pair in (("String", "Int"), ("Int", "String")):
        text, n = (a, b) if pair[0] == "String" else (b, a)
        if isinstance(a, Lifted) or isinstance(b, Lifted):
            return _lift("string", scalars.repeat, text, n)
        return text * max(n, 0)
    return _MUL.call(Thunk(value=a), Thunk(value=b))


_NUM = {("Int", "Int"): "Int", ("Double", "Double"): "Double"}
_MUL = _arith("multiply", lambda a, b: a * b, lambda a, b: a * b, _NUM, maps.map_product)
_INT = {("Int", "Int"): "Int"}


def _power(a: int, b: int) -> int:
    if b < 0:
        raise Failed("a power's exponent can't be negative")
    if abs(a) > 1 and b > 63:
        raise Failed("integer overflow")
    return a**b


def _branch(make: Callable):
    """A branch that only some rows take: its value, or the error that these rows will meet."""
    try:
        return make()
    except Failed as e:
        return e
    except NotLiftable:
        raise
    except EngineError as e:  # such a program's error depends on the row, so it runs row by row
        raise NotLiftable(str(e)) from None


def _choice(condition: Column, x, y) -> Lifted:
    """``x`` where the condition holds, else ``y``; either may be Failed."""
    if isinstance(x, Failed) and isinstance(y, Failed):
        dtype = "double"
    else:
        known = y if isinstance(x, Failed) else x
        dtype = _DTYPES.get(kind(known))
        if dtype is None or not any(isinstance(v, Failed) for v in (x, y)) and kind(x) != kind(y):
            raise NotLiftable("branches of different types")
    spark_type = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean"}[dtype]
    column = lambda v: F.raise_error(_column(v.message)).cast(spark_type) if isinstance(v, Failed) else _column(v)
    return Lifted(F.when(condition, column(x)).otherwise(column(y)), dtype)


def _if(c, a, b):
    c = c.force()
    if isinstance(c, Lifted) and c.dtype == "bool":
        return _choice(c.column, _branch(a.force), _branch(b.force))
    if kind(c) != "Bool":
        raise EngineError("if needs a Bool")
    return (a if c.name == "True" else b).force()


def _equal(x, y):
    x, y = x.force(), y.force()
    if kind(x) != kind(y) or kind(x) not in (*_DTYPES, "Duration", "DateTime"):
        raise EngineError(f"cannot compare {kind(x)} and {kind(y)}")
    if isinstance(x, Lifted) or isinstance(y, Lifted):
        return _lift("bool", lambda a, b: a == b, x, y)
    return TRUE if x == y else FALSE


def _and(x, y):
    x = x.force()
    if isinstance(x, Lifted) and x.dtype == "bool":
        return _choice(x.column, _branch(y.force), FALSE)
    if kind(x) != "Bool":
        raise EngineError("&& needs Bools")
    if x.name == "False":
        return FALSE
    y = y.force()
    if kind(y) != "Bool":
        raise EngineError("&& needs Bools")
    return y


def _negate(x):
    x = x.force()
    if kind(x) != "Int":
        raise EngineError("negate needs an Int")
    return _lift("int", lambda a: -a, x) if isinstance(x, Lifted) else _in_range(-x)


def _error(message):
    v = message.force()
    raise Failed(v if isinstance(v, Lifted) and v.dtype == "string" else str(v))


def _items(v) -> list:
    out = []
    while isinstance(v, Data) and v.name == "Cons":
        out.append(v.args[0].force())
        v = v.args[1].force()
    if v != NULL:
        raise EngineError("not a list")
    return out


def _field(name, obj):
    name, obj = name.force(), obj.force()
    fields = obj.fields() if isinstance(obj, (Series, Collection, Value)) else {}
    if name not in fields:
        raise EngineError(f"{kind(obj)} has no field {name}")
    return fields[name]


def _ts_accessor(names, coll):
    names, coll = _items(names.force()), coll.force()
    if not isinstance(coll, Collection):
        raise EngineError(f"{kind(coll)} has no columns")
    return coll.column(names[0]) if len(names) == 1 else coll.select(*names)


def _series(v, what: str) -> Series:
    v = v.force()
    if not isinstance(v, Series):
        raise EngineError(f"{what} needs a TimeSeries, not a {kind(v)}")
    return v


def _count(v) -> int:
    v = v.force()
    if kind(v) != "Int":
        raise EngineError(f"a window's rows are an Int, not a {kind(v)}")
    return v


def _number(v):
    v = v.force()
    if kind(v) not in ("Int", "Double"):
        raise EngineError(f"a {kind(v)} isn't a number")
    return v


def _seconds(v) -> int:
    v = v.force()
    if not isinstance(v, Duration):
        raise EngineError(f"{kind(v)} isn't a Duration")
    return int(v.seconds)


def _convolved(weights: list, series: Series) -> Series:
    """A window as long as the weights."""
    return windows.collapse(series, "convolve", len(weights), weights)


class Evaluator:
    def __init__(self, catalog=None, modules: dict[str, str] | None = None):
        """modules: further names of the two modules ("HeadWater" and "TimeSeries")."""
        self.catalog = catalog
        self.depth, self.limit = 0, DEPTH
        base = {
            "(+)": _arith("add", lambda a, b: a + b, lambda a, b: a + b, _NUM, maps.map_sum),
            "(-)": _arith("subtract", lambda a, b: a - b, lambda a, b: a - b, _NUM, maps.map_difference),
            "(*)": Fn(2, _multiply),
            "(/)": _arith("divide", lambda a, b: a // b, scalars.floor_div, _INT, maps.map_quotient),
            "(%)": _arith("take the remainder of", lambda a, b: a % b, lambda a, b: a - b * scalars.floor_div(a, b), _INT),
            "(**)": _arith("raise", _power, scalars.int_pow, _INT),
            "(&)": _arith("join the bits of", lambda a, b: a & b, lambda a, b: a.bitwiseAND(b), _INT),
            "(==)": Fn(2, _equal),
            "(&&)": Fn(2, _and),
            "negate": Fn(1, _negate),
            "if": Fn(3, _if),
            "error": Fn(1, _error),
            "mkAccessor": Fn(2, _field),
            "True": TRUE,
            "False": FALSE,
            "Null": NULL,
            "Cons": Fn(2, lambda a, b: Data("Cons", (a, b))),
        }
        plus = base["(+)"]
        text = _arith("add", lambda a, b: a + b, scalars.concat, {("String", "String"): "String"})
        base["(+)"] = Fn(2, lambda x, y: (text if kind(x.force()) == kind(y.force()) == "String" else plus).call(x, y))
        series = {
            "timeSeries": Fn(1, self._lookup),
            "mkTSAccessor": Fn(2, _ts_accessor),
            "mapTS": Fn(3, self._map),
            "differentiate": Fn(1, lambda s: windows.differentiate(_series(s, "differentiate"))),
            "windowSum": Fn(2, lambda k, s: windows.collapse(_series(s, "windowSum"), "sum", _count(k))),
            "windowProduct": Fn(2, lambda k, s: windows.collapse(_series(s, "windowProduct"), "product", _count(k))),
            "convolve": Fn(2, lambda w, s: _convolved(_items(w.force()), _series(s, "convolve"))),
            "scaleTS": Fn(2, lambda c, s: maps.scale(_series(s, "scaleTS"), _number(c))),
            "shiftTS": Fn(2, lambda c, s: maps.add_constant(_series(s, "shiftTS"), _number(c))),
            "filterTS": Fn(2, self._filter),
            "sample": Fn(2, lambda d, s: resample.sample(_series(s, "sample"), _seconds(d))),
            "take": Fn(2, lambda d, s: resample.take_last(_series(s, "take"), abs(_seconds(d)))),
            "timeDiff": Fn(2, self._time_diff),
            "correlation": Fn(2, lambda a, b: resample.correlation(_series(a, "correlation"), _series(b, "correlation")).first()[0]),
            "Average": Data("Average"),
            "Lerp": Data("Lerp"),
            "Discard": Data("Discard"),
            "align": Fn(5, self._align),
        }
        self.modules = {"HeadWater": base, "TimeSeries": series}
        for alias, name in (modules or {}).items():
            self.modules[alias] = self.modules[name]
        self.globals = {**base, **series}

    def register(self, name: str, arity: int, f: Callable, *, strict: bool = True, module: str = "HeadWater") -> None:
        """A builtin of the host: ``f`` gets values, or thunks if not strict."""
        value = Fn(arity, (lambda *a: f(*[x.force() for x in a])) if strict else f)
        self.modules[module][name] = self.globals[name] = value

    # --- running
    def run(self, text: str):
        imports, body = parse(text)
        names, qualified = dict(self.globals), {m: t for m, t in self.modules.items()}
        for module, only_qualified, alias in imports:
            if module not in self.modules:
                raise EngineError(f"no module {module}")
            qualified[alias] = self.modules[module]
            if not only_qualified:
                names.update(self.modules[module])
        self._resolve(body, set(names), qualified)
        env = {k: Thunk(value=v) for k, v in names.items()}
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20 * DEPTH))
        try:
            self.qualified = qualified
            return self.eval(body, env)
        finally:
            sys.setrecursionlimit(limit)

    def _resolve(self, e, names: set[str], qualified: dict) -> None:
        """Unknown names are errors before anything runs."""
        if isinstance(e, Var):
            if e.module is not None:
                if e.name not in qualified.get(e.module, {}):
                    raise EngineError(f"unknown identifier {e.module}.{e.name} at {e.at}")
            elif e.name not in names:
                raise EngineError(f"unknown identifier {e.name} at {e.at}")
        elif isinstance(e, Ap):
            self._resolve(e.f, names, qualified)
            self._resolve(e.x, names, qualified)
        elif isinstance(e, Lam):
            self._resolve(e.body, names.union(*map(_bound, e.params)), qualified)
        elif isinstance(e, Let):
            own = set(names)
            for d in e.defs:
                own |= _bound(d[1]) if d[0] is None else {d[1] if d[0] == "::" else d[0]}
            for d in e.defs:
                if d[0] != "::":
                    self._resolve(d[2], own if d[0] is None else own.union(*map(_bound, d[1])), qualified)
            self._resolve(e.body, own, qualified)
        elif isinstance(e, (Block, Tuple)):
            for x in e.parts:
                self._resolve(x, names, qualified)
        elif isinstance(e, Typed):
            self._resolve(e.body, names, qualified)

    def eval(self, e, env):
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, Var):
            return self.qualified[e.module][e.name] if e.module is not None else env[e.name].force()
        if isinstance(e, Ap):
            return self.apply(self.eval(e.f, env), Thunk(lambda: self.eval(e.x, env)))
        if isinstance(e, Lam):
            return self._function([(e.params, e.body)], env)
        if isinstance(e, Let):
            return self.eval(e.body, self._letrec(e.defs, env))
        if isinstance(e, Block):
            for x in e.parts[:-1]:
                self.eval(x, env)
            return self.eval(e.parts[-1], env)
        if isinstance(e, Tuple):
            return Data(TUPLE, tuple(Thunk(lambda x=x: self.eval(x, env)) for x in e.parts))
        return self._typed(self.eval(e.body, env), e.type)

    def apply(self, f, x: Thunk):
        if not isinstance(f, Fn):
            raise EngineError(f"a {kind(f)} isn't a function")
        args = (*f.args, x)
        if len(args) < f.arity:
            return Fn(f.arity, f.call, args)
        if self.depth >= self.limit:
            raise NotLiftable("the evaluation goes too deep")
        self.depth += 1
        try:
            return f.call(*args)
        finally:
            self.depth -= 1

    def _letrec(self, defs, env):
        env = dict(env)
        groups: dict[str, list] = {}
        types = {d[1]: d[2] for d in defs if d[0] == "::"}
        for d in defs:
            if d[0] is None:
                whole = Thunk(lambda d=d: self.eval(d[2], env))
                for name in _bound(d[1]):
                    env[name] = Thunk(lambda d=d, whole=whole, name=name: self._destructured(d[1], whole, name))
            elif d[0] != "::":
                groups.setdefault(d[0], []).append((d[1], d[2]))
        for name, clauses in groups.items():
            if len({len(p) for p, _ in clauses}) > 1:
                raise EngineError(f"the clauses of {name} take different numbers of arguments")
            if not clauses[0][0]:
                if len(clauses) > 1:
                    raise EngineError(f"{name} is defined twice")
                make = lambda body=clauses[0][1]: self.eval(body, env)
            else:
                make = lambda clauses=clauses: self._function(clauses, env)
            env[name] = Thunk((lambda make=make, t=types[name]: self._typed(make(), t)) if name in types else make)
        return env

    def _destructured(self, pattern, whole: Thunk, name: str):
        found: dict[str, Thunk] = {}
        if self._match(pattern, whole, found) is not True:
            raise EngineError("a definition's pattern doesn't match")
        return found[name].force()

    def _function(self, clauses, env) -> Fn:
        def call(*args, at=0):
            for k in range(at, len(clauses)):
                patterns, body = clauses[k]
                found: dict[str, Thunk] = {}
                result: object = True
                for p, a in zip(patterns, args, strict=True):
                    m = self._match(p, a, found)
                    if m is False:
                        result = False
                        break
                    if m is not True:
                        result = m if result is True else result & m
                if result is False:
                    continue
                if result is True:
                    return self.eval(body, {**env, **found})
                return _choice(result, _branch(lambda: self.eval(body, {**env, **found})), _branch(lambda: call(*args, at=k + 1)))
            raise Failed("no clause matches")

        return Fn(len(clauses[0][0]), call)

    def _match(self, p, x: Thunk, found: dict[str, Thunk]):
        """True, False, or a condition on columns."""
        if isinstance(p, PVar):
            found[p.name] = x
            return True
        v = x.force()
        if isinstance(p, PLit):
            if kind(v) != kind(p.value):
                raise EngineError(f"a {kind(v)} is matched with a {kind(p.value)}")
            return v.column == _column(p.value) if isinstance(v, Lifted) else v == p.value
        if isinstance(v, Lifted) and v.dtype == "bool" and not p.args:
            return v.column == F.lit(p.name == "True")
        if isinstance(v, Value):
            name, args = v.constructor, tuple(Thunk(value=x) for x in v.parts())
        elif p.name == TUPLE and isinstance(v, Data) and v.name == "Cons":  # a tuple also takes a list apart
            name, args = TUPLE, tuple(Thunk(value=x) for x in _items(v))
        elif isinstance(v, Data):
            name, args = v.name, v.args
        else:
            return False
        if name != p.name or len(args) != len(p.args):
            return False
        for q, a in zip(p.args, args, strict=True):
            if self._match(q, a, found) is not True:
                return False
        return True

    def _typed(self, v, t: tuple):
        plain = {"Integer": "Int", "Double": "Double", "String": "String", "Duration": "Duration", "DateTime": "DateTime"}
        ok = True
        if t[0] == "->":
            ok = isinstance(v, Fn)
        elif t[0] in plain:
            ok = kind(v) == plain[t[0]]
        elif t[0] == "TimeSeries":
            ok = isinstance(v, Series) and (len(t) < 2 or t[1] not in plain or {"int": "Integer", "double": "Double", "string": "String"}[v.dtype] == t[1])
            ok = ok and all(not str(a).isdigit() or int(a) == v.frequency_s for a in t[1:])
        elif t[0] == "TimeSeriesCollection":
            ok = isinstance(v, Collection) and all(not str(a).isdigit() or int(a) == v.frequency_s for a in t[1:])
        if not ok:
            raise EngineError(f"a {kind(v)} isn't of the type {' '.join(map(str, t))}")
        return v

    # --- series builtins
    def _lookup(self, name):
        name = name.force()
        if not isinstance(name, str):
            raise EngineError("timeSeries needs a String")
        if self.catalog is None:
            raise EngineError(f"no collection {name}")
        return self.catalog.collection(name)

    def _map(self, f, a, b):
        f, a, b = f.force(), _series(a, "mapTS"), _series(b, "mapTS")
        if not isinstance(f, Fn):
            raise EngineError("mapTS needs a function")
        if (a.dtype, b.dtype) != ("double", "double"):
            raise EngineError("mapTS maps series of doubles")
        call = lambda *xs: self._call(f, xs)
        depth, self.depth, self.limit = self.depth, 0, LIFT_DEPTH
        try:
            out = call(Lifted(F.col("v0"), "double"), Lifted(F.col("v1"), "double"))
        except Failed as e:  # whatever the row
            out = _choice(F.lit(True), e, 0.0)
        except (NotLiftable, RecursionError):
            self.depth, self.limit = 0, DEPTH
            return self._row_wise(call, a, b)
        finally:
            self.depth, self.limit = depth, DEPTH
        if kind(out) != "Double":
            raise EngineError(f"mapTS needs a Double of each row, not a {kind(out)}")
        return maps.map_series(lambda x, y: _rebound(out, x, y), [a, b], "double")

    def _filter(self, f, s):
        """The rows of a series for which a function says True; it must be one column expression."""
        f, s = f.force(), _series(s, "filterTS")
        depth, self.depth, self.limit = self.depth, 0, LIFT_DEPTH
        try:
            out = self._call(f, (Lifted(F.col("value"), s.dtype),))
        finally:
            self.depth, self.limit = depth, DEPTH
        if kind(out) != "Bool":
            raise EngineError(f"filterTS needs a Bool of each row, not a {kind(out)}")
        return maps.kept(s, lambda _: _column(out))

    def _call(self, f, xs):
        for x in xs:
            f = self.apply(f, Thunk(value=x))
        return f

    def _row_wise(self, call, a: Series, b: Series) -> Series:
        import pandas as pd

        def rows(x, y):
            out = []
            for p, q in zip(x, y, strict=True):
                v = call(float(p), float(q))
                if not isinstance(v, float):
                    raise EngineError(f"mapTS needs a Double of each row, not a {kind(v)}")
                out.append(v)
            return pd.Series(out, dtype="float64")

        own, self.catalog = self.catalog, None  # a frame has no business in a worker
        try:
            udf = F.pandas_udf(_shippable(rows), "double")
            return maps.map_series(lambda x, y: udf(x, y), [a, b], "double")
        finally:
            self.catalog = own

    def _align(self, how, fill, ends, a, b):
        wanted = tuple(getattr(x.force(), "name", None) for x in (how, fill, ends))
        if wanted != ("Average", "Lerp", "Discard"):
            raise EngineError("align knows Average Lerp Discard")
        x, y = resample.align(_series(a, "align"), _series(b, "align"))
        return Data("Cons", (Thunk(value=x), Thunk(value=Data("Cons", (Thunk(value=y), Thunk(value=NULL))))))

    def _time_diff(self, a, b):
        from datetime import datetime

        a, b = a.force(), b.force()
        if not (isinstance(a, Moment) and isinstance(b, Moment)):
            raise EngineError("timeDiff needs two DateTimes")
        return Duration((datetime.fromisoformat(a.text) - datetime.fromisoformat(b.text)).total_seconds())


def _shippable(f):
    """``f`` as cloudpickle can send it: the closure's evaluator loses its catalog by then, and workers need a deep stack."""
    from pyspark import cloudpickle

    frozen = cloudpickle.dumps(f)

    def run(x, y):
        import pickle
        import sys as _sys

        _sys.setrecursionlimit(max(_sys.getrecursionlimit(), 20 * DEPTH))
        return pickle.loads(frozen)(x, y)

    import pandas as pd

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return run


def _rebound(out, x: Column, y: Column):
    return out.column if isinstance(out, Lifted) else F.lit(out)


def _bound(p) -> set[str]:
    if isinstance(p, PVar):
        return {p.name}
    if isinstance(p, PCon):
        return set().union(*map(_bound, p.args)) if p.args else set()
    return set()


def query(text: str, catalog=None, modules: dict[str, str] | None = None):
    """What a program says: an int, float or str, or a Series; anything else isn't a result."""
    out = Evaluator(catalog, modules).run(text)
    if isinstance(out, (int, float, str, Series)) and not isinstance(out, bool):
        return out
    raise EngineError(f"a {kind(out)} isn't a result; numbers, texts and series are")


def result_json(result):
    """A result as JSON: text for a number or string; for a series a frame (row_idx, json) of the array's elements."""
    import json

    if not isinstance(result, Series):
        return json.dumps(result)
    cell = F.to_json(F.struct(F.col("value").alias("v")))
    shown = F.expr("substr(_cell, 6, length(_cell) - 6)")  # of {"v":...}
    ts = F.date_format(F.expr(f"timestampadd(SECOND, row_idx * {result.frequency_s}, {ntz(result.start)})"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return result.df.withColumn("_cell", cell).select("row_idx", F.concat(F.lit('["'), ts, F.lit('",'), shown, F.lit("]")).alias("json"))
