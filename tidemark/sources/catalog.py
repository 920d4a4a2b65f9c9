"""The catalog: collections and columns under one root folder, data as Parquet partitioned by block.

Layout: ``root/catalog/<N>.json`` is the N-th state of the catalog, made whole by one exclusive create, so that a reader
sees a state or the one before and of two writers one fails. ``root/data/<name>/<id>`` holds what one write has put out: the
touched blocks, whole. A collection's ``layers`` say which of these folders owns which blocks: a write rewrites the
blocks that it touches and nothing else, and readers keep what they began with. Beyond ``LAYERS`` the two neighbouring
layers of fewest blocks become one. Columns are stored by their id, so that adding or dropping one changes no data.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BLOCK_ROWS, TYPES, Collection, EngineError
from .ingest import block_info, bucketed, filled, last_write_wins, spans, upsert, with_blocks

LAYERS = 24
#: States of the catalog that ``vacuum`` leaves.
STATES = 3


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.entries: dict[str, dict] = {}
        self.frames: dict[str, DataFrame] = {}  # of collections over frames that exist already
        self.state = 0
        if self.root:
            self.restore()

    # --- definition -----------------------------------------------------------------------------------------------
    def list(self) -> list[str]:
        return sorted(self.entries)

    def create(self, name: str, frequency_s: int, max_null_s: int | None = None, start: datetime | None = None) -> dict:
        """Makes a collection, or returns the one of that name as it is."""
        if name.startswith("_") or not name:
            raise EngineError(f"{name!r} isn't a name for a collection")
        if name not in self.entries:
            if frequency_s <= 0:
                raise EngineError("the frequency must be positive")
            ids = [e["tableId"] for e in self.entries.values()]
            self.entries[name] = {"name": name, "tableId": max(ids, default=1) + 1, "length": 0, "columns": [], "startTime": (start or datetime.utcfromtimestamp(int(time.time()))).isoformat(), "dataFrequency": frequency_s, "maxNullTime": max_null_s, "layers": []}
            self.dump()
        return self.describe(name)

    def describe(self, name: str) -> dict:
        return {k: v for k, v in self._entry(name).items() if k != "layers"}

    def add_column(self, name: str, column: str, dtype: str) -> dict:
        """Adds a column, default-filled where rows exist, or returns the one of that name as it is."""
        entry = self._entry(name)
        if dtype not in TYPES:
            raise EngineError(f"{dtype!r} isn't a column type")
        if not any(c["name"] == column for c in entry["columns"]):
            self.last_column = max([getattr(self, "last_column", 1), *(c["columnId"] for e in self.entries.values() for c in e["columns"])]) + 1
            entry["columns"].append({"name": column, "columnId": self.last_column, "type": dtype})
            self.dump()
        return next(c for c in entry["columns"] if c["name"] == column)

    def describe_column(self, name: str, column: str) -> dict:
        """The column's catalog row, with its blocks and the spans of its slots, which go to the driver.

        For a series with very many gaps take ``spans(frame)`` and ``block_info(frame)``, which are frames.
        """
        own = next((c for c in self._entry(name)["columns"] if c["name"] == column), None)
        if own is None:
            raise EngineError(f"{name} has no column {column}")
        frame = self.frame(name)
        blocks = [r.asDict() for r in block_info(frame).orderBy("block_id").collect()]
        rows = [(r["start"], r["end"]) for r in spans(frame).orderBy("start").collect()]
        return own | {"blocks": [b["block_id"] for b in blocks], "blockRanges": [(b["first_row"], b["last_row"]) for b in blocks], "rowMappings": rows}

    def drop_column(self, name: str, column: str) -> None:
        entry = self._entry(name)
        entry["columns"] = [c for c in entry["columns"] if c["name"] != column]
        self.dump()

    # --- rows -----------------------------------------------------------------------------------------------------
    def append(self, name: str, rows: DataFrame, ts: str = "ts") -> dict[str, int]:
        """Writes timestamped rows: bucketed, last write wins, filled by the collection's rule, over what is there.

        A slot inside a null span, which a later write has closed, can't be written any more. Such slots are refused and
        counted: {"written": slots, "refused": slots}.
        """
        entry = self._entry(name)
        columns = self._columns(name)
        missing = set(columns) - set(rows.columns)
        if missing:
            raise EngineError(f"rows lack the columns {sorted(missing)}")
        start, freq, limit, length = datetime.fromisoformat(entry["startTime"]), entry["dataFrequency"], entry["maxNullTime"], entry["length"]
        new = last_write_wins(bucketed(rows, ts, start, freq), ts, list(columns)).persist()
        try:
            total, first = new.agg(F.count(F.lit(1)), F.min("row_idx")).first()
            if not total:
                return {"written": 0, "refused": 0}
            late, parts, refused = new.where(F.col("row_idx") < length), [], 0
            if first < length:
                there = self.frame(name).select("row_idx")
                refused = late.join(there, "row_idx", "left_anti").count()
                parts.append(late.join(there, "row_idx", "left_semi"))
            if (top := new.agg(F.max("row_idx")).first()[0]) >= length:
                parts.append(filled(new.where(F.col("row_idx") >= length), columns, freq, limit, last=length - 1))
            update = reduce(DataFrame.unionByName, parts)
            touched = {r[0] for r in late.select((F.col("row_idx") / BLOCK_ROWS).cast("bigint")).distinct().collect()} if first < length else set()  # a number a block
            if top >= length:
                touched |= set(range(max(0, length - 1) // BLOCK_ROWS if length else 0, top // BLOCK_ROWS + 1))
            if total > refused:
                self._write(name, update, touched)
                entry["length"] = max(length, top + 1)
                self.dump()
            return {"written": total - refused, "refused": refused}
        finally:
            new.unpersist()

    def update_rows(self, name: str, rows: DataFrame) -> None:
        """Writes rows with given row_idx over what is there."""
        self._entry(name)
        touched = {r[0] for r in with_blocks(rows).select("block_id").distinct().collect()}  # a number a block
        self._write(name, rows, touched)
        self._measure(name)
        self.dump()

    def new_block(self, name: str, block_id: int, start: int | None = None, end: int | None = None) -> None:
        """Rows of defaults for the slots [start, end) of a block (all of it, if not given) that has none yet."""
        lo, hi = block_id * BLOCK_ROWS, (block_id + 1) * BLOCK_ROWS
        start, end = lo if start is None else start, hi if end is None else end
        if not lo <= start < end <= hi:
            raise EngineError(f"[{start}, {end}) isn't a range of slots of block {block_id}")
        if self.frame(name).where((F.col("row_idx") >= lo) & (F.col("row_idx") < hi)).limit(1).count():
            raise EngineError(f"block {block_id} exists already")
        zeros = [F.lit(TYPES[t][1]).cast(TYPES[t][0]).alias(c) for c, t in self._columns(name).items()]
        self._write(name, self.spark.range(start, end).select(F.col("id").alias("row_idx"), *zeros), {block_id})
        self._measure(name)
        self.dump()

    def delete_block(self, name: str, block_id: int) -> None:
        entry = self._entry(name)
        entry["layers"] = _without(entry["layers"], {block_id})
        self._measure(name)
        self.dump()

    def frame(self, name: str) -> DataFrame:
        """The collection's rows: row_idx and the columns."""
        entry, columns = self._entry(name), self._columns(name)
        if name in self.frames:
            return self.frames[name].select("row_idx", *[F.col(f"`{c}`") for c in columns])
        return self._read(name, entry["layers"])

    def collection(self, name: str) -> Collection:
        """What the query language's ``#name`` is."""
        entry = self._entry(name)
        return Collection(self.frame(name), name, entry["tableId"], datetime.fromisoformat(entry["startTime"]), entry["dataFrequency"], {c["name"]: (c["columnId"], c["type"]) for c in entry["columns"]}, entry["maxNullTime"], entry["length"] or None)

    def register(self, name: str, frame: DataFrame, columns: dict[str, str], start: datetime, frequency_s: int, max_null_s: int | None = None) -> Collection:
        """A collection over rows (row_idx and columns) that exist already; nothing is copied."""
        self.entries.pop(name, None)
        root, self.root = self.root, None
        self.create(name, frequency_s, max_null_s, start)
        for c, t in columns.items():
            self.add_column(name, c, t)
        self.root = root
        self.frames[name] = frame
        return self.collection(name)

    # --- layers ---------------------------------------------------------------------------------------------------
    def _entry(self, name: str) -> dict:
        if name not in self.entries:
            raise EngineError(f"no collection {name}")
        return self.entries[name]

    def _columns(self, name: str) -> dict[str, str]:
        return {c["name"]: c["type"] for c in self._entry(name)["columns"]}

    def _read(self, name: str, layers: list) -> DataFrame:
        """The rows of some layers; a column that a layer doesn't have yet takes its default."""
        columns = self._entry(name)["columns"]
        schema = ", ".join(["row_idx bigint", *(f"c{c['columnId']} {TYPES[c['type']][0]}" for c in columns), "block_id bigint"])
        if not layers:
            return self.spark.createDataFrame([], schema).select("row_idx", *[F.col(f"c{c['columnId']}").alias(c["name"]) for c in columns])
        owned: dict[str, list] = {}
        for lo, hi, path in layers:
            owned.setdefault(path, []).append(F.col("block_id").between(lo, hi))
        frames = [self.spark.read.schema(schema).parquet(path).where(reduce(lambda a, b: a | b, own)) for path, own in owned.items()]
        cells = [F.coalesce(F.col(f"c{c['columnId']}"), F.lit(TYPES[c["type"]][1]).cast(TYPES[c["type"]][0])).alias(c["name"]) for c in columns]
        return reduce(DataFrame.unionAll, frames).select("row_idx", *cells)

    def _write(self, name: str, update: DataFrame, touched: set[int]) -> None:
        """Puts the rows of ``update`` over the blocks ``touched``, which are written whole to a folder of their own."""
        entry = self._entry(name)
        if self.root is None or name in self.frames:
            raise EngineError("this collection has no folder to write to")
        if not touched:
            return
        runs = _runs(touched)
        base = self._read(name, [x for x in entry["layers"] if any(lo <= x[1] and x[0] <= hi for lo, hi in runs)])
        here = reduce(lambda a, b: a | b, [F.col("row_idx").between(lo * BLOCK_ROWS, (hi + 1) * BLOCK_ROWS - 1) for lo, hi in runs])
        self._put(name, upsert(base.where(here), update, list(self._columns(name))), runs)
        while len(entry["layers"]) > LAYERS:
            layers = entry["layers"]
            k = min(range(len(layers) - 1), key=lambda i: layers[i + 1][1] - layers[i][0])
            self._put(name, self._read(name, layers[k : k + 2]), [(layers[k][0], layers[k + 1][1])])

    def _put(self, name: str, rows: DataFrame, runs: list[tuple[int, int]]) -> None:
        entry = self._entry(name)
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        stored = [F.col(f"`{c['name']}`").alias(f"c{c['columnId']}") for c in entry["columns"]]
        with_blocks(rows.select("row_idx", *stored)).repartition("block_id").write.partitionBy("block_id").parquet(path)
        kept = entry["layers"]
        for lo, hi in runs:
            kept = _cut(kept, lo, hi)
        entry["layers"] = sorted([*kept, *([lo, hi, path] for lo, hi in runs)])

    def _measure(self, name: str) -> None:
        """The length anew; the last layer that has rows tells it."""
        entry = self._entry(name)
        entry["length"] = 0
        for layer in reversed(entry["layers"]):
            top = self._read(name, [layer]).agg(F.max("row_idx")).first()[0]
            if top is not None:
                entry["length"] = top + 1
                return

    # --- persistence ----------------------------------------------------------------------------------------------
    def _path(self, path: str):
        out = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return out, out.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        path, fs = self._path(f"{self.root}/catalog")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def dump(self) -> None:
        """Makes the next state of the catalog, unless another writer has made it."""
        if not self.root:
            return
        path, fs = self._path(f"{self.root}/catalog/{self.state + 1}.json")
        held = {"entries": {n: e for n, e in self.entries.items() if n not in self.frames}, "lastColumn": getattr(self, "last_column", 1), "whole": True}
        if fs.exists(path):
            raise EngineError("another writer has changed this catalog; restore it and write again")
        stream = fs.create(path, False)
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        self.state += 1

    def restore(self) -> None:
        """The last whole state; a state that a writer hasn't ended doesn't count."""
        for state in reversed(self._states()):
            text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/catalog/{state}.json", wholetext=True).collect())
            try:
                held = json.loads(text)
            except ValueError:
                held = {}
            if held.get("whole"):
                self.entries, self.last_column, self.state = held["entries"], held["lastColumn"], max(self._states())
                return

    def vacuum(self) -> None:
        """Removes data folders that no state names any more, and all states but the last ``STATES``. Not while others write."""
        for state in self._states()[:-STATES]:
            path, fs = self._path(f"{self.root}/catalog/{state}.json")
            fs.delete(path, False)
        named = set()
        for state in self._states():
            for r in self.spark.read.text(f"{self.root}/catalog/{state}.json", wholetext=True).collect():
                named |= {x[2].rsplit("/", 1)[1] for e in json.loads(r[0])["entries"].values() for x in e["layers"]}
        for name in self.entries:
            path, fs = self._path(f"{self.root}/data/{name}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)


def _runs(blocks: set[int]) -> list[tuple[int, int]]:
    """The maximal runs of block numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for b in sorted(blocks):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def _cut(layers: list, lo: int, hi: int) -> list:
    """``layers`` without the blocks lo to hi."""
    out = []
    for a, b, path in layers:
        if b < lo or a > hi:
            out.append([a, b, path])
        else:
            out += [[a, lo - 1, path]] * (a < lo) + [[hi + 1, b, path]] * (b > hi)
    return out


def _without(layers: list, blocks: set[int]) -> list:
    for lo, hi in _runs(blocks):
        layers = _cut(layers, lo, hi)
    return layers
