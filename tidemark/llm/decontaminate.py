"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits of the lower-cased text. Every ``WIDTH``-word run of a benchmark item is a seed, however
frequent. Documents are joined to items by the seeds, and each item is aligned with the words around its seeds (match +2,
mismatch -1, gap -1); the score is the alignment's share of the score of a full copy. Where a passage has too few of the
item's words to reach the threshold in any order, which frequent runs mostly find, the alignment is left out. Items are
broadcast in slices of at most ``SLICE_WORDS`` words, a pass a slice. A copy that keeps no run of ``WIDTH`` words isn't seen.

Defined cases: null and empty texts and items match nothing; items of fewer than ``WIDTH`` words take no part; items with
equal texts are reported each, the smallest id first among equal scores; equal documents are judged alike; null ids are
carried; an empty benchmark or table marks nothing; other columns are carried, and one named ``matches`` gives way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_ALNUM, col, mix64, slices, word_hashes

WIDTH, MATCH, MISMATCH, GAP, THRESHOLD = 3, 2, -1, -1, 0.45
SLICE_WORDS = 1_000_000
_MASK = (1 << 22) - 1
_FACTORS = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def _words(texts: list[str | None]):
    """For each run of texts: (first index, word hashes, word bounds of each text)."""
    data = [(t or "").lower().encode() for t in texts]
    for first, part in slices(data):
        hashes, starts, _ = word_hashes(b"\n".join(part), NOT_ALNUM)
        yield first, hashes, np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))


def _grams(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - WIDTH + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        out += hashes[k : k + n] * _FACTORS[k]
    return mix64(out)


class Items:
    """A slice of the benchmark: words and runs of each item."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.grams = [], [], []
        for first, hashes, bounds in _words([t for _, t in rows]):
            for k in range(len(bounds) - 1):
                own = hashes[bounds[k] : bounds[k + 1]]
                if len(own) >= WIDTH:
                    self.ids.append(rows[first + k][0])
                    self.words.append(own.copy())
                    self.grams.append(_grams(own))
        self.seeds = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, dtype=np.uint64)
        self.bitmap = np.zeros(_MASK + 1, dtype=bool)
        self.bitmap[(self.seeds & np.uint64(_MASK)).astype(np.int64)] = True
        self.places: dict[int, list[tuple[int, int]]] = {}  # of each seed the (item, offset) where it stands
        for i, grams in enumerate(self.grams):
            for at, g in enumerate(grams.tolist()):
                self.places.setdefault(g, []).append((i, at))
        self.bags = [np.unique(w, return_counts=True) for w in self.words]

    def most(self, item: int, passage: np.ndarray) -> float:
        """What no alignment's score exceeds: the share of the item's words that the passage has, in any order."""
        words, n = self.bags[item]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        return float(np.minimum(np.bincount(at[words[at] == passage], minlength=len(words)), n).sum() / n.sum())

    def hits(self, hashes: np.ndarray, bounds: np.ndarray):
        """(text, word, key) of each seed found inside a text."""
        grams = _grams(hashes)
        at = np.flatnonzero(self.bitmap[(grams & np.uint64(_MASK)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        key = grams[at]
        found = self.seeds[np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)] == key
        at, key = at[found], key[found]
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + WIDTH <= bounds[text + 1]
        return text[inside], at[inside], key[inside]


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """(share of a full copy's score, end of the best local alignment in the passage)."""
    n = len(passage)
    above, slope, best, end = np.zeros(n + 1, dtype=np.int32), GAP * np.arange(n + 1, dtype=np.int32), 0, 0
    for w in item:
        row = np.zeros(n + 1, dtype=np.int32)
        np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row - slope) + slope  # gaps in the passage
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best / (MATCH * len(item)), end


def _judge(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, float, int, int]]]:
    """For each text its (item id, score, first word, end word) at or above the threshold."""
    out: list[list] = [[] for _ in range(len(bounds) - 1)]
    near: dict[tuple[int, int], list[int]] = {}
    for text, at, key in zip(*(x.tolist() for x in items.hits(hashes, bounds)), strict=True):
        for item, offset in items.places[key]:
            near.setdefault((text, item), []).append(at - offset)
    for (text, item), starts in near.items():
        lo_text, hi_text, words = int(bounds[text]), int(bounds[text + 1]), items.words[item]
        starts.sort()
        margin, best = len(words) // 2 + WIDTH, None
        k = 0
        while k < len(starts):  # seeds that lie near one another share an alignment
            last = k
            while last + 1 < len(starts) and starts[last + 1] - starts[last] <= 2 * margin:
                last += 1
            lo, hi = max(lo_text, starts[k] - margin), min(hi_text, starts[last] + len(words) + margin)
            score, end = align(hashes[lo:hi], words) if items.most(item, hashes[lo:hi]) >= THRESHOLD else (0.0, 0)
            if score >= THRESHOLD and (best is None or score > best[1]):
                _, back = align(hashes[lo : lo + end][::-1], words[::-1])
                best = (items.ids[item], score, lo + end - back - lo_text, lo + end - lo_text)
            k = last + 1
        if best:
            out[text].append(best)
    for found in out:
        found.sort(key=lambda x: (-x[1], x[0]))
    return out


def _slices(items: DataFrame):
    """The benchmark's rows in slices of at most ``SLICE_WORDS`` words, one at a time on the driver."""
    rows, size = [], 0
    for r in items.where("id IS NOT NULL").orderBy("id").toLocalIterator():
        n = len((r["text"] or "").split())
        if rows and size + n > SLICE_WORDS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r["id"], r["text"] or ""))
        size += n
    yield Items(rows)


_MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))


def leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``df`` with ``matches``, an array of (item_id, score, first_word, end_word), best first."""
    spark = df.sparkSession
    out = df.withColumn("matches", F.array().cast(_MATCHES))
    at = out.columns.index(text_col)
    for items in _slices(benchmark.select(col(item_col).cast("long").alias("id"), col("text").alias("text"))):
        shared = spark.sparkContext.broadcast(items)

        def judge(batches, shared=shared):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
            for batch in batches:
                found, where = [], batch.schema.names.index("matches")
                for _, hashes, bounds in _words(batch.column(at).to_pylist()):
                    found += [[dict(zip(("item_id", "score", "first_word", "end_word"), m, strict=True)) for m in own] for own in _judge(shared.value, hashes, bounds)]
                before = batch.column(where).to_pylist()
                found = [sorted(old + new, key=lambda m: (-m["score"], m["item_id"])) for old, new in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, kind) if i == where else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

        out = out.mapInArrow(judge, out.schema)
    return out


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs.select("doc_id", "text"), items).select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.get("matches", F.lit(0))["item_id"].alias("item_id"), F.get("matches", F.lit(0))["score"].alias("score"), F.expr("transform(matches, m -> m.item_id)").alias("item_ids"), "matches")
