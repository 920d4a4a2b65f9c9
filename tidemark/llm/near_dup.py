"""Near duplicates by circulant MinHash, with links confirmed on full shingle sets.

Signatures: a shingle's 64-bit hash gives a position (the first permutation); the second permutation, read from that
position on and wrapped around, gives all its coordinates at once, coordinate k being the permutation shifted by k. A
signature is the minimum over a document's shingles; some coordinates make a band (``bands_for``: 7 at a threshold of 85 %,
6 at 80 %), so that a pair at the threshold shares no band with a probability of 5e-6 at most.

Links: rows with equal shingle sets are one class, a node of its own number. Classes meet in bands; a bucket gives pairs of
a pivot and its members (all pairs in the smallest buckets; pivots follow one of ``ORDERS`` random orders, so that a copy
meets few different ones), pairs whose sketches of ``SKETCH`` coordinates agree too little are passed over (five standard
deviations below the threshold), the rest are confirmed on whole texts. After joining what is linked, every bucket that still
holds different components gives first each outside member's most similar partners, then all pairs between its components
(a pair in the first of its bands), and these are confirmed too. So a bucket of very many copies costs a multiple of its
size, not its square, and only what stays apart is compared further. Buckets are processed in blocks of ``BLOCK`` rows; of a
larger bucket the members outside its main component go to every block.

Defined cases: null and empty texts and texts without words have no shingles and no links; a text of fewer words than a
shingle is one shingle; equal texts link; very long texts are taken whole (from about a million distinct shingles on,
signatures look alike, and such texts meet in every bucket; they are still confirmed exactly); rows that repeat an id are
one document, so their texts are linked with one another; null ids take no part and are dropped from the groups (component
null); other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, col, free_name, mix64, shingle_hashes, written
from .components import components

WIDTH, PERCENT = 5, 85
COORDS = 252
#: Coordinates by which documents that share a bucket are compared.
SKETCH = 2 * COORDS
UNIVERSE = 1 << 20
BLOCK, ALL_PAIRS, PARTNERS, NEAREST, ORDERS, BROADCAST_IDS = 2048, 6, 64, 8, 8, 400_000
_PI: list = []


@dataclass(frozen=True)
class Bands:
    percent: int  # links are pairs with 100 * intersection >= percent * union
    rows: int  # coordinates of a band
    agree: int  # coordinates in which two sketches agree at least

    @property
    def count(self) -> int:
        return COORDS // self.rows


def bands_for(percent: int) -> Bands:
    """The longest bands by which a pair at the threshold is missed with a probability of 5e-6 at most."""
    s = percent / 100
    rows = max((r for r in range(1, 13) if COORDS % r == 0 and (1 - s**r) ** (COORDS // r) <= 5e-6), default=1)
    return Bands(percent, rows, int(SKETCH * max(0.0, s - 5 * (s * (1 - s) / SKETCH) ** 0.5)))


def _windows() -> np.ndarray:
    if not _PI:
        pi = np.random.default_rng(4242).permutation(UNIVERSE).astype(np.uint32)
        _PI.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:SKETCH]]), SKETCH))
    return _PI[0]


def signature(shingles: np.ndarray, width: int = COORDS) -> np.ndarray:
    """The first ``width`` coordinates of the circulant signature of a non-empty set of 64-bit hashes."""
    at, windows = (mix64(shingles) >> np.uint64(44)).astype(np.int64), _windows()[:, :width]
    out = windows[at[:1024]].min(axis=0)
    for lo in range(1024, len(at), 1024):
        np.minimum(out, windows[at[lo : lo + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, width: int) -> np.ndarray:
    """A key for each band of ``width`` coordinates."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(-1, width).astype(np.uint64)
        key = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for r in range(width):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(batches, bands: Bands):
    """id, h and text as id, h, number of shingles, digest of their set and band keys."""
    import pyarrow as pa

    for batch in batches:
        n, digests, keys = [], [], []
        for s in shingle_hashes(as_bytes(batch.column(2)), WIDTH):
            n.append(len(s))
            digests.append(_digest(s))
            keys.append(band_keys(signature(s), bands.rows) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "n", "digest", "keys"])


def _sketch(batches, bands: Bands):
    """id and text (with words) as id, text, digest, sig (a byte of each of ``SKETCH`` coordinates) and band keys."""
    import pyarrow as pa

    for batch in batches:
        digests, low, keys = [], [], []
        for s in shingle_hashes(as_bytes(batch.column(1)), WIDTH):
            sig = signature(s, SKETCH)
            digests.append(_digest(s))
            low.append((sig & np.uint32(0xFF)).astype(np.uint8).tobytes())
            keys.append(band_keys(sig[:COORDS], bands.rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text", "digest", "sig", "keys"])


def _runs(batches, keys: int):
    """Consecutive rows that agree in their first ``keys`` columns, as tables; the input is sorted by them."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts:
            yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    """An Arrow column of ``SKETCH`` bytes a row as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return np.empty((0, SKETCH), dtype=np.uint8)
    wide = str(column.type).startswith("large")
    first = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[first : first + SKETCH * len(column)].reshape(len(column), SKETCH)


def _stars(batches, bands: Bands):
    """Candidate pairs of each (key, block) at first: columns key, block, id, sig, sorted by the first two.

    Of up to ``ALL_PAIRS`` rows all pairs, else each row with the pivot, the first in one of ``ORDERS`` orders. All buckets
    of a batch are worked on at once; what a bucket has in further batches meets the pivot that it has so far.
    """
    import pyarrow as pa

    held = None  # the last bucket's pivot: key, block, id, sig
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, block, ids, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        goes_on = held is not None and held[0] == key[0] and held[1] == block[0]
        salt = (key % ORDERS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank = mix64(ids.astype(np.uint64) ^ salt)
        first = np.lexsort((ids, rank, run))[starts]  # of each run its least row
        ends_here = np.ones(len(starts), dtype=bool)
        ends_here[-1] = False  # it may go on
        small = (size <= ALL_PAIRS) & ends_here
        if goes_on:
            small[0] = False
        star = np.flatnonzero(~small[run] & (np.arange(n) != first[run]))
        left, right = [first[run[star]]], [star]
        for d in range(1, min(ALL_PAIRS, n)):
            at = np.flatnonzero((run[d:] == run[:-d]) & small[run[d:]])
            left.append(np.where(ids[at] < ids[at + d], at, at + d))
            right.append(np.where(ids[at] < ids[at + d], at + d, at))
        left, right = np.concatenate(left), np.concatenate(right)
        a, b = [], []
        for lo in range(0, len(left), 8192):
            x, y = left[lo : lo + 8192], right[lo : lo + 8192]
            near = ((sig[x] == sig[y]).sum(axis=1) >= bands.agree) & (ids[x] != ids[y])
            a.append(ids[x[near]])
            b.append(ids[y[near]])
        if goes_on:  # the rows here meet the pivot of the batches before
            rows = np.flatnonzero((run == 0) & (ids != held[2]))
            near = rows[(sig[rows] == held[3]).sum(axis=1) >= bands.agree]
            a.append(np.full(len(near), held[2]))
            b.append(ids[near])
        if not (goes_on and len(starts) == 1):
            k = int(first[-1])
            held = (key[-1], block[-1], int(ids[k]), sig[k].copy())
        if sum(map(len, a)):
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def _crossings(batches, bands: Bands, best: int | None = None):
    """Candidate pairs between the components of each (key, block): columns key, block, id, sig, label, lead, own, band, keys.
    A pair is given in the first band that it shares.

    best: each row outside the main component gives its most similar ones only.
    """
    import pyarrow as pa

    a_out, b_out = [], []
    for run in _runs(batches, 2):
        if run.num_rows < 2:
            continue
        ids, labels = run.column("id").to_numpy(), run.column("label").to_numpy()
        sig = _matrix(run.column("sig"))
        keys = run.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), bands.count)
        lead, own = run.column("lead").to_numpy(zero_copy_only=False), run.column("own").to_numpy(zero_copy_only=False)
        band = run.column("band")[0].as_py()
        for i in np.flatnonzero(lead):
            # Two outside the main component meet in every block; the one where the smaller id is at home counts.
            may = np.flatnonzero((labels != labels[i]) & (~lead | np.where(ids[i] < ids, own[i], False)))
            agree = (sig[may] == sig[i]).sum(axis=1)
            found, agree = may[agree >= bands.agree], agree[agree >= bands.agree]
            here = (keys[found] == keys[i]).argmax(axis=1) == band  # later bands give it too
            found = found[here][np.argsort(-agree[here], kind="stable")[:best]]
            a_out.append(np.full(len(found), ids[i]))
            b_out.append(ids[found])
        if sum(map(len, a_out)) > 20_000:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})
            a_out, b_out = [], []
    if a_out:
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})


def _confirmed(batches, percent: int):
    """Of each (a, salt) the pivot's row first (b null), then its partners; gives the pairs that are links."""
    import pyarrow as pa

    for run in _runs(batches, 2):
        b = run.column("b").to_pylist()
        sets = list(shingle_hashes(as_bytes(run.column("text").combine_chunks()), WIDTH))
        if b[0] is not None:
            continue
        linked = []
        for other, s in zip(b[1:], sets[1:], strict=True):
            if other is not None:
                both = len(np.intersect1d(sets[0], s, assume_unique=True))
                if both and 100 * both >= percent * (len(sets[0]) + len(s) - both):
                    linked.append(other)
        if linked:
            yield pa.RecordBatch.from_pydict({"a": np.full(len(linked), run.column("a")[0].as_py()), "b": np.array(linked)})


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, confirmed on the texts (node, text); a pivot's partners go in groups of ``PARTNERS``."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("groups"))
    salted = written(pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), "b"), "salted")
    partners = salted.join(texts, F.col("b") == F.col("node")).select("a", "salt", "b", "text")
    pivots = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = partners.union(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(rows.mapInArrow(lambda batches: _confirmed(batches, percent), "a long, b long"), "links")


def _grouped(docs: DataFrame, bands: Bands, same_ids: bool) -> DataFrame:
    """id, h (hash of the text), n, and first (id and h of the first row of its group; null without id or words) of each
    row of ``docs`` (id, text). ``same_ids``: rows that repeat an id are linked."""
    hashed = docs.select("id", F.xxhash64("text").alias("h"), "text")
    known = written(hashed.mapInArrow(lambda b: _describe(b, bands), "id long, h long, n long, digest binary, keys array<long>"), "signatures")
    worded = known.where("n > 0 AND id IS NOT NULL")
    classes = worded.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("first"), F.any_value("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    of = F.xxhash64("digest")
    repeated = written(worded.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(of).alias("least"), F.max(of).alias("most")).where("rows > 1"), "repeated")

    members = classes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("key").count().where("count > 1")
    met = written(members.join(shared, "key").select("key", "band", "node", "count"), "buckets")
    candidates = written(met.select("node").distinct().join(classes, "node").select("node", F.col("first.id").alias("rep"), F.col("digest").alias("of")), "candidates")
    small = candidates.count() <= BROADCAST_IDS
    sized = lambda frame: F.broadcast(frame) if small else frame
    own = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(sized(candidates.select("rep").distinct()), F.col("id") == F.col("rep"), "left_semi")
    texts = own.mapInArrow(lambda b: _sketch(b, bands), "id long, text string, digest binary, sig binary, keys array<long>")
    texts = texts.join(sized(candidates), (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("of"))).select("node", "text", "sig", "keys")
    if repeated.limit(1).count():  # only then can two rows be one node
        texts = texts.dropDuplicates(["node"])
    texts = written(texts, "texts")
    met = written(met.join(texts.select("node", "sig", "keys"), "node"), "bucket-signatures")

    def paired(rows: DataFrame, make, name: str) -> DataFrame:
        dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block")
        return written(dealt.mapInArrow(make, "a long, b long").distinct(), name)

    # A bucket's own blocks: those of another band bring other members together.
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("count") / BLOCK)).cast("int")
    stars = met.select("key", block.alias("block"), F.col("node").alias("id"), "sig")
    links = _links(paired(stars, lambda b: _stars(b, bands), "stars"), texts, bands.percent)
    if same_ids and repeated.where("least <> most").limit(1).count():
        number = classes.select("digest", "node")
        own = worded.select("id", "digest").join(repeated.where("least <> most").select("id"), "id", "left_semi").distinct()
        several = own.join(own.groupBy("id").agg(F.min("digest").alias("least")), "id").where("digest <> least").select("digest", "least").distinct()
        links = links.union(written(several.join(number.withColumnsRenamed({"node": "b"}), "digest").join(number.select(F.col("digest").alias("least"), F.col("node").alias("a")), "least").select("a", "b"), "same-ids"))
    labels = components(links)
    for best in (NEAREST, None):  # in buckets that still hold several components: the likeliest pairs first, then all
        labelled = met.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "band", "node", "sig", "keys", "count", F.coalesce("label", "node").alias("label"))
        parts = labelled.groupBy("key", "label").count()
        open_ = parts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
        rest = labelled.join(open_, "key").withColumn("home", block).withColumn("lead", F.col("label") != F.col("main"))
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        rest = rest.select("key", "band", "node", "sig", "keys", "label", "lead", "home", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("home"))).alias("block"))
        rest = rest.select("key", "block", F.col("node").alias("id"), "sig", "label", "lead", (F.col("home") == F.col("block")).alias("own"), "band", "keys")
        more = paired(rest, lambda b, best=best: _crossings(b, bands, best), "crossings")
        if not more.limit(1).count():
            break
        new = _links(more, texts, bands.percent)
        if new.limit(1).count():
            links = links.union(new)
            labels = components(links)

    linked = labels.join(classes.select("node", "first"), "node")
    firsts = linked.groupBy("label").agg(F.min("first").alias("top"))
    linked = linked.join(firsts, "label").select(F.col("node").alias("of"), "top")
    found = classes.join(linked, F.col("node") == F.col("of"), "left").select(F.col("digest").alias("set"), F.coalesce("top", "first").alias("first"))
    return known.join(found, (F.col("digest") == F.col("set")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left").select("id", "h", "n", "first")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of ``df``; links are pairs of ``percent`` similarity or more."""
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    rows = _grouped(docs, bands_for(percent), True)
    component = F.coalesce("first.id", "id")
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``df`` without the rows that near-duplicate another: of each group the row with the smallest id stays.

    Rows are told apart by id and text, so that rows which share an id and nothing else all stay; of rows that agree in
    both, one stays. Rows without words or without an id stay.
    """
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    rows = written(_grouped(docs, bands_for(percent), False).where("first IS NOT NULL"), "groups")
    removed = written(rows.where(F.struct("id", "h") != F.col("first")).select("id", "h").distinct(), "removed")
    again = written(rows.where(F.struct("id", "h") == F.col("first")).groupBy("id", "h").count().where("count > 1").select("id", "h"), "again")
    id_, h = free_name(df, "near_dup_id"), free_name(df, "near_dup_hash")
    own = df.withColumns({id_: col(id_col).cast("long"), h: F.xxhash64(col(text_col))})
    same = lambda o: (F.col(id_) == o["id"]) & (F.col(h) == o["h"])
    sized = lambda o: F.broadcast(o) if o.count() <= BROADCAST_IDS else o
    out = own.join(sized(removed), same(removed), "left_anti")
    if again.limit(1).count():
        single = sized(again)
        out = out.join(single, same(again), "left_anti").unionAll(out.join(single, same(again), "left_semi").dropDuplicates([id_, h]))
    return out.select(*[col(c) for c in df.columns])


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
