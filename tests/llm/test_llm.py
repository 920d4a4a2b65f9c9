"""Each operator against a plain form, on the test tables and on rows made to be awkward."""

import functools
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, classify, compression, decontaminate, licenses, near_dup, packing, sharding, token_files
from tidemark.llm.queries import oracle_sql, queries
from tidemark.llm.tokens import Encoder, encoder, tokenizer_path

LONG = " ".join(f"word{i % 977}" for i in range(20000))
BASE = " ".join(f"alpha{i}" for i in range(60))
AWKWARD = [
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE.replace("alpha30", "beta")),
    (4, ""),
    (5, None),
    (6, "  \n\t "),
    (7, "two words"),
    (7, "two words"),
    (8, LONG),
    (None, "no id at all here"),
    (9, "Été, ñandú <|endoftext|> don't  stop\n\nnow…"),
    (10, "two WORDS"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "x", 1, 2) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, score int, matches int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def library(name):
    """The tokenizer as the library loads it, with nothing set."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.fixture
def small_batches(spark):
    """Arrow batches of seven rows, so that what belongs together comes in several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(docs, name):
    texts = [r.text for r in docs.limit(60).collect()] + [t or "" for _, t in AWKWARD] + [" lead", "trail ", "x\n", "\nx", "a\x1cb c", "İ, b", ", ; !"]
    texts += ["x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|>b c", "<|ENDOFTEXT|> d", "<|endoftext |> e"]
    want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(tokenizer_path(name)).encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abcXYZéñßİ中’' \n\t.,;!?0123<|>endoftext\u0301\x1c"), max_size=60), max_size=6))
def test_encoder_on_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(tokenizer_path(name)).encode(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_marks_after_units_seen_before(name):
    cores = ["x", "7", "é", "ß", "İ", "ñ1", "\u0301", "e\u0301", "ʼ", "中", "..", "...", "!", ")", "a)", "don'", "it's", "x\t", "²", "Ⅷ", "“", "\x1c"]
    own = Encoder(tokenizer_path(name))
    for tail in ("", ".", "!", "?!", " a", ". a", "\n", ",\n"):
        texts = [lead + c + tail for c in cores for lead in ("", "b ", "b\n")]
        want = [library(name).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_token_files(spark, awkward):
    manifest = token_files.write_token_files(awkward, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in AWKWARD)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in AWKWARD if i is not None)
    at = 0
    left = sorted((str(i), library("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids + [0]) for i, t in AWKWARD)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == left
    empty = token_files.write_token_files(awkward.limit(0), tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0)
    assert token_files.read_token_files(empty).count() == 0


def test_token_file_format():
    import zstandard

    out = io.BytesIO()
    w = token_files.TokenFileWriter(out, 2)
    for i, ids in enumerate(([1, 2, 3], [], [7])):
        w.add(i, np.array(ids, dtype="<u4"))
    w.close()
    f = token_files.TokenFile(io.BytesIO(out.getvalue()))
    assert [f.read(k).tolist() for k in range(3)] == [[1, 2, 3], [], [7]] and f.lookup(2)[0].tolist() == [7]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [1, 2, 3, 7]
    bad = bytearray(out.getvalue())
    bad[int(f.offsets[1]) - 2] ^= 1
    with pytest.raises(Exception):
        token_files.TokenFile(io.BytesIO(bytes(bad))).read(0)


def test_packing(spark, awkward):
    assert packing.binary_lengths(4096 + 11, 4096) == [4096, 8, 2, 1]
    got = packing.pack(awkward, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)
    for i, t in AWKWARD:
        ids = library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        copies = sum(1 for j, _ in AWKWARD if j == i)
        assert sum(r.length for r in own) == copies * len(ids)
        if copies == 1:
            assert list(itertools.chain(*(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in own))) == ids
    assert packing.pack(awkward.limit(0), tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2).count() == 0


def test_sharding(spark, awkward, docs):
    got = sharding.external_shuffle(awkward, 5, bucket_bytes=40000).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in AWKWARD)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(5)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    out = sharding.external_shuffle(docs, 24, bucket_bytes=50000)
    order = [r.doc_id for r in out.orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(200)) and order != sorted(order)
    assert abs(np.corrcoef(order, range(200))[0, 1]) < 0.3
    assert sharding.external_shuffle(docs.limit(0), 24).count() == 0


def test_sharding_shuffles_texts_once(spark, docs, monkeypatch):
    plans, parquet = [], DataFrameWriter.parquet

    def kept(self, path, *args, **more):
        if "shards" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # these tables are small enough to be broadcast by Spark's own choice
    try:
        got = sharding.external_shuffle(docs, 24, bucket_bytes=50000)
        assert got.count() == docs.count()
    finally:
        spark.conf.set(name, before)
    (plan,) = plans
    assert "SortMergeJoin" not in plan
    joined = plan[plan.index("BroadcastHashJoin") :]
    texts = joined[: joined.index("BroadcastExchange")]
    assert texts.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in texts


def test_sharding_of_repeated_rows(spark):
    """Rows that are equal throughout, more than a bucket's share, come back whole and are spread over buckets."""
    rows = [(5, "same text " * 20, k % 2) for k in range(3000)] + [(i, f"text {i}", 0) for i in range(300)] + [(None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3)
    got = sharding.external_shuffle(df, 7, bucket_bytes=1 << 15).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, _ in rows)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    common = sharding._numbered(df, "doc_id", "text").where("v.text LIKE 'same%'").collect()
    assert sorted((r.v.slot, r.number) for r in common) == sorted((s, n) for s in (0, 1) for n in range(1500))


def _brute_groups(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, awkward, docs):
    for df in (awkward, docs):
        rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
        got = near_dup.near_duplicates(df).where("doc_id IS NOT NULL").collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == _brute_groups(rows) and len(got) == len(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    edit = lambda w: " ".join([*w[:100], "other", *w[101:]])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (1, edit(a)), (2, edit(b)), (9, "alone here")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {7: 1, 1: 1, 2: 1, 9: 9}
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and {(r.doc_id, r.text) for r in kept.collect()} == {rows[2], rows[3], rows[4]}
    stay = spark.createDataFrame([(7, " ".join(a)), (7, " ".join(b)), (7, " ".join(a)), (None, "x y"), (None, "x y"), (3, None), (3, None), (3, "")], "doc_id long, text string")
    assert sorted(map(str, near_dup.one_of_each(stay).collect())) == sorted(map(str, [r for r in stay.distinct().collect() if r.doc_id == 7] + [r for r in stay.collect() if r.doc_id != 7]))
    assert near_dup.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_thresholds(spark, percent):
    """Pairs just at and just below the threshold: n words more in one of two texts that are else equal."""
    assert (1 - (percent / 100) ** near_dup.bands_for(percent).rows) ** near_dup.bands_for(percent).count < 5e-6
    rows, want, shingles = [], {}, 200
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(shingles + 4)]
        union = shingles * 100 // percent + (k % 2)  # k odd: one shingle too many
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"m{k}x{i}" for i in range(union - shingles)]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (1 if 100 * shingles < percent * union else 0)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, percent=percent).collect()}
    assert got == want
    assert {r.doc_id for r in near_dup.one_of_each(df, percent=percent).collect()} == set(want.values())


def test_near_duplicates_large_group(spark, monkeypatch, small_batches):
    """Copies that link only through others, in buckets that need several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == _brute_groups(rows)


def test_neighbors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(1001, None), (1002, []), (1003, [0.0] * 64), (1004, [float("nan")] * 64), (1005, [1.0]), (1006, [None] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbors(df.unionAll(df.where("vec_id = 3")).unionAll(bad), 20).collect()
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        scores = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hit += len({r.vec_id for r in own} & set(ids[order]))
        total += 20
        assert [r.rank for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-12 for r in own)
    assert hit / total >= 0.9
    assert ann.nearest_neighbors(df.limit(0), 20).count() == 0


def test_neighbor_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(60)], "vec_id long, embedding array<double>")
    got = sorted(ann.nearest_neighbors(df, 5).where("query_id = 20").collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_neighbors_of_common_vectors(spark, small_batches):
    """A vector that a third of all rows share, repeated ids, one id with two vectors, clashing columns; every leaf is searched."""
    rng = np.random.default_rng(3)
    common = rng.normal(size=16).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(1800)]
    rows += [(3, common)] * 40 + [(7, rng.normal(size=16).tolist())]
    df = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double, id int")
    got = ann.nearest_neighbors(df, 20, target=1.0, probe_queries=400, query_rows=32, vector_rows=600).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    queries = sorted({i for i in ids.tolist() if i % 20 == 0})
    assert {r.query_id for r in got} == set(queries)
    for q in queries:
        best = {}
        for at in np.flatnonzero(ids == q):
            for i, s in zip(ids.tolist(), (x * x[at]).sum(axis=1).tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == want, q


#: Least accuracy, recall of label 1 and of label 0; the decision point of toxicity spares clean text.
@pytest.mark.parametrize(("label", "chosen", "mod", "rem", "least"), [("quality", classify.QUALITY, 3, 1, (0.97, 0.97, 0.9)), ("toxic", classify.TOXICITY, 5, 0, (0.95, 0.75, 0.98))])
def test_classifiers(spark, awkward, label, chosen, mod, rem, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = classify.learn(docs, labels.where(~classify.held_out("doc_id", mod, rem)), label, chosen, **classify.LEARN[label])
    held = classify.scored(docs.join(labels, "doc_id").where(classify.held_out("doc_id", mod, rem)), model).select(label, "score").collect()
    right = np.mean([(r.score >= 0.5) == bool(r[label]) for r in held])
    recall = np.mean([r.score >= 0.5 for r in held if r[label] == 1])
    clean = np.mean([r.score < 0.5 for r in held if r[label] == 0])
    assert right > least[0] and recall > least[1] and clean > least[2], (right, recall, clean)
    out = classify.scored(awkward, model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out) and set(out[0].asDict()) == {"doc_id", "text", "shard", "score", "matches"}
    none = classify.learn(docs, labels.where(f"{label} = 1"), label, chosen)
    assert none.scores([b"x"])[0] > 0.5


def _toxic_texts():
    """1,200 ordinary texts and 400 toxic ones, of which 10 have toxic words of their own and 20 are near copies of one text."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(300)]
    copied = ["".join(rng.choices("qrstuvwxyz", k=8)) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(1200)]
    texts += [" ".join(rng.choices(vocabulary, k=37) + ["vilestword"] * 3) for _ in range(370)]
    texts += [" ".join(rng.choices(vocabulary, k=37) + ["raravoxest"] * 3) for _ in range(10)]
    texts += [" ".join(rng.choices(vocabulary, k=2) + copied) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i].encode() for i in order], [int(i >= 1200) for i in order], copied


def test_rare_toxic_segments():
    texts, labels, copied = _toxic_texts()
    toxic = compression.train(texts, labels, classify.TOXICITY).contents[0]
    assert compression.encoded(b" vilest") in toxic and compression.encoded(b" rara") in toxic
    assert not any(compression.encoded(b" " + w[:5].encode()) in toxic for w in copied)


def test_both_dictionaries_hold_text():
    texts, labels, _ = _toxic_texts()
    contents = compression.train(texts, labels, classify.TOXICITY).contents
    words = {w for t, y in zip(texts, labels, strict=True) if not y for w in t.split()}
    assert len(contents) == 4
    for toxic, ordinary in (contents[:2], contents[2:]):
        assert toxic.strip(b"\0") and sum(compression.encoded(b" " + w[:5]) in ordinary for w in words) >= 2


def test_rates():
    """Words that any long text may hold, but label 1 holds far more often for its length."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=900) + ["stainword"]) for _ in range(200)]
    texts += [" ".join(rng.choices(vocabulary, k=60) + ["stainword"] * 4) for _ in range(80)]
    rng.shuffle(texts)
    data, labels = [t.encode() for t in texts], [int(len(t) < 2000) for t in texts]
    contents = compression.train(data, labels, classify.TOXICITY).contents
    assert compression.encoded(b" stainw") not in contents[0] and compression.encoded(b" stain") in contents[2]


def test_toxicity_by_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = classify.learn(docs, labels.where(~classify.held_out("doc_id", 5, 0)), "toxic", classify.TOXICITY, **classify.LEARN["toxic"])
    held = classify.scored(docs.join(labels, "doc_id").where(classify.held_out("doc_id", 5, 0)), model).select("toxic", "lang", "score").collect()
    found = [(r.lang, r.score >= 0.5) for r in held if r.toxic == 1]
    spanish = [x for lang, x in found if lang == "es"]
    right, clean = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]), np.mean([r.score < 0.5 for r in held if r.toxic == 0])
    print({lang: (sum(x for k, x in found if k == lang), sum(k == lang for k, _ in found)) for lang in dict(found)}, right, np.mean([x for _, x in found]), clean)
    assert len(spanish) == 6 and sum(spanish) >= 4 and np.mean([x for _, x in found]) > 0.6


def test_learning_passes_over_long_texts(spark):
    rows = [(i, "some plain words of number " + str(i % 7) if i % 2 else "vile words that are bad " + str(i % 7), int(i % 2 == 0)) for i in range(40)]
    first = spark.createDataFrame([(i,) for i in range(40)], "k long").orderBy(F.xxhash64("k"), "k").first().k
    rows = [(i, t + " long" * 2000 if i == first else t, y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = classify.learn(df, df, "toxic", classify.TOXICITY, sample_bytes=8000)
    assert not isinstance(model, classify.Constant)


def _plain_alignment(p, q):
    h, best = np.zeros((len(q) + 1, len(p) + 1), dtype=int), 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == p[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best / (2 * len(q))


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(40):
        p, q = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 12))
        assert decontaminate.align(p.astype(np.uint64), q.astype(np.uint64))[0] == _plain_alignment(p, q)


def test_leaks(spark, awkward):
    rng = random.Random(4)
    item = [f"item{i}" for i in range(40)]
    edited = [f"new{i}" if rng.random() < 0.2 else w for i, w in enumerate(item)]
    rows = [(100, "start " + " ".join(item) + " end"), (101, " ".join(edited)), (102, " ".join(item[:6])), (103, "nothing of it"), (104, None)]
    rows += [(200 + i, " ".join(item).upper()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(item)), (None, BASE)], "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontaminate.leaks(df, bench).collect()}
    assert {k for k, m in got.items() if m} == {100, 101, *range(200, 260)}
    assert [m.item_id for m in got[100]] == [1, 4] and got[100][0].score == 1.0 and (got[100][0].first_word, got[100][0].end_word) == (1, 41)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and not any(r.matches for r in decontaminate.leaks(df, bench.limit(0)).collect())


def test_leaks_against_all_pairs(spark, sf_dir, docs):
    """Every document aligned with every item, without seeds."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower().replace("_", " "))
    number: dict = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.uint64)
    items = {r.item_id: coded(r.text) for r in bench if len(words(r.text)) >= decontaminate.WIDTH}
    got = {r.doc_id: {m.item_id: m.score for m in r.matches} for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    found = 0
    for r in docs.collect():
        text, want = coded(r.text), {}
        for i, item in items.items():
            shared = np.isin(item, text).mean()  # no alignment's score exceeds it
            if shared >= decontaminate.THRESHOLD and (score := decontaminate.align(text, item)[0]) >= decontaminate.THRESHOLD:
                want[i] = score
        assert got[r.doc_id] == want, r.doc_id
        found += len(want)
    assert found >= 3


def test_leaks_in_awkward_tables(spark):
    long = " ".join(["word"] * 30000)
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, long, 0, "a"), (2, f"{long} {item} {long}", 0, "b"), (None, item, 0, "c"), (3, item, 0, "d"), (3, item, 0, "d"), (4, "", 0, None), (5, None, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches int, item_id string")
    out = decontaminate.leaks(df, spark.createDataFrame([(9, item, "x")], "item_id long, text string, doc_id string"))
    assert set(out.columns) == set(df.columns)
    assert sorted(((str(r.doc_id), len(r.matches), r.item_id) for r in out.collect()), key=str) == sorted(((str(i), int(i in (2, 3, None)), c) for i, _, _, c in rows), key=str)


def test_repeated_edited_copies(spark):
    item, half = [f"item{i}" for i in range(40)], [f"half{i}" for i in range(40)]
    edited = " ".join(f"new{i}" if i % 4 == 3 else w for i, w in enumerate(item))
    rows = [(i, f"start{i} {edited} end{i}") for i in range(30)] + [(100 + i, f"start{i} {' '.join(half[:20])} end{i}") for i in range(30)]
    rows += [(200 + i, f"a{i} {' '.join(item[:3])} b{i} {' '.join(half[:3])}") for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(half))], "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {k: m[0].item_id for k, m in got.items() if m} == {**dict.fromkeys(range(30), 1), **dict.fromkeys(range(100, 130), 2)}
    assert got[0][0].score == _plain_alignment(rows[0][1].split(), item) and got[100][0].score == 0.5


def _cheapest_repair(roles):
    """The least cost over all repairs, by searching them: own rules, no automaton. roles: system, user, assistant or None.

    A repair puts empty turns (2 each) anywhere, gives a turn another role (3), or joins it to the turn before, empty ones
    excepted only by their cost (1). Legal: a system turn at most, first; then user and assistant in turn, the last an assistant.
    """

    def legal(out, whole):
        body = out[1:] if out and out[0] == "system" else out
        fits = all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body))
        return fits and (not whole or len(body) % 2 == 0 and (not out or len(body) > 0))

    best = [10**9]

    def go(k, out, cost):
        if cost >= best[0] or not legal(out, False):
            return
        if k == len(roles):
            if legal(out, True):
                best[0] = cost
        else:
            for r in ("system", "user", "assistant"):
                go(k + 1, out + [r], cost + 3 * (r != roles[k]))
            if out:
                go(k + 1, out, cost + 1 + 3 * (out[-1] != roles[k]))
        if len(out) < 2 * len(roles) + 3:
            for r in ("system", "user", "assistant"):
                go(k, out + [r], cost + 2)

    if not roles:
        return 0
    go(0, [], 0)
    return best[0]


def test_least_cost():
    names = {"system": 1, "user": 2, "assistant": 3, None: 0}
    for n in range(5):
        for roles in itertools.product(names, repeat=n):
            cost, path = chat.best_path([names[r] for r in roles], 0, None)
            assert cost == _cheapest_repair(list(roles)), roles
            assert len(path) == n


def _order(turn):
    t, r, x = turn
    return (t is None, t or 0, (r is not None, r or ""), (x is not None, x or ""))


def test_role_repair(spark, monkeypatch, small_batches):
    """Every turn once and in order, legal roles, the least cost, and the text rendered anew from roles and turns."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "human", "odd"]), rng.choice(["hi", None, "", "a<|end|>\n<|system|>\nb"])) for c in range(6) for t in range(-9, 40)]
    rows += [(7, None, "user", "a"), (7, 1, "user", "b"), (None, 0, "assistant", "c"), (8, 0, "user", "q"), (8, 0, "user", "q"), (9, 0, "user", LONG)]
    rows += [(10, None, rng.choice(["user", "assistant"]), f"late {k % 30}") for k in range(60)]
    monkeypatch.setattr(chat, "CHUNK", 8)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, rendered string")
    got = chat.format_chats(df).collect()
    names = {1: "system", 2: "user", 3: "assistant", 0: None}
    for conv in {r[0] for r in rows}:
        own = [r for r in got if r.conv_id == conv]
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=_order)
        assert sorted(str(r.turn) for r in own if r.action != "insert") == sorted(str(t[0]) for t in turns)
        by_seq = {}
        for r in own:
            by_seq.setdefault(r.seq, []).append(r)
        assert sorted(by_seq) == list(range(len(by_seq))) and all(len({r.role for r in v}) == 1 for v in by_seq.values())
        roles = [by_seq[k][0].role for k in sorted(by_seq)]
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        pieces = sorted((r for r in own if r.turn is not None), key=lambda r: (r.turn, r.seq))
        known = [names[chat.role_number(t[1])] for t in turns]
        numbered = [t for t in turns if t[0] is not None]
        if len({t[0] for t in numbered}) == len(numbered) == len(turns):  # then a piece's own turn is known
            cost = sum(2 for r in own if r.action == "insert")
            cost += sum(3 * (r.role != k) + (r.action == "merge") for r, k in zip(pieces, known, strict=True))
            assert cost == chat.best_path([chat.role_number(t[1]) for t in turns], 0, None)[0], conv
            whole = ""
            for k in sorted(by_seq):
                inside = sorted((r.turn for r in by_seq[k] if r.turn is not None))
                texts = [re.sub(r"<(\\*)\|", r"<\\\1|", next(t[2] for t in turns if t[0] == n) or "") for n in inside]
                whole += f"<|{by_seq[k][0].role}|>\n" + "\n".join(texts) + "<|end|>\n"
            assert "".join(r.rendered for r in sorted(own, key=lambda r: (r.seq, r.turn is None, r.turn or 0))) == whole
        text = "".join(r.rendered for r in sorted(own, key=lambda r: (r.seq, r.turn is None, r.turn or 0)))
        assert text.startswith("<|") and text.endswith("<|end|>\n") and text.count("<|end|>") == len(by_seq)
    assert chat.format_chats(df.limit(0)).count() == 0
    assert all(chat.unescaped(chat.escaped(t)) == t for t in ("<|a", "<\\|", "<\\\\||<", "x"))


def test_licenses(spark, awkward):
    mit = licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Person\n" + mit.upper().replace("LICENSE", "LICENCE")), (3, "A text.\nreleased  under the MIT licence\nAnd more."), (4, None), (5, "mit"), (3, "other row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, (r.whole_text, r.licenses))
    assert got[1] == got[2] == ("MIT", "MIT") and got[3] == (None, "MIT") and got[4] == got[5] == got[None] == (None, "")
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    more = spark.createDataFrame([("House-1", "House licence.\nUse it as you like."), ("House-1", "Under the house licence.")], "license string, text string")
    rows = [(None, bsd + "\n" + "\n".join(" " for _ in range(9))), (8, "x\nunder the HOUSE license\n" + LONG), (9, "house license use it as you like"), (10, LONG)]
    clash = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, digest string, license string")
    assert {tuple(r) for r in licenses.scan_licenses(clash, extra=more).collect()} == {(None, "BSD-3-Clause", "BSD-3-Clause"), (8, None, "House-1"), (9, "House-1", "House-1"), (10, None, "")}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    for t in (mit, "Ä, b_c—D (c)", "© 2020 X\nrest", "v. 2.0 of the LICENCE"):
        assert spark.range(1).select(licenses.canonical(F.lit(t))).first()[0] == licenses.canonical_text(t)


def test_license_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(map(str, c.sql(oracle_sql()["op9_license_scan"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries()["op9_license_scan"](spark, sf_dir).collect()) == want


def _plain_learn(docs, labels, label, chosen, mod, rem, per_class, common):
    """The learning rows picked in plain Python, and the model from them. docs: {id: text}; labels: [(id, label)]."""
    import struct

    import xxhash

    known = [(k, y) for k, y in labels if y in (0, 1) and zlib.crc32(str(k).encode()) % mod != rem]
    order = lambda k: (xxhash.xxh64_intdigest(struct.pack("<q", k), seed=42) + 2**63) % 2**64  # noqa: E731  as a signed number
    n1 = sum(y for _, y in known)
    more = 1 if n1 > len(known) - n1 else 0  # the more frequent label
    rows = []
    for y in (0, 1):
        rows += sorted((p for p in known if p[1] == y), key=lambda p: order(p[0]))[: per_class * (common if y == more else 1)]
    rows = [(docs[k] or "", y) for k, y in sorted(rows, key=lambda p: (order(p[0]), p[0])) if k in docs]
    return compression.train([t.encode() for t, _ in rows], [y for _, y in rows], chosen)


def _plain_score(model, text):
    """The score of one text from the model's dictionaries and weights, worked out here."""
    import zstandard as z

    s, data = model.s, text.encode()
    data = data.lower() if s.lower else data

    def size(window, content):
        end = compression._CARRIER if s.codes else b""
        params = z.ZstdCompressionParameters.from_level(s.level, min_match=s.min_match, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content + end, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window + end))

    raw = []
    for k in range(0, len(model.contents), 2):
        if not data:
            raw += [0.0] * 8
            continue
        parts = compression.overlapping(compression.encoded(b" " + data), 3 * s.window, 36) if s.codes else compression.windows(data, s.window)
        gains = [size(w, model.contents[k + 1]) - size(w, model.contents[k]) for w in parts]
        top, own = sorted(gains)[::-1], len(z.ZstdCompressor(level=1, write_content_size=False).compress(data)) + 20
        raw += [max(gains), sum(top[:3]) / 3, 100 * sum(gains) / len(data), 100 * sum(g for g in gains if g > 2) / len(data), np.mean([g > 2 for g in gains]), np.log1p(max(0, sum(gains))), min(gains), 100 * sum(gains) / own]
    if s.whole:
        raw.append(100 * (size(data, model.contents[1]) - size(data, model.contents[0])) / own if data else 0.0)
    x = (np.concatenate([raw, np.square(raw)]) - model.center) / model.scale
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + np.clip(x, -20, 20) @ model.weights[1:], -30, 30)))


PLAIN = {"toxic": (classify.TOXICITY, 5, 0), "quality": (classify.QUALITY, 3, 1)}


@pytest.mark.parametrize(("name", "label"), [("op2_quality_compression", "quality"), ("op6_toxicity_compression", "toxic")])
def test_classifier_queries_against_one_process(spark, sf_dir, docs, name, label):
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    chosen, mod, rem = PLAIN[label]
    model = _plain_learn(texts, labels, label, chosen, mod, rem, **classify.LEARN[label])
    got = queries()[name](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(_plain_score(model, texts[r.doc_id] or ""), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rem)


def test_classifiers_on_awkward_tables(spark):
    texts, labels, _ = _toxic_texts()
    model = compression.train(texts, labels, classify.TOXICITY)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in AWKWARD], "doc_id long, text string, score string, held_out string")
    out = classify.scored(df, model).collect()
    assert len(out) == len(AWKWARD) and len({r.score for r in out if r.text == "two words"}) == 1
    assert len({r.score for r in out if not r.text}) == 1 and all(0 <= r.score <= 1 for r in out)
    assert classify.scored(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = classify.classify(df.limit(0), none, "toxic", classify.TOXICITY, 5, 0)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r.score for r in classify.classify(df.select("doc_id", "text"), none, "toxic", classify.TOXICITY, 5, 0).collect()} == {0.5}


def test_pipeline(spark, sf_dir):
    """run() against the stages in one process: plain learning and scoring, all pairs of shingle sets, all alignments, the library's ids."""
    import corpus_pipeline as p

    got = p.run(spark, sf_dir).collect()
    kept = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    table = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for label, keeps in (("toxic", lambda s: s < 0.5), ("quality", lambda s: s >= 0.5)):
        chosen, mod, rem = PLAIN[label]
        model = _plain_learn(kept, [(r.doc_id, r[label]) for r in table], label, chosen, mod, rem, **classify.LEARN[label])
        kept = {i: t for i, t in kept.items() if keeps(_plain_score(model, t))}
    first = {i: c for i, _, c in _brute_groups(list(kept.items()), 80)}
    kept = {i: t for i, t in kept.items() if first[i] == i}
    words = lambda t: np.array([zlib.crc32(w.encode()) for w in re.findall(r"[^\W_]+", t.lower())], dtype=np.uint64)
    items = [words(r.text or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i in list(kept):
        own = words(kept[i])
        if any(len(x) >= 3 and np.isin(x, own).mean() >= 0.45 and decontaminate.align(own, x)[0] >= 0.45 for x in items):
            del kept[i]
    assert {r.doc_id for r in got} == set(kept) and 0 < len(kept) < 200
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for i, t in kept.items():
        ids = library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids + [2]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.length for r in own] == packing.binary_lengths(len(ids), 4096)
        for r in own:
            assert (r.doc_tokens, r.offset) == (len(ids), 0) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])


def test_pipeline_on_awkward_tables(spark, sf_dir, tmp_path):
    """Stages keep what they should of rows made to be awkward: nulls, repeats, one id with two texts, clashing columns, none."""
    import corpus_pipeline as p

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    sane = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "m") for i, t in [*((None if i is None else i + 10**6, t) for i, t in AWKWARD), (10**6 + 7, BASE.replace("alpha", "gamma"))]], "doc_id long, text string, lang string, source string, n_chars int, score double, matches string")
    both = sane.withColumns({"n_chars": F.col("n_chars").cast("int"), "score": F.lit(0.1), "matches": F.lit("x")}).select(*odd.columns).unionAll(odd)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    there = {tuple(r) for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= there, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = sorted((str(r.doc_id), str(r.text)) for r in p.near_dup(spark, docs, str(tmp_path)).where("doc_id >= 1000000 OR doc_id IS NULL").collect())
    alone = [1, 4, 5, 6, 7, 8, 9]
    want = sorted([(str(i + 10**6), str(dict(AWKWARD)[i])) for i in alone] + [("None", "no id at all here"), (str(10**6 + 7), BASE.replace("alpha", "gamma"))])
    assert kept == want
    assert p.packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
