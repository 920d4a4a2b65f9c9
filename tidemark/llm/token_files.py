"""Token-id files: one zstandard frame a document, and a seek table at the end, so readers decompress what they ask for.

A file is, in order: the frames; a skippable frame (magic 0x184D2A50) with the documents' ids (8-byte little-endian
integers, then a byte each that is 1 where the id was null) and the width of a token id in its first byte; a skippable
frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable format: for each frame its compressed
size, decompressed size and the low 32 bits of the XXH64 of its content, then the footer. Any zstandard decoder reads the
file as one stream of ids.

Defined cases: a null text is empty; an empty document holds the end id alone; documents of one id lie one after
another, ordered by a hash of their text; null ids come first; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, scratch_path, written
from .tokens import encoder, in_parts, tokenizer_path

_INDEX, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class TokenFileWriter:
    def __init__(self, stream, width: int = 4, level: int = 3):
        import zstandard

        self.out, self.width = stream, width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens += len(ids)

    def close(self) -> None:
        keys = np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + bytes(x is None for x in self.ids)
        body = bytes([self.width]) + keys
        self.out.write(struct.pack("<II", _INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, _FOOT)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)


class TokenFile:
    """Random access to a file of ``TokenFileWriter``; ``stream`` needs seek and read."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != _FOOT or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of this file")
        at = size - 9 - 12 * n
        stream.seek(at)
        table = np.frombuffer(stream.read(12 * n), dtype="<u4").reshape(n, 3)
        self.sizes, self.raw_sizes, self.checksums = table[:, 0], table[:, 1], table[:, 2]
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes.astype(np.int64))))
        stream.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", stream.read(8))
        body = stream.read(length)
        if magic != _INDEX or length != 1 + 9 * n:
            raise ValueError("no document index in this file")
        self.width = body[0]
        missing = body[1 + 8 * n :]
        self.doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(body[1 : 1 + 8 * n], dtype="<i8"), missing, strict=True)]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def n_tokens(self, k: int) -> int:
        return int(self.raw_sizes[k]) // self.width

    def read(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; no other frame is read."""
        import xxhash
        import zstandard

        self.stream.seek(int(self.offsets[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.sizes[k])), max_output_size=int(self.raw_sizes[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        return [self.read(k) for k, x in enumerate(self.doc_ids) if x == doc_id]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(df: DataFrame, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, width: int = 2) -> DataFrame:
    """Writes the ids of each text, ``end_id`` after it, in files of ascending ``id_col`` order.

    Returns the manifest, a row a file: file, part (their order), docs, tokens. ``width`` is the bytes an id takes. A
    task writes under a name of its own and renames the file when it is whole, so repeated tasks are harmless.
    """
    path = path or scratch_path(df.sparkSession, "tokens")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = _filesystem(path)
        part = TaskContext.get().partitionId()
        own, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:06d}.zst"
        encode, out, writer = encoder(tokenizer).encode, None, None
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            if writer is None and ids:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own)
                writer = TokenFileWriter(out, width)
            for texts in in_parts([x or "" for x in batch.column(1).to_pylist()]):
                for raw in encode(texts):
                    writer.add(ids[at], np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id)))
                    at += 1
        if writer:
            writer.close()
            out.close()
            store.move(own, final)
            yield pa.RecordBatch.from_pydict({"file": [final.rsplit("/", 1)[1]], "part": pa.array([part], pa.int32()), "docs": [len(writer.ids)], "tokens": [writer.tokens]})

    tie = F.xxhash64(col(text_col))
    ordered = df.select(col(id_col).cast("long").alias("k"), col(text_col).alias("t"), tie.alias("h")).repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    manifest = ordered.mapInArrow(write, "file string, part int, docs long, tokens long")
    return written(manifest.withColumn("file", F.concat(F.lit(path + "/"), "file")), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 4 bytes each)."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _filesystem(name)
                with store.open_input_file(at) as stream:
                    f = TokenFile(stream)
                    for lo in range(0, len(f), 512):
                        own = range(lo, min(lo + 512, len(f)))
                        rows = [f.read(k).astype("<u4") for k in own]
                        ends = start + np.cumsum([len(x) for x in rows])
                        yield pa.RecordBatch.from_arrays([pa.array([f.doc_ids[k] for k in own], pa.int64()), pa.array(ends - [len(x) for x in rows], pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        start = int(ends[-1])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    n = max(1, manifest.count())
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), (F.row_number().over(Window.orderBy("part")) - 1).cast("int").alias("nth"))
    return files.repartitionById(n, F.col("nth")).select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = read_token_files(write_token_files(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
