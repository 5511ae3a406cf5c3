"""Token-id files of directly addressable codes: any token of a file is read without decoding a block.

Ids are split into 8-bit chunks. Level 0 holds every id's low chunk; an id with more chunks sets its bit in the
level's continuation bitmap and goes on in the next level, at the position given by the number of set bits
before it. A rank directory (set bits before every 512th position) makes that count one lookup and one popcount
over at most 64 bytes.

File format (little-endian): magic ``TESSDAC1``; u64 documents, u64 tokens, u64 levels; documents x i64 id;
documents x u8 "id is null"; (documents + 1) x u64 token start; then per level u64 chunks, the chunks (u8), the
bitmap (u8, lowest bit first), and the directory (u64 per 512 positions).

Writing: documents are range-partitioned and sorted by id, each task encodes its texts and writes files of at
most ``FILE_TOKENS`` ids (one longer document is one file) into the shared folder, under a temporary name that is renamed when
complete, so a task that runs twice leaves one file. A manifest row per file gives its global token start; the
only global step is a running sum over files. Reading: one task per file, whole documents or single tokens.

Edge cases: null text is empty (only the end id), null ids come last, repeated ids are ordered by a hash of the
text, an empty table writes no file and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions, shared_path
from tessera.llm.encode import coder

MAGIC = b"TESSDAC1"
STEP = 512
FILE_TOKENS = 8_000_000


def pack(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes. ``starts`` has one entry more than ``doc_ids``."""
    null = np.array([d is None for d in doc_ids], dtype="u1")
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        ones = np.add.reduceat(more, np.arange(0, len(more), STEP)) if len(more) else np.zeros(0, np.int64)
        before = (np.cumsum(ones) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype("u1").tobytes()
                      + np.packbits(more, bitorder="little").tobytes() + before.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))
    return b"".join([head, keys.tobytes(), null.tobytes(), np.asarray(starts, "<u8").tobytes(), *levels])


class DacFile:
    """Random access to one file, given as ``read(offset, length) -> bytes``."""

    def __init__(self, read):
        self.read = read
        head = read(0, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a token-id file of this format")
        self.n_docs, self.n_tokens, n_levels = struct.unpack("<QQQ", head[8:])
        at = 32
        keys = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        null = np.frombuffer(read(at + 8 * self.n_docs, self.n_docs), "u1")
        self.doc_ids = [None if x else k for k, x in zip(keys.tolist(), null)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []                                  # (chunks, at of chunks, of bitmap, of directory)
        for _ in range(n_levels):
            n = struct.unpack("<Q", read(at, 8))[0]
            bits, marks = -(-n // 8), -(-n // STEP)
            self.levels.append((n, at + 8, at + 8 + n, at + 8 + n + bits))
            at += 8 + n + bits + 8 * marks

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        n, _, bitmap, marks = self.levels[level]
        if i >= n:
            i, last = n, (n - 1) // STEP
        else:
            last = i // STEP
        if n == 0:
            return 0
        before = struct.unpack("<Q", self.read(marks + 8 * last, 8))[0]
        at = last * STEP
        bits = np.unpackbits(np.frombuffer(self.read(bitmap + at // 8, -(-(i - at) // 8)), "u1"), bitorder="little")
        return int(before + bits[:i - at].sum())

    def token(self, i: int) -> int:
        """Id at position i of the file: per level one chunk, one bit and one rank."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift, level = 0, 0, 0
        while True:
            _, chunks, bitmap, _ = self.levels[level]
            value |= self.read(chunks + i, 1)[0] << shift
            if not self.read(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of a range of positions; each level contributes one consecutive piece."""
        parts, level = [], 0
        while end > start:
            _, chunks, bitmap, _ = self.levels[level]
            low = np.frombuffer(self.read(chunks + start, end - start), "u1").astype("<u4")
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + first, -(-end // 8) - first), "u1"), bitorder="little")
            more = bits[start - 8 * first:end - 8 * first].astype(bool)
            parts.append((low, more))
            if not more.any():
                break
            start = self._rank(level, start)
            end, level = start + int(more.sum()), level + 1
        value = np.zeros(0, "<u4")
        for low, more in reversed(parts):
            low[more] |= value << 8
            value = low
        return value

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> DacFile:
    """A file of the shared folder, held in memory (its size is bounded by the writer)."""
    fs, p = _filesystem(path)
    with fs.open_input_file(p) as f:
        raw = f.read()
    return DacFile(lambda at, n: raw[at:at + n])


def open_remote(path: str) -> DacFile:
    """A file read by ranges: a token costs a few small reads."""
    fs, p = _filesystem(path)
    f = fs.open_input_file(p)
    return DacFile(lambda at, n: f.read_at(n, at))


def write(docs: DataFrame, vocabulary: str, kind: str = "words", end_id: int | None = 1,
          file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode and write all documents; returns the manifest: path, base (global start), n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = shared_path(spark, "dac")
    rows = docs.select("doc_id", "text").withColumn("__tie", F.xxhash64("text"))
    ranged = (rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_last(), F.col("__tie"))
              .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "__tie").select("doc_id", "text"))

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, root = _filesystem(folder)
        code, part = coder(vocabulary, kind), 0
        keys, lists, total = [], [], 0

        def flush():
            nonlocal keys, lists, total, part
            name = f"part-{task.partitionId():06d}-{part:06d}.dac"
            temporary = f"{root}/.{name}.{task.taskAttemptId()}"
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(temporary) as f:
                f.write(pack(keys, starts, np.concatenate(lists)))
            fs.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": task.partitionId(), "seq": part, "path": f"{folder}/{name}",
                                               "n_docs": len(keys), "n_tokens": total}], schema)
            keys, lists, total, part = [], [], 0, part + 1
            return row

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), code.documents(batch.column(1), end_id)):
                if keys and total + len(ids) > file_tokens:
                    yield flush()
                keys.append(key)
                lists.append(ids)
                total += len(ids)
        if keys:
            yield flush()

    import pyarrow as pa
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    files = cut(ranged.mapInArrow(save, "part long, seq long, path string, n_docs long, n_tokens long"), "dac-manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"), "n_docs", "n_tokens")


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (global), ids (binary, little-endian u32)."""

    def load(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                f = open_file(row["path"])
                starts = f.starts.tolist()
                for a in range(0, f.n_docs, 2_000):
                    b = min(a + 2_000, f.n_docs)
                    ids = f.tokens(starts[a], starts[b])
                    raw = [ids[starts[i] - starts[a]:starts[i + 1] - starts[a]].astype("<u4").tobytes() for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[a:b], pa.int64()), pa.array([row["base"] + s for s in starts[a:b]], pa.int64()),
                         pa.array(raw, pa.binary())], ["doc_id", "start", "ids"])

    spread = manifest.repartition(partitions(manifest.sparkSession), "path")
    return spread.select("path", "base").mapInArrow(load, "doc_id long, start long, ids binary")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
