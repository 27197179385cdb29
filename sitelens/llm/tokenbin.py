"""Token ids in bit-packed files.

Format of one file (all integers little-endian)::

    "TKBIN001" | packed blocks | footer | footer offset: u64 | "TKBIN001"
    footer: u32 bits per id | u32 ids per block | u64 documents | u64 ids | u64 blocks
            | i64 document ids | u8 "id is null" flags | u64 document lengths | u64 block offsets

Every id takes the least number of bits that holds the vocabulary.  A block holds
a fixed number of ids and starts at a byte, so block offsets give random access
and numpy unpacks a block at once.

Writing: documents are range partitioned by id (one shuffle of the texts), sorted
within partitions, and encoded as a stream; each task rolls over to a new file at
``file_ids`` ids and holds only one block and the document index of one file.
Files get names of their own per attempt; only those in the manifest, which Spark
commits, are ever read, so retried or lost tasks leave no trace in the result.
The folder must be one that both Spark and pyarrow can open.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import scratch_folder, text_or_empty
from sitelens.llm.wordbpe import text_groups, word_encoder

MAGIC = b"TKBIN001"
BLOCK_IDS = 65_536
FILE_IDS = 8_388_608


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    cells = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):                    # whole bytes: the same layout, without expanding bits
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    cells = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (cells.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class TokenFileWriter:
    def __init__(self, folder: str, name: str, bits: int):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.bits = name, bits
        self.out = fs.open_output_stream(f"{path}/{name}", compression=None)
        self.out.write(MAGIC)
        self.at, self.offsets, self.docs, self.lens = len(MAGIC), [], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lens.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            flat, stop = np.concatenate(self.held), self.n_held - self.n_held % BLOCK_IDS
            for i in range(0, stop, BLOCK_IDS):
                self._block(flat[i:i + BLOCK_IDS])
            self.held, self.n_held = [flat[stop:]], self.n_held - stop

    def _block(self, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.bits // 8}").tobytes() if self.bits in (8, 16, 32) else pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        null = np.array([d is None for d in self.docs], np.uint8)
        self.out.write(struct.pack("<IIQQQ", self.bits, BLOCK_IDS, len(self.docs), self.n_ids, len(self.offsets)))
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes())
        self.out.write(np.array(self.lens, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack("<Q", self.at) + MAGIC)
        self.out.close()
        return self.name, len(self.docs), self.n_ids


class TokenFile:
    """Random access to one file: reads the footer, then only the blocks that are asked for."""

    def __init__(self, folder: str, name: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        at, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is not a token file")
        foot = self.file.read_at(size - 16 - at, at)
        self.bits, self.block, n_docs, self.n_ids, n_blocks = struct.unpack_from("<IIQQQ", foot)
        p = 32
        ids = np.frombuffer(foot, "<i8", n_docs, p)
        null = np.frombuffer(foot, np.uint8, n_docs, p + 8 * n_docs)
        p += 9 * n_docs
        self.lens = np.frombuffer(foot, "<u8", n_docs, p).astype(np.int64)
        self.offsets = np.frombuffer(foot, "<u8", n_blocks, p + 8 * n_docs).astype(np.int64)
        self.docs = [None if z else int(d) for d, z in zip(ids, null)]
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _get(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            n = min(self.block, self.n_ids - k * self.block)
            self._last = (k, unpack(self.file.read_at((n * self.bits + 7) // 8, int(self.offsets[k])), self.bits, n))
        return self._last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        flat = np.concatenate([self._get(k) for k in range(first, last + 1)])
        return flat[start - first * self.block:stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id",
                 text: str = "text", file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Encode and write every text; return the manifest (part, seq, name, n_docs, n_ids).

    A null text is empty (only its end id is written).  Documents are in ascending
    order of the key, nulls first; rows with equal keys are ordered by text.  An
    empty table writes no file.
    """
    bits = bits_for(vocabulary)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    rows = rows.repartitionByRange(n, "k").sortWithinPartitions("k", "t")

    def task(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, out, done = word_encoder(tokenizer), None, []
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                for k, ids in zip(keys[a:b], enc.encode(texts[a:b])):
                    if out is None:
                        out = TokenFileWriter(folder, f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.tkb", bits)
                    out.add(k, np.concatenate([ids, end]))
                    if out.n_ids >= file_ids:
                        done.append(out.close())
                        out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pydict({
                "part": [part] * len(done), "seq": list(range(len(done))), "name": [d[0] for d in done],
                "n_docs": [d[1] for d in done], "n_ids": [d[2] for d in done]})

    schema = "part long, seq long, name string, n_docs long, n_ids long"
    path = f"{folder}/_manifest"
    rows.mapInArrow(task, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, file, position.

    The running start is a window over one row per file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.select("name", "start").repartition("name")

    def task(batches):
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                f = TokenFile(folder, name)
                for a in range(0, len(f.docs), 4096):
                    some = range(a, min(a + 4096, len(f.docs)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([f.docs[i] for i in some], pa.int64()),
                        "start": pa.array([start + int(f.starts[i]) for i in some], pa.int64()),
                        "n_tokens": pa.array([int(f.lens[i]) for i in some], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(f.document(i).astype("<u4").tobytes()) for i in some],
                                              pa.int64()),
                        "file": [name] * len(some), "position": pa.array(list(some), pa.int64())})

    return files.mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, position long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257,
                folder: str | None = None) -> DataFrame:
    """Write all documents and read the files back."""
    folder = folder or scratch_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, vocabulary), folder)
