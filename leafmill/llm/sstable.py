"""Token ids in sorted-string-table shards (operator 3).

A shard is one file of entries in ascending key order::

    block*  index  bloom  footer

A block holds entries ``shared | unshared | value length`` (varints), the key's bytes
beyond the prefix it shares with the key before, and the value; it is compressed with
zstd and followed by its CRC-32. The sparse index has the last key, offset and length of
every block. The Bloom filter covers all keys. The fixed-size footer has the places of
index and filter, the numbers of entries and ids, the width of an id and a magic number.
A lookup reads the footer, asks the filter, bisects the index and scans one block (and
the next ones, while a key repeats).

Spark deals rows by ranges of ``doc_id`` (and of a hash of the text and a random number, so
that rows of one id can go to several ranges), sorts each range, and every task streams its
rows into shards of at most ``SHARD_BYTES`` and ``SHARD_ENTRIES``. A shard is written under another name and renamed when it is whole; the
manifest of a job lists only shards of tasks that Spark committed, so lost executors and
repeated tasks leave at most unlisted files.

Defined results: null or empty text has the end id alone; null ids sort first; rows that
repeat an id are all stored, in the order of a hash of their text; an empty table gives no shard and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import _tokens
from leafmill.llm._common import map_batches, materialize, new_dir, read_table

END_ID = 2
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 64 * 1024 * 1024
SHARD_ENTRIES = 1 << 20
RANGE_BYTES = 64 * 1024 * 1024
MOST_RANGES = 20_000
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MAGIC = b"LMSSTAB1"
FOOTER = struct.Struct("<QQQQQQB7x8s")

MANIFEST = "part int, shard int, path string, n_entries long, n_ids long, first_id long, last_id long"


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes whose order is that of the ids, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _key_hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def _bloom_places(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of keys by their two hashes, (keys, 2)."""
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return ((hashes[:, :1] + steps * hashes[:, 1:]) % np.uint64(n_bits)).astype(np.int64)


class Writer:
    """Writes one shard to an open binary file; keys must not descend."""

    def __init__(self, file, id_bytes: int):
        import zstandard

        self.file, self.id_bytes, self.pack = file, id_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.first: bytes | None = None
        self.hashes = array("Q")
        self.n_entries = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        elif key < self.last:
            raise ValueError("keys descend")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if key != self.last or not self.n_entries:
            self.hashes.extend(_key_hashes(key))
        self.last = key
        self.n_entries += 1
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.file.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        hashes = np.array(self.hashes, np.uint64).reshape(-1, 2)
        bits = np.zeros(max(64, len(hashes) * BLOOM_BITS_PER_KEY), np.bool_)
        for k in range(0, len(hashes), 1 << 16):
            bits[_bloom_places(hashes[k : k + (1 << 16)], len(bits))] = True
        bloom = struct.pack("<Q", len(bits)) + np.packbits(bits, bitorder="little").tobytes()
        self.file.write(index + bloom)
        at = self.at
        self.file.write(
            FOOTER.pack(
                at, len(index), at + len(index), len(bloom), self.n_entries, self.n_ids, self.id_bytes, MAGIC
            )
        )


class Reader:
    """Reads one shard from a random-access file (``seek``, ``read``, ``size``)."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        end = file.size()
        at, n, bloom_at, bloom_n, self.n_entries, self.n_ids, self.id_bytes, magic = FOOTER.unpack(
            self._read(end - FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, self.index = self._read(at, n), []
        k = 0
        while k < n:
            size, k = _read_varint(data, k)
            key, k = data[k : k + size], k + size
            block_at, k = _read_varint(data, k)
            block_n, k = _read_varint(data, k)
            self.index.append((key, block_at, block_n))
        self.bloom_at, self.bloom_n, self.bloom = bloom_at, bloom_n, None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        data, k, key = self.unpack.decompress(data[:-4]), 0, b""
        while k < len(data):
            shared, k = _read_varint(data, k)
            unshared, k = _read_varint(data, k)
            size, k = _read_varint(data, k)
            key, k = key[:shared] + data[k : k + unshared], k + unshared
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", size // self.id_bytes, k)
            k += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            data = self._read(self.bloom_at, self.bloom_n)
            n = struct.unpack("<Q", data[:8])[0]
            self.bloom = np.unpackbits(np.frombuffer(data, np.uint8, offset=8), bitorder="little")[:n]
        places = _bloom_places(np.array([_key_hashes(key)], np.uint64), len(self.bloom))
        return bool(self.bloom[places].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of that key."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found = []
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            for k, ids in self.block(i):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def _ranges(docs: DataFrame) -> int:
    """Ranges of about ``RANGE_BYTES`` by the planner's size of the table, where it knows one; at least the session's partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_RANGES, -(-size // RANGE_BYTES))) if size < 1 << 50 else least


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """Write all of ``docs`` as shards below ``path``; returns the manifest, one row for each shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.encoder(tokenizer)
        id_bytes = 2 if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, shard, done = TaskContext.get().partitionId(), 0, []
        end = np.asarray([end_id], "<u4").tobytes()
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        writer = None

        def finish() -> None:
            nonlocal writer, shard
            writer.close()
            writer.file.close()
            name = f"part-{part:05d}-{shard:04d}-{uuid.uuid4().hex}.sst"
            store.move(writer.path, f"{folder}/{name}")
            done.append(
                (part, shard, f"{path}/{name}", writer.n_entries, writer.n_ids, id_of(writer.first), id_of(writer.last))
            )
            writer, shard = None, shard + 1

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(texts), strict=True):
                if writer is None:
                    temporary = f"{folder}/_open-{uuid.uuid4().hex}"
                    writer = Writer(store.open_output_stream(temporary), id_bytes)
                    writer.path = temporary
                writer.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                if writer.at >= shard_bytes or writer.n_entries >= shard_entries:
                    finish()
        if writer is not None:
            finish()
        columns = list(zip(*done, strict=True)) or [[]] * 7
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["part", "shard", "path", "n_entries", "n_ids", "first_id", "last_id"],
        )

    keyed = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.rand(11).alias("salt")
    )
    dealt = keyed.repartitionByRange(_ranges(docs), "doc_id", "hash", "salt").sortWithinPartitions("doc_id", "hash", "text")
    return materialize(map_batches(dealt.select("doc_id", "text"), write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens and ids_crc32 of every entry."""
    order = Window.orderBy("part", "shard")  # one row for each shard
    based = materialize(
        manifest.select("path", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("base")), "bases"
    )
    n = based.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = _open(path)
                with store.open_input_file(inner) as file:
                    shard = Reader(file)
                    for i in range(len(shard.index)):
                        out: list[list] = [[], [], [], []]
                        for key, ids in shard.block(i):
                            row = (id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                            for col, value in zip(out, row, strict=True):
                                col.append(value)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    return map_batches(
        based.repartition(max(1, min(n, 10_000))), read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids stored under one identifier, from the shards whose range holds it."""
    found = []
    inside = (F.col("last_id") >= doc_id) & (F.coalesce(F.col("first_id"), F.lit(-(1 << 63))) <= doc_id)
    rows = manifest.where(inside).orderBy("part", "shard")
    for row in rows.collect():
        store, inner = _open(row["path"])
        with store.open_input_file(inner) as file:
            found += [ids.copy() for ids in Reader(file).get(doc_id)]
    return found


def op3_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_shards(docs, new_dir(spark, "shards"), _tokens.tokenizer_path("byte_bpe_50k.json"))
    return read_shards(manifest)
