"""Token ids in one wavelet-matrix file per shard.

A shard holds the ids of whole documents one after the other.  The shard's
alphabet numbers its different ids by falling frequency; its wavelet matrix has
one bit plane per bit of such a number, highest first: plane l lists bit l of
all numbers in the order left by the planes above (those with a 0 before those
with a 1, stably).  The upper planes are mostly zeros.  Planes are cut into chunks of ``CHUNK_BITS`` bits; each
chunk is compressed on its own and the directory keeps the number of ones
before it, so a query touches one chunk per plane:

* ``access(i)``: the id at place i;
* ``rank(id, i)`` / ``count(id)``: how often an id occurs before place i / at all;
* ``select(id, k)``: the place of the k-th occurrence;
* ``ids()``: everything, plane by plane.

File layout (little endian): 8 bytes magic; u32 length of the header; the
header as JSON (numbers of ids and planes, zeros per plane, places of the
sections); then the alphabet (u32 each); then per plane the directory (u64 ones before, u64 place, u32
bytes, for each chunk) and the chunks, and one section with the documents
(Arrow IPC stream of id and number of ids).  Sections and chunks are zstd
frames.
"""

from __future__ import annotations

import io
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.session import scratch_path

from .common import materialise, pick
from .tokens import VOCABULARY, crc32, encoded

MAGIC = b"WAVELET1"
END_ID = 2
CHUNK_BITS = 1 << 15
#: Ids of a shard; a document is never divided, so its last one may exceed this.
SHARD_IDS = 1 << 21
#: Values that are moved at once.
BLOCK = 1 << 15
_ENTRY = np.dtype([("ones", "<u8"), ("at", "<u8"), ("size", "<u4")])


def _parted(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The values whose bit is 0, then those whose bit is 1, in order; block by block, to stay in the cache."""
    out = np.empty_like(values)
    low, high = 0, len(values) - int(np.count_nonzero(one))
    for at in range(0, len(values), BLOCK):
        bits, part = one[at:at + BLOCK], values[at:at + BLOCK]
        if not bits.any():
            out[low:low + len(part)] = part
            low += len(part)
            continue
        zeros, ones = part[np.flatnonzero(~bits)], part[np.flatnonzero(bits)]
        out[low:low + len(zeros)] = zeros
        out[high:high + len(ones)] = ones
        low, high = low + len(zeros), high + len(ones)
    return out


def _joined(values: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    """The inverse of ``_parted``; the first ``zeros`` values have the bit 0."""
    out = np.empty_like(values)
    low, high = 0, zeros
    for at in range(0, len(values), BLOCK):
        bits, part = one[at:at + BLOCK], out[at:at + BLOCK]
        if not bits.any():
            part[:] = values[low:low + len(part)]
            low += len(part)
            continue
        where = np.flatnonzero(~bits)
        part[where] = values[low:low + len(where)]
        low += len(where)
        where = np.flatnonzero(bits)
        part[where] = values[high:high + len(where)]
        high += len(where)
    return out


def build(ids: np.ndarray, documents: pa.RecordBatch) -> bytes:
    """The file of ``ids``; ``documents`` lists the shard's documents in order."""
    pack = zstandard.ZstdCompressor(level=1).compress
    body = io.BytesIO()

    def section(data: bytes) -> dict:
        place = {"at": body.tell(), "size": len(data)}
        body.write(data)
        return place

    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    n_planes = max(1, (len(alphabet) - 1).bit_length())
    symbol = np.zeros(len(counts), np.uint16 if n_planes <= 16 else np.uint32)
    symbol[alphabet] = np.arange(len(alphabet))
    head = {"ids": len(ids), "bits": n_planes, "alphabet": section(pack(alphabet.astype("<u4").tobytes()))}
    now = symbol[ids]
    planes = []
    for plane in range(n_planes - 1, -1, -1):
        one = (now & now.dtype.type(1 << plane)) != 0
        packed = np.packbits(one)
        step = CHUNK_BITS // 8
        n_chunks = -(-len(packed) // step)
        entries = np.zeros(n_chunks, _ENTRY)
        padded = np.zeros(n_chunks * step, np.uint8)
        padded[:len(packed)] = packed
        per_chunk = np.bitwise_count(padded).reshape(n_chunks, step).sum(axis=1, dtype=np.uint64)
        entries["ones"] = np.cumsum(per_chunk) - per_chunk
        for c in range(n_chunks):
            place = section(pack(packed[c * step:(c + 1) * step].tobytes()))
            entries[c]["at"], entries[c]["size"] = place["at"], place["size"]
        planes.append({"zeros": int(len(now) - per_chunk.sum()), **section(pack(entries.tobytes()))})
        now = _parted(now, one)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as writer:
        writer.write_batch(documents)
    head |= {"planes": planes, "documents": section(pack(sink.getvalue().to_pybytes()))}
    header = json.dumps(head).encode()
    return MAGIC + np.uint32(len(header)).astype("<u4").tobytes() + header + body.getvalue()


class WaveletFile:
    """Queries on the bytes of one file; chunks are decompressed when a query needs them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = int(np.frombuffer(data, "<u4", 1, 8)[0])
        header = json.loads(data[12:12 + size])
        self._body = memoryview(data)[12 + size:]
        self.n_ids, self.n_planes = header["ids"], header["bits"]
        self._zeros = [p["zeros"] for p in header["planes"]]
        self._directories = [np.frombuffer(self._section(p), _ENTRY) for p in header["planes"]]
        self._documents = header["documents"]
        self.alphabet = np.frombuffer(self._section(header["alphabet"]), "<u4")
        self._chunk = lru_cache(maxsize=256)(self._read_chunk)

    def _section(self, place: dict) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._body[place["at"]:place["at"] + place["size"]])

    def _read_chunk(self, plane: int, chunk: int) -> np.ndarray:
        entry = self._directories[plane][chunk]
        return np.frombuffer(self._section({"at": int(entry["at"]), "size": int(entry["size"])}), np.uint8)

    def documents(self) -> pa.Table:
        """(doc_id, n_ids) of the shard's documents in order."""
        return pa.ipc.open_stream(self._section(self._documents)).read_all()

    def _bit(self, plane: int, i: int) -> int:
        chunk, at = divmod(i, CHUNK_BITS)
        return int(self._chunk(plane, chunk)[at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        if i == 0:
            return 0
        chunk, at = divmod(i - 1, CHUNK_BITS)
        bits = self._chunk(plane, chunk)
        at += 1
        ones = int(np.bitwise_count(bits[:at >> 3]).sum(dtype=np.int64))
        if at & 7:
            ones += (int(bits[at >> 3]) >> (8 - (at & 7))).bit_count()
        return int(self._directories[plane]["ones"][chunk]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for plane in range(self.n_planes):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            value = value << 1 | bit
            i = self._zeros[plane] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _symbol(self, value: int) -> int:
        """The number of an id in the alphabet; -1 if it does not occur."""
        found = np.flatnonzero(self.alphabet == value)
        return int(found[0]) if len(found) else -1

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` before ``end`` lie below the last plane."""
        begin = 0
        for plane in range(self.n_planes):
            a, b = self._ones(plane, begin), self._ones(plane, end)
            if symbol >> (self.n_planes - 1 - plane) & 1:
                begin, end = self._zeros[plane] + a, self._zeros[plane] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place ``i``."""
        symbol = self._symbol(value)
        if symbol < 0:
            return 0
        begin, end = self._range(symbol, min(max(i, 0), self.n_ids))
        return end - begin

    def count(self, value: int) -> int:
        return self.rank(value, self.n_ids)

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th bit (from 0) that equals ``bit``."""
        ones = self._directories[plane]["ones"].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * CHUNK_BITS - ones
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._chunk(plane, chunk))
        return chunk * CHUNK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[chunk])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        symbol = self._symbol(value)
        at = self._range(symbol, self.n_ids)[0] + k
        for plane in range(self.n_planes - 1, -1, -1):
            bit = symbol >> (self.n_planes - 1 - plane) & 1
            at = self._find(plane, bit, at - self._zeros[plane] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order (uint32), from the last plane up to the first."""
        value = np.zeros(self.n_ids, np.uint16 if self.n_planes <= 16 else np.uint32)
        for plane in range(self.n_planes - 1, -1, -1):
            packed = [self._read_chunk(plane, c) for c in range(len(self._directories[plane]))]
            one = np.unpackbits(np.concatenate([*packed, np.zeros(0, np.uint8)]))[:self.n_ids].astype(np.bool_)
            zeros = self._zeros[plane]
            value[zeros:] |= value.dtype.type(1 << (self.n_planes - 1 - plane))
            value = _joined(value, one, zeros)
        return self.alphabet[value] if self.n_ids else np.zeros(0, np.uint32)


def _write(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under its final name only: a lost or repeated task leaves no half file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def write_shards(docs: DataFrame, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the ids of the columns doc_id, text in ascending order of doc_id; the manifest of the files.

    The manifest (file, task, part, n_docs, n_ids; ordered by task and part)
    is stored.  Null ids come first; equal ids follow each other in the order
    in which they were read.
    """
    from pyspark.sql import types as T

    id_field = docs.schema["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def flush():
            nonlocal part, size
            name = f"shard-{task:06d}-{part:06d}.wm"
            lengths = np.array([len(x) for x in held], np.int64)
            documents = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(lengths)],
                                                   names=["doc_id", "n_ids"])
            _write(folder, name, build(np.concatenate(held), documents))
            row = pa.RecordBatch.from_pylist([{"file": name, "task": task, "part": part, "n_docs": len(held),
                                               "n_ids": size}], schema)
            part, size = part + 1, 0
            held.clear()
            names.clear()
            return row

        for batch in batches:
            column = batch.column("doc_id")
            for i, ids in enumerate(encoded(batch.column("text"), vocabulary)):
                held.append(np.append(ids, np.uint32(end_id)))
                names.append(column.slice(i, 1))
                size += len(held[-1])
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("task", pa.int32()), ("part", pa.int32()),
                        ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # the place in the input splits a run of equal ids over several tasks
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    ranged = (placed.repartitionByRange(F.col("doc_id"), F.col("place"))
              .sortWithinPartitions("doc_id", "place").select(F.col("doc_id").cast(id_field.dataType), "text"))
    manifest = ranged.mapInArrow(run, T.StructType([
        T.StructField("file", T.StringType()), T.StructField("task", T.IntegerType()),
        T.StructField("part", T.IntegerType()), T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType())]))
    return materialise(manifest.repartition(1), "wavelet-manifest")  # one short row per file


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, id_type) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the files."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                opened = WaveletFile(content.as_py())
                documents = opened.documents()
                lengths = documents.column("n_ids").to_numpy()
                ends = np.cumsum(lengths)
                parts = np.split(opened.ids(), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[-1]] * len(lengths), pa.string()),
                     documents.column("doc_id").combine_chunks(), pa.array(ends - lengths),
                     pa.array(lengths), pa.array([crc32(p) for p in parts], pa.int64())],
                    names=["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    found = files.mapInArrow(run, T.StructType([
        T.StructField("file", T.StringType()), T.StructField("doc_id", id_type), T.StructField("local", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
    # ids before each file: before its task's first file (one row per task) and within the task
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("part")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("within", within).join(tasks, "task").select(
        "file", (F.col("before") + F.col("within")).alias("base"))
    return found.join(starts, "file").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def wavelet_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                       shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    ``folder`` must be one that all executors share; by default a new one
    under ``spark.checkpoint.dir``.  A null text counts as empty (only the end
    id); rows with equal ids are separate documents; an empty table writes no
    file and gives an empty table.
    """
    spark = docs.sparkSession
    base = pick(docs, doc_id=id_col, text=text_col)
    own = folder is None
    folder = folder or scratch_path(spark, "wavelet")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)  # it exists even when there is nothing to write
    if own:
        store.deleteOnExit(path)
    manifest = write_shards(base, folder, end_id, shard_ids)
    return read_documents(spark, folder, manifest, base.schema["doc_id"].dataType)


def op9_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the wavelet-matrix files."""
    return wavelet_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
