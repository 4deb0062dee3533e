"""Token ids in binary files: one shared zstandard dictionary, each document compressed by itself.

A shard file holds, one after another: a header (magic, hash of the dictionary), the documents'
frames in ascending doc_id order, an index row for each document (id, place and length of its
frame, number of ids) and a footer that says where the index begins. A reader finds one short
document by its index row and decompresses nothing else. The dictionary lies beside the shards
under its hash, and manifest.json lists the shards with the ids before each.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import arrow_batches, new_path, slices, table
from tallyhouse.llm.tokens import encoder
from tallyhouse.session import qualified

MAGIC = b"THTOKID1"
HEADER, FOOTER = "<8sQ", "<QQ8s"
#: Place and length of the frame, number of ids, id, and whether the id is null.
INDEX = np.dtype([("at", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("doc_id", "<i8"), ("null_id", "<u4")])
#: The dictionary is trained on the ids of so many documents at most, and so many bytes of each.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 2000, 16_384, 65_536
LEVEL = 3
#: Rows that are encoded at once, and letters of a text by which the rows of one id are dealt over shards.
BATCH_ROWS, TIE_LETTERS = 2048, 32


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that names it, as qualified() makes it."""
    return pafs.FileSystem.from_uri(path)


def put(path: str, chunks: Iterator[bytes]) -> int:
    """Write a file under another name and move it, so that a lost or repeated task leaves no half file."""
    fs, name = _open(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    part, size = f"{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, name)
    return size


def get(path: str) -> bytes:
    fs, name = _open(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def dictionary_hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample, the texts of the ids with the least hashes; raw sample bytes where there are too few to train on."""
    import zstandard

    rows, h = docs.count(), F.xxhash64("doc_id", F.lit("dictionary"))
    share = min(1.0, 2 * TRAIN_DOCS / max(rows, 1))
    # So few ids are sorted that one task can; an id counts once, however many rows it has.
    near = docs.select(h.alias("h")).where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    least = [r.h for r in near.distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    if not least:
        return b""
    picked = docs.withColumn("h", h).where((F.col("h") <= least[-1]) & (F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    picked = picked.groupBy("h").agg(F.min("text").alias("text"))

    def ids(batches):
        for batch in slices(batches):
            found = encoder(tokenizer).encode(batch.column("text"))
            yield pa.record_batch([pa.array([(x + end_id.to_bytes(4, "little"))[:TRAIN_BYTES] for x in found], pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in picked.select("text").mapInArrow(ids, "ids binary").collect())
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> dict:
    """Write all documents' ids in ascending doc_id order (ties by text, null ids first); returns the manifest.

    A null or empty text gives the end id alone, repeated rows are written repeatedly, an empty
    table gives no shards, and columns besides doc_id and text are not read. Any length of text
    works; a worker holds one slice of rows and a shard's index at a time.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    key = dictionary_hash(dictionary)
    put(f"{folder}/{key:016x}.dict", iter([dictionary]))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    end = end_id.to_bytes(4, "little")

    def write(batches):
        shard, index, totals = TaskContext.get().partitionId(), [], [0, 0, None, None]

        def chunks():
            compressor, at = _compressor(dictionary), struct.calcsize(HEADER)
            yield struct.pack(HEADER, MAGIC, key)
            for batch in slices(batches, BATCH_ROWS):
                ids = encoder(tokenizer).encode(batch.column("text"))
                for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    frame = compressor.compress(x + end)
                    index.append((at, len(frame), len(x) // 4 + 1, doc_id or 0, doc_id is None))
                    at += len(frame)
                    yield frame
            rows = np.array(index, INDEX)
            named = rows["doc_id"][rows["null_id"] == 0]
            totals[:] = len(rows), int(rows["ids"].sum()), *((int(named[0]), int(named[-1])) if len(named) else (None, None))
            yield rows.tobytes()
            yield struct.pack(FOOTER, at, len(rows), MAGIC)

        size = put(f"{folder}/shard-{shard:06d}.tok", chunks())
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (shard, *totals, size)], ["shard", "docs", "ids", "first", "last", "bytes"])

    with arrow_batches(spark):
        done = docs.repartitionByRange(n, "doc_id", F.substring("text", 1, TIE_LETTERS)).sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard long, docs long, ids long, first long, last long, bytes long").collect()
    before, listed = 0, []
    for row in sorted(done, key=lambda r: r.shard):
        if row.docs:
            listed.append({"shard": row.shard, "file": f"shard-{row.shard:06d}.tok", "docs": row.docs, "ids": row.ids, "bytes": row.bytes, "start": before, "first": row.first, "last": row.last})
            before += row.ids
    manifest = {"format": MAGIC.decode(), "dictionary": f"{key:016x}", "end_id": end_id, "shards": listed}
    put(f"{folder}/manifest.json", iter([json.dumps(manifest).encode()]))
    # What tasks that were lost or repeated have left half written; they are done by now.
    fs, at = _open(folder)
    for info in fs.get_file_info(pafs.FileSelector(at)):
        if re.search(r"\.[0-9a-f]{32}$", info.base_name):
            fs.delete_file(info.path)
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    folder = qualified(spark, folder)
    manifest = json.loads(get(f"{folder}/manifest.json"))
    kind = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], kind)
    files = spark.createDataFrame([(x["file"], x["start"]) for x in manifest["shards"]], "file string, start long")

    def read(batches):
        dictionary = get(f"{folder}/{manifest['dictionary']}.dict")
        if f"{dictionary_hash(dictionary):016x}" != manifest["dictionary"]:
            raise ValueError("the dictionary isn't the one that the shards were written with")
        decompressor = _decompressor(dictionary)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                index, fetch = open_shard(f"{folder}/{file}", int(manifest["dictionary"], 16))
                starts = start + np.cumsum(index["ids"], dtype=np.int64) - index["ids"]
                for at in range(0, len(index), 256):
                    rows = index[at : at + 256]
                    ids = [decompressor.decompress(x) for x in fetch(rows)]
                    yield pa.record_batch([pa.array(rows["doc_id"], mask=rows["null_id"] == 1), pa.array(starts[at : at + 256]), pa.array(rows["ids"].astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.repartition(len(manifest["shards"])).mapInArrow(read, kind)


def open_shard(path: str, key: int):
    """A shard's index, and a function that gives the frames of neighbouring index rows with one read."""
    fs, name = _open(path)
    file = fs.open_input_file(name)
    file.seek(file.size() - struct.calcsize(FOOTER))
    at, rows, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
    file.seek(0)
    if struct.unpack(HEADER, file.read(struct.calcsize(HEADER))) != (MAGIC, key) or magic != MAGIC:
        raise ValueError(f"{path} isn't a shard of this dictionary")
    file.seek(at)
    index = np.frombuffer(file.read(rows * INDEX.itemsize), INDEX)

    def fetch(some: np.ndarray) -> list[bytes]:
        begin = int(some["at"][0])
        file.seek(begin)
        data = file.read(int(some["at"][-1]) + int(some["size"][-1]) - begin)
        return [data[int(a) - begin : int(a) - begin + int(s)] for a, s in zip(some["at"], some["size"], strict=True)]

    return index, fetch


def document_ids(folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, found through the index of the shards whose range of ids has it, and read alone.

    Of rows of one id the first is read. The folder names its file system, as qualified() makes it.
    """
    manifest = json.loads(get(f"{folder}/manifest.json"))
    decompressor = _decompressor(get(f"{folder}/{manifest['dictionary']}.dict"))
    for shard in manifest["shards"]:
        if shard["first"] is None or not shard["first"] <= doc_id <= shard["last"]:
            continue
        index, fetch = open_shard(f"{folder}/{shard['file']}", int(manifest["dictionary"], 16))
        found = np.flatnonzero((index["doc_id"] == doc_id) & (index["null_id"] == 0))
        if len(found):
            return np.frombuffer(decompressor.decompress(fetch(index[found[:1]])[0]), "<u4")
    return None


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
