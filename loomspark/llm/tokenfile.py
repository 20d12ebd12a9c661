"""Token-id files: a zstandard dictionary shared by all documents, one compressed frame per document.

A file set is a folder with three tables:

* ``blocks``: one row per block of documents in ascending order: its range partition and place in it, the ids before
  it in its partition, first and last doc_id, the documents' ids, counts and byte offsets, and the joined frames;
* ``dictionary``: the dictionary, its SHA-256 and the width of a serialized id in bytes;
* ``manifest``: per range partition the number of ids of all partitions before it.

A short document is read from one block row: the id range finds the block, the offset index the frame.
Spark's own writer commits the tables, so lost executors leave no partial file behind.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_BYTES, doc_columns, shared_dir, slices, tokenizer_words

#: Bytes of frames in a block.
BLOCK_BYTES = 1 << 20
#: The dictionary: documents it is trained on (a bounded sample by a hash of doc_id, at most twice as many) and its size.
SAMPLE_DOCS, DICTIONARY_BYTES = 1000, 64 << 10

BLOCKS = "part int, block int, before long, low long, high long, n_ids long, doc_ids array<long>, counts array<long>, offsets array<long>, dict_sha256 string, frames binary"
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"


def _serialize(ids: bytes, width: int) -> bytes:
    """Little-endian unsigned integers of ``width`` bytes from those of 4."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _widen(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` documents; empty where they are too few to train one."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    own = doc_columns(docs).where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)) & (F.length("text") <= 20_000))
    rows = own.select("text").limit(2 * sample_docs).collect()
    end = np.array([end_id], dtype="<u4").tobytes()
    samples = [_serialize(x + end, width) for x in tokenizer_words(tokenizer_path, False).encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, level: int = 3, sample_docs: int = SAMPLE_DOCS) -> None:
    """Write all documents in ascending doc_id order (null first; equal ids by text, repeated rows side by side)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, sample_docs)
    sha = hashlib.sha256(dictionary).hexdigest()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = tokenizer_words(tokenizer_path, False)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True)
        part = TaskContext.get().partitionId()
        block, before, ids, counts, offsets, frames = 0, 0, [], [], [0], []

        def out():
            nonlocal block, before, ids, counts, offsets, frames
            n = sum(counts)
            row = (part, block, before, ids[0], ids[-1], n, ids, counts, offsets, sha, b"".join(frames))
            block, before, ids, counts, offsets, frames = block + 1, before + n, [], [], [0], []
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts, TEXT_BYTES):
                for doc, own in zip(docs_[i:j], encoder.encode(texts[i:j])):
                    own += end
                    frames.append(packer.compress(_serialize(own, width)))
                    ids.append(doc)
                    counts.append(len(own) // 4)
                    offsets.append(offsets[-1] + len(frames[-1]))
                    if offsets[-1] >= BLOCK_BYTES:
                        yield out()
        if ids:
            yield out()

    # ties of doc_id are split by text, so a hot id does not fill one partition
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = doc_columns(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(dictionary, sha, width)], "dictionary binary, dict_sha256 string, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    # one row per range partition reaches the driver
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    at, rows = 0, []
    for part, n_ids in sorted((r.part, r.n) for r in sums):
        rows.append((part, at))
        at += n_ids
    spark.createDataFrame(rows, "part int, part_start long").coalesce(1).write.parquet(f"{path}/manifest")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not have the hash it was written with")
    return dictionary, row.dict_sha256, row.width


def _unpacker(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary, sha, width = _opened(spark, path)

    def run(batches):
        unpack = _unpacker(dictionary)
        for b in batches:
            for row in b.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                at, out = row["before"], []
                frames = row["frames"]
                for doc, n, a, z in zip(row["doc_ids"], row["counts"], row["offsets"], row["offsets"][1:]):
                    own = _widen(unpack.decompress(frames[a:z]), width)
                    if len(own) != 4 * n:
                        raise ValueError("a document does not have the length it was written with")
                    out.append((doc, row["part"], at, n, zlib.crc32(own)))
                    at += n
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "before", "doc_ids", "counts", "offsets", "dict_sha256", "frames")
    starts = spark.read.parquet(f"{path}/manifest")  # one row per range partition: its size is bounded by that
    return blocks.mapInArrow(run, READ).join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every document with this id, from the blocks whose id range holds it."""
    dictionary, _, width = _opened(spark, path)
    unpack, out = _unpacker(dictionary), []
    near = spark.read.parquet(f"{path}/blocks").where((F.coalesce("low", F.lit(-(1 << 63))) <= doc_id) & (F.col("high") >= doc_id))
    for row in near.orderBy("part", "block").toLocalIterator():
        for doc, a, z in zip(row.doc_ids, row.offsets, row.offsets[1:]):
            if doc == doc_id:
                out.append(np.frombuffer(_widen(unpack.decompress(bytes(row.frames[a:z])), width), "<u4").tolist())
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write all documents, then read them back.

    Null and empty texts are the end id alone; a null ``doc_id`` comes first and stays null; an empty table gives no
    row; repeated rows give repeated rows; other columns are ignored.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/token-files"
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
