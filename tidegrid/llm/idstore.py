"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder. `dictionary` holds the dictionary. Each `part-*.ids` file is

    magic "TGIDS1\\0\\0" | SHA-256 of the dictionary (32) | bytes per id (1) | zeros (7)
    one zstandard frame per document: its ids as little-endian unsigned integers
    index: for n documents, n+1 offsets of frames (<u8), n counts of ids (<u8), n ids of documents (<i8),
           n flags (1: the document's id is null)
    n (<u8) | place of the index (<u8) | magic

so that any document is read by two seeks: its offsets, then its frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, filesystem, hashed_sample, new_path, spread, written
from .tokens import encoder, grouped

MAGIC = b"TGIDS1\0\0"
_HEAD, _TAIL = "<8s32sB7x", "<QQ8s"
_HEAD_SIZE, _TAIL_SIZE = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
#: The dictionary is trained on so many documents at most, on so many bytes of each, and is so large.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 4096, 64 * 1024
#: Documents that one reading task gets.
DOCS_PER_READ = 4000


def _narrow(ids: np.ndarray, width: int) -> np.ndarray:
    if width == 2 and len(ids) and ids.max() > 0xFFFF:
        raise ValueError("ids over 65535 need id_width=4")
    return ids.astype("<u2") if width == 2 else ids


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; empty if the samples are too few or too small for one."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_width: int = 2, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Encodes every whole text and writes a store at path, in ascending order of ids (nulls first).

    Gives its manifest, evaluated: file, number (its place in the order), n_docs, n_tokens. A null or
    empty text has the end id alone. Repeated ids stay beside one another. An empty table gives an empty
    manifest. id_width 2 holds ids under 65536, 4 all. Files of failed attempts aren't in the manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    few = hashed_sample(rows, sample_docs, "doc_id", "text").where(F.length("text") > 0).select(F.substring("text", 1, SAMPLE_BYTES).alias("text")).collect()
    end = struct.pack("<I", end_id)
    dictionary = train_dictionary([_narrow(np.frombuffer(x + end, "<u4"), id_width).tobytes()[:SAMPLE_BYTES] for x in encoder(tokenizer).encode([r["text"] for r in few])])
    where, folder = filesystem(path)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=3)  # else each document's frame would digest the dictionary anew
        own = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        last = _narrow(np.frombuffer(end, "<u4"), id_width).tobytes()
        for batch in grouped(batches, 1):
            ids, counts = encoder(tokenizer).encode_column(batch.column(1))
            raw, at, frames = memoryview(_narrow(ids, id_width)).cast("B"), 0, []
            del ids
            for n in (counts * id_width).tolist():
                frames.append(own.compress(bytes(raw[at : at + n]) + last))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = filesystem(path)
        number, name, at, out = TaskContext.get().partitionId(), "", _HEAD_SIZE, None
        ids, counts, sizes = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{number:06d}-{uuid.uuid4().hex}.ids"
                out = target.open_output_stream(f"{base}/{name}")
                out.write(struct.pack(_HEAD, MAGIC, hashlib.sha256(dictionary).digest(), id_width))
            for frame in batch.column(2):
                out.write(frame.as_buffer())
            ids.append(batch.column(0))
            counts.append(batch.column(1).to_numpy())
            sizes.append(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
        if out is None:
            return
        names, n_tokens = pa.chunked_array(ids, pa.int64()).combine_chunks(), np.concatenate(counts)
        offsets = np.cumsum(np.concatenate([[at], *sizes]))
        out.write(offsets.astype("<u8").tobytes() + n_tokens.astype("<u8").tobytes())
        out.write(pc.fill_null(names, 0).to_numpy().astype("<i8").tobytes() + pc.is_null(names).cast(pa.uint8()).to_numpy().tobytes())
        out.write(struct.pack(_TAIL, len(n_tokens), int(offsets[-1]), MAGIC))
        out.close()
        for first in range(0, len(n_tokens), DOCS_PER_READ):
            some = n_tokens[first : first + DOCS_PER_READ]
            yield pa.RecordBatch.from_pydict({"file": [name], "number": [number], "first": [first], "n_docs": [len(some)], "n_tokens": [int(some.sum())]})

    # Encoded where they are read: only frames travel, and the sort's sample of ids doesn't encode again.
    frames = written(rows.mapInArrow(press, "doc_id long, n_tokens long, frame binary"), "id-frames")
    # Rows that share an id, or have none, are dealt by a second key: they needn't fit in one task.
    dealt = frames.withColumn("_own", F.xxhash64("frame")).repartitionByRange("doc_id", "_own").sortWithinPartitions("doc_id", "_own").drop("_own")
    done = dealt.mapInArrow(write, "file string, number long, first long, n_docs long, n_tokens long")
    manifest = written(done, "ids-manifest")
    drop_written(frames)
    return manifest


def _read_block(where, folder: str, file: str, first: int, n: int, dictionary: bytes) -> Iterator[tuple[int | None, bytes]]:
    """Id and token ids (<u4) of n documents from number first on."""
    with where.open_input_file(f"{folder}/{file}") as f:
        magic, digest, width = struct.unpack(_HEAD, f.read_at(_HEAD_SIZE, 0))
        total, index, again = struct.unpack(_TAIL, f.read_at(_TAIL_SIZE, f.size() - _TAIL_SIZE))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{file} isn't a whole file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was written with another dictionary")
        if first + n > total:
            raise ValueError(f"{file} has {total} documents")
        offsets = np.frombuffer(f.read_at(8 * (n + 1), index + 8 * first), "<u8").tolist()
        counts = np.frombuffer(f.read_at(8 * n, index + 8 * (total + 1) + 8 * first), "<u8").tolist()
        names = np.frombuffer(f.read_at(8 * n, index + 8 * (2 * total + 1) + 8 * first), "<i8").tolist()
        nulls = f.read_at(n, index + 8 * (3 * total + 1) + first)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpress = zstandard.ZstdDecompressor(dict_data=shared)
        at = 0
        while at < n:  # about 8 MB at once
            to = at + 1
            while to < n and offsets[to + 1] - offsets[at] < 8 << 20:
                to += 1
            raw = f.read_at(offsets[to] - offsets[at], offsets[at])
            for k in range(at, to):
                ids = unpress.decompress(raw[offsets[k] - offsets[at] : offsets[k + 1] - offsets[at]])
                if len(ids) != counts[k] * width:
                    raise ValueError(f"document {first + k} of {file}: {len(ids)} bytes, not {counts[k]} ids")
                yield None if nulls[k] else names[k], ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            at = to


def read_one(path: str, file: str, place: int) -> np.ndarray:
    """The ids of the document at a place of a file."""
    where, folder = filesystem(path)
    with where.open_input_file(f"{folder}/dictionary") as f:
        dictionary = f.read()
    return np.frombuffer(next(_read_block(where, folder, file, place, 1, dictionary))[1], "<u4")


def read_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """One row per document of the store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row per file, so as many as there were tasks; of blocks, the sums.
    parts = manifest.groupBy("number").agg(F.sum("n_tokens").alias("n")).orderBy("number").collect()
    base, starts = 0, {}
    for r in parts:
        starts[r["number"]] = base
        base += r["n"]
    by_number = spark.createDataFrame([(k, v) for k, v in starts.items()], "number long, base long")
    # Blocks of a file before this one: a file has few, and they stay together.
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("number").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = manifest.select("number", "first", before.alias("before"))
    blocks = manifest.join(heads, ["number", "first"]).join(by_number, "number").select("file", "first", "n_docs", (F.col("base") + F.col("before")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(path)
        with where.open_input_file(f"{folder}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["base"], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc, ids in _read_block(where, folder, row["file"], row["first"], row["n_docs"], dictionary):
                    for c, v in zip(out.values(), (doc, at, len(ids) // 4, zlib.crc32(ids))):
                        c.append(v)
                    at += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out.values()], names=list(out))

    # A row is much work in few bytes: the number of tasks is given, else Spark would merge them.
    return blocks.repartition(spread(manifest)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int, **kwargs) -> DataFrame:
    path = new_path(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, path, write_ids(docs, path, tokenizer, end_id, **kwargs))
