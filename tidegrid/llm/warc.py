"""WARC archives under zstandard: a leading skippable frame holds the dictionary, each record is one frame.

A response record's block is an HTTP header and the payload. A revisit record keeps the HTTP header alone;
its digest and Content-Length are those of the full payload, which the record it refers to holds.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, new_path, spread, written
from .idstore import train_dictionary

_SKIPPABLE, _ZSTD = 0x184D2A5D, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A payload of fewer bytes is never a revisit.
LEAST_REVISIT = 100
#: Each archive's dictionary is trained on so many of its first records, on so many bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4096, 32 * 1024
#: An archive is closed beyond so many bytes; a reading task gets about so many.
ARCHIVE_BYTES, SPLIT_BYTES = 512 << 20, 4 << 20
#: Pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "null" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # control characters and the like can't end the line
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#-_.!~*()[]%' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{what}: bad header line {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(raw: bytes) -> dict:
    """Checks one record's headers, lengths and digest. Raises ValueError where they don't hold."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    head = _fields(lines[1:], "WARC")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys():
        raise ValueError(f"no {', '.join(sorted(missing))} in a record")
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{head['warc-record-id']}: Content-Length {n} doesn't fit a block of {len(rest) - 4}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    inner = http.split(b"\r\n")
    if not gap or not inner[0].startswith(b"HTTP/"):
        raise ValueError(f"{head['warc-record-id']}: no HTTP header")
    length = int(_fields(inner[1:], "HTTP")["content-length"])
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if head["warc-type"] == "response":
        if length != len(payload) or digest != hashlib.sha256(payload).hexdigest():
            raise ValueError(f"{head['warc-record-id']}: payload and its length or digest differ")
    elif head["warc-type"] != "revisit" or payload or "warc-refers-to" not in head:
        raise ValueError(f"{head['warc-record-id']}: neither a response nor a revisit")
    return {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None, "payload": payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", _SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def read_dictionary(f) -> tuple[bytes, int]:
    """The dictionary of an archive (empty: none) and where its first record's frame begins."""
    head = f.read_at(8, 0)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != _SKIPPABLE:
        return b"", 0
    n = struct.unpack("<I", head[4:])[0]
    raw = f.read_at(n, 8)
    if len(raw) != n:
        raise ValueError("the dictionary's frame is cut off")
    if raw[:4] == struct.pack("<I", _ZSTD):  # it may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw, 8 + n


def frame_length(data: bytes, at: int) -> int:
    """Bytes of the zstandard frame at a place, by its block headers; 0 if data ends before it does."""
    if len(data) - at < 18 and len(data) - at < zstandard.frame_header_size(data[at:] + bytes(18)):
        return 0
    head = data[at : at + 18]
    if struct.unpack("<I", head[:4])[0] != _ZSTD:
        raise ValueError("no zstandard frame where one should begin")
    checksum, end = 4 * zstandard.get_frame_parameters(head).has_checksum, at + zstandard.frame_header_size(head)
    while True:
        if len(data) < end + 3:
            return 0
        b = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
        if b & 1:
            break
    end += checksum
    return end - at if end <= len(data) else 0


def read_records(f, start: int, stop: int, dictionary: bytes) -> Iterator[bytes]:
    """The records whose frames begin in a range that begins and ends with a frame, some MB at a time."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpress = zstandard.ZstdDecompressor(dict_data=shared)
    data, at, more = b"", 0, start
    while True:
        n = frame_length(data, at) if at < len(data) else 0
        if n:
            yield unpress.decompress(data[at : at + n])
            at += n
            continue
        if more >= stop:
            if at < len(data):
                raise ValueError("the last frame is cut off")
            return
        data, at = data[at:] + f.read_at(min(SPLIT_BYTES, stop - more), more), 0
        more = min(more + SPLIT_BYTES, stop)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row to archives at path; gives their manifest, evaluated: file, start, stop, n_records.

    Of rows with equal payloads of least_revisit bytes or more, those with the smallest id are responses and
    all others revisits of it; rows that share that id too are all responses. A null payload is empty. A row
    with a null id is a revisit if another with its payload has an id, else a response. A null url gives no
    WARC-Target-URI. An empty table gives no archive. Files of failed attempts aren't in the manifest.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # One row for each payload that occurs twice: Spark broadcasts it if it is small, else splits hot digests.
    same = written(rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "payloads")
    rows = rows.join(same, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    base = filesystem(path)
    base[0].create_dir(base[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(path)
        number = TaskContext.get().partitionId()
        out, name, at, press, start, n = None, "", 0, None, 0, 0
        done: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            records = [record_bytes(i, u, h.encode("utf-8", "surrogatepass"), d, r) for i, u, h, d, r in zip(*cols)]
            for record in records:
                if out is None:
                    dictionary = train_dictionary([x[:SAMPLE_BYTES] for x in records[:SAMPLE_RECORDS]], DICTIONARY_BYTES)
                    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                    if shared:
                        shared.precompute_compress(level=3)
                    press = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=shared)
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.warc.zst"
                    out = where.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(dictionary_frame(dictionary))
                    at = start = len(dictionary_frame(dictionary))
                    n = 0
                frame = press.compress(record)
                out.write(frame)
                at += len(frame)
                n += 1
                if at - start >= SPLIT_BYTES:
                    done.append((name, start, at, n))
                    start, n = at, 0
                if at >= ARCHIVE_BYTES:
                    out.close()
                    if n:
                        done.append((name, start, at, n))
                    out = None
        if out is not None:
            out.close()
            if n:
                done.append((name, start, at, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["file", "start", "stop", "n_records"])

    return written(rows.mapInArrow(write, "file string, start long, stop long, n_records long"), "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Each record of the archives at path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, on request payload (null for revisits)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{folder}/{row['file']}") as f:
                    dictionary, _ = read_dictionary(f)
                    some, n = [], 0
                    for raw in read_records(f, row["start"], row["stop"], dictionary):
                        got = parse_record(raw)
                        if not payloads:
                            del got["payload"]
                        elif got["record_type"] == "revisit":
                            got["payload"] = None
                        some.append(got)
                        n += 1
                        if len(some) == 1000:
                            yield pa.RecordBatch.from_pylist(some, schema=schema)
                            some = []
                    if n != row["n_records"]:
                        raise ValueError(f"{row['file']}: {n} records, not {row['n_records']}")
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    # Rows of the manifest are small, what they stand for isn't: the number of tasks is given, else Spark would merge them.
    return manifest.repartition(spread(manifest)).mapInArrow(read, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def archive_and_read_back(pages: DataFrame, **kwargs) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, path, write_archives(pages, path, **kwargs))
