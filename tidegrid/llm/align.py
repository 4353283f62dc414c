"""Alignment of two tokenizers over whole texts: a byte-level BPE (A) and a sentencepiece model with byte fallback (B).

Texts are cut into units where both tokenizers can't but begin a token; equal units are tokenized and aligned once, whatever
the number of their places. Everything after tokenization is relational: posexplode, windowed cumulative lengths, an
equi-join on unit and offset, running cut counts as group ids, joins with the counts of id pairs.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, drop_written, release_memory, written
from .tokens import _gathered, grouped, stretches

#: Bytes of texts, about, that make a block: a block's distinct units are one row, joined with its documents.
BLOCK_BYTES = 8 << 20
#: Units that one task aligns, about, and units that are tokenized at once.
UNITS_PER_TASK, TOGETHER = 100_000, 4096
#: Id pairs up to which their counts are broadcast (some 60 bytes each); beyond, links and counts are shuffled.
PAIRS_SENT = 1_000_000
#: Both tokenizers begin a token at these signs after a letter, and at a letter after a lone line end.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = re.compile(rf"(?<=[{_LETTER}])(?=[.,;:!?\n])|(?<=\S\n)(?=[{_LETTER}])")
_MARK = "\x1f"
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARKED = [(rf"([^{_WHITE}])\n([{_LETTER}])", f"\\1\n{_MARK}\\2"), (rf"([{_LETTER}])([.,;:!?\n])", rf"\1{_MARK}\2")]


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of byte-level tokens stand for: printable ones for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers: their vocabularies as bytes, which texts they give back, and the ids of units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in entries.items():
            self.a_bytes[i] = bytes(map(of.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if self.a.normalizer is not None or any(chr(0x21 + k) not in entries for k in range(94)):
            raise ValueError(f"{a_path} isn't a plain byte-level tokenizer")
        inner = re.compile(rf"[^\u2581]\u2581|[{_LETTER}][.,;:!?]|\n")
        if not any(self.b.is_byte(i) for i in range(len(pieces))) or any(inner.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError(f"{b_path} has no byte fallback, or pieces that reach across a unit's end")

    def gives_back(self, texts: list[str]) -> list[bool]:
        """Whether the joined bytes of a text's tokens are a space and the text: A's always are, B's are what its normalizer makes."""
        return [bool(t) and n.replace("\u2581", " ") == f" {t}" for t, n in zip(texts, self.b.normalize(texts))]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units. B sets a space before each text: one that a unit begins with, or one before a line end, which are then dropped."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = [x if u[0] == " " else x[2:] for u, x in zip(units, self.b.encode([u[1:] if u[0] == " " else f"\n{u}" for u in units], num_threads=1))]
        for u, x, y in zip(units, a, b):
            raw = u.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) != raw or b"".join(map(self.b_bytes.__getitem__, y)) != raw:
                raise ValueError(f"the tokens of {u!r} aren't its bytes")
        return a, b


@functools.lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    """One for each Python worker."""
    return Pair(a_path, b_path)


def cut_units(spaced: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units of stretches, the units of each stretch one after another, by number, and how many each has."""
    if pc.any(pc.match_substring(spaced, _MARK)).as_py():
        split = pa.array([_CUT.split(s) for s in spaced.to_pylist()], pa.large_list(pa.large_string()))
    else:
        for pattern, by in _MARKED:
            spaced = pc.replace_substring_regex(spaced, pattern, by)
        split = pc.split_pattern(spaced, _MARK)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("text", pa.binary()), ("units", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def split_blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a block of rows of (doc_id, text): its distinct units and how often each occurs; its documents, how many units each has, and all their units by number (<i4, zstandard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in grouped(batches, 1, block_bytes):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            kept: list[bool] = []
            for at in range(0, len(texts), 512):
                kept += pair(a_path, b_path).gives_back(texts.slice(at, 512).to_pylist())
            texts = pc.if_else(pa.array(kept, pa.bool_()), texts, pa.scalar("", pa.large_string()))
            sizes, flat, units = np.zeros(len(texts), np.int64), np.empty(0, np.int32), pa.array([], pa.large_string())
            if any(kept):
                found = stretches(texts)
                spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), found.words, pa.scalar(" ", pa.large_string()))
                units, own, lengths = cut_units(spaced)
                sizes[found.rows] = np.add.reduceat(lengths[found.place], found.starts)
                flat = _gathered(own, np.cumsum(lengths) - lengths, lengths, found.place)
                del found, spaced, own, lengths
            del texts
            text = zstandard.ZstdCompressor(level=1).compress(flat.astype("<i4").tobytes())
            once = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            counts = pa.array(np.bincount(flat, minlength=len(units)).astype(np.int64))
            out = pa.RecordBatch.from_arrays([pa.array([number]), once(batch.column(0)), once(pa.array(sizes.astype(np.int32))), pa.array([text], pa.binary()), once(units.cast(pa.string())), once(counts)], schema=_BLOCK)
            del batch, text, units, flat, counts
            yield out
            del out
            number += 1

    return docs.mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, text binary, units array<string>, counts array<long>")


def encode_units(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """unit, n and the ids of both tokenizers, as a and b, of distinct units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                a, b = pair(a_path, b_path).encode(some.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], names=["unit", "n", "a", "b"])
        release_memory()

    return units.mapInArrow(run, "unit string, n long, a array<int>, b array<int>")


def vocabulary(spark: SparkSession, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """code, length in bytes: A's ids, then B's from the number given on. As many rows as both vocabularies have entries."""
    own = pair(a_path, b_path)
    lengths = [*map(len, own.a_bytes), *map(len, own.b_bytes)]
    frame = spark.createDataFrame(pd.DataFrame({"code": np.arange(len(lengths), dtype=np.int32), "length": np.array(lengths, np.int32)}), "code int, length int")
    return frame, len(own.a_bytes)


def align_units(units: DataFrame, vocab: DataFrame, b_from: int, parts: int) -> DataFrame:
    """Each unit's groups and links: unit, n, n_a, n_b, n_groups, n_links, groups (their text), links (a, b).

    units: unit_id, unit, n, a, b. Both tokenizers' tokens come from one posexplode, after the only shuffle, by unit. A token
    starts at the windowed sum of the lengths before it. The equi-join of A's and B's starts, on unit and offset, is a full outer
    one, so it's written as a grouping: where both have a token, a group begins, and the running count of such rows is the group
    id. Each row of it is one link: the tokens that cover the bytes from there to the next start are the latest of either side.
    """
    rows = units.repartition(parts, "unit_id")
    of_b = F.col("pos") >= F.col("n_a")
    tokens = rows.select("unit_id", F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("pos", "id")).select("unit_id", of_b.alias("of_b"), "pos", "id", F.when(of_b, F.col("id") + b_from).otherwise(F.col("id")).alias("code"))
    before = W.partitionBy("unit_id", "of_b").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = tokens.join(F.broadcast(vocab), "code").withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    both = placed.groupBy("unit_id", "start").agg(F.max(F.when(~F.col("of_b"), F.col("id"))).alias("new_a"), F.max(F.when(F.col("of_b"), F.col("id"))).alias("new_b"))
    so_far = W.partitionBy("unit_id").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = F.col("new_a").isNotNull() & F.col("new_b").isNotNull()
    first = F.when(cut & (F.col("start") > 0), ";").when(cut, "").otherwise(",")
    links = both.select(
        "unit_id", "start", F.last("new_a", ignorenulls=True).over(so_far).alias("a"), F.last("new_b", ignorenulls=True).over(so_far).alias("b"), F.sum(cut.cast("int")).over(so_far).alias("group"),
        F.when(F.col("new_a").isNotNull(), F.concat(first, F.col("new_a").cast("string"))).alias("text_a"), F.when(F.col("new_b").isNotNull(), F.concat(first, F.col("new_b").cast("string"))).alias("text_b"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "a", "b", "text_a", "text_b")))
    found = links.groupBy("unit_id").agg(F.count("text_a").alias("n_a"), F.count("text_b").alias("n_b"), F.max("group").cast("long").alias("n_groups"), F.count("*").alias("n_links"), ordered.alias("l"))
    ids = lambda name: F.array_join(F.col("l")[name], "")  # noqa: E731  of one side: 1,2;3
    text = F.when(F.col("n_groups") == 1, F.concat(ids("text_a"), F.lit("|"), ids("text_b"))).otherwise(F.array_join(F.zip_with(F.split(ids("text_a"), ";"), F.split(ids("text_b"), ";"), lambda x, y: F.concat(x, F.lit("|"), y)), ";"))
    return rows.select("unit_id", "unit", "n").join(found, "unit_id").select("unit", "n", "n_a", "n_b", "n_groups", "n_links", text.alias("groups"), F.arrays_zip(F.col("l")["a"].alias("a"), F.col("l")["b"].alias("b")).alias("links"))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: What travels of a unit: all but n_links, which is n_a + n_b - n_groups, and the groups' text, as text of 14 signs in half a byte each.
_SENT, _SIGNS, _HALF, _PAD = ["n_a", "n_b", "n_groups", "n_best", "count_sum"], "0123456789,;| ", "0123456789abcd", "e"


def _packed() -> Column:
    text = F.translate(F.concat_ws(" ", *_SENT, "groups"), _SIGNS, _HALF)
    return F.unhex(F.when(F.length(text) % 2 == 1, F.concat(text, F.lit(_PAD))).otherwise(text))


def _unpacked(packed: pa.Array) -> pa.Array:
    """The texts of a binary column."""
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    halves = np.stack([raw >> 4, raw & 15], axis=1).ravel()
    kept = halves < len(_SIGNS)
    at = np.concatenate([[0], np.cumsum(kept)])[2 * np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64))])]
    signs = np.frombuffer(_SIGNS.encode(), np.uint8)[halves[kept]]
    return pa.Array.from_buffers(pa.large_string(), len(packed), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(signs.tobytes())])


def _assembled(blocks: pa.Table, units: pa.Table, with_groups: bool) -> pa.Table:
    """The documents of a block from its units: sums and joined texts. units: place, packed."""
    block = blocks.select(["doc_ids", "sizes", "text"]).combine_chunks().to_batches()[0]
    sizes = block.column(1).flatten().to_numpy().astype(np.int64)
    place = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column(2)[0].as_py()), "<i4")
    rows = np.empty(units.num_rows, np.int64)
    rows[units.column("place").to_numpy()] = np.arange(units.num_rows)
    fields = pc.split_pattern(_unpacked(units.column("packed").combine_chunks().take(pa.array(rows))), " ", max_splits=len(_SENT))
    each = {c: pc.list_element(fields, k).cast(pa.int64()).to_numpy() for k, c in enumerate(_SENT)} if len(rows) else dict.fromkeys(_SENT, np.zeros(0, np.int64))
    each["n_links"] = each["n_a"] + each["n_b"] - each["n_groups"]  # a link begins where a token of either side does
    some, starts = sizes > 0, np.cumsum(sizes) - sizes
    out = {"doc_id": block.column(0).flatten()}
    for c in _NUMBERS:
        total = np.zeros(len(sizes), np.int64)
        if some.any():
            total[some] = np.add.reduceat(each[c][place], starts[some])
        out[c] = pa.array(total)
    texts = pc.list_element(fields, len(_SENT)) if len(rows) else pa.array([], pa.large_string())
    del fields, each
    shas, groups = [], []
    for at in range(0, len(sizes), 1024):  # the texts of so many documents at once
        n = sizes[at : at + 1024]
        own = place[int(starts[at]) : int(starts[at]) + int(n.sum())]
        joined = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), texts.take(pa.array(own))), pa.scalar(";", pa.large_string())).to_pylist()
        shas += [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined]
        groups += joined if with_groups else []
    out["groups_sha256"] = pa.array(shas, pa.string())
    if with_groups:
        out["groups"] = pa.array(groups, pa.string())
    release_memory()
    return pa.table(out)


@dataclass
class Alignment:
    """Evaluated tables. units: unit, n (its places), n_a, n_b, n_groups, n_links, groups, links. pairs: a, b, n (links that hold the pair), best."""

    blocks: DataFrame
    units: DataFrame
    pairs: DataFrame

    def unit_scores(self) -> DataFrame:
        """unit, n_best, count_sum over one place's links."""
        links = self.units.select("unit", F.inline("links"))
        pairs = self.pairs.select("a", "b", F.col("n").alias("count"), F.col("best").cast("int").alias("best"))
        if pairs.limit(PAIRS_SENT + 1).count() <= PAIRS_SENT:
            pairs = F.broadcast(pairs)
        return links.join(pairs, ["a", "b"]).groupBy("unit").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))

    def documents(self, *, with_groups: bool = False) -> DataFrame:
        """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups: the groups' text too.

        The units of a block and its documents meet by block: numbers are summed, texts joined, at the units' places.
        """
        scored = written(self.units.drop("n", "links").join(self.unit_scores(), "unit").select("unit", _packed().alias("packed")), "scored")
        places = self.blocks.select(F.col("block").alias("of"), F.posexplode("units").alias("place", "unit"))
        of_block = places.join(scored, "unit").select("of", "place", "packed")

        def assemble(blocks: pa.Table, units: pa.Table) -> pa.Table:
            return _assembled(blocks, units, with_groups)

        schema = f"doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string" + (", groups string" if with_groups else "")
        return self.blocks.select("block", "doc_ids", "sizes", "text").groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(assemble, schema)


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Alignment:
    """Aligns the tokens of A over a space and the text with those of B over the text, which sets that space itself.

    Special tokens' strings are ordinary text. Null and empty texts, and those that B doesn't give back byte by byte, have no
    tokens: zeros and ''. Null and repeated ids are documents of their own, other columns are ignored, an empty table gives no
    rows. A word in a third of all rows is one unit; a block, of some `block_bytes` of texts or one longer text, bounds what a
    document is joined with; a run without any place to cut is one unit, whose tokens are sorted, not crossed.
    """
    spark = docs.sparkSession
    bounded_batches(spark, size=4 << 20)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # shuffles of written tables go with their jobs; the session keeps this
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(split_blocks(rows, a_path, b_path, block_bytes), "blocks")
    distinct = blocks.select(F.inline(F.arrays_zip("units", "counts"))).groupBy(F.col("units").alias("unit")).agg(F.sum("counts").alias("n"))
    encoded = written(encode_units(distinct, a_path, b_path).withColumn("unit_id", F.monotonically_increasing_id()), "units")
    vocab, b_from = vocabulary(spark, a_path, b_path)
    units = written(align_units(encoded, vocab, b_from, max(1, -(-encoded.count() // UNITS_PER_TASK))), "aligned")
    drop_written(encoded)
    counted = units.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Of one id of B there are at most as many pairs as A has ids.
    pairs = written(counted.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b"))), "pairs")
    return Alignment(blocks, units, pairs)


def align_documents(docs: DataFrame, a_path: str, b_path: str, **kwargs) -> DataFrame:
    done = align(docs, a_path, b_path, **kwargs)
    out = done.documents()
    drop_written(done.units)  # what documents need of it is in a table of its own
    return out
