"""Token counts of whole texts, without their ids: Arrow batches balanced by bytes, long texts split where no tokenizer joins."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder, grouped, stretches

#: Bytes that are encoded at once, and bytes of a text beyond which it is split at the next safe boundary.
BATCH_BYTES, PIECE_BYTES = 4 << 20, 256 << 10
#: Distinct stretches whose counts a worker keeps.
KEPT_STRETCHES = 500_000
#: A lone space: every tokenizer here begins a token at it. Python's white space holds all that they take for it.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


class PieceCounter:
    """Counts by a sentencepiece model that starts each text with a space of its own and has no piece with a space after another character.

    So what stands between lone spaces is encoded by itself, once for each distinct stretch.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        self.apart = not any("\u2581" in p.lstrip("\u2581") for p in pieces) and self._splits("a b") and self._splits("1 ,")
        self.known: dict[str, int] = {}

    def _splits(self, text: str) -> bool:
        return self.model.encode(text) == [i for part in text.split(" ") for i in self.model.encode(part)]

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count_column(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        counts = np.zeros(len(texts), np.int64)
        # A space sign in the text itself joins with spaces: those texts are encoded whole.
        whole = pc.match_substring(texts, "\u2581").to_numpy(zero_copy_only=False) | (not self.apart)
        if whole.any():
            counts[whole] = self._counts(texts.filter(pa.array(whole)).to_pylist())
            texts = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        if pc.any(pc.not_equal(texts, "")).as_py():
            found = stretches(texts)
            words = found.words.to_pylist()
            if len(self.known) + len(words) > KEPT_STRETCHES:
                self.known.clear()
            new = [w for w in words if w not in self.known]
            self.known.update(zip(new, self._counts(new)))
            each = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            counts[found.rows] = np.add.reduceat(each[found.place], found.starts)
        return counts


@functools.lru_cache(maxsize=1)
def counter(path: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(path)


def split_text(text: str, most: int = PIECE_BYTES) -> list[str]:
    """Pieces of some `most` characters each, cut before lone spaces alone; a run without one stays whole."""
    out, at = [], 0
    while len(text) - at > most and (found := _BOUNDARY.search(text, at + most)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def balanced(sizes: np.ndarray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Runs of rows of about equal bytes, each of some `most` or less, save for single rows that are larger."""
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // most)) if len(sizes) else 0
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1, n) * (ends[-1] / n)) + 1, [len(sizes)]])).astype(int) if n else []
    return list(zip(cuts[:-1], cuts[1:]))


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens), of whole texts.

    tokenizer: a file of the tokenizers library (.json) or of sentencepiece (.model), without begin, end or added special
    tokens; special strings in a text are handled as the library does by default. A null or empty text has 0 of each.
    Null and repeated ids are rows of their own, an empty table gives none, other columns are ignored. Nothing is shuffled:
    a task holds a few batches of its own texts, so neither many rows of one id nor a very long text changes the plan. A long
    text without any lone space is encoded whole.
    """
    bounded_batches(docs.sparkSession)
    pieces = tokenizer.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer) if pieces else encoder(tokenizer)
        for batch in grouped(batches, 2):
            texts = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            sizes, owner = pc.binary_length(texts).to_numpy(zero_copy_only=False), np.arange(len(texts))
            if (sizes > PIECE_BYTES).any():
                # sentencepiece sets a space before each text itself, the others keep it at the start of the next piece.
                split = [[t.as_py()] if n <= PIECE_BYTES or (pieces and (not own.apart or "\u2581" in t.as_py())) else split_text(t.as_py()) for t, n in zip(texts, sizes.tolist())]
                owner = np.repeat(owner, [len(x) for x in split])
                texts = pa.array([p[1:] if pieces and k else p for x in split for k, p in enumerate(x)], pa.large_string())
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            found = np.zeros(len(batch.column(0)), np.int64)
            for a, b in balanced(sizes):
                np.add.at(found, owner[a:b], own.count_column(texts.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
