"""Quality rules: plain counts of each text, and a hashed n-gram log-likelihood ratio of trusted to raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_sample, release_memory, word_hashes

#: n-grams of one and two tokens are hashed to so many buckets.
BUCKETS = 1 << 17
#: The trusted text, and the threshold, come from so many labelled documents of either kind at most.
LABELLED = 20_000
#: A clean document rejected weighs as much as so many poor ones kept.
REJECT_COST = 20.0
#: The threshold where labels don't give one: such a share of the mean log-likelihood is plainly another kind of text.
THRESHOLD = -0.1
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = word_hashes(words)
    x = np.zeros(n, np.uint64)
    for i in range(window):
        x = (x ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes know only ASCII white space
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def buckets_of(text: str | None, buckets: int) -> np.ndarray:
    """The buckets of all n-grams of a text's tokens: runs of letters and digits, runs of other signs."""
    h = word_hashes(_TOKEN.findall((text or "").lower()))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(31)
    return (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # of log-likelihoods, by bucket
    threshold: float

    def score(self, text: str | None) -> float:
        b = buckets_of(text, len(self.ratio))
        return float(self.ratio[b].mean(dtype=np.float64)) if len(b) else 0.0


def best_threshold(good: np.ndarray, bad: np.ndarray, cost: float = REJECT_COST) -> float:
    """Where documents below cost least: the middle of the widest gap between scores of the same, least cost."""
    if not len(good) or not len(bad):
        return THRESHOLD
    at = np.unique(np.concatenate([good, bad]))
    lost = cost * np.searchsorted(np.sort(good), at, side="left") / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), at, side="left") / len(bad)
    total = lost + kept
    best = np.flatnonzero(total <= total.min() + 1e-12)
    gaps = [(at[k] - at[k - 1] if k else 0.0, k) for k in best.tolist()]
    width, k = max(gaps, key=lambda g: (g[0], -g[1]))
    return float(at[k] - width / 2)


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Raw counts of all documents, trusted counts of one half of the labelled clean ones, the threshold by the other half.

    labels: doc_id, quality (1: good), toxic. Trusted are good and not toxic. Of more labelled documents than
    `labelled` of either kind, those with the least hashes serve, about. Labels without a document count nowhere.
    """
    bounded_batches(docs.sparkSession)
    role = F.when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 0, F.lit("good"))).when(F.col("quality") == 0, F.lit("bad"))
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), role.alias("role")).where("role IS NOT NULL AND l_id IS NOT NULL").groupBy("l_id").agg(F.min("role").alias("role"))  # bad < good
    some = [hashed_sample(known.where(F.col("role") == r), labelled, "l_id") for r in ("good", "bad")]
    half = F.pmod(F.crc32(F.col("l_id").cast("string")), F.lit(2)) == 0
    some = some[0].union(some[1]).withColumn("trusted", (F.col("role") == "good") & half)
    some = docs.sparkSession.createDataFrame(some.collect(), some.schema)  # 2 * labelled rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                b = buckets_of(text.as_py(), buckets)
                np.add.at(raw, b, 1)
                if good:
                    np.add.at(trusted, b, 1)
        release_memory(others=True)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], trusted[at])], names=["bucket", "raw", "trusted"])

    marked = texts.join(F.broadcast(some.where("trusted").select("l_id", "trusted")), F.col("doc_id") == F.col("l_id"), "left")
    sums = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("good")).mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).toPandas().to_numpy()  # a row a bucket at most
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    if len(sums):
        raw[sums[:, 0]], trusted[sums[:, 0]] = sums[:, 1], sums[:, 2]
    if not trusted.sum():
        return Model(np.zeros(buckets, np.float32), -np.inf)
    ratio = np.log((trusted + 1) / (trusted.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    model = Model(ratio.astype(np.float32), -np.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["role", "score"])
        release_memory(others=True)

    held = some.where("NOT trusted").select("l_id", "role")
    got = texts.join(F.broadcast(held), F.col("doc_id") == F.col("l_id")).select("role", "text").mapInArrow(score, "role string, score double").toPandas()
    return Model(model.ratio, best_threshold(*(got.loc[got["role"] == r, "score"].to_numpy() for r in ("good", "bad"))))


def judge(docs: DataFrame, labels: DataFrame, *, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **kwargs) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept, and the columns named in keep.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows of 8. score: the mean
    over all n-grams of the log of their trusted to raw probability, 0 for a text without tokens. kept: not
    base_failed, and score at least the threshold that fit() found; without trusted text, every score will do.

    A null or empty text has no words and fails. Null ids and repeated rows are judged like others. Empty
    tables give no rows. Columns not named are ignored; those in keep keep their names.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **kwargs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                text = text.as_py()
                counts = base_counts(text)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                score = model.score(text)
                for c, v in zip(cols, (*counts, failed, score, not failed and score >= model.threshold)):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types)), *batch.columns[2:]], names=[*names, *(f"keep_{i}" for i in range(len(keep)))])
        release_memory(others=True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    extra = "".join(f", keep_{i} {rows.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = rows.mapInArrow(run, f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean{extra}")
    return out if not keep else out.select(*names, *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def keep_good(docs: DataFrame, labels: DataFrame, **kwargs) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs."""
    aliased = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    got = judge(aliased, labels, id_col=at[kwargs.pop("id_col", "doc_id")], text_col=at[kwargs.pop("text_col", "text")], keep=tuple(aliased.columns), **kwargs)
    return got.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
