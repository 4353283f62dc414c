"""Near-duplicate texts by SetSketch registers (Ertl 2021): band, estimate jointly by likelihood, verify on full sets."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_words, drop_written, release_memory, word_hashes, written
from .components import connected_components

#: Registers hold floor(1 - log_BASE of the least of n exponential variables of rate RATE), cut to 0..LIMIT.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 1
#: A pair of similarity 0.8 misses all of 24 bands of 4 registers once in 300,000 times.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: A candidate whose estimate is so far below the threshold (3.7 standard deviations) isn't verified.
MARGIN = 0.15
#: What one task compares at most: rows of a bucket, and shingles of these.
BUCKET_ROWS, BUCKET_SHINGLES = 4096, 4_000_000
#: Rows of larger buckets are dealt by so many further bands each, so many times in a row.
FURTHER, TURNS = 7, 3
#: Members by which a set of 32-bit hashes may differ from the full set, as members that share a hash are one.
SLACK = 2
#: Bits of a row's bitmap, by which pairs that can't be similar are told without loss.
BITS = 4096


@functools.cache
def _multipliers(n: int = REGISTERS) -> np.ndarray:
    return np.random.default_rng(1).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of the shingles of k words; of fewer words, one of all of them."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(k, len(words))
    x = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - width + 1 + i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.unique(x)


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def registers(x: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes. That of a union is the maximum of the sketches."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[at : at + 4096][None, :] * _multipliers()[:, None]).min(axis=1))
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, LIMIT).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs, from which registers are greater, less or equal and the sets' sizes."""
    more, less = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE)
    slope = lambda x: c / (1 - np.clip(x, 0, 1) * c) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in the similarity
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py = np.maximum(p(x), 1e-12), np.maximum(p(y), 1e-12)
        rise = -more * v * slope(x) / px - less * u * slope(y) / py + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - px - py, 1e-12)
        low, high = np.where(rise > 0, j, low), np.where(rise > 0, high, j)
    return (low + high) / 2


def similar(x: set, y: set, percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0


def sketch(docs: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), sig (registers, little-endian 16 bits each)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(1):
                x = shingle_hashes(byte_words(text.as_py()), k)
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sig.append(registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])
        release_memory(others=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose joint estimate isn't below least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3)]
                size = [batch.column(i).to_numpy().astype(float) for i in (4, 5)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(joint_estimate(*sig, *size) >= least)) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[str, set] = ("", set())
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):  # one pair at a time: texts can be long
                y = y.as_py()
                if y != kept[0]:  # a hub's pairs stand together
                    kept = (y, shingle_set(byte_words(y), k))
                near.append(similar(shingle_set(byte_words(x.as_py()), k), kept[1], percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])
        release_memory(others=True)

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _hash_sets(texts: DataFrame, k: int) -> DataFrame:
    """rep, hashes: sets of 32-bit hashes, which travel with each bucket. What they find, full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_hashes(byte_words(t.as_py()), k) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "hashes"])
        release_memory(others=True)

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, hashes binary")


def links_among(labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of similar sets that connect all that links connect, of rows whose labels tell what is connected already, and pairs that miss similarity by SLACK members.

    Of two rows with unequal labels one isn't of the commonest label: only such rows look at all others. Two
    sets' bitmaps differ in no more bits than the sets do in members, so no similar pair is passed over.
    """
    names, label, count = np.unique(labels, return_inverse=True, return_counts=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(x) for x in sets], np.int64)
    bits = np.empty((len(sets), BITS // 64), np.uint64)
    for i, x in enumerate(sets):
        row = np.zeros(BITS, bool)
        row[(x % BITS).astype(np.int64)] = True
        bits[i] = np.packbits(row).view(np.uint64)
    common = int(count.argmax())
    order = np.argsort(size, kind="stable")  # rows of like size, which alone can be similar, stand together
    size, label, bits = size[order], label[order], bits[order]
    low = np.searchsorted(100 * (size + SLACK), percent * size, side="left")
    high = np.searchsorted(percent * size, 100 * (size + SLACK), side="right")
    out = []
    for i in np.flatnonzero(label != common).tolist():
        j = np.arange(low[i], high[i])
        j = j[(label[j] != label[i]) & ((label[j] == common) | (j > i))]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for m in j[(100 + percent) * (apart - 2 * SLACK) <= (100 - percent) * (size[j] + size[i])].tolist():
            p, q = root(int(label[i])), root(int(label[m]))
            if p != q:
                x, y = sets[order[i]], sets[order[m]]
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                rest = len(x) + len(y) - shared
                if 100 * shared >= percent * rest:
                    parent[max(p, q)] = min(p, q)
                if 100 * (shared + SLACK) >= percent * (rest - SLACK):
                    out.append((int(order[i]), int(order[m])))
    return out


def _dealt(rows: DataFrame, sigs: DataFrame, most_rows: int, most_shingles: int) -> DataFrame:
    """task, rep, label: the rows (key, band, rep, label, n) of open buckets, those with several labels, dealt to tasks of bounded size.

    A bucket that fits is a task. Rows of larger ones are dealt by FURTHER more bands, a few times if need be, as two
    that are similar share another band. What is too large then is dealt in parts so that rows of unequal labels still
    meet: parts of all that don't have the commonest label meet one another and all parts of that label.
    """
    done = None
    for turn in range(TURNS + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "m", "w")
        rows = written(rows.join(sizes, "key"), "open")
        fits = (F.col("m") <= most_rows) & (F.col("w") <= most_shingles)
        own = rows.where(fits).select(F.col("key").alias("task"), "rep", "label")
        done = own if done is None else done.unionByName(own)
        rows = rows.where(~fits)
        if rows.isEmpty():
            return done
        if turn < TURNS:
            turned = rows.drop("m", "w").join(sigs.hint("merge"), "rep").withColumn("further", F.explode(F.sequence(F.lit(1), F.lit(FURTHER))))
            turned = turned.withColumn("band", F.pmod(F.col("band") + F.col("further"), F.lit(BANDS)))
            registers_of = F.expr(f"substring(sig, {2 * ROWS} * band + 1, {2 * ROWS})")
            rows = turned.select(F.xxhash64("key", "further", registers_of).alias("key"), "band", "rep", "label", "n")
    common = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("common"))
    rows = rows.join(common, "key").withColumn("few", F.col("label") != F.col("common"))
    parts = lambda c: F.ceil(F.greatest(F.count_if(c) * 2.0 / most_rows, F.sum(F.when(c, F.col("n")).otherwise(0)) * 2.0 / most_shingles)).cast("int")
    counts = rows.groupBy("key").agg(parts(F.col("few")).alias("f"), parts(~F.col("few")).alias("c"))
    rows = rows.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("few"), F.col("f")).otherwise(F.col("c"))).cast("int"))
    few, rest = rows.where("few"), rows.where("NOT few")
    crossed = few.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(F.xxhash64("key", F.lit(0), "own", "other").alias("task"), "rep", "label")
    crossed = crossed.unionByName(rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("f") - 1))).select(F.xxhash64("key", F.lit(0), "other", "own").alias("task"), "rep", "label"))
    within = few.where("f > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("f") - 1))).select(F.xxhash64("key", F.lit(1), F.least("own", "other"), F.greatest("own", "other")).alias("task"), "rep", "label")
    return done.unionByName(crossed).unionByName(within)


def _compared(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the rows of each task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy()
        found = links_among(pdf["label"].to_numpy(), [np.frombuffer(x, "<u4") for x in pdf["hashes"]], percent)
        return pd.DataFrame({"a": rep[[i for i, _ in found]], "b": rep[[j for _, j in found]]}).astype("int64")

    return tasks.join(sets.hint("merge"), "rep").groupBy("task").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a document's set holds its distinct shingles of k words, or all its words
    as one if they are fewer. Documents with 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id that links reach, kept whether it is the document's own.

    Documents of equal sets are one class from the start. Classes that share a band of registers are a bucket.
    First each bucket's members meet its hub, the member with most company in all its buckets, by the joint
    estimate and then by their full sets. Then the rows of each bucket that still holds several components are
    compared by sets of hashes, in tasks of bucket_rows rows and bucket_shingles shingles at most, which give only
    links that connect something; full sets confirm those too. So a similar pair is missed only if it shares no
    band, once in 300,000 times at a similarity of 0.8 and less above, and nothing grows with the square of a
    group but the comparisons of rows that its hub doesn't connect.

    Null and empty texts, or texts without words, have n_shingles 0 and link with nothing. A row with a null
    id links with nothing: component_id is null and kept true. Rows that share an id are one document with
    several texts: they share a component. An empty table gives no rows. Other columns are ignored.
    """
    least, made = max(0.0, percent / 100 - MARGIN), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    all_rows = written(sketch(docs, k, id_col=id_col, text_col=text_col), "sketches")
    same = kept(all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    classes = same.select("rep", "n_shingles", "sig")
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])).alias("band", "key")
    bands = classes.select("rep", F.col("n_shingles").alias("size"), band)
    shared = kept(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = kept(bands.join(shared, "key"), "members")
    company = kept(members.groupBy("rep").agg(F.sum("n").alias("company")), "company")
    hubs = kept(members.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("hub")), "hubs")
    to_hub = members.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    asked = kept(_likely(to_hub, classes, least), "asked")
    # The texts of all members of buckets, once: no others are asked for.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = kept(texts.join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    links = kept(_verified(asked, texts, k, percent), "verified")
    parts = kept(connected_components(links), "components")

    now = members.select("key", "band", "rep", F.col("size").alias("n")).join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    tasks = _dealt(now.select("key", "band", "rep", F.coalesce("component", "rep").alias("label"), "n"), classes.select("rep", "sig"), bucket_rows, bucket_shingles)
    if not tasks.isEmpty():
        own = texts.join(tasks.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
        again = kept(_compared(tasks, kept(_hash_sets(own, k), "sets"), percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "asked")
        more = kept(_verified(again, texts, k, percent), "verified")
        if not more.isEmpty():
            # components so far stand for their links
            links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(more)
            parts = kept(connected_components(links), "components")

    whole = written(same.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "classes")
    for done in made:  # what follows doesn't read them
        drop_written(done)
    out = all_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(whole, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out._tidegrid_tables = [all_rows, whole]  # read when out is evaluated
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """docs with one document of each component: that of the smallest id. Of rows that share an id, one stays."""
    result = near_duplicates(docs, id_col=id_col, **kwargs)
    found = written(result, "duplicates")
    for done in result._tidegrid_tables:
        drop_written(done)
    out = docs.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), F.col(id_col).cast("long") == F.col("gone"), "left_anti")
    ids = found.where("doc_id IS NOT NULL")
    if ids.count() > ids.select("doc_id").distinct().count():
        # one of the rows of each repeated id; rows without an id all stay
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(out.where(F.col(id_col).isNull()))
    return out
