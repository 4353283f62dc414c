"""Best-fit packing of token sequences by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, written
from .tokens import encoder, grouped

#: Pieces that one instance of the packing problem has, about. An instance is what all its islands solve.
BLOCK_ITEMS = 4000
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 12, 2, 60
#: On the first island a mutation dissolves fewer than so many of the worst-filled bins, and of others; on the next ones, a multiple.
DISSOLVED = 10
#: Islands that one task evolves.
ROWS_PER_TASK = 4
#: Rows, and bytes of texts, that are encoded at once: twice as many take half as much memory again, and hardly less time.
GROUP_ROWS, GROUP_BYTES = 500, 2 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of n ids: all but the first are full."""
    k = max(1, -(-n // capacity))
    first = n - capacity * (k - 1)
    yield 0, 0, first
    for i in range(1, k):
        yield i, first + capacity * (i - 1), capacity


def bin_fills(of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each bin holds. A packing is the bin of each item; items are in falling order of size."""
    return np.bincount(of, weights=sizes).astype(np.int64)


def _renumbered(of: np.ndarray) -> np.ndarray:
    """The same packing with bins numbered from 0, without gaps."""
    return (np.cumsum(np.bincount(of) > 0) - 1)[of]


def best_fit(items: np.ndarray, sizes: np.ndarray, fills: np.ndarray, capacity: int) -> list[int]:
    """The bins of items, in the order given, dealt to bins of such fills: each to the least room that is enough, or to a new bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n, out = 0, len(fills), []  # a bit for each room that a bin has
    for k, room in enumerate((capacity - fills).tolist()):
        if room:
            by_room[room].append(k)
            mask |= 1 << room
    for size in sizes[items].tolist():
        able = mask >> size
        if able:
            room = (able & -able).bit_length() - 1 + size
            k = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, k, n = capacity, n, n + 1
        out.append(k)
        if room > size:
            by_room[room - size].append(k)
            mask |= 1 << (room - size)
    return out


def fitness(of: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Falkenauer's: the mean of squared fills, which rates few, full bins highest."""
    return float(((bin_fills(of, sizes) / capacity) ** 2).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of a go whole into b; b's bins that held any of their items are dissolved, and what they displace is dealt by best fit."""
    fills = bin_fills(a, sizes)
    chosen, hit = np.zeros(len(fills), bool), np.zeros(int(b.max()) + 1, bool)
    chosen[np.argsort(-fills + rng.random(len(fills)) * (1 + capacity // 64), kind="stable")[: max(1, int(len(fills) * rng.uniform(0.1, 0.9)))]] = True
    taken = chosen[a]
    hit[b[taken]] = True
    stay = ~taken & ~hit[b]
    child = np.where(taken, a, len(fills) + b)
    settled = taken | stay
    child[settled] = _renumbered(child[settled])
    loose = np.flatnonzero(~settled)
    child[loose] = best_fit(loose, sizes, bin_fills(child[settled], sizes[settled]), capacity)
    return child


def fullest(items: list[int], sizes: np.ndarray, room: int) -> list[int]:
    """Of the items, in falling order of size, some that fill the room as far as any do; large ones rather than small ones."""
    reach, seen, mask = 1, [], (1 << (room + 1)) - 1
    own = sizes[items].tolist()
    for size in own:
        seen.append(reach)  # sums that the items before this one reach, a bit each
        reach |= reach << size & mask
        if reach >> room:
            break
    left, out = reach.bit_length() - 1, []
    for k in range(len(seen) - 1, -1, -1):
        if not seen[k] >> left & 1:
            out.append(items[k])
            left -= own[k]
    return out


def mutate(of: np.ndarray, sizes: np.ndarray, capacity: int, dissolved: int, rng: np.random.Generator) -> np.ndarray:
    """Fewer than `dissolved` of the worst-filled bins, and of others, are emptied. Each new bin takes the largest item left and fills up as far as the others allow."""
    fills = bin_fills(of, sizes)
    gone = np.zeros(len(fills), bool)
    gone[np.argsort(fills, kind="stable")[: int(rng.integers(2, dissolved))]] = True
    gone[rng.integers(0, len(fills), int(rng.integers(1, dissolved)))] = True
    loose = gone[of]
    child, n = of.copy(), len(fills)
    left = np.flatnonzero(loose).tolist()
    while left:
        own = [left[0], *fullest(left[1:], sizes, capacity - int(sizes[left[0]]))]
        child[own] = n
        n += 1
        some = set(own)
        left = [i for i in left if i not in some]
    return _renumbered(child)


def seeds(sizes: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """First best fit in falling order, then of orders that chance has loosened."""
    out = []
    for k in range(n):
        order = np.argsort(-(sizes + rng.random(len(sizes)) * (capacity * 0.04 * k)), kind="stable")
        of = np.empty(len(sizes), np.int64)
        of[order] = best_fit(order, sizes, np.empty(0, np.int64), capacity)
        out.append(of)
        if of.max() + 1 == -(-int(sizes.sum()) // capacity):  # as few as can be
            break
    return out


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, generations: int, rng: np.random.Generator, *, most: int = POPULATION, dissolved: int = DISSOLVED) -> list[np.ndarray]:
    """Best first. Ends early once a member has as few bins as the sum of sizes needs."""
    least = -(-int(sizes.sum()) // capacity)
    rank = lambda of: (int(of.max()) + 1, -fitness(of, sizes, capacity))
    scored = sorted(((rank(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    count = len(scored)
    for _ in range(generations):
        if scored[0][0][0] <= least or len(sizes) < 2:
            break
        pick = lambda: scored[min(rng.integers(0, len(scored), 2))][2]  # noqa: E731  a tournament of two
        child = crossover(pick(), pick(), sizes, capacity, rng)
        for child in (child, mutate(child, sizes, capacity, dissolved, rng), mutate(pick(), sizes, capacity, dissolved, rng)):
            scored.append((rank(child), count, child))
            count += 1
        ranked = sorted(scored, key=lambda x: x[:2])
        scored = [x for k, x in enumerate(ranked) if not k or x[0] != ranked[k - 1][0]][:most]  # equals don't crowd others out
    return [p for _, _, p in scored]


def _island(capacity: int, generations: int, seed: int):
    """Evolves each row: an island with the sizes of its block and the elites that came to it. Islands differ in seeds and in how much a mutation dissolves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(others=True)  # documents have been cut: no tokenizer is asked any more
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                rng = np.random.default_rng([seed, row["block"], row["island"], row["epoch"]])
                population = [np.array(x, np.int64) for x in row["members"]] or seeds(sizes, capacity, POPULATION, rng)
                best = evolve(population, sizes, capacity, generations, rng, dissolved=DISSOLVED * (1 + row["island"]))
                out = {"block": [row["block"]], "island": [row["island"]], "epoch": [row["epoch"] + 1], "sizes": [row["sizes"]], "members": [[p.tolist() for p in best]], "n_bins": [int(best[0].max()) + 1], "fit": [fitness(best[0], sizes, capacity)]}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("island", pa.int64()), ("epoch", pa.int64()), ("sizes", pa.list_(pa.int32())), ("members", pa.list_(pa.list_(pa.int32()))), ("n_bins", pa.int64()), ("fit", pa.float64())]))

    return run


_ISLAND = "block long, island long, epoch long, sizes array<int>, members array<array<int>>, n_bins long, fit double"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, evaluated: doc_id, piece, start, length, ids_crc32, deal (a number of its own)."""
    bounded_batches(docs.sparkSession, GROUP_ROWS)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in grouped(batches, 1, GROUP_BYTES):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            flat, counts = encoder(tokenizer).encode_column(batch.column(1))
            raw, at = memoryview(flat).cast("B"), 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                for piece, start, length in cut(n + 1, capacity):
                    crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(start + length, n))])
                    crc = zlib.crc32(end, crc) if start + length > n else crc
                    for c, v in zip(cols, (doc, piece, start, length, crc, number)):
                        c.append(v)
                    number += 1
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int, *, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, seed: int = 7) -> DataFrame:
    """pieces, of at most capacity each, with sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt at random to blocks of about block_items,
    each an instance of bin packing. All islands of a block evolve a population of its packings; after each
    epoch the best of an island goes to the next one in the ring. The best of all islands is the block's
    packing. Blocks only bound what a task holds: each leaves about half a sequence unfilled.
    """
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("deal"), "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-part.count() // block_items))
    # Within a block, pieces of one length are alike: deal gives them an order.
    part = part.withColumn("block", F.pmod(F.xxhash64("deal"), F.lit(blocks)))
    sizes = part.groupBy("block").agg(F.reverse(F.array_sort(F.collect_list(F.col("length").cast("int")))).alias("sizes"))
    state = sizes.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"), F.lit(0).cast("long").alias("epoch"), "sizes", F.array().cast("array<array<int>>").alias("members"))
    for epoch in range(epochs):
        # A row is much work in few bytes: the number of tasks is given, else Spark would merge them.
        state = written(state.repartition(max(1, min(20_000, -(-blocks * islands // ROWS_PER_TASK)))).mapInArrow(_island(capacity, generations, seed), _ISLAND), "islands")
        if epoch + 1 < epochs and islands > 1:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("members", 1, 1).alias("guest"))
            state = state.join(elite, ["block", "island"]).select("block", "island", "epoch", "sizes", F.concat("guest", "members").alias("members"))
    best = state.groupBy("block").agg(F.min_by(F.element_at("members", 1), F.struct("n_bins", -F.col("fit"), "island")).alias("of"))

    def place(key, own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "deal"], ascending=[False, True], kind="stable")
        bins = np.asarray(of["of"].iloc[0], dtype=np.int64)
        own["sequence_id"] = (int(key[0]) << 32) + bins
        own["offset"] = own.groupby("sequence_id")["length"].cumsum() - own["length"]
        return own[["doc_id", "piece", "start", "length", "ids_crc32", "deal", "sequence_id", "offset"]]

    placed = part.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, f"{_PIECES}, sequence_id long, offset long")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """All documents in sequences of at most capacity ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated ids are documents of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    pieces = cut_documents(docs, tokenizer, end_id, capacity, id_col=id_col, text_col=text_col)
    return pack(pieces, capacity, **kwargs).drop("deal")
