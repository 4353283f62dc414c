"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words of the head, and one class of all others, are the leaves of a tree in which the more frequent ones stand
nearer the root: so a word's path is its class, the groups in the class, its place in the last one. Each inner node
is a softmax over WIDTH outcomes. Its weights are rows of a hashed table, one row for each n-gram or skip feature
of the words before, given the node. A word beyond the head has its count's share of the last class. So the
probabilities of all words, with one unknown, sum to one.

Biases are logarithms of counts. The rows are trained by distributed gradient updates: each task goes over its
documents from the same model by AdaGrad, and the tasks' changes of a row are averaged by how often each saw it,
in whole numbers, so that their order doesn't matter. A round goes over the documents in slices, whose number
grows with the tokens: each starts from the one before.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column_words, written
from .tokens import grouped

WIDTH = 20
#: Rows of the table at least, a power of two; there are twice as many as words with a path.
ROWS = 1 << 16
#: Words whose counts go to every task at most; the counts of others are joined.
HEAD = 1 << 18
#: A training task gets about so many tokens; changes are sent once a task.
TASK_TOKENS = 3_000_000
RATE, CHUNK, ROUNDS = 0.35, 8192, 1
#: Neighbouring rows of the table whose changes travel as one record: most rows change in each task.
BLOCK = 64
#: Changes are summed as whole multiples of this.
STEP = 2.0**-20
#: The end of a document, as a token: no word holds a space.
END = " "


_heads: dict[str, tuple[pa.Array, int]] = {}


@dataclass
class Model:
    key: str
    head: object  # a broadcast of the frequent words, most frequent first, as an Arrow column
    n_head: int
    least: int  # of the head's counts
    log_counts: np.ndarray  # of the head: log10(count + 0.5)
    total: int  # tokens of training documents, N
    distinct: int  # of them, V
    complete: bool  # the head holds all of them
    n_model: int  # the first so many of the head have a path
    rare_total: int
    nodes: np.ndarray  # of each word's path, and of the others' last: inner nodes, -1 after the end
    digits: np.ndarray  # the outcome at each
    bias: np.ndarray  # by node
    table: np.ndarray  # the weights

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def rare_norm(self) -> float:
        return float(np.log10(self.rare_total + 0.5 * (self.distinct - self.n_model + 1)))

    def _head(self) -> tuple[pa.Array, int]:
        """Words of the head, and where the end is among them (-1: nowhere); kept for each Python worker."""
        if self.key not in _heads:
            _heads.clear()
            words = self.head.value
            _heads[self.key] = words, pc.index(words, END).as_py()
        return _heads[self.key]

    @property
    def end_place(self) -> int:
        return self._head()[1]

    def places(self, words: pa.Array) -> np.ndarray:
        """Where words stand in the head, -1 elsewhere."""
        return pc.fill_null(pc.index_in(words, value_set=self._head()[0]), -1).to_numpy().astype(np.int64)


def tree(mass: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and digits of the paths to leaves of such mass, and the mass of each node's outcomes: Huffman's tree, node 0 the root."""
    n = len(mass)
    heap = [(float(m), i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    parent, digit, children = {}, {}, []
    take = (n - 2) % (width - 1) + 2 if n > 1 else 1  # the first node has fewer outcomes, all others width
    while len(heap) > 1 or not children:
        some = [heapq.heappop(heap) for _ in range(take)]
        k = n + len(children)
        for d, (_, i) in enumerate(some):
            parent[i], digit[i] = k, d
        children.append([m for m, _ in some])
        heapq.heappush(heap, (sum(m for m, _ in some), k))
        take = width
    count = len(children)  # the last one made is the root
    up = np.fromiter((parent.get(i, -1) for i in range(n + count)), np.int64, n + count)
    own = np.fromiter((digit.get(i, 0) for i in range(n + count)), np.int8, n + count)
    at, steps = np.arange(n), []
    while (at >= 0).any():
        steps.append((np.where(at >= 0, up[at], -1), np.where(at >= 0, own[at], 0)))
        at = np.where(at >= 0, up[at], -1)
    steps = [x for x in steps if (x[0] >= 0).any()]
    depth = np.sum([x[0] >= 0 for x in steps], axis=0)
    nodes, digits = np.full((n, len(steps)), -1, np.int32), np.zeros((n, len(steps)), np.int8)
    for k, (node, d) in enumerate(steps):  # from the leaf up
        some = np.flatnonzero(node >= 0)
        nodes[some, depth[some] - 1 - k] = n + count - 1 - node[some]
        digits[some, depth[some] - 1 - k] = d[some]
    outcomes = np.zeros((count, width))
    for k, c in enumerate(children):
        outcomes[count - 1 - k, : len(c)] = c
    return nodes, digits, outcomes


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def contexts(p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features: the word before, the one before that (a skip), both together."""
    a, b = _spread(p1, 1), _spread(p2, 2)
    return [a, b, (a ^ (b >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)]


def feature_rows(model: Model, level: int, node: np.ndarray, hashed: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the table, given the node: at the root for all features, one level down for single words, below for the word before."""
    own = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - (len(model.table) - 1).bit_length())
    return [(((h + own) ^ (own >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> shift).astype(np.int64) for h in hashed[: max(1, 3 - level)]]


def slices_of(tokens: int, task_tokens: int = TASK_TOKENS) -> tuple[int, int]:
    """Slices of a round, and tasks of a slice: both grow with the root of the tokens."""
    tasks = max(1, -(-tokens // task_tokens))
    slices = math.isqrt(tasks - 1) + 1
    return slices, -(-tasks // slices)


def _whole(table: np.ndarray) -> np.ndarray:
    """A table's rows as one item each, which are written faster than their numbers are."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1])))[:, 0]


class _Buffers:
    """Room for the numbers of a chunk, used again and again: to ask the system for it each time costs more than the sums."""

    def __init__(self, rows: int = CHUNK) -> None:
        self.z, self.more, self.sums = (np.empty((rows, WIDTH), np.float32) for _ in range(3))
        self.place, self.ones = np.arange(rows), np.ones(WIDTH, np.float32)

    def logits(self, model: Model, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z, more = self.z[: len(node)], self.more[: len(node)]
        np.take(model.bias, node, axis=0, out=z, mode="clip")
        for r in rows:
            z += np.take(model.table, r, axis=0, out=more, mode="clip")
        return z


def _context(ids: np.ndarray, starts: np.ndarray, n_model: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each, as places; rare words and the outside of a document have ones of their own."""
    known = np.where((ids < 0) | (ids >= n_model), n_model, ids)
    p1, p2 = np.full(len(ids), n_model + 1), np.full(len(ids), n_model + 1)
    p1[1:], p2[2:] = known[:-1], known[:-2]
    p1[starts] = n_model + 1
    p2[starts] = n_model + 1
    second = starts[starts + 1 < len(ids)] + 1
    p2[second] = n_model + 1
    return p1, p2


def log_probabilities(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each token's path; a rare word's share of its class isn't in it."""
    p1, p2 = _context(ids, starts, model.n_model)
    leaf = np.where((ids < 0) | (ids >= model.n_model), model.n_model, ids)
    out, room = np.zeros(len(ids), np.float64), _Buffers()
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        where, own, hashed = np.arange(at, at + len(leaf[part])), leaf[part], contexts(p1[part], p2[part])
        for k in range(model.nodes.shape[1]):
            node = model.nodes[own, k]
            go = np.flatnonzero(node >= 0)
            if not len(go):
                break
            if len(go) < len(node):
                where, own, node, hashed = where[go], own[go], node[go], [h[go] for h in hashed]
            z = room.logits(model, node, feature_rows(model, k, node, hashed))
            own_z = z[room.place[: len(z)], model.digits[own, k]]
            # Logits are small, as biases are logarithms of shares: no need to take the greatest away.
            out[where] += own_z - np.log(np.exp(z, out=z) @ room.ones)
    return out / np.log(10)


class Trainer:
    """Gradient updates of a copy of the table."""

    def __init__(self, model: Model, rate: float = RATE) -> None:
        self.model, self.rate, self.start = model, rate, model.table
        self.model.table = self.start.astype(np.float32)
        self.squares = np.full(len(model.table), 1e-2, np.float32)
        self.seen = np.zeros(len(model.table), np.int64)
        self.room = _Buffers()

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        m = self.model
        room = self.room
        p1, p2 = _context(ids, starts, m.n_model)
        leaf = np.where((ids < 0) | (ids >= m.n_model), m.n_model, ids)
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            own, hashed = leaf[part], contexts(p1[part], p2[part])
            for k in range(m.nodes.shape[1]):
                node = m.nodes[own, k]
                go = np.flatnonzero(node >= 0)
                if not len(go):
                    break
                if len(go) < len(node):
                    own, node, hashed = own[go], node[go], [h[go] for h in hashed]
                rows = feature_rows(m, k, node, hashed)
                e = room.logits(m, node, rows)
                np.exp(e, out=e)
                e /= (e @ room.ones)[:, None]
                e.reshape(-1)[room.place[: len(e)] * WIDTH + m.digits[own, k]] -= 1
                for r in rows:
                    self._step(r, e)

    def _step(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        n, room, table = len(rows), self.room, self.model.table
        key = np.sort(rows * CHUNK + room.place[:n])  # whole numbers sort several times as fast as places by them
        r = key // CHUNK
        order = key - r * CHUNK
        new = np.concatenate([[True], r[1:] != r[:-1]])
        first = np.flatnonzero(new)
        r, count = r[first], np.diff(first, append=n)
        g, own = room.sums[: len(r)], room.more[: len(r)]
        np.take(gradient, order[first], axis=0, out=g, mode="clip")
        many = np.flatnonzero(count > 1)  # most rows stand once in a chunk: nothing is summed up there
        if len(many):
            rest = np.take(gradient, order[~new], axis=0, out=room.more[: n - len(r)], mode="clip")
            more = count[many] - 1
            g[many] += np.add.reduceat(rest, np.cumsum(more) - more, axis=0)
        squares = self.squares[r] + np.einsum("ij,ij->i", g, g) / np.sqrt(count, dtype=np.float32)
        self.squares[r] = squares
        g *= (self.rate / np.sqrt(squares))[:, None].astype(np.float32)
        _whole(table)[r] = _whole(np.subtract(np.take(table, r, axis=0, out=own, mode="clip"), g, out=own))
        self.seen[r] += count

    def changes(self) -> Iterator[pa.RecordBatch]:
        """(block, times its rows were seen, their changes) of the blocks with rows that changed."""
        seen, new, old = (x.reshape(len(self.seen) // BLOCK, -1) for x in (self.seen, self.model.table, self.start))
        full = np.flatnonzero(seen.any(axis=1))
        for at in range(0, len(full), 256):
            some = full[at : at + 256]
            parts = seen[some].astype("<i8"), (new[some] - old[some]).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in parts)], names=["block", "seen", "change"])


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, change): the changes of all tasks, averaged by how often each saw a row."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, n, change in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.frombuffer(n, "<i8")
            # Whole numbers: sums don't depend on the order of arrival.
            more = np.rint(np.frombuffer(change, "<f2").reshape(BLOCK, WIDTH).astype(np.float64) / STEP).astype(np.int64) * n[:, None]
            if block in found:
                for old, x in zip(found[block], (n, more)):
                    old += x
            else:
                found[block] = n.copy(), more
    mean = [(sums * STEP / np.maximum(n[:, None], 1)).astype("<f2").tobytes() for n, sums in found.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(mean, pa.binary())], names=["block", "change"])


def _flat(model: Model, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, each text's end after them, their places in the head, and where each text starts among them."""
    words, sizes = column_words(texts)
    ids = np.insert(model.places(words), np.cumsum(sizes), model.end_place)
    return words, ids, np.cumsum(sizes + 1) - sizes - 1


def _held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) of the texts, with the end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 0):
            words, _ = column_words(batch.column(0))
            coded = words.dictionary_encode()
            known = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())])
            count = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(known) - 1), batch.num_rows)
            yield pa.RecordBatch.from_arrays([known.cast(pa.large_binary()).cast(pa.binary()), pa.array(count, pa.int64())], names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def start_model(counts: DataFrame, *, head: int = HEAD) -> Model:
    """A model whose only weights are biases."""
    spark = counts.sparkSession
    by_count = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)  # N tokens have sqrt(2N) different counts at most
    total, distinct = sum(c * n for c, n in by_count), sum(n for _, n in by_count)
    least, words = 0, 0
    for c, n in by_count:
        if words + n > head:
            break
        least, words = c, words + n
    rows = counts.where(F.col("c") >= least).collect() if words else []  # head rows at most
    rows.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    c = np.array([r["c"] for r in rows], np.float64)
    n_model, rare_total = len(rows), total - int(c.sum())
    nodes, digits, outcomes = tree(np.append(c, rare_total + 0.5))
    bias = np.where(outcomes > 0, np.log(np.maximum(outcomes, 1e-9) / outcomes.sum(axis=1, keepdims=True)), -80.0).astype(np.float32)
    words_sent = spark.sparkContext.broadcast(pa.array([bytes(r["word"]) for r in rows], pa.large_binary()).cast(pa.large_string()))
    table = np.zeros((max(ROWS, 1 << (2 * n_model - 1).bit_length()), WIDTH), np.float32)
    return Model(uuid.uuid4().hex, words_sent, n_model, least, np.log10(c + 0.5), total, distinct, words == distinct, n_model, rare_total, nodes, digits, bias, table)


def train(texts: DataFrame, model: Model, *, rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> Model:
    """Distributed gradient updates over all tokens of all texts, rounds times; a text is in one slice of a round."""
    spark = texts.sparkSession
    slices, tasks = slices_of(model.total, task_tokens)
    for turn in range(rounds * slices):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == turn % slices) if slices > 1 else texts
        sent = spark.sparkContext.broadcast(model.table.astype(np.float16))
        bare = Model(**{**model.__dict__, "table": None})

        def run(batches: Iterator[pa.RecordBatch], sent=sent, bare=bare) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Model(**{**bare.__dict__, "table": sent.value}))
            for batch in grouped(batches, 0):
                trainer.learn(*_flat(trainer.model, batch.column(0))[1:])
            yield from trainer.changes()

        # Fewer, larger tasks than files: the changes that travel then keep to the number of tokens.
        changes = part.coalesce(tasks).mapInArrow(run, "block long, seen binary, change binary")

        merged = changes.repartition(F.col("block")).mapInArrow(averaged, "block long, change binary").toArrow()  # as many rows as the table at most
        blocks = model.table.reshape(-1, BLOCK, WIDTH)
        for batch in merged.to_batches(256):
            if batch.num_rows:
                blocks[batch.column(0).to_numpy()] += np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f2").reshape(-1, BLOCK, WIDTH)
        del merged
        sent.destroy()
    return model


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """rows (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score, score in place of text."""
    sent = rows.sparkSession.sparkContext.broadcast(model.table.astype(np.float16))
    bare = Model(**{**model.__dict__, "table": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**{**bare.__dict__, "table": sent.value.astype(np.float32)})
        uid = TaskContext.get().partitionId() << 40
        for batch in grouped(batches, 1):
            words, ids, starts = _flat(m, batch.column(1))
            in_head = ids >= 0
            log_c = np.where(in_head, m.log_counts[np.maximum(ids, 0)] if m.n_head else 0.0, np.log10(0.5) if m.complete else 0.0)
            rare = (ids < 0) | (ids >= m.n_model)
            share = np.where(rare, log_c - m.rare_norm, 0.0)
            sums = lambda x: np.add.reduceat(x, starts)
            n = np.diff(np.r_[starts, len(ids)])
            # Words whose count must be looked up: none if the head holds all that were seen.
            ends = starts + n - 1
            asked = ~in_head & (not m.complete)
            asked[ends] = False  # the end is looked up below if the head is too small even for it
            far = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sums(asked.astype(np.int64)))]), words.filter(pa.array(np.delete(asked, ends))))
            if not m.complete and m.end_place < 0:
                far = pa.array([[*x, END] for x in far.to_pylist()], far.type)
            uids = uid + np.arange(batch.num_rows)
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(uids), batch.column(0), batch.column(2), pa.array(n), pa.array(sums(in_head.astype(np.int64))), pa.array(sums(log_c - m.base_norm)), pa.array(sums(log_probabilities(m, ids, starts) + share)), far.cast(pa.list_(pa.string())).cast(pa.list_(pa.binary()))], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far"])

    got = rows.select("doc_id", "text", "held_out").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, far array<binary>")
    if not model.complete:
        got = written(got, "scores")
        asked = got.select("uid", F.explode("far").alias("word"))
        known = asked.join(counts.where(F.col("c") < model.least), "word", "left")
        sums = known.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("n"))
        got = got.join(sums, "uid", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("n", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0)), "score": F.col("score") + F.coalesce("more", F.lit(0.0))})
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, *, head: int = HEAD, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out; counts and weights come from all others.
    Tokens are lower-cased (A-Z) words and one end. base_score is the smoothed unigram log10 probability of
    the text, score the model's. A null or empty text is the end alone. A null id isn't held out. Repeated
    rows count as often as they stand. No rows give no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _held_out(id_col).alias("held_out"))
    texts = rows.where("NOT held_out").select("text")
    counts = written(count_tokens(texts), "counts")
    model = start_model(counts, head=head)
    if model.total:
        model = train(texts, model, rounds=rounds)
    return score(rows, model, counts)
