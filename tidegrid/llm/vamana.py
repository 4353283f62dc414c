"""Embedding near-duplicates over a robust-pruned flat graph (Subramanya et al. 2019), built on overlapping cluster shards."""

from __future__ import annotations

import functools
import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, filesystem, forget, hashed_sample, new_path, spread, written
from .components import connected_components

#: Centroids are fitted on so many vectors at most; there is one for SHARD_ROWS vectors, and MOST_CLUSTERS at most.
SAMPLE, SHARD_ROWS, MOST_CLUSTERS = 20_000, 1000, 1024
#: Clusters that a vector is a member of, and those, the nearest to its own, whose united graph it searches at first.
MEMBER_OF, REACH = 2, 6
#: A shard has about so many members at most, a search so many queries and so many nodes at once; what is larger is dealt.
SHARD_MOST, QUERY_MOST, REGION_MOST = 3000, 1000, 12_000
#: Neighbours of a node, candidates they are pruned from, how much farther a detour may be, width of the search.
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 24
#: Links that lead out of a dense group: so many to nodes OUTER_FAR times as far as the last neighbour, and so many back.
OUTER, OUTER_BACK, OUTER_FAR = 4, 8, 3.0
#: Links that lead to each node from its own neighbours at least.
WAYS_IN = 3
#: Nodes that miss the threshold by so much are still expanded.
SLACK = 0.08
#: (Query, node) pairs that are expanded at once.
FRONT = 30_000
#: Queries of the audit's first draw, queries with links that it needs, and the mean recall below which the search is made again.
AUDIT_QUERIES, AUDIT_LINKED, AUDIT_RECALL = 256, 128, 0.99
#: Queries that are compared with all vectors in one pass.
EXACT_BLOCK = 4096
log = logging.getLogger(__name__)


def unit(values) -> np.ndarray | None:
    """The vector at length 1, in double precision; None if it is null, empty or zero or a component is null or not finite."""
    if values is None or not len(values):
        return None
    v = np.asarray([np.nan if x is None else x for x in values] if isinstance(values, list) else values, dtype=np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum())


def _prepared(rows: DataFrame) -> DataFrame:
    """vec_id, dim, digest and vec: components as they are where they are floats, as the unit's doubles take twice the room, else the unit."""
    narrow = rows.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            vecs = [unit(x) for x in given]
            dim = [0 if v is None else len(v) for v in vecs]
            digest = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vecs]
            kept = [None if v is None else np.asarray(x, np.float32).tobytes() if narrow else v.tobytes() for x, v in zip(given, vecs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(kept, pa.binary())], names=["vec_id", "dim", "digest", "vec"])

    return rows.mapInArrow(run, "vec_id long, dim int, digest binary, vec binary")


def _matrix(column, dim: int) -> np.ndarray:
    """Units in double precision, of units or of components in single precision."""
    raw = b"".join(column)
    if len(raw) == 8 * dim * len(column):
        return np.frombuffer(raw, np.float64).reshape(-1, dim)
    v = np.frombuffer(raw, np.float32).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(10):
        near = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centers = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centers)
    return centers


def robust_prune(sims: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each node out of its candidates near (rows: nearest first, -1: none): each kept one rules out those that are alpha times closer to it than to the node."""
    n = len(near)
    alive = near >= 0
    rows = np.arange(n)
    dist = 1 - sims[rows[:, None], np.maximum(near, 0)]
    kept = np.full((n, degree), -1, np.int64)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        best = np.where(some, near[rows, at], 0)
        kept[some, k] = best[some]
        detour = alpha * (1 - sims[best[:, None], np.maximum(near, 0)])
        alive &= ~(some[:, None] & (detour <= dist))
        alive[rows[some], at[some]] = False
    return [x[x >= 0] for x in kept]


def build_graph(vecs: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbours of each node of a shard: robust-pruned, with the way back, pruned again."""
    n = len(vecs)
    sims = vecs @ vecs.T
    np.fill_diagonal(sims, -2)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return [np.empty(0, np.int64)] * n
    near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    first = robust_prune(sims, near, degree)
    back: list[list[int]] = [x.tolist() for x in first]
    for i, x in enumerate(first):
        for j in x.tolist():
            back[j].append(i)
    wide = min(max(map(len, back)), 4 * degree)
    table = np.full((n, wide), -1, np.int64)
    for i, x in enumerate(back):
        x = np.array(list(dict.fromkeys(x)), np.int64)
        x = x[np.argsort(-sims[i, x], kind="stable")][:wide]
        table[i, : len(x)] = x
    pruned = robust_prune(sims, table, degree)
    # A dense group fills its members' lists with one another: its nearest outsiders link it with the rest.
    last = 1 - np.take_along_axis(sims, near, 1)[:, min(degree, c) - 1]
    outside = np.where(1 - sims >= OUTER_FAR * last[:, None], sims, -3)
    count = min(OUTER, n - 1)
    outer = np.argpartition(-outside, count - 1, axis=1)[:, :count]
    far = np.take_along_axis(outside, outer, 1)
    back = [[] for _ in range(n)]
    for i, k in zip(*np.nonzero(far > -2)):
        back[int(outer[i, k])].append((-float(far[i, k]), int(i)))
    # Pruning leaves some members of a dense group without a link from it. Each gets WAYS_IN from those of its
    # own neighbours that gave the fewest.
    given = [0] * n
    ways: list[list[int]] = [[] for _ in range(n)]
    for i, x in enumerate(pruned):
        for j in sorted(x.tolist(), key=given.__getitem__)[:WAYS_IN]:
            ways[j].append(i)
            given[j] += 1
    heads = np.zeros(n, np.int64)
    out = []
    for i, x in enumerate(pruned):
        x = [*x.tolist(), *ways[i], *outer[i, far[i] > -2].tolist(), *(j for _, j in sorted(back[i])[:OUTER_BACK])]
        out.append(list(dict.fromkeys(x)))
        heads[out[-1]] += 1
    # A node without a way in can't be found: its nearest neighbour gets one.
    for i in np.flatnonzero(heads == 0).tolist():
        out[int(near[i, 0])].append(i)
    return [np.array(x, np.int64) for x in out]


class Searcher:
    """Searches the graph of some shards, united, for many queries at once."""

    def __init__(self, vecs: np.ndarray, neighbours: list[np.ndarray], cluster: np.ndarray | None = None) -> None:
        self.vecs = vecs
        wide = max(map(len, neighbours), default=0)
        self.table = np.full((len(vecs), max(1, wide)), -1, np.int64)
        for i, x in enumerate(neighbours):
            self.table[i, : len(x)] = x
        cluster = np.zeros(len(vecs), np.int64) if cluster is None else cluster
        self.entries = self._medoids([np.flatnonzero(cluster == c) for c in np.unique(cluster)])

    def _medoids(self, clusters: list[np.ndarray]) -> np.ndarray:
        """The node nearest each cluster's centre, and, where the graph falls into parts, that of each part that has none yet."""
        first = [int(c[(self.vecs[c] @ self.vecs[c].mean(axis=0)).argmax()]) for c in clusters]
        order = np.concatenate([np.array(first, np.int64), np.argsort(-(self.vecs @ self.vecs.mean(axis=0)), kind="stable")])
        seen = np.zeros(len(self.vecs), bool)
        out = []
        for k, start in enumerate(order.tolist()):
            if seen[start]:
                if k < len(first):
                    out.append(start)
                continue
            out.append(start)
            seen[start] = True
            front = np.array([start])
            while len(front):
                new = np.unique(self.table[front])
                new = new[new >= 0]
                front = new[~seen[new]]
                seen[front] = True
        return np.array(out, np.int64)

    def _look(self, queries: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities of (query, node) pairs that weren't looked at before."""
        ok = nodes >= 0
        q, nodes = q[ok], nodes[ok]
        flat = np.unique(q * len(self.vecs) + nodes)
        q, nodes = flat // len(self.vecs), flat % len(self.vecs)
        new = ~self.seen[q, nodes]
        q, nodes = q[new], nodes[new]
        self.seen[q, nodes] = True
        out = np.empty(len(q))
        for at in range(0, len(q), 200_000):
            part = slice(at, at + 200_000)
            out[part] = np.einsum("ij,ij->i", queries[q[part]], self.vecs[nodes[part]])
        return q, nodes, out

    def within(self, queries: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of at least this cosine: a greedy search from the medoids and from the query's own node (own; -1: none), then all in range are expanded until none is new."""
        n = len(queries)
        self.seen = np.zeros((n, len(self.vecs)), bool)
        sims = np.full((n, beam), -2.0)
        nodes = np.full((n, beam), -1, np.int64)
        done = np.ones((n, beam), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge(q: np.ndarray, x: np.ndarray, s: np.ndarray) -> None:
            found.append((q, x, s))
            nonlocal sims, nodes, done
            order = np.lexsort((-s, q))
            q, x, s = q[order], x[order], s[order]
            first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            good = place < beam
            q, x, s, place = q[good], x[good], s[good], place[good]
            rows, inverse = np.unique(q, return_inverse=True)
            more = (np.full((len(rows), beam), -2.0), np.full((len(rows), beam), -1, np.int64))
            more[0][inverse, place], more[1][inverse, place] = s, x
            all_s = np.concatenate([sims[rows], more[0]], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[rows] = np.take_along_axis(all_s, top, 1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], more[1]], axis=1), top, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], more[1] < 0], axis=1), top, 1)

        every = np.repeat(np.arange(n), len(self.entries))
        merge(*self._look(queries, every, np.tile(self.entries, n)))
        if own is not None:
            merge(*self._look(queries, np.arange(n), own))
        while True:
            q = np.flatnonzero(~done.all(axis=1))
            if not len(q):
                break
            at = (~done[q]).argmax(axis=1)  # the nearest that isn't expanded
            done[q, at] = True
            near = self.table[nodes[q, at]]
            merge(*self._look(queries, np.repeat(q, near.shape[1]), near.ravel()))
        q, x, s = (np.concatenate(c) for c in zip(*found))
        front = s >= least - SLACK
        hits = [(q[s >= least], x[s >= least])]
        waiting = [(q[front], x[front])]
        while waiting:
            fq, fx = waiting.pop()
            if len(fq) > FRONT:  # a dense group's front is long: a part at a time bounds memory
                waiting += [(fq[at : at + FRONT], fx[at : at + FRONT]) for at in range(0, len(fq), FRONT)]
                continue
            near = self.table[fx]
            q, x, s = self._look(queries, np.repeat(fq, near.shape[1]), near.ravel())
            hits.append((q[s >= least], x[s >= least]))
            if (s >= least - SLACK).any():
                waiting.append((q[s >= least - SLACK], x[s >= least - SLACK]))
        del self.seen
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search_links(classes: DataFrame, dim: int, least: float, reach: int, beam: int, member_of: int) -> tuple[DataFrame, DataFrame]:
    """(rep, n, k): weights and number of the classes that each class links with; (a, b): links that connect what links connect."""
    spark = classes.sparkSession
    n = classes.count()
    few = hashed_sample(classes.select("rep", "vec"), SAMPLE, "rep").toPandas()
    centers = fit_centroids(_matrix(few["vec"], dim), int(np.clip(-(-n // SHARD_ROWS), 1, MOST_CLUSTERS)))
    member_of, reach = min(member_of, len(centers)), min(reach, len(centers))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-(_matrix(batch.column(2).to_pylist(), dim) @ centers.T), axis=1, kind="stable")[:, :member_of]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["rep", "w", "vec", "of"])

    # Assigned twice, as vectors with their clusters would be one table more.
    placed = classes.select("rep", "w", "vec").mapInArrow(assign, "rep long, w long, vec binary, of array<int>")
    sizes = written(placed.select(F.explode("of").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("members"), F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("subs")), "cluster-sizes")
    member = placed.withColumn("cluster", F.explode("of")).join(F.broadcast(sizes), "cluster")  # MOST_CLUSTERS rows
    member = member.select("cluster", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int").alias("sub"), "rep", "w", "of", "vec")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        ids = pdf["rep"].to_numpy()
        return pdf.assign(near=[ids[x].tolist() for x in build_graph(_matrix(pdf["vec"], dim))])

    # The index: a folder for each shard, that searches read. So no node travels to the regions that hold it, a dozen or so.
    index = new_path(spark, "index")
    member.groupBy("cluster", "sub").applyInPandas(build, "cluster int, sub int, rep long, w long, of array<int>, vec binary, near array<long>").write.partitionBy("cluster", "sub").parquet(index)

    # A class searches the region of its nearest cluster: the clusters nearest to that one, in this order.
    between = centers @ centers.T
    np.fill_diagonal(between, 2)
    regions = np.argsort(-between, axis=1, kind="stable")[:, :reach]
    region = spark.createDataFrame([(h, int(c), k) for h, x in enumerate(regions) for k, c in enumerate(x)], "home int, cluster int, rank int")  # reach * MOST_CLUSTERS rows
    before = F.coalesce(F.sum("size").over(W.partitionBy("home").orderBy("rank", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("cluster", "sub", (F.col("members") / F.col("subs")).alias("size"))
    parts = shards.join(F.broadcast(region), "cluster").withColumn("part", F.floor(before / REGION_MOST).cast("int")).groupBy("home", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "cluster", "sub"))).alias("shards"))
    # Each shard's classes search each part of their region: some numbers a row.
    jobs = written(shards.select(F.col("cluster").alias("home"), "sub").join(parts, "home"), "jobs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(index)
        for batch in batches:
            for job in batch.to_pylist():
                home = job["home"]
                asked = _shard(where, folder, home, job["sub"])
                asked = None if asked is None else asked[asked["of"].map(lambda of: of[0] == home)]
                nodes = [x for x in (_shard(where, folder, s["cluster"], s["sub"]) for s in job["shards"]) if x is not None]
                if asked is None or not len(asked) or not nodes:
                    continue
                ids, w, vecs, near, cluster = _united(pd.concat(nodes, ignore_index=True), regions[home], dim)
                if not len(ids):
                    continue
                searcher = Searcher(vecs, near, cluster)
                for at in range(0, len(asked), QUERY_MOST):
                    some = asked.iloc[at : at + QUERY_MOST]
                    reps = some["rep"].to_numpy()
                    own = np.minimum(np.searchsorted(ids, reps), len(ids) - 1)
                    own = np.where(ids[own] == reps, own, -1)
                    q, x = searcher.within(_matrix(some["vec"], dim), least, beam, own)
                    other = reps[q] != ids[x]
                    q, x = q[other], x[other]
                    yield pa.RecordBatch.from_pandas(_summed(reps, ids, w, q, x, np.ones(len(q), bool)), preserve_index=False)

    found = written(jobs.repartition(spread(jobs)).mapInArrow(search, _FOUND), "found")
    forget(index)
    for done in (sizes, jobs):
        drop_written(done)
    return _links_of(found)


def _shard(where, folder: str, cluster: int, sub: int) -> pd.DataFrame | None:
    """A shard of the index by ascending rep; None if it is empty."""
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(f"{folder}/cluster={cluster}/sub={sub}", allow_not_found=True))
    rows = []
    for x in found:
        if x.base_name.endswith(".parquet"):
            with where.open_input_file(x.path) as f:
                rows.append(pq.ParquetFile(f).read())
    return pa.concat_tables(rows).to_pandas().assign(cluster=cluster).sort_values("rep", kind="stable", ignore_index=True) if rows else None


def _united(nodes: pd.DataFrame, region: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids, weights, vectors, neighbours and clusters of a part's nodes, with the lists of all shards of the part that hold a node united.

    A node of several of a region's clusters counts in the first of them, so that a region holds it once.
    """
    rank = {int(c): k for k, c in enumerate(region)}
    first = np.array([rank[c] == min(rank.get(int(x), len(rank)) for x in of) for c, of in zip(nodes["cluster"], nodes["of"])], bool)
    kept = nodes[first].sort_values("rep", kind="stable")
    ids = kept["rep"].to_numpy()
    if not len(ids):
        return ids, ids, np.empty((0, dim)), [], ids

    def places(reps: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, reps), len(ids) - 1)
        return np.where(ids[at] == reps, at, -1)

    heads = np.repeat(places(nodes["rep"].to_numpy()), nodes["near"].map(len).to_numpy())
    tails = places(np.concatenate(nodes["near"].tolist()))
    links = np.unique((heads * len(ids) + tails)[(heads >= 0) & (tails >= 0)])
    ends = np.searchsorted(links, np.arange(1, len(ids)) * len(ids))
    return ids, kept["w"].to_numpy(), _matrix(kept["vec"], dim), np.split(links % len(ids), ends), kept["cluster"].to_numpy()


_FOUND = "rep long, n long, k long, root long"


def _summed(reps: np.ndarray, ids: np.ndarray, w: np.ndarray, q: np.ndarray, x: np.ndarray, new: np.ndarray) -> pd.DataFrame:
    """Found pairs (places of reps, of ids) as rows of _FOUND: sums by query of those that are new, and what all connect."""
    count = np.bincount(q[new], weights=w[x[new]], minlength=len(reps)).astype(np.int64)
    kinds = np.bincount(q[new], minlength=len(reps))
    all_ids, inverse = np.unique(np.concatenate([reps, ids]), return_inverse=True)
    root = _roots(len(all_ids), inverse[: len(reps)][q], inverse[len(reps) :][x])
    moved = np.flatnonzero(root != np.arange(len(root)))
    some = np.flatnonzero(count)
    none = np.zeros(len(moved), np.int64)
    return pd.DataFrame({"rep": np.concatenate([reps[some], all_ids[moved]]), "n": np.concatenate([count[some], none]), "k": np.concatenate([kinds[some], none]), "root": np.concatenate([reps[some], all_ids[root[moved]]])})


def _links_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def _compared(classes: DataFrame, dim: int, least: float, low: float, high: float) -> tuple[pd.DataFrame, DataFrame]:
    """The queries whose hashes are in [low, high) of all, EXACT_BLOCK or so, and what comparing them with all vectors finds."""
    place = F.xxhash64("rep", "vec").cast("double") / 2.0**64 + 0.5
    few = classes.where((place >= low) & (place < high) if high < 1 else place >= low).select("rep", "vec").toPandas()
    asked, reps = _matrix(few["vec"], dim), few["rep"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(ids) if len(reps) else 0, 2000):
                own, vecs = ids[at : at + 2000], _matrix(batch.column(2).slice(at, 2000).to_pylist(), dim)
                q, x = np.nonzero((asked @ vecs.T >= least) & (reps[:, None] != own[None, :]))
                yield pa.RecordBatch.from_pandas(_summed(reps, own, w[at : at + 2000], q, x, np.ones(len(q), bool)), preserve_index=False)

    return few, written(classes.select("rep", "w", "vec").mapInArrow(run, _FOUND), "exact")


def _exact_links(classes: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """As _search_links(), of all pairs: blocks of queries, one after another, compare with all vectors."""
    blocks = max(1, -(-classes.count() // EXACT_BLOCK))
    found = [_compared(classes, dim, least, i / blocks, (i + 1) / blocks)[1] for i in range(blocks)]
    return _links_of(functools.reduce(DataFrame.unionByName, found))


def audit(classes: DataFrame, links: DataFrame, dim: int, least: float, queries: int = AUDIT_QUERIES, linked: int = AUDIT_LINKED) -> tuple[float | None, int, int]:
    """Mean share of their classes that queries found, queries with links, queries drawn. Copies count once.

    Queries are drawn, and compared with all vectors, until `linked` have links or all are drawn; the mean is
    None where none has. A query that found more than there is counts as whole.
    """
    n, low, total, some, drawn = classes.count(), 0.0, 0.0, 0, 0
    size = queries
    while low < 1 and some < linked:
        high = min(1.0, low + size / max(1, n))
        few, found = _compared(classes, dim, least, low, high)
        true = found.where("n > 0").groupBy("rep").agg(F.sum("k").alias("true"))
        got = true.join(links.select("rep", "k"), "rep", "left").agg(F.count("*").alias("c"), F.sum(F.least(F.coalesce("k", F.lit(0)) / F.col("true"), F.lit(1.0))).alias("s")).first()
        total, some, drawn = total + (got["s"] or 0.0), some + got["c"], drawn + len(few)
        drop_written(found)
        low, size = high, min(2 * size, EXACT_BLOCK)
    return total / some if some else None, some, drawn


def near_vectors(vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least `least`, in double precision, are linked. n_links counts the other
    vectors that a vector was found linked with, component_id is the least vec_id that links reach.

    Vectors equal once at length 1 are a class. Each class is a member of its nearest clusters' shards. A
    graph is built in each shard and the lists of a class that several shards hold are united. A class searches
    the united graph of its nearest cluster and of those around it, from the medoids and from its own node, and goes
    from shard to shard along united lists; only of regions of more than REGION_MOST nodes does it search the
    parts one by one. All found links are exact; an audit
    measures the mean recall of queries that have links and, below AUDIT_RECALL, has the search made once more with
    more clusters and a wider beam, and then all pairs compared in blocks. The result's _tidegrid_recall has, by
    dimension, the recall, the queries with links and the queries that the audit drew; recall None: nothing has links.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do
    vectors of unequal length. A row with a null id links with nothing: component_id is null, kept true. Rows
    that share an id are one node with several vectors. Other columns are ignored; no rows give no rows.
    """
    bounded_batches(vectors.sparkSession, 4000)
    rows = _prepared(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")))
    valid = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = written(valid.groupBy("dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("vec").alias("vec")), "classes")
    counts, edges, recall = None, None, {}
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):  # few: vectors of one model have one
        own = classes.where(F.col("dim") == dim)
        for reach, beam, member_of in ((REACH, BEAM, MEMBER_OF), (3 * REACH, 4 * BEAM, 2 * MEMBER_OF)):
            n, e = _search_links(own, dim, least, reach, beam, member_of)
            recall[dim] = audit(own, n, dim, least)
            log.info("dimension %d, beam %d: recall %s, mean of %d queries with links out of %d", dim, beam, *recall[dim])
            if recall[dim][0] is None or recall[dim][0] >= AUDIT_RECALL:
                break
        else:
            n, e = _exact_links(own, dim, least)
            recall[dim] = (1.0, *recall[dim][1:])
            log.warning("dimension %d: the search misses the bound on recall; all pairs were compared", dim)
        n = n.withColumn("dim", F.lit(dim))
        counts, edges = (n, e) if counts is None else (counts.unionByName(n), edges.unionByName(e))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = written(connected_components(edges), "components").withColumnRenamed("node", "rep")
    known = classes.select("dim", "digest", "rep", "w").join(counts, ["rep", "dim"], "left").join(parts, "rep", "left")
    known = written(known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "classes")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    out._tidegrid_recall = recall
    return out
