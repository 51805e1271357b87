"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced splitting of a bounded sample: a cluster above its share is split again until every leaf
holds about LEAF sampled vectors, so their number grows with the table up to CENTROIDS. Every vector goes to its nearest
centroid's list, and boundary vectors, those hardly farther from further centroids than from their second, also to these
lists, unless a list already chosen lies closer to that centroid. A query searches the centroids by best-first search in
a neighbour graph held in memory: it takes the nearest lists until they hold enough vectors for k neighbours, and all
lists whose distance is no more than RATIO of the way from that of these to the query's root mean square distance from
all centroids (so the ratio means the same for clustered vectors and for those that are all about equally far apart). It
prunes the rest and scans what is left with exact Euclidean distances in double precision. No number of lists is fixed.
A query that still has fewer than k neighbours is compared with all vectors.

Lists are tables of packed blocks, each of about BLOCK bytes of one list where it holds as many, joined to packed blocks of
queries. A list of more than SHARD bytes is dealt to several shards, which may go to several tasks, and its queries go to each. A task that scans holds the best of at most about HELD
queries and hands them on before it takes more. The driver and the broadcast hold the centroids and their graph only, at most
CENTROIDS of them.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates, and
neither do vectors of another length than the most frequent; rows whose vec_id is null take no part; of rows with one
vec_id the nearest counts as that candidate, and queries with one vec_id share one answer, but a query's own id is never its candidate; with fewer candidates than k all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables, text

#: Bounds of the sample that is fitted and of the centroids.
SAMPLE, CENTROIDS = 16_384, 4_096
#: Bytes of a list's block, of a block of queries and of a list's shard; bytes of queries that a task packs at once; queries whose best a task holds.
BLOCK, ASKED, SHARD, PACKED, HELD = 1 << 20, 1 << 23, 1 << 28, 1 << 25, 16_384
LEAF, COPIES, BOUNDARY, RATIO, LINKS = 4, 2, 1.1, 0.73, 24
#: Lists whose distance is that of the nearest but for this factor are never pruned: to a vector far from all, all are like that.
NEAR = 1.05
#: Centroids that a search looks into at once, and those beyond its limit before it ends.
WIDTH, PATIENCE = 128, 24


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def __post_init__(self) -> None:
        self.mean, self.square = self.centroids.mean(0), (self.centroids**2).sum(1).mean()

    def limit(self, query: np.ndarray, least: float, ratio: float) -> float:
        """The squared distance up to which lists are kept, from that of the lists that hold enough vectors."""
        usual = np.sqrt(max((query * query).sum() - 2 * query @ self.mean + self.square, 0))
        return max(np.sqrt(least) + ratio * (usual - np.sqrt(least)), np.sqrt(least) * NEAR) ** 2 + 1e-12


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, leaf: int, most: int) -> np.ndarray:
    """Centres of clusters of at most about `leaf` vectors, by repeated splits into up to eight of bounded size."""
    leaf = max(leaf, -(-len(sample) // max(1, most * 3 // 4)))
    rng, todo, out = np.random.default_rng(5), [np.arange(len(sample))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(sample[rows].mean(0))
            continue
        parts = min(8, -(-len(rows) // leaf))
        centre = sample[rng.choice(rows, parts, replace=False)]
        bound = -(-len(rows) * 5 // (4 * parts))
        for _ in range(6):
            far = _distances(sample[rows], centre)
            label = np.full(len(rows), -1)
            order = np.argsort(far.min(1), kind="stable")  # close vectors choose first, full clusters turn the rest away
            room = np.full(parts, bound)
            choice = np.argsort(far, 1)
            for i in order:
                for c in choice[i]:
                    if room[c]:
                        label[i], room[c] = c, room[c] - 1
                        break
            centre = np.stack([sample[rows[label == c]].mean(0) if (label == c).any() else centre[c] for c in range(parts)])
        todo.extend(rows[label == c] for c in range(parts) if (label == c).any())
    return np.array(out).reshape(len(out), -1)


def merged(centroids: np.ndarray) -> np.ndarray:
    """The centroids without those that rounding cannot tell from an earlier one."""
    norm = (centroids * centroids).sum(1)
    kept = np.ones(len(centroids), bool)
    for i in range(0, len(centroids), 256):
        part = slice(i, i + 256)
        same = _distances(centroids[part], centroids) <= 1e-12 * (norm[part, None] + norm)
        for j in range(i, min(i + 256, len(centroids))):
            kept[j] = not (same[j - i, :j] & kept[:j]).any()
    return centroids[kept]


def build_graph(centroids: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """Each centroid's nearest others with as many from all over, and spread-out places to start from."""
    n = len(centroids)
    near = np.empty((n, min(links, max(0, n - 1))), np.int64)
    away = np.random.default_rng(6).integers(0, max(1, n), (n, min(links, n)))
    for i in range(0, n, 256):
        far = _distances(centroids[i : i + 256], centroids)
        far[np.arange(len(far)), i + np.arange(len(far))] = np.inf
        near[i : i + 256] = np.argsort(far, 1, kind="stable")[:, : near.shape[1]]
    entries, least = [0] if n else [], np.full(n, np.inf)
    while len(entries) < min(n, max(16, int(n**0.5))):
        least = np.minimum(least, ((centroids - centroids[entries[-1]]) ** 2).sum(1))
        entries.append(int(least.argmax()))
    return np.concatenate((near, away), 1), np.array(entries, np.int64)


def search_graph(index: Index, query: np.ndarray, sizes: np.ndarray, enough: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids found, nearest first, and their squared distances: best-first search, WIDTH at a time, until none ahead is within the limit that the lists with `enough` vectors set."""
    c = index.centroids
    seen, spent = np.zeros(len(c), bool), np.zeros(len(c), bool)
    seen[index.entries] = True
    found, d, patience = index.entries, ((c[index.entries] - query) ** 2).sum(1), PATIENCE
    while True:
        order = np.lexsort((found, d))
        found, d = found[order], d[order]
        last = int(np.searchsorted(np.cumsum(sizes[found]), enough))
        limit = index.limit(query, d[last], ratio) if last < len(found) else np.inf
        fresh = np.flatnonzero(~spent[found])
        ahead = fresh[d[fresh] <= limit][:WIDTH]
        if not len(ahead):
            ahead, patience = fresh[:patience], 0
            if not len(ahead):
                return found, d
        spent[found[ahead]] = True
        new = np.unique(index.graph[found[ahead]])
        new = new[~seen[new]]
        seen[new] = True
        found, d = np.concatenate((found, new)), np.concatenate((d, ((c[new] - query) ** 2).sum(1)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _fit(dim: int, leaf: int, most: int):
    """One task: it holds the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)) for b in batches if b.num_rows]
        if parts:
            ids = np.concatenate([p[0] for p in parts])
            centroids = balanced_centroids(np.concatenate([p[1] for p in parts])[np.argsort(ids, kind="stable")], leaf, most)
            yield pa.RecordBatch.from_arrays([text.binary([centroids.tobytes()])], ["centroids"])

    return run


def _pieces(held: np.ndarray, dim: int, size: int) -> np.ndarray:
    """How many pieces of about `size` bytes as many vectors make."""
    return np.maximum(1, -(-held * 8 * dim // size))


def _blocks(names: tuple[str, str], ids: np.ndarray, lists: np.ndarray, vectors: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """A row for each list, dealt to one of its parts by its ids."""
    order = np.argsort(lists, kind="stable")
    ids, lists, vectors = ids[order], lists[order], vectors[order]
    cut = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True]))) if len(lists) else np.zeros(1, np.int64)
    held = [ids[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    dealt = [zlib.crc32(x) % n for x, n in zip(held, parts[lists[cut[:-1]]].tolist(), strict=True)]
    packed = [vectors[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(lists[cut[:-1]], pa.int32()), pa.array(dealt, pa.int32()), text.binary(held), text.binary(packed)], ["list", "part", *names])


def _least(v: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The rows with the `most` smallest ids among equal vectors: no other copy can be among fewer than `most` neighbours."""
    _, group = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    group, sorted_ids = group[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])
    order, group = order[fresh], group[fresh]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) < most])


def _placed(batches: Iterator[pa.RecordBatch], c: np.ndarray, dim: int, most: int, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, ids, centroids nearest first, those whose lists take the vector) of the candidates of each batch."""
    rows = min(1024, max(1, BLOCK // (8 * dim)))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            v, ids = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            few = _least(v, ids, most)
            v, ids = v[few], ids[few]
            far = _distances(v, c)
            some = np.argpartition(far, min(2 * COPIES, far.shape[1]) - 1, 1)[:, : 2 * COPIES]
            d = np.take_along_axis(far, some, 1)
            order = np.lexsort((some, d))
            near, d = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
            chosen = np.zeros(near.shape, bool)
            chosen[:, 0] = True
            for j in range(1, near.shape[1] if copies > 1 else 1):
                close = np.zeros(len(v), bool)
                for i in range(j):
                    close |= chosen[:, i] & (((c[near[:, i]] - c[near[:, j]]) ** 2).sum(1) < d[:, j] * 0.5)
                chosen[:, j] = (d[:, j] <= d[:, 1] * BOUNDARY**2) & ~close & (chosen.sum(1) < copies)
            yield v, ids, near, chosen


def _count(shared, dim: int, most: int):
    """How many vectors have each centroid as their nearest, and how many its list takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centroids
        size, held = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for _, _, near, chosen in _placed(batches, c, dim, most, COPIES):
            size += np.bincount(near[:, 0], minlength=len(c))
            held += np.bincount(near[chosen], minlength=len(c))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(size[some]), pa.array(held[some])], ["list", "n", "held"])

    return run, "list int, n long, held long"


def _post(shared, dim: int, most: int, copies: int = COPIES, held: np.ndarray | None = None):
    """Packed lists of each batch: the nearest centroid and, for boundary vectors, further ones; lists that take `held` vectors have parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centroids
        sizes = np.zeros(len(c), np.int64) if held is None else held
        parts, shards = _pieces(sizes, dim, BLOCK), _pieces(sizes, dim, SHARD)
        for v, ids, near, chosen in _placed(batches, c, dim, most, copies):
            row, col = np.nonzero(chosen)
            packed = _blocks(("ids", "vectors"), ids[row], near[row, col], v[row], parts)
            yield packed.append_column("shard", pa.array(packed.column("part").to_numpy() % shards[packed.column("list").to_numpy()], pa.int32()))

    return run, "list int, part int, ids binary, vectors binary, shard int"


def lists_of(index: Index, query: np.ndarray, sizes: np.ndarray, ratio: float, enough: int) -> np.ndarray:
    """The nearest lists that hold `enough` vectors together (all, if there are fewer), and those within the limit that they set."""
    found, d = search_graph(index, query, sizes, enough, ratio)
    last = int(np.searchsorted(np.cumsum(sizes[found]), enough))
    if last < len(found):
        return found[(np.arange(len(found)) <= last) | (d <= index.limit(query, d[last], ratio))]
    order = np.argsort(((index.centroids - query) ** 2).sum(1), kind="stable")
    return np.union1d(found, order[: int(np.searchsorted(np.cumsum(sizes[order]), enough)) + 1])


def _ask(shared, dim: int, sizes: np.ndarray, ratio: float, enough: int | None, parts: int, held: np.ndarray):
    """Packed queries of the lists that they search, for each of their shards: all lists without `enough`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        every, most, shards = np.flatnonzero(sizes), max(1, PACKED // (8 * dim)), _pieces(held, dim, SHARD)
        for batch in batches:
            v, ids = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            at, found, n = 0, [], 0
            for i in range(len(v)):
                found.append(every if enough is None else lists_of(index, v[i], sizes, ratio, enough))
                n += len(found[-1])
                if n >= most or i + 1 == len(v):
                    row = np.repeat(np.arange(at, i + 1), [len(x) for x in found])
                    packed = _blocks(("queries", "wanted"), ids[row], np.concatenate(found), v[row], np.full(len(sizes), parts))
                    at, found, n = i + 1, [], 0
                    number = shards[packed.column("list").to_numpy()]
                    for shard in range(int(number.max())):
                        some = packed.filter(pa.array(number > shard))
                        yield some.append_column("shard", pa.array(np.full(some.num_rows, shard), pa.int32()))

    return run, "list int, part int, queries binary, wanted binary, shard int"


def _scan(dim: int, k: int, most: int = HELD):
    """The k nearest that this task has seen for each query, handed on whenever it holds `most` queries."""

    def emit(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        size = [len(i) for i, _ in best.values()]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), size)), pa.array(np.concatenate([i for i, _ in best.values()])), pa.array(np.concatenate([d for _, d in best.values()]))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in (r for batch in batches for r in batch.to_pylist()):
            ids, v = np.frombuffer(b"".join(x["ids"] for x in r["held"]), np.int64), np.frombuffer(b"".join(x["vectors"] for x in r["held"])).reshape(-1, dim)
            asked, q = np.frombuffer(b"".join(x["queries"] for x in r["asked"]), np.int64), np.frombuffer(b"".join(x["wanted"] for x in r["asked"])).reshape(-1, dim)
            step = max(1, BLOCK // max(1, v.size))
            for at in range(0, len(asked), step):
                names = asked[at : at + step].tolist()
                far = np.sqrt(((v[None] - q[at : at + step, None]) ** 2).sum(2))
                worst = np.array([best[x][1][-1] if x in best and len(best[x][1]) == k else np.inf for x in names])
                for j in np.flatnonzero(far.min(1) <= worst).tolist():  # the others have k nearer ones
                    query, other = names[j], ids != names[j]
                    old = best.get(query, (np.empty(0, np.int64), np.empty(0)))
                    i, d = np.concatenate((old[0], ids[other])), np.concatenate((old[1], far[j][other]))
                    order = np.lexsort((i, d))
                    i, d = i[order], d[order]
                    # of a repeated id the nearest counts
                    first = np.sort(np.unique(i, return_index=True)[1])
                    best[query] = (i[first][:k], d[first][:k])
                if len(best) >= most:
                    yield emit(best)
                    best = {}
        if best:
            yield emit(best)

    return run, "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(sound & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = RATIO, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (same columns) its k nearest rows of `vectors`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows, asked = rows.where(F.size("v") == dim), usable(queries).where(F.size("v") == dim)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    fitted = chosen.repartition(1).mapInArrow(_fit(dim, LEAF, CENTROIDS), "centroids binary").first()
    centroids = merged(np.frombuffer(fitted["centroids"]).reshape(-1, dim))
    shared = spark.sparkContext.broadcast(Index(centroids, *build_graph(centroids, LINKS)))  # at most CENTROIDS rows
    most = k + 1  # a query's own row is no candidate
    sizes, held = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
    for number, n, taken in rows.mapInArrow(*_count(shared, dim, most)).groupBy("list").agg(F.sum("n"), F.sum("held")).collect():  # a row for each centroid
        sizes[number], held[number] = n, taken
    parts = -(-asked.count() * 8 * dim // ASKED)

    def packed(blocks: DataFrame, name: str) -> DataFrame:
        """One row for each part of a shard, of bounded size, dealt by the keys of the join."""
        return blocks.repartition("list", "shard").groupBy("list", "shard", "part").agg(F.collect_list(F.struct(*blocks.columns[2:4])).alias(name)).drop("part")

    def scan(copies: int, wanted: DataFrame, enough: int | None) -> DataFrame:
        taken = held if copies > 1 else sizes
        lists = rows.mapInArrow(*_post(shared, dim, most, copies, taken))
        probed = wanted.mapInArrow(*_ask(shared, dim, sizes, ratio, enough, max(1, parts), taken))
        return packed(lists, "held").join(packed(probed, "asked"), ["list", "shard"]).select("held", "asked").mapInArrow(*_scan(dim, k))

    def nearest_rows(found: DataFrame) -> DataFrame:
        """Copies of a vector and rows of one id may be found by several tasks."""
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    near = tables.keep(nearest_rows(scan(COPIES, asked, most)))
    if sizes.sum() > k:
        full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
        if not short.isEmpty():
            near = nearest_rows(near.union(scan(1, short, None).select(*near.columns)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
