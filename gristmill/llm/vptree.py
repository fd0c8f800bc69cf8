"""Nearest neighbours by inner product: a vantage-point tree for each shard, searched with relaxed pruning.

Rows are dealt into shards by a hash, so a shard holds its share of any group. Inner products become distances by one more
coordinate: for vectors x no longer than M, (x, sqrt(M^2 - |x|^2)) is the nearer to (q, 0) the larger q.x is. A tree parts
its vectors at the median distance to a vantage point, the one of a few whose distances spread most. Where a query has its
k-th best at distance t, the far side of a node is left out if the triangle inequality puts it beyond t / factor: factor
one is the exact search, larger factors leave out more. A first pass with a much larger factor finds most of the best, the
second goes through the tree with the factor asked for. A shard's equal vectors are one point with its smallest ids.

Queries meet shards in chunks, both bounded in bytes, so that work on a chunk and a shard fits one task; no vector, query
or result passes through the driver. What a shard finds for a query is k rows at most, and the best k of those stay.
Scores are summed component by component in double precision, so equal vectors have equal scores everywhere.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths never meet; rows with one vec_id are queries, and candidates, each by itself; ties go
to the smaller vec_id; a query with no candidate has no row; an empty table gives an empty table. Columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare

K, EVERY = 20, 20
#: Exact search is factor 1; see README for recall and share of vectors compared.
FACTOR, EAGER = 6.5, 4.0
LEAF, TRIED, SAMPLE = 128, 8, 256
#: Bytes of a shard's or a chunk's vectors in double precision, and rows of a shard where there are tasks to spare.
BYTES, ROWS = 16 << 20, 2048


class Best:
    """The k best points of each query so far."""

    def __init__(self, queries: np.ndarray, scaled: np.ndarray, k: int):
        self.queries, self.scaled = queries, scaled
        self.point, self.score, self.product = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf), np.full((len(queries), k), -np.inf)
        #: The least product among the k best, as the matrix has it.
        self.least = np.full(len(queries), -np.inf)

    def add(self, who: np.ndarray, point: np.ndarray, score: np.ndarray, product: np.ndarray, ids: np.ndarray) -> None:
        """Offer each of the queries a row of points, -1 for none; ids settle ties."""
        points = np.concatenate((self.point[who], point), axis=1)
        scores, products = np.concatenate((self.score[who], score), axis=1), np.concatenate((self.product[who], product), axis=1)
        products[points < 0] = -np.inf
        top = np.lexsort((ids[points], -scores, points < 0), axis=-1)[:, : self.point.shape[1]]
        for own, new in ((self.point, points), (self.score, scores), (self.product, products)):
            own[who] = np.take_along_axis(new, top, 1)
        self.least[who] = self.product[who].min(axis=1)


class Tree:
    """The distinct vectors of a shard, in the order of the leaves, and the nodes over them."""

    FIELDS = ("vectors", "ids", "rows", "first", "node", "radius")

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, first: np.ndarray, node: np.ndarray, radius: np.ndarray):
        self.vectors, self.ids, self.rows, self.first, self.node, self.radius = vectors, ids, rows, first, node, radius
        scale = np.abs(vectors).max() if len(vectors) else 1.0
        self.points = vectors.astype(np.float64) / scale
        square = np.einsum("ij,ij->i", self.points, self.points)
        self.reach = float(square.max()) if len(square) else 0.0
        self.more = np.sqrt(np.maximum(0.0, self.reach - square))

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int = K, seed: int = 1) -> Tree:
        """A tree of all vectors; of equal ones the k + 1 smallest ids are kept, which no query can need more of."""
        # + 0.0 makes -0.0 and 0.0 one value
        vectors = np.ascontiguousarray(vectors) + vectors.dtype.type(0)
        order = np.lexsort((rows, ids))
        vectors, ids, rows = vectors[order], ids[order], rows[order]
        view = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, heads, group = np.unique(view, return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        start = np.cumsum(sizes) - sizes
        kept = by[np.arange(len(by)) - np.repeat(start, sizes) <= k]
        bare = cls(vectors[heads], ids, rows, start, np.zeros((0, 5), np.int64), np.zeros(0))
        leaves, node, radius = bare.parted(np.random.default_rng(seed))
        place = np.empty(len(heads), np.int64)
        place[leaves] = np.arange(len(leaves))
        kept = kept[np.argsort(place[group[kept]], kind="stable")]
        first = np.concatenate(([0], np.cumsum(np.minimum(sizes, k + 1)[leaves])))
        return cls(vectors[heads][leaves], ids[kept], rows[kept], first, node, radius)

    def parted(self, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points in leaf order, nodes (begin, end, vantage, inner, outer), radii); children are -1 at leaves, vantages places in leaf order."""
        order = np.arange(len(self.points))
        nodes: list[list[int]] = []
        radii: list[float] = []
        todo = [(0, len(order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me, own = len(nodes), order[a:b]
            if parent >= 0:
                nodes[parent][side] = me
            nodes.append([a, b, -1, -1, -1])
            radii.append(0.0)
            if b - a <= LEAF:
                continue
            some = own[draw.integers(0, b - a, SAMPLE)]
            tried = own[draw.integers(0, b - a, TRIED)]
            best = max(tried.tolist(), key=lambda v: self.between(v, some).std())
            far = self.between(best, own)
            radius = float(np.median(far))
            inner = far <= radius
            cut = int(inner.sum())
            if cut == b - a:
                continue
            order[a:b] = np.concatenate((own[inner], own[~inner]))
            nodes[me][2], radii[me] = best, radius
            todo += [(a + cut, b, me, 4), (a, a + cut, me, 3)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table = np.array(nodes, np.int64).reshape(-1, 5)
        inside = table[:, 2] >= 0
        table[inside, 2] = place[table[inside, 2]]
        return order, table, np.array(radii)

    def between(self, vantage: int, points: np.ndarray) -> np.ndarray:
        gap = self.points[points] - self.points[vantage]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.more[points] - self.more[vantage]) ** 2)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(points, their scores; -1 where there are fewer) of the k best for each query, ties to the smaller first id, and how many pairs were compared."""
        # as long as the longest vector: a query's length changes no order, and distances are told apart best so
        q = queries / np.abs(queries.astype(np.float64)).max(axis=1, keepdims=True)
        q *= np.sqrt(self.reach / np.einsum("ij,ij->i", q, q))[:, None]
        best = Best(queries, q, k)
        seen = np.zeros((len(q), len(self.node)), bool)
        compared = 0
        for relaxed in sorted({factor * EAGER, factor}, reverse=True):
            todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
            while todo:
                me, who, gap = todo.pop()
                # a query that has too few yet goes everywhere; rounding must leave nothing out
                near = np.sqrt(np.maximum(0.0, 2 * self.reach - 2 * best.least[who]))
                open_ = gap <= near / relaxed + 1e-6
                who, gap = who[open_], gap[open_]
                begin, end, vantage, inner, outer = self.node[me].tolist()
                if vantage < 0:
                    who = who[~seen[who, me]]
                    seen[who, me] = True
                    compared += len(who) * (end - begin)
                    self.scan(best, who, begin, end)
                elif len(who):
                    far = np.sqrt(np.maximum(0.0, 2 * self.reach - 2 * (q[who] @ self.points[vantage])))
                    todo.append((outer, who, np.maximum(gap, self.radius[me] - far)))
                    todo.append((inner, who, np.maximum(gap, far - self.radius[me])))
        return best.point, best.score, compared

    def scan(self, best: Best, who: np.ndarray, begin: int, end: int) -> None:
        """Compare queries with a leaf. Products of the matrix tell which may be among the best; scores on the original vectors, and ids, decide."""
        if not len(who) or begin == end:
            return
        products = best.scaled[who] @ self.points[begin:end].T
        slack = 1e-15 * (self.points.shape[1] + 64) * self.reach
        may = products >= best.least[who][:, None] - slack
        some = may.any(axis=1)
        who, may, products = who[some], may[some], products[some]
        at, point = np.nonzero(may)
        score = np.full(products.shape, -np.inf)
        score[at, point] = exact(best.queries[who[at]], self.vectors[begin + point])
        best.add(who, np.where(may, np.arange(begin, end), -1), score, products, self.ids[self.first[:-1]])

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows for each query but for the row that is its own."""
        # one more point, as a query's own row may be all that there is of one
        found, scores, _ = self.search(queries, k + 1, factor)
        who, place = np.nonzero(found >= 0)
        point = found[who, place]
        sizes = np.diff(self.first)[point]
        row = np.repeat(self.first[point], sizes) + within(sizes)
        score, who = np.repeat(scores[who, place], sizes), np.repeat(who, sizes)
        other = self.rows[row] != own[who]
        who, row, score = who[other], row[other], score[other]
        order = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        first = np.searchsorted(who, who, "left")
        keep = np.arange(len(who)) - first < k
        return who[keep], self.ids[row[keep]], score[keep]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Tree:
        with np.load(io.BytesIO(body)) as z:
            return cls(*(z[f] for f in cls.FIELDS))


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … for each of the sizes, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, in double precision."""
    out = np.zeros(len(a))
    for j in range(a.shape[1] if len(a) else 0):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


def usable(column: str) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def vectors_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def cleaned(rows: DataFrame) -> DataFrame:
    """(row, vec_id, width, v): the rows that take part, each with a number of its own."""
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    return materialize(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("width"), "v"), "vptree-rows")


def index(rows: DataFrame, shards: DataFrame, k: int = K) -> DataFrame:
    """(width, shard, tree) for the rows of cleaned()."""

    def build(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        tree = Tree.of(vectors_of(table.column("v"), width), table.column("vec_id").to_numpy(), table.column("row").to_numpy(), k)
        return pa.table({"width": pa.array([width], pa.int32()), "shard": table.column("shard").combine_chunks()[:1], "tree": pa.array([tree.to_bytes()], pa.binary())})

    dealt = rows.join(F.broadcast(shards), "width").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    grouped = dealt.select("width", "shard", "row", "vec_id", "v").groupBy("width", "shard")
    return materialize(grouped.applyInArrow(build, "width int, shard int, tree binary"), "vptree-trees")


def neighbours(rows: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id that `every` divides, the k best of all other rows that the search finds."""
    spark = rows.sparkSession
    prepare(spark)
    known = cleaned(rows)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    tasks = partitions(spark)
    # a row for each length of vectors
    bytes_ = F.col("width") * 8
    shards = F.greatest(F.ceil(F.col("n") * bytes_ / BYTES), F.least(F.lit(tasks), F.ceil(F.col("n") / ROWS)), F.lit(1))
    chunks = F.greatest(F.ceil(F.col("asked") * bytes_ / BYTES), F.lit(1))
    sizes = known.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked"))
    plan = materialize(sizes.select("width", shards.alias("shards"), chunks.alias("chunks")), "vptree-plan")
    trees = index(known, plan.select("width", "shards"), k)

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tree = Tree.from_bytes(left.column("tree")[0].as_py())
        own, ids = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
        who, found, score = tree.nearest(vectors_of(right.column("v"), key[0].as_py()), own, k, factor)
        return pa.table({"row": own[who], "query_id": ids[who], "vec_id": found, "score": score})

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    small = F.broadcast(plan)
    left = trees.join(small, "width").select("width", "shard", spread("chunks").alias("chunk"), "tree")
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    right = known.where(asked).join(small, "width").select("width", spread("shards").alias("shard"), chunk.alias("chunk"), "row", "vec_id", "v")
    keys = ("width", "shard", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact_: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    both = found.select("query_id", "vec_id").distinct().join(exact_.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"]).count()
    return both / max(1, exact_.select("query_id", "vec_id").distinct().count())
