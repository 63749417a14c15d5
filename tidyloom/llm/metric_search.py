"""Exact search for the highest inner products, best first in M-trees.

Inner products become distances of a metric space by one more coordinate: a row x gets
sqrt(M - x·x), M being the greatest x·x, and a query q gets 0; then the squared distance
is q·q + M - 2 q·x, and the nearest rows are those with the highest products.

The tree has three levels. Its root is a bounded number of cells (``CELLS`` at most) whose
routing objects are rows with the smallest hashes; every row belongs to the nearest. A cell with
more rows than a tree may hold is split by hash into several trees, so a hot cell is spread over
tasks. A tree is one row of a table: pages of at most ``PAGE`` entries, with a routing object,
a covering radius and the distance to the routing object above for each page, and the
distance to the page's routing object for each entry.

Queries are searched in blocks. First each visits the tree that holds its own vector, which gives a
bound; then the trees of all cells that the bound and the covering radius do not exclude. Inside
a tree, pages are taken best first, a few at a time; stored parent distances exclude pages
and entries by the triangle inequality before a distance is computed, and what is left is computed
as integers. Bounds leave a margin for rounding, so results are exact. No bound helps where
all vectors are equally far apart; then every entry is looked at, in blocks.

Defined cases: equal vectors meet once; of their rows the ``k`` + 1 with the smallest ids can be in
a result and are kept, repeated rows as often as they occur. The candidates of a query are all rows but
one with its own id and vector, so a repetition of it is a candidate. Null ids are no queries and come last among
ties. Vectors that are null or hold null or non-finite components take no part; shorter vectors
are filled up with zeros; components count as at most 2**27 in size, so that products fit into a long.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import saved

#: Entries of a page and of a tree, cells of the root, queries of a block.
PAGE, TREE, CELLS, BLOCK = 64, 4096, 4096, 512
#: Greatest size of a component.
LARGEST = 1 << 27
#: Share of the largest distance that bounds leave for rounding.
MARGIN = 1e-6
#: Stands for a null id among numbers; a flag tells it from the same number.
NO_ID = (1 << 63) - 1

HITS = "q long, score long, id long"
TREES = "cell int, part int, n int, vectors binary, ids binary, nulls binary, counts binary, starts binary, routes binary, radii binary, parents binary, above binary"


def quantized(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component as array of ints; null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(doubles, lambda x: F.when(F.abs(x) >= LARGEST / scale, F.signum(x) * LARGEST).otherwise(F.floor(scale * x).cast("double")).cast("int"))
    return F.when(vector.isNotNull() & ~bad, whole)


@dataclass
class Space:
    """The metric: number of components and the greatest x·x."""

    size: int
    most: int

    def matrix(self, vectors: list | np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.size), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows of a and b."""
        if self.most < 1 << 52:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The further coordinate of rows."""
        return np.sqrt(np.maximum(0.0, self.most - (x.astype(float) ** 2).sum(1)))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows of the table."""
        fa, fb = a.astype(float), b.astype(float)
        square = (fa**2).sum(1)[:, None] + (fb**2).sum(1) - 2 * fa @ fb.T + (self.lift(a)[:, None] - self.lift(b)) ** 2
        return np.sqrt(np.maximum(0.0, square))

    def from_queries(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        fq = q.astype(float)
        return np.sqrt(np.maximum(0.0, (fq**2).sum(1)[:, None] + self.most - 2 * fq @ x.astype(float).T))

    def reach(self, q: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Distance beyond which a row has a lower product than ``worst``; with the margin."""
        square = (q.astype(float) ** 2).sum(1) + self.most
        return np.sqrt(np.maximum(0.0, square - 2 * worst)) + MARGIN * np.sqrt(square)


@dataclass
class Tree:
    """Pages of entries, each page with its routing object."""

    vectors: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    routes: np.ndarray
    radii: np.ndarray
    parents: np.ndarray
    above: np.ndarray

    @classmethod
    def build(cls, space: Space, x: np.ndarray, ids: list[np.ndarray], nulls: np.ndarray, root: np.ndarray) -> Tree:
        """Pages around every so-many-th row; a larger group is cut by the distance to its routing object."""
        n = len(x)
        chosen = np.arange(0, n, PAGE)
        distance = space.between(x, x[chosen])
        nearest = distance.argmin(1)
        own = distance[np.arange(n), nearest]
        order = np.lexsort((own, nearest))
        group = nearest[order]
        rank = np.arange(n) - np.searchsorted(group, group)
        starts = np.flatnonzero(rank % PAGE == 0)
        own, routes = own[order], x[chosen[group[starts]]]
        ends = np.append(starts[1:], n)
        flat = np.concatenate([ids[i] for i in order]) if n else np.zeros(0, np.int64)
        counts = np.array([len(ids[i]) for i in order], np.int32)
        return cls(
            x[order], flat, nulls[order], counts, np.append(starts, n), routes, own[ends - 1], own, space.between(routes, root[None])[:, 0]
        )

    def packed(self) -> dict[str, bytes]:
        kinds = dict(vectors=np.int32, ids=np.int64, nulls=np.int32, counts=np.int32, starts=np.int32, routes=np.int32, radii=float, parents=float, above=float)
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in kinds.items()}

    @classmethod
    def unpacked(cls, space: Space, row: dict) -> Tree:
        table = lambda name: np.frombuffer(row[name], np.int32).reshape(-1, space.size).astype(np.int64)
        flat = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(
            table("vectors"), flat("ids", np.int64), flat("nulls", np.int32), flat("counts", np.int32), flat("starts", np.int32),
            table("routes"), flat("radii", float), flat("parents", float), flat("above", float),
        )


class Best:
    """The k best rows found for every query of a block."""

    def __init__(self, k: int, worst: np.ndarray):
        self.k, self.worst = k, worst
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.query, self.score = np.append(self.query, query), np.append(self.score, score)
        self.id, self.null = np.append(self.id, ids), np.append(self.null, null)
        order = np.lexsort((self.id, self.null, -self.score, self.query))
        by = self.query[order]
        rank = np.arange(len(by)) - np.searchsorted(by, by)
        order = order[rank < self.k]
        self.query, self.score, self.id, self.null = (a[order] for a in (self.query, self.score, self.id, self.null))
        last = np.flatnonzero(rank == self.k - 1)
        self.worst = self.worst.copy()
        np.maximum.at(self.worst, by[last], self.score[np.searchsorted(self.query, by[last], "right") - 1])


def search(space: Space, tree: Tree, q: np.ndarray, worst: np.ndarray, k: int, root: np.ndarray) -> tuple[Best, int]:
    """The k rows with the highest products for every query, as far as they reach ``worst``; and the number of products computed."""
    best = Best(k, worst)
    first_id = np.append(0, np.cumsum(tree.counts))
    top = space.from_queries(q, root[None])[:, 0]
    reach = space.reach(q, worst)
    # Stored distances to the root's routing object exclude pages for which no distance is needed.
    open_pages = np.abs(top[:, None] - tree.above) - tree.radii <= reach[:, None]
    pages = np.flatnonzero(open_pages.any(0))
    bound, to_page = np.full(open_pages.shape, np.inf), np.full(open_pages.shape, np.inf)
    if len(pages):
        to_page[:, pages] = space.from_queries(q, tree.routes[pages])
        bound[:, pages] = np.where(open_pages[:, pages], np.maximum(0.0, to_page[:, pages] - tree.radii[pages]), np.inf)
    order = np.argsort(bound, axis=1, kind="stable")
    computed, at, step = len(q) * (1 + len(pages)), 0, 1
    while at < order.shape[1]:
        taken = order[:, at : at + step]
        row = np.repeat(np.arange(len(q)), taken.shape[1])
        page = taken.ravel()
        near = bound[row, page] <= reach[row]
        if not near.any():
            break
        row, page = row[near], page[near]
        by_page = np.argsort(page, kind="stable")
        row, page = row[by_page], page[by_page]
        edges = np.append(np.flatnonzero(np.diff(page, prepend=-1)), len(page))
        hits = []
        for a, b in zip(edges, edges[1:], strict=False):
            own, p = row[a:b], page[a]
            entries = np.arange(tree.starts[p], tree.starts[p + 1])
            # Stored distances to the page's routing object exclude entries in the same way.
            may = np.abs(to_page[own, p][:, None] - tree.parents[entries]) <= reach[own][:, None]
            entries, may = entries[may.any(0)], may[:, may.any(0)]
            if not len(entries):
                continue
            score = space.products(q[own], tree.vectors[entries])
            computed += score.size
            i, j = np.nonzero(may & (score >= best.worst[own][:, None]))
            hits.append((own[i], score[i, j], entries[j]))
        if hits:
            query, score, entry = (np.concatenate(c) for c in zip(*hits, strict=True))
            many = tree.counts[entry]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ids = tree.ids[np.repeat(first_id[entry], many) + within]
            # Null ids are the last of their entry.
            null = within >= np.repeat(many - tree.nulls[entry], many)
            best.add(np.repeat(query, many), np.repeat(score, many), ids, null)
            reach = space.reach(q, best.worst)
        at, step = at + step, step * 4
    return best, computed


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Every different vector with the smallest of its ids; null ids are numbers after all others."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))
    few = rows.select("v", "id").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ids = F.sort_array(F.collect_list(F.coalesce("id", F.lit(NO_ID))))
    return few.groupBy("v").agg(ids.alias("ids"), F.count_if(F.col("id").isNull()).cast("int").alias("nulls"))


def _celled(points: DataFrame, space: Space, pivots: np.ndarray) -> DataFrame:
    """Add the cell of the nearest routing object and the distance to it."""
    schema = points.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("distance")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                distance = space.between(space.matrix(_column(part, "v").to_pylist()), pivots)
                cell = distance.argmin(1)
                own = distance[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(own)], [*part.schema.names, "cell", "distance"])

    return points.mapInArrow(run, schema)


def _part(parts: str | Column) -> Column:
    return F.pmod(F.xxhash64("v"), parts).cast("int")


def _trees(celled: DataFrame, space: Space, pivots: np.ndarray) -> DataFrame:
    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, part = (int(x) for x in key)
        ids = [np.asarray(i, np.int64) for i in frame["ids"]]
        tree = Tree.build(space, space.matrix(list(frame["v"])), ids, frame["nulls"].to_numpy(), pivots[cell])
        return pd.DataFrame([{"cell": cell, "part": part, "n": len(frame), **tree.packed()}])

    return celled.select("cell", "part", "v", "ids", "nulls").groupBy("cell", "part").applyInPandas(build, TREES)


def _hits(pairs: DataFrame, space: Space, pivots: np.ndarray, k: int) -> DataFrame:
    """Search every pair of a block of queries and a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = {name: _column(batch, name)[row].as_py() for name in batch.schema.names}
                q = np.frombuffer(one["queries"], np.int32).reshape(-1, space.size).astype(np.int64)
                name, worst = np.frombuffer(one["names"], np.int64), np.frombuffer(one["worst"], np.int64)
                best, _ = search(space, Tree.unpacked(space, one), q, worst, k, pivots[one["cell"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[best.query]), pa.array(best.score), pa.array(best.id, mask=best.null)], ["q", "score", "id"]
                )

    return pairs.mapInArrow(run, HITS)


def _blocks(queries: DataFrame, space: Space, trees: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> DataFrame:
    """A row for every block and tree that may hold a better row for some query of the block.

    ``queries`` has a list of (q, v, worst, cell, part) in each row: the tree that a query has visited is left out.
    ``trees`` has the number of trees of every cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "part", "names", "queries", "worst"]
        for batch in batches:
            for members in _column(batch, "members").to_pylist():
                q = space.matrix([m["v"] for m in members])
                name, worst, cell, part = (np.array([m[c] for m in members], np.int64) for c in ("q", "worst", "cell", "part"))
                near = space.from_queries(q, pivots) - radii <= space.reach(q, worst)[:, None]
                for c in np.flatnonzero(near.any(0)):
                    for p in range(trees[c]):
                        own = np.flatnonzero(near[:, c] & ~((cell == c) & (part == p)))
                        if len(own):
                            binary = [name[own].tobytes(), q[own].astype(np.int32).tobytes(), worst[own].tobytes()]
                            columns = [pa.array([c], pa.int32()), pa.array([p], pa.int32()), *(pa.array([b], pa.binary()) for b in binary)]
                            yield pa.RecordBatch.from_arrays(columns, names)

    return queries.mapInArrow(run, "cell int, part int, names binary, queries binary, worst binary")


def _home(grouped: DataFrame, space: Space) -> DataFrame:
    """A row for every block of queries and the tree of their own vectors, nothing known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = _column(batch, "members").to_pylist()
            names = [np.array([m["q"] for m in own], np.int64).tobytes() for own in members]
            vectors = [space.matrix([m["v"] for m in own]).astype(np.int32).tobytes() for own in members]
            worst = [np.full(len(own), -(1 << 62)).tobytes() for own in members]
            columns = [_column(batch, "cell"), _column(batch, "part"), *(pa.array(b, pa.binary()) for b in (names, vectors, worst))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "part", "names", "queries", "worst"])

    return grouped.select("cell", "part", "members").mapInArrow(run, "cell int, part int, names binary, queries binary, worst binary")


def _first(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_products(rows: DataFrame, queries: Column, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest products for every row for which ``queries`` holds."""
    spark = rows.sparkSession
    asked = F.coalesce(queries, F.lit(False)) & F.col(id).isNotNull()
    rows = rows.select(F.col(id).cast("long").alias("id"), quantized(vector, scale).alias("v"), asked.alias("asked")).where("v IS NOT NULL")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    points = saved(_points(rows, k))
    n, most, size = points.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("v"))).first()
    space = Space(max(1, size or 0), most or 0)
    wanted = min(CELLS, max(1, -(-n // TREE)))
    pivots = space.matrix([r.v for r in points.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v").collect()] or [[]])
    celled = saved(_celled(points, space, pivots))
    found = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    trees, radii = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in found:
        trees[r.cell], radii[r.cell] = -(-r.n // TREE), r.radius
    # One row a cell, so never more than CELLS.
    parts = spark.createDataFrame([(c, int(p)) for c, p in enumerate(trees) if p], "cell int, parts int")
    celled = celled.join(F.broadcast(parts), "cell").withColumn("part", _part("parts"))
    forest = saved(_trees(celled, space, pivots))

    # Equal queries are searched once; one row more than asked for, since their own row is among them.
    distinct = rows.where("asked").select("v").distinct()
    placed = saved(distinct.join(celled.select("v", "cell", "part"), "v").withColumn("q", F.monotonically_increasing_id()))
    member = F.struct("q", "v")
    per_tree = placed.groupBy("cell", "part", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(-(-TREE // BLOCK))).alias("block")).agg(F.collect_list(member).alias("members"))
    at_home = saved(_hits(_home(per_tree, space).join(forest, ["cell", "part"]), space, pivots, k + 1))
    bounds = at_home.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    known = placed.join(bounds, "q", "left").withColumn("worst", F.when(F.col("n") > k, F.col("least")).otherwise(-(1 << 62)))
    blocks = max(1, -(-placed.count() // BLOCK))
    blocked = known.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("q", "v", "worst", "cell", "part")).alias("members"))
    pairs = saved(_blocks(blocked.select("members"), space, trees, pivots, radii))
    elsewhere = _hits(pairs.join(forest, ["cell", "part"]), space, pivots, k + 1)
    best = _first(saved(at_home.unionByName(elsewhere)), k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("found"))
    lists = saved(lists.join(placed.select("q", "v"), "q").select("v", "found"))

    answered = rows.where("asked").select("v", "id", square.alias("own")).join(lists, "v")
    pair = F.transform("found", lambda f: F.struct(f["score"].alias("score"), f["id"].alias("id")))
    # Its own row, or one with the same product and id, is taken out once.
    own = F.array_position(pair, F.struct(F.col("own").alias("score"), F.col("id").alias("id"))).cast("int")
    others = F.filter("found", lambda f: f["rank"] != F.col("at"))
    listed = answered.withColumn("at", F.coalesce(own, F.lit(0))).select("id", F.posexplode(F.slice(others, 1, k)).alias("i", "f"))
    return listed.select(
        F.col("id").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score")
    )
