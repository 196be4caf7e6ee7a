"""Exact top-k by inner product with two cover trees, one over queries and one over data."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 256
TOP = 5
FAN = 12
LEAF = 256
FIRST_ROWS = 512
ROWS = 4096
BLOCK = 16384
EXACT = 2.0**26  # norms from which products pass 2**52


class CoverTree:
    """Balls within balls over integer vectors.

    A node's children are centred on its points, chosen one after another as the
    farthest from those before, until they cover it with half its radius or
    there are ``FAN`` of them; each child keeps the radius that its own points
    need.  Points are in tree order, so a node is a stretch of rows.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        self._points = points.astype(np.float64)
        self._build(0, len(points))
        self.points, self.ids = self._points[self.order], ids[self.order]
        self.centres = np.array(self.centre).reshape(len(self.centre), points.shape[1])
        self.radii = np.array(self.radius)
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.least = np.array([self.ids[s:e].min() for s, e in self.span])

    def _build(self, start: int, end: int) -> int:
        todo = [(start, end, None)]
        while todo:
            s, e, parent = todo.pop()
            rows = self.order[s:e]
            centre = self._points[rows[0]]
            far = np.sqrt(((self._points[rows] - centre) ** 2).sum(1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.span.append((s, e))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if e - s <= LEAF or far.max() == 0:
                continue
            near, owner, k = far.copy(), np.zeros(e - s, np.int64), 0
            while k + 1 < FAN and near.max() > far.max() / 2:
                k += 1
                d = np.sqrt(((self._points[rows] - self._points[rows[near.argmax()]]) ** 2).sum(1))
                owner[d < near] = k
                near = np.minimum(near, d)
            by = np.lexsort((near, owner))  # a child's centre comes first
            self.order[s:e] = rows[by]
            cuts = np.searchsorted(owner[by], np.arange(k + 2))
            todo += [(s + int(a), s + int(b), node) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return 0

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers under 2**31, each exact as int64 if under 2**63: doubles hold those of halves."""
    upper = [np.floor(v / 65536) for v in (a, b)]
    lower = [v - 65536 * h for v, h in zip((a, b), upper, strict=True)]
    whole = lambda x, y: (x @ y.T).astype(np.int64)
    return (whole(upper[0], upper[1]) << 32) + ((whole(upper[0], lower[1]) + whole(lower[0], upper[1])) << 16) + whole(lower[0], lower[1])


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best rows for each query, other ids only; unused places are -1.

    Node pairs are pruned with  <q, x> <= <Q, X> + rQ |X| + rX |Q| + rQ rX  for
    centres Q, X and covering radii r, against the worst kth score of the
    queries under the query node; at equal scores the smaller id wins.  Vectors hold
    whole numbers.  Where norms reach 2**26, doubles can't hold products: these are
    put together from halves of 16 bits then, as int64, up to 2**62.
    """
    large = [float(np.sqrt((v * v).sum(axis=1).max(initial=0.0))) for v in (queries, data)]
    exact = max(large) >= EXACT
    slack = 2e-6 + 1e-12 * large[0] * large[1]
    lowest = np.iinfo(np.int64).min if exact else -np.inf
    best_score = np.full((len(queries), top), lowest)
    best_id = np.full((len(queries), top), np.iinfo(np.int64).max)
    if not len(queries) or not len(data):
        return np.where(best_score == lowest, -1, best_id), best_score
    qt, xt = CoverTree(queries, query_ids), CoverTree(data, data_ids)
    sizes = np.array([e - s for s, e in xt.span])

    def bound(q: int, nodes: np.ndarray) -> np.ndarray:
        return xt.centres[nodes] @ qt.centres[q] + qt.radii[q] * xt.norms[nodes] + xt.radii[nodes] * qt.norms[q] + qt.radii[q] * xt.radii[nodes] + slack / 2

    def alive(q: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = qt.span[q]
        rows = qt.order[s:e]
        worst = float(best_score[rows, -1].min())
        ub = bound(q, nodes)
        last = best_id[rows, -1].max()
        keep = (ub > worst + slack) | ((ub >= worst) & (xt.least[nodes] < last))
        return nodes[keep], ub[keep]

    def base(q: int, nodes: np.ndarray) -> None:
        s, e = qt.span[q]
        rows = qt.order[s:e]
        at = np.concatenate([np.arange(*xt.span[n]) for n in nodes])
        scores = products(qt.points[s:e], xt.points[at]) if exact else qt.points[s:e] @ xt.points[at].T
        scores[qt.ids[s:e, None] == xt.ids[None, at]] = lowest
        both = np.concatenate([best_score[rows], scores], 1)
        ids = np.concatenate([best_id[rows], np.broadcast_to(xt.ids[at], scores.shape)], 1)
        kth = np.partition(both, -top, axis=1)[:, -top]
        r, c = np.nonzero(both >= kth[:, None])  # all that tie with the kth, too
        score = both[r, c]
        ident = np.where(score == lowest, np.iinfo(np.int64).max, ids[r, c])
        by = np.lexsort((ident, ~score if exact else -score, r))
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = place < top
        best_score[rows[r[first]], place[first]] = score[by][first]
        best_id[rows[r[first]], place[first]] = ident[by][first]

    def open_nodes(nodes: np.ndarray) -> np.ndarray:
        return np.array([c for n in nodes for c in (xt.children[n] or [n])], np.int64)

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        nodes, ub = alive(q, nodes)
        if qt.children[q]:
            if len(nodes):
                nodes = open_nodes(nodes)
                todo += [(c, nodes) for c in qt.children[q]]
            continue
        while any(xt.children[n] for n in nodes):
            nodes, ub = alive(q, open_nodes(nodes))
        by, room = np.argsort(-ub, kind="stable"), FIRST_ROWS
        nodes = nodes[by]
        while len(nodes):  # leaves by falling bound, a few first, then as many as ROWS rows
            nodes, _ = alive(q, nodes)
            take = max(1, int(np.searchsorted(np.cumsum(sizes[nodes]), room, "right")))
            if len(nodes):
                base(q, nodes[:take])
            nodes, room = nodes[take:], min(4 * room, ROWS)
    return np.where(best_score == lowest, -1, best_id), best_score


def top_k(vectors: DataFrame, every: int = 50, top: int = TOP, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``top`` rows for each query.

    A component x counts as floor(scale * x).  Queries are the rows whose vec_id
    is divisible by ``every``; candidates are all rows with another vec_id.
    Queries and data are dealt into blocks of about ``block`` rows by a digest of
    the id, so that no group of equal vectors meets in one block; each pair of
    blocks is one task, which searches two trees, and a query keeps ``top`` rows
    of each data block, so the merge gets top x blocks rows per query.  Rows with
    a null id, a null vector or a null or non-finite component take no part;
    equal rows count once; vectors meet only vectors of their own length; extra
    columns are ignored; an empty table gives no rows.  Scores are exact whatever the
    components; where a squared norm reaches 2**62, so that a long might not hold
    one, it is an error.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.filter("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    v = v.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale)).alias("x")).withColumn("dim", F.size("x")).dropDuplicates(["vec_id", "x"])
    n, longest = v.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))).first()
    if (longest or 0.0) >= 2.0**62:
        raise ValueError("inner products of these vectors don't fit a long")
    data_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * block)))
    data = v.withColumn("data_block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(data_blocks)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = v.filter(F.col("vec_id") % every == 0).withColumn("query_block", F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("data_block", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))))
    keys = ["dim", "query_block", "data_block"]

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        stack = lambda c: np.array(c.tolist(), np.float64).reshape(len(c), -1)
        ids, scores = search(stack(q["x"]), q["vec_id"].to_numpy(), stack(x["x"]), x["vec_id"].to_numpy(), top)
        found = np.isfinite(scores) & (scores > np.iinfo(np.int64).min)
        return pd.DataFrame({"query_id": np.repeat(q["vec_id"].to_numpy(), found.sum(1)), "vec_id": ids[found], "score": scores[found].astype(np.int64)})

    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""
