"""Hard negatives by an inverted multi-index.

A vector is cut into two halves, and each half has a codebook of its own (k-means
over a bounded sample).  A cell holds the vectors whose halves are nearest to one
word of either codebook.  A query's inner product with any vector of a cell is at
most the sum of two half scores,

    q1 . c1 + |q1| r1  +  q2 . c2 + |q2| r2,

with r the largest distance of the cell's vectors from the word.  The
multi-sequence heap visits cells by this bound, largest first, so whatever it has not
visited scores no more than the next cell's bound.  A search stops when that certifies
its window: all its places are taken by scores above the bound, or the bound lies below
the window.  So the index never changes the result, only how much is read.

Rows are dealt out by a hash of their id into shards of about ``shard_rows``, each
with an index of its own; every anchor is asked of every shard, and the best of the
shards are merged.  Copies of one vector are spread over the shards like any others.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspark.llm.common import bucket_below, only

#: Sampled vectors that the codebooks are fitted on, rounds of k-means, words of a codebook.
SAMPLE, ROUNDS, WORDS = 4_096, 8, 32
#: Rows of a shard; anchors of a group; rows compared at a time (visited cells are put together so far).
SHARD_ROWS, ANCHORS, TOGETHER = 50_000, 20_000, 512
#: Positives of an anchor, negatives of a pair.
POSITIVES, NEGATIVES = 5, 5


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x): the vectors that take part, with components floor(256 x)."""
    d = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & d.isNotNull() & (F.size(d) > 0) & F.forall(
        d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.pmod(F.col(vec_id), F.lit(7)) == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    rows = only(vectors, vec_id, embedding, label).where(fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), moved.cast("long").alias("label"),
                       F.transform(d, lambda x: F.floor(x * 256).cast("double")).alias("x"))


def by_dimension(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and the matrix of the vectors of each dimension in an Arrow table."""
    ids, labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
    x = t.column("x").combine_chunks()
    if isinstance(x, pa.ChunkedArray):
        x = x.chunk(0)
    dims, values = x.value_lengths().to_numpy(), x.flatten().to_numpy()
    ends = np.cumsum(dims)
    return {int(d): (ids[m], labels[m], values[(ends[m] - d)[:, None] + np.arange(d)])
            for d in np.unique(dims) for m in [dims == d]}


def codebooks(rows: DataFrame, *, sample: int = SAMPLE, words: int = WORDS, rounds: int = ROUNDS) -> dict[int, tuple]:
    """For each dimension two arrays of words, fitted on at most about ``sample`` vectors
    chosen by a hash of their id."""
    drawn = rows.where(bucket_below(F.col("vec_id"), sample, rows.count())).toArrow()
    rng, out = np.random.default_rng(13), {}
    for dim, (_, _, x) in by_dimension(drawn).items():
        out[dim] = tuple(_kmeans(h, min(words, len(x)), rounds, rng) for h in (x[:, :dim // 2], x[:, dim // 2:]))
    return out


def _kmeans(x: np.ndarray, words: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:words]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=words)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


class MultiIndex:
    """Vectors of one dimension by cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple):
        half = x.shape[1] // 2
        self.books, self.half = books, half
        near = [_nearest(h, c) for h, c in zip((x[:, :half], x[:, half:]), books)]
        words = len(books[1])
        by = np.lexsort((ids, near[0] * words + near[1]))
        self.ids, self.labels, self.x = ids[by], labels[by], x[by]
        cell = (near[0] * words + near[1])[by]
        self.cells, start = np.unique(cell, return_index=True)
        self.start = np.append(start, len(cell))
        # distances of the members from the words, per word: the radii that hold for all its cells
        self.radius = []
        for h, c, n in zip((x[:, :half], x[:, half:]), books, near):
            r = np.zeros(len(c))
            np.maximum.at(r, n, np.sqrt(((h - c[n]) ** 2).sum(1)))
            self.radius.append(r * (1 + 1e-9) + 1e-6)
        place = np.full(len(books[0]) * words, -1)
        place[self.cells] = np.arange(len(self.cells))
        self.place = place.reshape(len(books[0]), words)
        self.used = [np.flatnonzero((self.place >= 0).any(1)), np.flatnonzero((self.place >= 0).any(0))]

    def visits(self, q: np.ndarray, together: int):
        """(rows, bound): rows of the cells by falling bound, some cells at a time, and a
        bound on the scores of all rows not yet given (-inf in the end)."""
        sides = []
        for part, c, r, used in zip((q[:self.half], q[self.half:]), self.books, self.radius, self.used):
            b = c[used] @ part + np.sqrt(part @ part) * r[used]
            by = np.argsort(-b, kind="stable")
            sides.append((b[by].tolist(), used[by].tolist()))
        (b1, w1), (b2, w2) = sides
        slack = 1e-9 * (abs(b1[0]) + abs(b2[0]) + abs(b1[-1]) + abs(b2[-1])) + 1e-6
        heap, found, size = [(-(b1[0] + b2[0]), 0, 0)], [], 0
        # multi-sequence: (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0)
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b2):
                heapq.heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(b1):
                heapq.heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))
            at = self.place[w1[i], w2[j]]
            if at >= 0:
                found.append(np.arange(self.start[at], self.start[at + 1]))
                size += len(found[-1])
            if found and (size >= together or not heap):
                yield np.concatenate(found), (-heap[0][0] + slack) if heap else -np.inf
                found, size = [], 0

    def positives(self, anchor: int, label: int, q: np.ndarray, top: int, together: int = TOGETHER) -> list[tuple[int, int]]:
        """The ``top`` other rows of the label by (score falling, id)."""
        best: list[tuple[float, int]] = []
        for rows, bound in self.visits(q, together):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != anchor)]
            best = sorted(best + list(zip((-(self.x[rows] @ q)).tolist(), self.ids[rows].tolist())))[:top]
            if len(best) == top and -best[-1][0] > bound:
                break
        return [(i, int(-s)) for s, i in best]

    def negatives(self, label: int, q: np.ndarray, scores: list[int], top: int, together: int = TOGETHER) -> list[list[tuple[int, int]]]:
        """For each positive score p the ``top`` rows of other labels with 0.8 p <= score <= p,
        by (score falling, id)."""
        best: list[list[tuple[float, int]]] = [[] for _ in scores]
        todo = set(range(len(scores)))
        for rows, bound in self.visits(q, together):
            rows = rows[self.labels[rows] != label]
            s, ids = self.x[rows] @ q, self.ids[rows]
            for k in list(todo):
                p = scores[k]
                fit = np.flatnonzero((100 * s >= 80 * p) & (s <= p))
                if len(fit):
                    best[k] = sorted(best[k] + list(zip((-s[fit]).tolist(), ids[fit].tolist())))[:top]
                if 100 * bound < 80 * p or len(best[k]) == top and -best[k][-1][0] > bound:
                    todo.discard(k)
            if not todo:
                break
        return [[(i, int(-s)) for s, i in b] for b in best]


def hard_negatives(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 100,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE, words: int = WORDS,
                   shard_rows: int = SHARD_ROWS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its
    first ``positives`` other rows of the same label; for each of them the first
    ``negatives`` rows of other labels with a score from 0.8 of the positive's score to all
    of it, rank 1 first.  Scores are inner products of the components floor(256 x); larger
    scores come first, equal ones by smaller id.  They are whole numbers and exact below 2^53.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part; vectors are compared within their dimension.  An id that
    occurs several times counts once, as its row with the smallest (label, vector).  A positive without rows in
    its window (always so where its score is negative) gives no rows.  Other columns
    are left aside; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id=vec_id, embedding=embedding, label=label)
    shards = max(1, -(-rows.count() // shard_rows))
    books = spark.sparkContext.broadcast(codebooks(rows, sample=sample, words=words))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    asked = asked.select(F.col("vec_id").alias("anchor_id"), "row.label", "row.x")
    groups = max(1, -(-rows.count() // (every * anchors)))

    def to_shards(d: DataFrame) -> DataFrame:
        """Anchors in groups, each sent to every shard: the stated query set against all rows."""
        d = d.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int"))
        return d.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    copies = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def indexes(t: pa.Table) -> dict[int, MultiIndex]:
        out = {}
        for dim, (ids, labels, x) in by_dimension(t).items():
            kept = np.lexsort((*x.T[::-1], labels, ids))
            kept = kept[np.append(True, np.diff(ids[kept]) != 0)]
            plain = tuple(np.zeros((1, n)) for n in (dim // 2, dim - dim // 2))
            out[dim] = MultiIndex(ids[kept], labels[kept], x[kept], books.value.get(dim, plain))
        return out

    def find_positives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        index, out = indexes(left), []
        for a, l, x in zip(*(right.column(c).to_pylist() for c in ("anchor_id", "label", "x"))):
            if len(x) in index:
                out += [(a, i, s) for i, s in index[len(x)].positives(a, l, np.array(x), positives)]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["anchor_id", "positive_id", "positive_score"])

    def find_negatives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        index, out = indexes(left), []
        for a, l, x, found in zip(*(right.column(c).to_pylist() for c in ("anchor_id", "label", "x", "found"))):
            if len(x) in index:
                got = index[len(x)].negatives(l, np.array(x), [f["positive_score"] for f in found], negatives)
                out += [(a, f["positive_id"], f["positive_score"], i, s) for f, g in zip(found, got) for i, s in g]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=names)

    def ask(d: DataFrame, how, schema: str) -> DataFrame:
        return copies.groupBy("shard", "block").cogroup(to_shards(d).groupBy("shard", "block")).applyInArrow(how, schema)

    def first(d: DataFrame, of: list[str], score: str, name: str, n: int) -> DataFrame:
        w = Window.partitionBy(*of).orderBy(F.desc(score), name)
        return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    near = ask(asked, find_positives, "anchor_id long, positive_id long, positive_score long")
    near = first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    with_positives = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))
    hard = ask(asked.join(with_positives, "anchor_id"), find_negatives,
               "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    hard = first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
WHERE rank <= {NEGATIVES}"""
