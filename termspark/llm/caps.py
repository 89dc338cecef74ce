"""Embedding near duplicates by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product reaches
``alpha``.  The directions form structured random product codes: the space is
rotated at random and cut into three blocks, each block has ``words`` random unit
code words, and a direction is one word of each block, so ``words ** 3`` directions
need only ``3 * words`` inner products.  List decoding goes block by block and keeps a
prefix while the best remaining words could still reach ``alpha``, which finds all
filters that a vector exceeds.  Several codes with rotations of their own even out
how many filters a vector gets.

Vectors that share a filter are compared exactly (cosine in double precision).
A pair that meets in several filters counts in the first of them alone, so each
filter's task reports counts for each vector and a spanning forest of its links,
never the pairs.  Equal vectors are one node with a multiplicity; a filter with
very many vectors is compared block by block.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspark.llm.common import materialize, only
from termspark.llm.graph import components, forest

#: Independent codes, filters that a vector passes on average in each, vectors meant for a filter.
CODES, LISTED, LOAD = 8, 5.0, 128
#: Vectors of a filter compared in one task.
CHUNK = 2048
#: Busy filters up to this number (some 30 bytes each) go to the tasks as a broadcast; more are joined by shuffle.
BROADCAST_FILTERS = 200_000
#: Filters asked of a vector at least in each code (its best ones, where fewer exceed alpha).
LEAST = 2


def cap_height(dim: int, share: float) -> float:
    """alpha for which a random direction of ``dim`` dimensions has an inner product of at
    least alpha with a given one with probability ``share``: the cap's share of the sphere."""
    t = np.linspace(-1, 1, 200_001)[1:-1]
    density = np.exp((dim - 3) / 2 * np.log1p(-t * t))
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    if dim == 1:
        return 0.5  # one of two directions
    return float(t[np.searchsorted(-above, -share)]) if share < 1 else -1.0


class ProductCode:
    """One rotation and the code words of its blocks, the same on every machine."""

    def __init__(self, dim: int, words: int, seed: int, listed: float):
        rng = np.random.default_rng([seed, dim, words])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut = np.array_split(np.arange(dim), min(3, dim))
        self.words = []
        for block in self.cut:
            w = rng.standard_normal((words, len(block)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(self.cut)))
        self.size = words ** len(self.cut)
        self.alpha = cap_height(dim, min(1.0, listed / self.size))

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, b] @ w.T for b, w in zip(self.cut, self.words)]

    @staticmethod
    def _sums(parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0]
        for p in parts[1:]:
            out = (out[:, :, None] + p[:, None, :]).reshape(len(p), -1)
        return out

    def decode(self, x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row exceeds, and of its best ``least``
        filters (alpha falls to the ``least``-th best for a row with fewer)."""
        parts = self._products(x)
        top = [np.sort(p, axis=1)[:, ::-1][:, :least] for p in parts]
        best = np.sort(self._sums(top), axis=1)[:, ::-1]
        bound = np.minimum(self.alpha, best[:, min(least, best.shape[1]) - 1]) - 1e-12
        rest = np.zeros((len(parts) + 1, len(x)))
        for k in range(len(parts) - 1, -1, -1):
            rest[k] = rest[k + 1] + parts[k].max(1)
        rows, code, have = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, p in enumerate(parts):
            grown = have[:, None] + p[rows]
            r, c = np.nonzero(grown + rest[k + 1][rows][:, None] >= bound[rows][:, None])
            rows, code, have = rows[r], code[r] * p.shape[1] + c, grown[r, c]
        return rows, code


def _met_before(a: list[np.ndarray], b: list[np.ndarray], filter_id: int, wide: int = 4096) -> np.ndarray:
    """Which pairs of the two lists of rows share a filter before ``filter_id``, from the
    sorted filters of each row: one matrix product for each ``wide`` of the filters that occur."""
    cut = [[s[:np.searchsorted(s, filter_id)] for s in side] for side in (a, b)]
    flat = [np.concatenate(side) for side in cut]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in cut]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(both), wide):
        part, has = both[lo:lo + wide], []
        for f, o, n in zip(flat, owner, (len(a), len(b))):
            at = np.minimum(np.searchsorted(part, f), len(part) - 1)
            same = part[at] == f
            x = np.zeros((n, len(part)), np.float32)
            x[o[same], at[same]] = 1
            has.append(x)
        out |= has[0] @ has[1].T > 0
    return out


def _codes(dim: int, words: int, codes: int, listed: float) -> list[ProductCode]:
    return [ProductCode(dim, words, seed, listed) for seed in range(codes)]


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least_cosine: float = 0.95,
                 codes: int = CODES, listed: float = LISTED, load: int = LOAD) -> DataFrame:
    """One row per vector row: (vec_id, n_links, component_id, kept).

    Vectors with a cosine of at least ``least_cosine`` (double precision) that share a
    filter are linked; n_links counts the other rows linked directly, component_id is
    the smallest vec_id reachable, itself included.  A vector that is null, empty or
    zero, or that holds a null or non-finite component, is linked with nothing; vectors
    of unlike length are never linked; a null vec_id takes part but is never the
    smallest (alone, its component is null and it counts as kept); repeated ids are
    rows of their own.  Labels and other columns are left aside; an empty table gives
    no rows.
    """
    kind = vectors.schema[embedding].dataType
    size = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8
    number = np.float32 if size == 4 else np.float64

    def clean(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array(v, number) if v and None not in v else None
                good = x is not None and np.isfinite(x).all() and (x != 0).any()
                out.append((x + number(0)).tobytes() if good else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = only(vectors, vec_id, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    rows = rows.mapInArrow(clean, "vec_id long, v binary") \
        .select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    rows = materialize(rows)
    nodes = materialize(rows.where("v is not null").groupBy("h1", "h2").agg(
        F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    words = max(8, math.ceil((n * listed / load) ** (1 / 3)))

    def listing(batches, whole=True):
        known: dict[int, list[ProductCode]] = {}
        for b in batches:
            ids, raw, m = (b.column(k).to_pylist() for k in range(3))
            by: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by.setdefault(len(v) // size, []).append(i)
            for dim, at in by.items():
                if dim not in known:
                    known[dim] = _codes(dim, words, codes, listed)
                for lo in range(0, len(at), 512):
                    part = at[lo:lo + 512]
                    x = np.frombuffer(b"".join(raw[i] for i in part), number).reshape(len(part), dim).astype(np.float64)
                    x = x / np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = [(r, c + k * code.size) for k, code in enumerate(known[dim]) for r, c in [code.decode(x)]]
                    r, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    order = np.lexsort((c, r))
                    r, c = r[order], c[order]
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim), pa.int32()), pa.array(c, pa.int64())], ["dim", "filter"])
                        continue
                    cut = np.searchsorted(r, np.arange(len(part) + 1))
                    lists = [c[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(r), dim), pa.int32()), pa.array(c, pa.int64()),
                        pa.array([ids[part[k]] for k in r], pa.int64()), pa.array([m[part[k]] for k in r], pa.int64()),
                        pa.array([raw[part[k]] for k in r], pa.binary()), pa.array([lists[k] for k in r], pa.binary())],
                        ["dim", "filter", "node", "m", "v", "lists"])

    listed_rows = nodes.select("node", "v", "m").mapInArrow(
        listing, "dim int, filter long, node long, m long, v binary, lists binary")
    busy = materialize(nodes.select("node", "v", "m").mapInArrow(lambda batches: listing(batches, False), "dim int, filter long")
            .groupBy("dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
            .withColumn("k", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n"))
    # while they are few, a broadcast spares the vectors a second exchange
    few = busy.count() <= BROADCAST_FILTERS
    blocks = listed_rows.join(F.broadcast(busy) if few else busy, ["dim", "filter"], "left").withColumn("k", F.coalesce("k", F.lit(1))) \
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))) \
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def compare(key, t):
        filter_id = key[1].as_py()
        i, j = key[2].as_py(), key[3].as_py()
        node, m = np.array(t.column("node")), np.array(t.column("m"))
        mine = np.array(t.column("mine"))
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), number).reshape(len(node), -1).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = [np.frombuffer(s, np.int32) for s in t.column("lists").to_pylist()]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, pa_, pb_ = np.zeros(len(node), np.int64), [], []
        step = max(1, 4_000_000 // max(1, len(right)))
        for s in range(0, len(left), step):
            rows_ = left[s:s + step]
            hit = x[rows_] @ x[right].T >= least_cosine
            if i == j:
                hit &= rows_[:, None] < right[None, :]
            if not hit.any():
                continue
            u, v = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            some = hit[np.ix_(u, v)]
            u, v = rows_[u], right[v]
            some &= ~_met_before([lists[k] for k in u], [lists[k] for k in v], filter_id)
            links[u] += some @ m[v]
            links[v] += m[u] @ some
            p, q = np.nonzero(some)
            pa_.append(u[p])
            pb_.append(v[q])
        a = np.concatenate(pa_) if pa_ else np.empty(0, np.int64)
        b = np.concatenate(pb_) if pb_ else np.empty(0, np.int64)
        edges = forest(node[a], node[b]) if len(a) else []
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], np.array([e[0] for e in edges], np.int64)]), pa.int64()),
            "b": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]), pa.int64())})

    # dealt out by block: the join above may have left all blocks of a filter in one place
    found = materialize(blocks.select("dim", "filter", "i", "j", "mine", "node", "m", "v", "lists").repartition("dim", "filter", "i", "j")
                        .groupBy("dim", "filter", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b").distinct())
    whole = nodes.select("h1", "h2", "node", "m", "low").join(counts, "node", "left").join(comp, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    smallest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    named = whole.join(smallest, "component").select(
        "h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("good"))
    good, bad = rows.where("v is not null"), rows.where("v is null")
    return (good.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
            .union(bad.select("vec_id", F.lit(0).cast("long"), "vec_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
