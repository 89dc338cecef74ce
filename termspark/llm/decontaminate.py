"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is a short set Q of word shingles, a document a set D that may be
thousands of times larger, so the Jaccard similarity of the two says nothing
and MinHash is applied to containment instead.  Items are partitioned by their
size.  An item's sketch is the bottom of its shingles in MinHash order; the
sketch length follows from its size class: with at most ``slack`` = |Q| -
ceil(t|Q|) shingles absent, any document that contains a share t of Q holds at
least ``need`` of the ``slack + need`` smallest.  Documents are probed with the
sketches alone, and a document that reaches ``need`` hits of an item is verified
by exact shingle containment.  The bound is deterministic: no match is lost.

Items go to the tasks in blocks of bounded size, each of which passes over the
documents once; the documents are never shuffled.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import WordHash, doc_words, keep_rows, mix64, only, shingle_hashes, slices

#: Shingles of test items that go to the tasks at once (8 bytes each).
BLOCK_SHINGLES = 1_000_000
#: Sketch hits asked of items with fewer shingles than the key's bound.
NEED = ((8, 1), (32, 2), (1 << 62, 4))


def item_sets(items: DataFrame, shingle: int = 5, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, k, shingles): the distinct shingle sets of the items; ``k`` words make
    a shingle, fewer than ``shingle`` where the item has fewer."""

    def run(batches):
        seen = WordHash()
        for b in batches:
            words = [doc_words(t) for t in b.column(1).to_pylist()]
            sets = [shingle_hashes(w, seen, shingle) for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([min(len(w), shingle) for w in words], pa.int32()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "n", "k", "shingles"])

    rows = only(items, item_id, text).select(
        F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("t"))
    return (rows.mapInArrow(run, "item_id long, n long, k int, shingles binary")
            .where("n > 0").dropDuplicates(["item_id", "shingles"]))


def short_shingles(words: list[bytes], seen: WordHash, k: int) -> np.ndarray:
    """The distinct runs of ``k`` words, each hashed as an item of these words alone."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    acc = np.full(len(h) - k + 1, k, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        acc = mix64(acc ^ h[i:len(acc) + i])
    return np.unique(acc)


class Sketches:
    """The sketches of one block of items, by size class, and the exact sets."""

    BITS = 20

    def __init__(self, rows: list[tuple[int, bytes, int]], percent: int, shingle: int = 5):
        self.short = sorted({r[2] for r in rows} - {shingle})  # numbers of words of items that are one shingle
        self.ids = [r[0] for r in rows]
        self.sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.least = [-(-percent * len(s) // 100) for s in self.sets]
        keys, owner, self.need = [], [], np.empty(len(rows), np.int64)
        for i, s in enumerate(self.sets):
            need = min(next(k for bound, k in NEED if len(s) < bound), self.least[i])
            order = s[np.argsort(mix64(s ^ np.uint64(0xA5A5A5A5)), kind="stable")]
            sketch = order[:len(s) - self.least[i] + need]
            self.need[i] = need
            keys.append(sketch)
            owner.append(np.full(len(sketch), i))
        k, o = np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(owner or [np.empty(0, np.int64)])
        by = np.argsort(k, kind="stable")
        self.keys, self.owner = k[by], o[by]
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def matches(self, words: list[bytes], seen: WordHash, shingle: int) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, shared) of the items it contains."""
        s = shingle_hashes(words, seen, shingle)
        if self.short:
            s = np.unique(np.concatenate([s, *[short_shingles(words, seen, k) for k in self.short]]))
        probe = s[self.some[(s >> np.uint64(64 - self.BITS)).astype(np.int64)]]
        if not len(probe):
            return []
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        got = [self.owner[x:y] for x, y in zip(lo, hi) if y > x]
        if not got:
            return []
        item, hits = np.unique(np.concatenate(got), return_counts=True)
        out = []
        for i in item[hits >= self.need[item]]:
            q = self.sets[i]
            at = np.minimum(np.searchsorted(s, q), len(s) - 1)
            shared = int((s[at] == q).sum())
            if shared >= self.least[i]:
                out.append((self.ids[i], len(q), shared))
        return out


def _blocks(items: DataFrame, percent: int, shingle: int, item_id: str, text: str, block: int):
    """The sketches, block by block; each block is bounded, their number grows."""
    sets = item_sets(items, shingle, item_id, text)
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / block))
    for k in range(parts):
        part = sets if parts == 1 else sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(parts)) == k)
        rows = [(r["item_id"], bytes(r["shingles"]), r["k"]) for r in part.select("item_id", "shingles", "k").collect()]
        if rows:
            yield items.sparkSession.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))), percent


def contaminated(docs: DataFrame, items: DataFrame, *, percent: int = 75, shingle: int = 5,
                 doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                 block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each document row and test item it contains:
    (doc_id, item_id, n_item, n_shared, containment).

    An item is contained when at least ``percent`` % of its distinct
    ``shingle``-word shingles occur in the document.  Words are lower-cased
    runs without white space.  An item of fewer words is one shingle, which a
    document holds that has these words in a row; null or blank items and
    documents match nothing; items repeated under one id count once; a null id
    stays null; other columns of either table are left aside.  No items, or no
    documents, give no rows.
    """
    rows = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    out = None
    for sent, pct in _blocks(items, percent, shingle, item_id, text, block):

        def run(batches, sent=sent, pct=pct):
            index, seen = Sketches(sent.value, pct, shingle), WordHash()
            for b in slices(batches):
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                         for m in index.matches(doc_words(t), seen, shingle)]
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "item_id", "n_item", "n_shared"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _free_of(sent, percent: int, shingle: int):
    """For keep_rows: texts that hold none of the items of one block."""

    def start():
        index, seen = Sketches(sent.value, percent, shingle), WordHash()
        return lambda texts: [not index.matches(doc_words(t), seen, shingle) for t in texts]

    return start


def decontaminate(docs: DataFrame, items: DataFrame, *, percent: int = 75, shingle: int = 5,
                  item_id: str = "item_id", text: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no test item (see
    :func:`contaminated`); rows without text stay, repeated rows stay or go
    together, columns may have any name; no items leave the table as it is."""
    for sent, pct in _blocks(items, percent, shingle, item_id, text, block):
        docs = keep_rows(docs, text, _free_of(sent, pct, shingle))
    return docs
