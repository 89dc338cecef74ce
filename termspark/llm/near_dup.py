"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

SuperMinHash draws for every shingle one random permutation of the signature
positions; the shingle offers position ``perm[j]`` the value ``j + r_j`` with r_j
uniform in [0, 1).  The ranks of one shingle are correlated (each occurs once),
which lowers the variance below that of independent minima, and a document is
finished after the round j in which every position has a value: all later values
are larger.  Long documents stop after the first round.

Steps, all of them joins and aggregates over small rows:

1. signature, band keys and a 128-bit fingerprint of each document's exact
   shingle set; equal sets become one node, so copies cost one row;
2. band keys meet; each bucket has a center (its smallest node), and members
   are paired with centers, never with each other: pairs grow with the rows;
3. pairs whose signatures agree on less than ``floor`` of the positions are
   left out (0.6 against 0.75 is 4.9 standard deviations of the estimate), the
   center that a node meets most often is confirmed on the full sets, and a
   union-find over these links gives the first components;
4. a bucket with members outside its center's component is compared block by
   block, each such member against all members of other components, on the full
   sets, so a link that does not run over a center is found too; a task reports
   what its links connect, not all pairs.

With 40 bands of 5 values a pair at exactly 0.75 is missed with probability
2e-5; nothing is capped or sampled.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspark.llm.common import WordHash, doc_words, materialize, mix64, only, set_hash, shingle_hashes, slices
from termspark.llm.graph import components, forest

BANDS, ROWS, FLOOR = 40, 5, 0.6
#: Candidate documents up to this count travel to the scans as a broadcast list of ids; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Pairs whose texts meet in one task.
PAIRS_A_TASK = 256
#: Members of a bucket in a part of it, and their shingles; shingles that a task compares.
CHUNK, CHUNK_SHINGLES, TASK_SHINGLES = 1024, 1_000_000, 3_000_000
#: Shingles of a numpy batch (more if one document has more).
BATCH_ELEMENTS = 60_000


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row per set) of ``m`` <= 256 values rank << 32 | random."""
    sig = np.full((len(sets), m), np.uint64((1 << 64) - 1), np.uint64)
    if not sets or not sum(map(len, sets)):
        return sig
    flat, low = sig.reshape(-1), np.uint64(0xFFFFFFFF)
    el = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for j in range(m):
        x = mix64(el + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        k = j + ((x & low) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            at, k0 = k, k
        else:
            r = np.arange(len(el))
            at = perm[r, k].astype(np.int64)
            perm[r, k] = perm[r, j]
        np.minimum.at(flat, doc * m + at, (x >> np.uint64(32)) | np.uint64(j << 32))
        if j == m - 1:
            break
        busy = sig.max(1) >= np.uint64((j + 1) << 32)
        keep = busy[doc]
        if not keep.any():
            break
        if perm is None:  # swaps of round 0: position k0 now holds 0
            el, doc, k0 = el[keep], doc[keep], k0[keep]
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(el), m)).copy()
            perm[np.arange(len(el)), k0] = 0
            perm[:, 0] = k0
        elif keep.mean() < 0.7:
            el, doc, perm = el[keep], doc[keep], perm[keep]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros(len(sig), np.uint64)[:, None]
    for i in range(rows):
        acc = mix64(acc ^ part[:, :, i]) + np.uint64(i)
    return acc.view(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    """16 bits of each signature value, for the estimate."""
    return (mix64(sig) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, *, shingle: int = 5, bands: int = BANDS, rows: int = ROWS,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, fp, sig, bands) of each document row; node
    (a 64-bit name of the set) and what follows are null for an empty set."""
    m = bands * rows
    schema = "doc_id long, n_shingles long, node long, fp binary, sig binary, bands array<long>"

    def run(batches):
        seen = WordHash()
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(ids):
                sets, total, hi = [], 0, lo
                while hi < len(ids) and total < BATCH_ELEMENTS:
                    sets.append(shingle_hashes(doc_words(texts[hi]), seen, shingle))
                    total += len(sets[-1])
                    hi += 1
                sig = super_minhash(sets, m)
                key, brief = band_keys(sig, bands, rows), short(sig)
                fps = [set_hash(s) if len(s) else None for s in sets]
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int.from_bytes(f[:8], "little", signed=True) if f else None for f in fps], pa.int64()),
                    pa.array(fps, pa.binary()), pa.array([brief[i].tobytes() if x else None for i, x in enumerate(some)], pa.binary()),
                    pa.array([key[i] if x else None for i, x in enumerate(some)], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "fp", "sig", "bands"])
                lo = hi

    return only(docs, doc_id, text).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the signature positions on which two documents agree."""
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1) if len(a) else np.empty((0, 1))
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1) if len(b) else np.empty((0, 1))
    return pd.Series((x == y).mean(1))


def _texts(docs: DataFrame, nodes: DataFrame, reps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, t): one text for each node wanted, from the document rows with its id."""
    want = materialize(nodes.distinct().join(reps, "node").select("node", "rep"))
    if want.count() <= BROADCAST_IDS:
        want = F.broadcast(want)
    rows = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.join(want, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "t")


def _confirm(docs, pairs, reps, percent, shingle, doc_id, text) -> DataFrame:
    """The pairs (a, b) that are links by their full sets.  Centers stand in column b; a
    center of very many pairs is dealt out over as many keys as its pairs need."""
    texts = materialize(_texts(docs, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), reps, doc_id, text))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_A_TASK))
    keys = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("k"))
    left = pairs.join(keys, "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a") \
        .withColumn("salt", F.pmod(F.hash("a"), F.col("k"))).drop("k")
    right = keys.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")

    def run(batches):
        seen, last = WordHash(), (None, None)
        for batch in slices(batches):
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                if last[0] != b[i]:
                    last = (b[i], shingle_hashes(doc_words(tb[i]), seen, shingle))
                x, y = shingle_hashes(doc_words(ta[i]), seen, shingle), last[1]
                named = all(int.from_bytes(set_hash(s)[:8], "little", signed=True) == n for s, n in ((x, a[i]), (y, b[i])))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if named and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                              pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    # so many tasks that the texts of one task's pairs are a bounded number of Arrow bytes
    met = left.repartition(tasks, "b", "salt").join(right.repartition(tasks, "b", "salt"), ["b", "salt"]).select("a", "b", "ta", "tb")
    return met.mapInArrow(run, "a long, b long").distinct()


def _component_of(df: DataFrame, col: str, comp: DataFrame, out: str) -> DataFrame:
    return df.join(comp.select(F.col("node").alias(col), F.col("component").alias(out)), col, "left") \
        .withColumn(out, F.coalesce(out, col))


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    x = _component_of(_component_of(pairs, "a", comp, "ca"), "b", comp, "cb")
    return materialize(x.where("ca <> cb").select("a", "b"))


def _overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with all sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what one set alone holds is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[col]
    owner, col = owner[keep], place[col[keep]]
    by = np.argsort(col, kind="stable")
    owner, col = owner[by], col[by]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        x, y = np.searchsorted(col, [lo, lo + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[owner[x:y], col[x:y] - lo] = 1
        out += has[rows] @ has.T
    return out


def _mixed_buckets(docs, member, comp, reps, percent, shingle, doc_id, text) -> DataFrame:
    """Edges (a, b) that connect what links across components connect, from the buckets
    that hold several components.

    Members outside their center's component are compared with all members of other
    components, part by part, on their full sets, as in _confirm; a task reports a
    spanning forest over the links it finds.  Its edges need not be links themselves:
    they say what is connected and are not to be confirmed again.
    """
    pairs = member.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    out = _across(pairs, comp)
    mixed = member.join(out.select(F.col("a").alias("node"), F.col("b").alias("center"), F.lit(True).alias("out")), ["node", "center"], "left")
    split = mixed.where("out").groupBy("band").agg(F.lit(True).alias("x")).drop("x")
    mixed = mixed.join(split, "band").select("band", "node", F.coalesce("out", F.lit(False)).alias("out"))
    mixed = materialize(_component_of(mixed, "node", comp, "c"))
    texts = _texts(docs, mixed.select("node"), reps, doc_id, text)

    def hashes(batches):
        seen = WordHash()
        for b in slices(batches):
            sets = [(n, shingle_hashes(doc_words(t), seen, shingle)) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            sets = [(n, s) for n, s in sets if len(s) and int.from_bytes(set_hash(s)[:8], "little", signed=True) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["node", "hashes"])

    sets = materialize(texts.mapInArrow(hashes, "node long, hashes binary"))
    # Members outside their center's component lie in p parts, the others in q, of bounded members and
    # shingles.  A block compares one part of the outside members with itself and one part of the others
    # (kind 0), or with another part of the outside members (kind 1); l and r are its sides.
    sized = mixed.join(sets.select("node", (F.octet_length("hashes") / 8).alias("e")), "node")
    parts = sized.groupBy("band").agg(*[F.greatest(F.ceil(F.count_if(w) / CHUNK), F.ceil(F.sum(F.when(w, F.col("e")).otherwise(0)) / CHUNK_SHINGLES), F.lit(1))
                                        .cast("int").alias(n) for n, w in (("p", F.col("out")), ("q", ~F.col("out")))]).where("p > 1 or q > 1")
    placed = mixed.join(parts, "band", "left").na.fill(1, ["p", "q"]) \
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    blocks = F.expr("""if(out, concat(
            transform(sequence(0, q - 1), x -> named_struct('kind', 0, 'a', mine, 'b', x, 'l', true, 'r', x = 0)),
            transform(filter(sequence(0, p - 1), x -> x <> mine), x -> named_struct('kind', 1, 'a', least(mine, x), 'b', greatest(mine, x), 'l', mine < x, 'r', mine > x))),
        transform(sequence(0, p - 1), x -> named_struct('kind', 0, 'a', x, 'b', mine, 'l', false, 'r', true)))""")
    rows = placed.select("band", "node", "c", F.explode(blocks).alias("x")).select("band", "x.kind", "x.a", "x.b", "x.l", "x.r", "node", "c").join(sets, "node")
    copies = F.when(F.col("out"), F.col("p") + F.col("q") - 1).otherwise(F.col("p"))
    work = sized.join(parts, "band", "left").na.fill(1, ["p", "q"]).agg(F.sum(copies), F.sum(F.col("e") * copies)).first()
    tasks = max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(work[0] or 0) // 20_000), int((work[1] or 0) // TASK_SHINGLES))
    dealt = rows.repartition(tasks, "band", "kind", "a", "b").sortWithinPartitions("band", "kind", "a", "b")

    def compare(batches):
        def group(rows):
            l, r, node, c = (np.array([x[k] for x in rows]) for k in (4, 5, 6, 7))
            if not l.any() or (c == c[0]).all():
                return []
            sets = [np.frombuffer(x[8], np.uint64) for x in rows]
            size = np.array([len(x) for x in sets])
            left = np.flatnonzero(l)
            near = (c[left][:, None] != c[None, :]) & r[None, :]
            for at, both in enumerate(_overlaps(sets, left)):
                both = both.astype(np.int64)
                near[at] &= 100 * both >= percent * (size[left[at]] + size - both)
            p, q = np.nonzero(near)
            return forest(node[left[p]], node[q]) if len(p) else []

        held, key = [], None
        for b in slices(batches, 512):
            edges = []
            for r in zip(*(b.column(k).to_pylist() for k in range(9))):
                if r[:4] != key and held:
                    edges += group(held)
                    held = []
                key = r[:4]
                held.append(r)
            yield _edges(edges)
        if held:
            yield _edges(group(held))

    return materialize(dealt.select("band", "kind", "a", "b", "l", "r", "node", "c", "hashes").mapInArrow(compare, "a long, b long").distinct())


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, *, percent: int = 75, shingle: int = 5, bands: int = BANDS, rows: int = ROWS,
                    floor: float = FLOOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (doc_id, n_shingles, component_id, kept, node, group).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their
    distinct shingles (fewer words than ``shingle``: the whole sequence is the
    only one).  component_id is the smallest doc_id reachable over links, itself
    included.  A document without words (or with null text) is linked with
    nothing and is its own component; a null doc_id takes part but is never the
    smallest (alone, its component is null and it counts as kept); repeated
    ids are joined only by their texts.  ``node`` names the shingle set and ``group``
    the component (null: no words).  Other columns of ``docs`` are left aside; an
    empty table gives no rows.
    """
    s = materialize(signatures(docs, shingle=shingle, bands=bands, rows=rows, doc_id=doc_id, text=text))
    full = s.where("node is not null")
    reps = full.groupBy("node").agg(F.min("doc_id").alias("rep"))
    node = materialize(full.select("node", "sig", "bands").dropDuplicates(["node"]))

    keys = node.select("node", F.explode("bands").alias("band"))
    centers = keys.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("c")).where("c > 1").drop("c")
    member = materialize(keys.join(centers, "band"))
    sig = node.select("node", "sig")
    star = (member.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("met"))
            .join(sig, "node").join(sig.select(F.col("node").alias("center"), F.col("sig").alias("csig")), "center")
            .select(F.col("node").alias("a"), F.col("center").alias("b"), "met", _agreement("sig", "csig").alias("est"))
            .where(F.col("est") >= floor))
    best = Window.partitionBy("a").orderBy(F.desc("met"), F.desc("est"), "b")
    first = materialize(star.withColumn("r", F.row_number().over(best)).where("r = 1").select("a", "b"))
    links = materialize(_confirm(docs, first, reps, percent, shingle, doc_id, text))
    comp = components(links)

    # a center met less often is a member of a mixed bucket like any other; what the first
    # part of the buckets joins is not compared again in the others
    for part in (F.pmod("band", F.lit(8)) == 0, F.pmod("band", F.lit(8)) > 0):
        more = _mixed_buckets(docs, member.where(part), comp, reps, percent, shingle, doc_id, text)
        if more.take(1):
            links = links.union(more)
            comp = components(links)
    root = reps.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = root.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = root.join(smallest, "component").select("node", "component_id", F.col("component").alias("group"))
    return (s.select("doc_id", "n_shingles", "node").join(named, "node", "left")
            .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node", "group"))


def _named_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` plus ``_node``, the name of each row's shingle set (null: empty)."""

    at = docs.columns.index(text)

    def run(batches):
        seen = WordHash()
        for b in slices(batches):
            sets = [shingle_hashes(doc_words(t), seen, shingle) for t in b.column(at).cast(pa.binary()).to_pylist()]
            names = [int.from_bytes(set_hash(x)[:8], "little", signed=True) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], [*b.schema.names, "_node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))


def keep_one(docs: DataFrame, *, shingle: int = 5, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, when one row of each group of near duplicates
    stays: one with the smallest id (a group without ids: any of its rows).  Rows
    without words all stay.

    Only the rows whose id is touched (it goes, or stands for several rows) are
    looked at again; their ids travel as a broadcast up to BROADCAST_IDS of them and
    are joined by shuffle beyond.
    """
    names = docs.columns
    result = near_duplicates(docs, shingle=shingle, doc_id=doc_id, text=text, **how).where("node is not null")
    pairs = materialize(result.groupBy("group", "doc_id", "node").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("node").alias("k"))
    first = pairs.groupBy(F.col("group").alias("g")).agg(F.min(order).alias("f")).select("g", "f.i", "f.k")
    judged = materialize(pairs.join(first, F.col("group") == F.col("g")).select(
        "doc_id", "node", "n", (F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("k"))).alias("stays")))
    touched = materialize(judged.where("not stays or n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")).distinct())
    small = touched.count() <= BROADCAST_IDS
    ids = F.broadcast(touched) if small else touched
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    is_touched = F.col(i).cast("long").eqNullSafe(F.col("_id"))
    again = _named_sets(rows.join(ids, is_touched, "left_semi"), t, shingle)
    stay = judged.where("stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_n"))
    chosen = again.where("_node is not null").join(
        stay.join(ids.withColumnRenamed("_id", "_t"), F.col("_id").eqNullSafe(F.col("_t")), "left_semi"),
        is_touched & (F.col("_node") == F.col("_n")), "left_semi").dropDuplicates([i, "_node"])
    cols = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    return (rows.join(ids, is_touched, "left_anti").select(*cols)
            .union(again.where("_node is null").select(*cols)).union(chosen.select(*cols)))
