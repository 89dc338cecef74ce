"""Character grams by sorted suffixes.

One row for each start of a piece, not one for each start and length: the characters from
there on, the character before.  A range partitioning and a sort put equal prefixes side by
side, so a gram is a run of rows, and all of its occurrences lie in one batch of rows or
in batches that touch.  A run inside a batch is complete and gives its entropies at once;
the runs at a batch's ends, a few of each length, give context counts that a second,
small aggregation adds up.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import sql_str
from termspark.session import materialize

_OUT = "gram string, side int, ctx string, c long, freq long, left double, right double"


def starts(pieces: DataFrame, piece_col: str = "piece", max_len: int = 4, boundary: str = K.BOUNDARY, weight: str = "n") -> DataFrame:
    """(s, prev, n): for each character of a piece, up to ``max_len`` characters from it on
    (``boundary`` counts as one at the end), the character before it and the piece's weight.
    The grams are the proper prefixes of ``s``."""
    b = sql_str(boundary)
    padded = pieces.select(weight, F.expr(f"concat({b}, {piece_col}, {b})").alias("_p"))
    each = padded.select(weight, "_p", F.explode(F.expr("sequence(2, greatest(length(_p) - 1, 2))")).alias("_i")).where("length(_p) > 2")
    return each.select(F.expr(f"substring(_p, _i, {max_len})").alias("s"), F.expr("substring(_p, _i - 1, 1)").alias("prev"), F.col(weight).alias("n"))


def _numbered(values: list[str]) -> tuple[np.ndarray, list[str]]:
    names: dict[str, int] = {}
    return np.fromiter((names.setdefault(v, len(names)) for v in values), np.int64, len(values)), list(names)


def _runs(s: list[str], prev: list[str], n: np.ndarray, max_len: int) -> list[tuple]:
    """The rows of _OUT for sorted starts: complete runs, and the contexts of those at the ends."""
    out, before = [], _numbered(prev)
    for k in range(1, max_len):
        rows = [i for i, x in enumerate(s) if len(x) > k]
        if not rows:
            continue
        grams, at = [s[i][:k] for i in rows], np.array(rows)
        run = np.cumsum([0] + [a != b for a, b in zip(grams, grams[1:])])
        first = np.flatnonzero(np.diff(run, prepend=-1))
        weight, freq = n[at], np.bincount(run, weights=n[at]).astype(np.int64)
        entropy, counts = [], []
        for ctx, names in ((before[0][at], before[1]), _numbered([s[i][k] for i in rows])):
            pair, inverse = np.unique(run * len(names) + ctx, return_inverse=True)
            c = np.bincount(inverse, weights=weight).astype(np.int64)
            of, logs = pair // len(names), c * np.log2(c)
            entropy.append((freq * np.log2(freq) - np.bincount(of, weights=logs)) / freq)
            counts.append((of, pair % len(names), c, names))
        ends = {0, int(run[-1])}
        # shorter starts are no rows of this length, so a run beside one may reach into the next batch
        out += [(grams[f], None, None, None, int(freq[r]), float(entropy[0][r]), float(entropy[1][r]))
                for r, f in enumerate(first.tolist()) if r not in ends]
        for side, (of, ctx, c, names) in enumerate(counts):
            for j in np.flatnonzero((of == 0) | (of == run[-1])).tolist():
                out.append((grams[first[of[j]]], side, names[ctx[j]], int(c[j]), None, None, None))
    return out


def suffix_entropies(at: DataFrame, max_len: int = 4, partitions: int | None = None) -> DataFrame:
    """A17 + A18 from :func:`starts`: (gram, freq, left, right), the frequency and plain Shannon
    entropy (bits) of the previous and the next character, the boundary an ordinary
    symbol, for grams of up to ``max_len - 1`` characters."""
    by = [partitions] if partitions else []
    lined = at.select("s", "prev", "n").repartitionByRange(*by, "s").sortWithinPartitions("s")

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in batches:
            rows = _runs(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), max_len)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in _OUT.split(", ")])

    found = materialize(lined.mapInArrow(run, _OUT))
    whole = found.where("side is null").select("gram", "freq", "left", "right")
    counts = found.where("side is not null").groupBy("gram", "side", "ctx").agg(F.sum("c").alias("c"))
    logs = F.col("c") * F.log2("c")
    ends = counts.groupBy("gram").agg(F.sum(F.when(F.col("side") == 0, F.col("c"))).alias("freq"),
                                      F.sum(F.when(F.col("side") == 0, logs)).alias("_l"), F.sum(F.when(F.col("side") == 1, logs)).alias("_r"))
    t = F.col("freq").cast("double")
    return whole.unionByName(ends.select("gram", "freq", ((t * F.log2(t) - F.col("_l")) / t).alias("left"), ((t * F.log2(t) - F.col("_r")) / t).alias("right")))
