"""Frequency, neighbour entropy and cohesion.

Neighbour entropy is computed algebraically instead of holding a context map
per gram: for one side with total ``T`` (the gram frequency), non-edge
context counts ``c`` and an optional edge count ``e``

    H = -sum (c/T) log2(c/T) - log2(e/T)
      = (S0 * log2 T - S1) / T + [e present] (log2 T - log2 e)

with ``S0 = sum c`` and ``S1 = sum c*log2 c``.  So the job is two
aggregations: ``(gram, side, ctx) -> c`` and then ``gram -> (T, S0, S1, e)``,
both with map-side partial aggregation.  A gram that owns a third of all
occurrences spreads over its contexts in the first shuffle and costs one row
per map task in the second; no group ever holds a context map.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K


def gram_freq(occ: DataFrame, min_freq: int = K.COHESION_MIN_FREQ) -> DataFrame:
    """Occurrences per gram with the frequency floor."""
    f = occ.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    return f.where(F.col("freq") >= min_freq) if min_freq else f


def side_contexts(occ: DataFrame, flag: str | None = None) -> DataFrame:
    """A7 in long form: (gram, side, ctx, c) with side 0 = previous token,
    1 = next token; with ``flag`` also ``ca``, the occurrences where it is true."""
    cols = [flag] if flag else []
    sides = occ.select("gram", *cols, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("prev").alias("ctx")),
        F.struct(F.lit(1).alias("side"), F.col("next").alias("ctx")),
    )).alias("_x")).select("gram", "_x.side", "_x.ctx", *cols)
    more = [F.count_if(F.col(flag)).alias("ca")] if flag else []
    return sides.groupBy("gram", "side", "ctx").agg(F.count(F.lit(1)).alias("c"), *more)


def _side_entropy(s0, s1, e, t, edge_distinct: bool):
    logt = F.log2(t)
    base = (F.coalesce(s0, F.lit(0)).cast("double") * logt - F.coalesce(s1, F.lit(0.0))) / t
    if edge_distinct:
        # README variant: every edge occurrence is a distinct neighbour
        edge = F.when(e.isNotNull(), e.cast("double") / t * logt).otherwise(F.lit(0.0))
    else:
        edge = F.when(e.isNotNull(), logt - F.log2(e)).otherwise(F.lit(0.0))
    return base + edge


def context_entropy(occ: DataFrame | None, boundary: str = K.BOUNDARY, edge: str = "code",
                    ctx_counts: DataFrame | None = None, corpora: dict[str, str] | None = None,
                    sums: DataFrame | None = None) -> DataFrame:
    """A7+A8: per gram its frequency and left / right neighbour entropy.

    ``edge='code'`` adds ``-log2(e/T)`` for the edge marker (an always-at-edge
    gram scores 0); ``edge='distinct'`` treats each edge occurrence as a
    distinct neighbour.  ``corpora`` maps a prefix of the output columns to a count
    column of ``ctx_counts``: several corpora come out of one aggregation (a gram
    that a corpus does not hold has frequency 0 and null entropies there).  ``sums``:
    grams that ``ctx_counts`` lacks, whose contexts are added up already
    (``growth.sorted_sides``).
    """
    cc = ctx_counts if ctx_counts is not None else side_contexts(occ)
    corpora = corpora or {"": "c"}
    is_edge = F.col("ctx") == boundary
    aggs, out = [], ["gram"]
    for p, count in corpora.items():
        c = F.nullif(F.col(count), F.lit(0))
        aggs.append(F.coalesce(F.sum(F.when(F.col("side") == 0, c)), F.lit(0)).alias(f"{p}freq"))
        for k, side in enumerate("lr"):
            here = F.col("side") == k
            aggs += [F.sum(F.when(here & ~is_edge, c)).alias(f"_{p}{side}0"),
                     F.sum(F.when(here & ~is_edge, c * F.log2(c))).alias(f"_{p}{side}1"),
                     F.max(F.when(here & is_edge, c)).alias(f"_{p}{side}e")]
        t = F.nullif(F.col(f"{p}freq"), F.lit(0))
        out += [F.col(f"{p}freq")] + [
            _side_entropy(F.col(f"_{p}{side}0"), F.col(f"_{p}{side}1"), F.col(f"_{p}{side}e"), t, edge == "distinct").alias(f"{p}{name}_entropy")
            for side, name in (("l", "left"), ("r", "right"))]
    added = cc.groupBy("gram").agg(*aggs)
    return (added if sums is None else added.unionByName(sums)).select(*out)


def cohesion_from(entropies: DataFrame, min_freq: int = K.COHESION_MIN_FREQ, min_entropy: float = K.COHESION_MIN_ENTROPY,
                  joiner: str = K.GRAM_JOINER, prefix: str = "") -> DataFrame:
    """A9 from a table of frequencies and side entropies: (gram, freq, entropy) with
    ``freq >= min_freq`` and cohesion ``>= min_entropy``.

    Cohesion of a multi-token gram is ``min(left, right)`` entropy in bits;
    of a single token it is ``ln(freq)`` (nats), as in the original.
    """
    freq = F.col(f"{prefix}freq")
    ent = F.when(F.col("gram").contains(joiner), F.least(f"{prefix}left_entropy", f"{prefix}right_entropy")).otherwise(F.log(freq.cast("double")))
    return entropies.where(freq >= min_freq).select("gram", freq.alias("freq"), ent.alias("entropy")).where(F.col("entropy") >= min_entropy)


def cohesion(occ: DataFrame, min_freq: int = K.COHESION_MIN_FREQ, min_entropy: float = K.COHESION_MIN_ENTROPY,
             joiner: str = K.GRAM_JOINER, edge: str = "code") -> DataFrame:
    """A9 over n-gram occurrences (A7 + A8 + :func:`cohesion_from`)."""
    return cohesion_from(context_entropy(occ, edge=edge), min_freq, min_entropy, joiner)


def gram_total(freq_table: DataFrame, freq_col: str = "freq") -> DataFrame:
    """A10: the global total of a frequency table (all n-gram lengths), as one row."""
    return freq_table.agg(F.coalesce(F.sum(freq_col), F.lit(0)).cast("bigint").alias("total"))


def char_entropies(char_occ: DataFrame, weight: str | None = None) -> DataFrame:
    """A17 + A18 in one aggregation: per char gram its frequency and the plain Shannon
    entropy (bits) of the next (``right``) and previous (``left``) character, the edge
    marker being an ordinary symbol.  Occurrences are added up per (gram, previous,
    next) before each is turned into its two sides."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    both = char_occ.groupBy("gram", "prev", "next").agg(n.alias("c"))
    sides = both.select("gram", "c", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("prev").alias("ctx")),
        F.struct(F.lit(1).alias("side"), F.col("next").alias("ctx")))).alias("_x")).select("gram", "_x.side", "_x.ctx", "c")
    cc = sides.groupBy("gram", "side", "ctx").agg(F.sum("c").alias("c"))
    logs = F.col("c") * F.log2("c")
    agg = cc.groupBy("gram").agg(F.sum(F.when(F.col("side") == 0, F.col("c"))).alias("freq"),
                                 F.sum(F.when(F.col("side") == 0, logs)).alias("_l"), F.sum(F.when(F.col("side") == 1, logs)).alias("_r"))
    t = F.col("freq").cast("double")
    return agg.select("gram", "freq", ((t * F.log2(t) - F.col("_l")) / t).alias("left"), ((t * F.log2(t) - F.col("_r")) / t).alias("right"))


def char_side_entropy(char_occ: DataFrame, ctx_col: str) -> DataFrame:
    """A17 (``next``) / A18 (``prev``): (gram, freq, entropy) of one side."""
    side = {"next": "right", "prev": "left"}[ctx_col]
    return char_entropies(char_occ).select("gram", "freq", F.col(side).alias("entropy"))


def merge_entropy(right: DataFrame, left: DataFrame) -> DataFrame:
    """Inner join right (freq, entropy) with left (entropy); keep the
    smaller entropy."""
    r = right.select("gram", "freq", F.col("entropy").alias("_re"))
    l = left.select("gram", F.col("entropy").alias("_le"))
    return r.join(l, "gram", "inner").select("gram", "freq", F.least("_le", "_re").alias("entropy"))
