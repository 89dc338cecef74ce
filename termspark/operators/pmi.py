"""Pointwise mutual information.

A k-token gram has k-1 binary splits; each split is one exploded row whose
two halves are equi-joined to the marginal frequency table.  The joins are
plain DataFrame joins: AQE broadcasts the frequency table when its runtime
size is under the broadcast threshold and otherwise shuffles both sides (and
splits a skewed half such as a very common first token).
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import is_alnum_only


def pmi(scored: DataFrame, freq_table: DataFrame, total: Column | int | None = None, joiner: str = K.GRAM_JOINER,
        single_slope: float = K.PMI_SINGLE_SLOPE, single_intercept: float = K.PMI_SINGLE_INTERCEPT,
        single_const: float | None = None, missing: int | None = None,
        min_pmi: float | None = K.PMI_MIN) -> DataFrame:
    """Add ``pmi`` to a (gram, freq, ...) table with one row a gram.

    Multi-token gram: ``log2(freq * total / max_split(lf * rf))`` — the split
    maximising the product, i.e. the smallest PMI (as the original code does).
    Single token: ``single_slope * len + single_intercept``, or
    ``single_const`` when given (variants 5.0 / 10.0).
    ``total`` is A10 of ``freq_table`` (default: a scalar subquery over it).
    ``missing=None`` requires both halves of every split in ``freq_table`` and fails
    the query otherwise, as the original throws; an integer stands in for an absent
    half (J2).  A zero product gives +inf, as the original's floating division does.
    Rows are kept when ``pmi > min_pmi`` (None keeps all).
    """
    cols = scored.columns
    if total is None:
        total = freq_table.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total")).scalar()
    total = F.lit(total) if isinstance(total, int) else total
    f = freq_table.select(F.col("gram").alias("_g"), F.col("freq").cast("bigint").alias("_f"))
    toks = F.split(F.col("gram"), re.escape(joiner), -1)
    once = scored.select(F.inline(F.array(F.struct(*[F.col(c) for c in cols], toks.alias("_t")))))
    # a single token has no split: one row with null halves
    x = once.withColumn("_j", F.explode_outer(F.expr("CASE WHEN size(_t) > 1 THEN sequence(1, size(_t) - 1) END")))
    sp = x.select(*cols, F.col("_j").isNotNull().alias("_multi"), F.array_join(F.expr("slice(_t, 1, _j)"), joiner).alias("_lw"),
                  F.array_join(F.expr("slice(_t, _j + 1, size(_t))"), joiner).alias("_rw"))
    j = sp.join(f.select(F.col("_g").alias("_lw"), F.col("_f").alias("_lf")), "_lw", "left") \
        .join(f.select(F.col("_g").alias("_rw"), F.col("_f").alias("_rf")), "_rw", "left")
    lf, rf = F.col("_lf"), F.col("_rf")
    if missing is None:
        absent = F.col("_multi") & (lf.isNull() | rf.isNull())
        lf = F.when(absent, F.raise_error(F.concat(F.lit("no frequency for a part of gram "), F.col("gram"))).cast("bigint")).otherwise(lf)
    else:
        lf, rf = F.coalesce(lf, F.lit(missing)), F.coalesce(rf, F.lit(missing))
    rest = [c for c in cols if c != "gram"]
    ff = j.groupBy("gram").agg(*[F.any_value(c).alias(c) for c in rest], F.any_value("_multi").alias("_multi"),
                               F.max(F.when(F.col("_multi"), lf * rf)).alias("_ff"))
    multi = F.when(F.col("_ff") == 0, F.lit(float("inf"))).otherwise(
        F.log2(F.col("freq").cast("double") * total.cast("double") / F.col("_ff").cast("double")))
    if single_const is not None:
        single = F.lit(float(single_const))
    else:
        single = F.lit(single_slope) * F.length("gram") + F.lit(single_intercept)
    out = ff.select(*cols, F.when(F.col("_multi"), multi).otherwise(single.cast("double")).alias("pmi"))
    if min_pmi is not None:
        out = out.where(F.col("pmi").isNotNull() & ~F.isnan("pmi") & (F.col("pmi") > min_pmi))
    return out


def char_pmi(merged: DataFrame, freq_table: DataFrame, drop_alnum: bool = True) -> DataFrame:
    """PMI of a char gram over its binary splits, skipping splits with an
    absent half; ``total`` is the NUMBER of frequency rows and the quotient
    ``f * total / max`` is integer division; grams with no valid split are dropped,
    and so are grams of ASCII letters and digits alone unless ``drop_alnum`` is off."""
    total = freq_table.agg(F.count(F.lit(1)).alias("n")).scalar()
    f = freq_table.select(F.col("gram").alias("_g"), F.col("freq").cast("bigint").alias("_f"))
    m = merged.where(F.length("gram") > 1)
    if drop_alnum:
        m = m.where(~is_alnum_only("gram"))
    sp = m.withColumn("_j", F.explode(F.sequence(F.lit(1), F.length("gram") - 1))).select(
        "*", F.substring("gram", 1, F.col("_j")).alias("_lw"), F.expr("substring(gram, _j + 1)").alias("_rw"))
    j = sp.join(f.select(F.col("_g").alias("_lw"), F.col("_f").alias("_lf")), "_lw") \
        .join(f.select(F.col("_g").alias("_rw"), F.col("_f").alias("_rf")), "_rw")
    rest = [c for c in merged.columns if c != "gram"]
    ff = j.groupBy("gram").agg(*[F.any_value(c).alias(c) for c in rest], F.max(F.col("_lf") * F.col("_rf")).alias("_ff"))
    quotient = F.call_function("div", F.col("freq").cast("bigint") * total, F.col("_ff"))
    return ff.select(*merged.columns, F.log2(F.nullif(quotient, F.lit(0)).cast("double")).alias("pmi"))


def positional_pos(merged: DataFrame, pos_prop: DataFrame) -> DataFrame:
    """``min(prop[first char].p1, prop[last char].p3)``, -1 when either
    character is absent from the positional table."""
    first = pos_prop.select(F.col("ch").alias("_fc"), F.col("p1").alias("_p1"))
    last = pos_prop.select(F.col("ch").alias("_lc"), F.col("p3").alias("_p3"))
    x = merged.withColumn("_fc", F.substring("gram", 1, 1)).withColumn("_lc", F.substring("gram", -1, 1))
    x = x.join(first, "_fc", "left").join(last, "_lc", "left")
    pp = F.when(F.col("_p1").isNotNull() & F.col("_p3").isNotNull(), F.least("_p1", "_p3")).otherwise(F.lit(-1.0))
    return x.select(*merged.columns, pp.alias("pos_prob"))


def char_term_filter(df: DataFrame, min_pmi: float = K.CHAR_MIN_PMI,
                     min_entropy: float = K.CHAR_MIN_ENTROPY,
                     min_pos_prob: float = K.CHAR_MIN_POS_PROB) -> DataFrame:
    """drop ``pmi < 1 or entropy < 1.5 or pos_prob < 0.04`` (NaN PMI
    dropped as the original does)."""
    ok = (F.col("pmi").isNotNull() & ~F.isnan("pmi") & (F.col("pmi") >= min_pmi)
          & (F.col("entropy") >= min_entropy) & (F.col("pos_prob") >= min_pos_prob))
    return df.where(ok)
