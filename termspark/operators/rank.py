"""Final ranking, rule filters and evaluation (J7, F2-F8, O2, O4, O5, O7,
A20, U3, U4)."""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import contains_any, ends_with_any, length_factor, starts_with_any
from termspark.operators import tokenize as tk
from termspark.operators.ranking import global_rank


def attach_predictions(features: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Attach ``pred`` by term.  The original throws on a term without a
    prediction; ``check`` fails the query in that case, otherwise such terms are
    dropped.  Of several predictions for a term the last by ``ord`` counts (the
    greatest where predictions carry no such column)."""
    last = F.max_by("pred", "ord") if "ord" in predictions.columns else F.max("pred")
    p = predictions.groupBy("term").agg(last.alias("pred"), F.lit(True).alias("_known"))
    if not check:
        return features.join(p.drop("_known"), "term", "inner")
    error = F.raise_error(F.concat(F.lit("candidate term without prediction: "), F.col("term")))
    x = features.join(p, "term", "left")
    return x.withColumn("pred", F.when(F.col("_known").isNull(), error.cast("double")).otherwise(F.col("pred"))).drop("_known")


def final_score(df: DataFrame) -> DataFrame:
    """O2: ``sqrt(freq)^2 * entropy * pmi * length_factor(term) * exp(pred)``."""
    sq = F.sqrt(F.col("freq").cast("double"))
    s = sq * sq * F.col("entropy") * F.col("pmi") * length_factor("term") * F.exp("pred")
    return df.withColumn("final_score", s)


def final_floor(df: DataFrame, min_pred: float = K.FINAL_MIN_PRED, min_pmi: float = K.FINAL_MIN_PMI,
                min_freq: int = K.FINAL_MIN_FREQ) -> DataFrame:
    """F2: ``pred >= 0.3 and pmi >= 2 and freq >= 20``."""
    return df.where((F.col("pred") >= min_pred) & (F.col("pmi") >= min_pmi) & (F.col("freq") >= min_freq))


def affix_filter(df: DataFrame, term_col: str = "term", no_begin: Sequence[str] = K.NO_BEGIN,
                 no_end: Sequence[str] = K.NO_END, no_in: Sequence[str] = K.NO_IN) -> DataFrame:
    """drop terms starting with / ending with / containing a listed string."""
    c = F.col(term_col)
    bad = starts_with_any(c, no_begin) | ends_with_any(c, no_end) | contains_any(c, no_in)
    return df.where(~bad)


def affix_filter_join(df: DataFrame, term_col: str = "term", no_begin: DataFrame | None = None, no_end: DataFrame | None = None,
                      no_in: DataFrame | None = None, broadcast_words: int = tk.BROADCAST_WORDS) -> DataFrame:
    """F3 / F8 with lists of any size (tables with a column ``word``): drops terms that start
    with, end with or contain a listed string; a null term goes as well.  An empty string is in every term.

    Up to ``broadcast_words`` strings travel to the tasks, which look each term up where it lies.  With more, the pieces
    of each distinct term that are as long as some listed string (its prefixes, its suffixes, its substrings) meet the
    list in one equi-join; what the plan holds does not grow with the lists.  The result is the same."""
    kept = df.where(F.col(term_col).isNotNull())
    lists = [x if x is None else x.select("word").where("word is not null").distinct() for x in (no_begin, no_end, no_in)]
    left, few = broadcast_words, []
    for x in lists:
        few.append([] if x is None else [r["word"] for r in x.limit(left + 1).collect()])
        left -= len(few[-1])
        if left < 0:
            return _affix_join(kept, term_col, lists)
    return _affix_lookup(kept, term_col, few) if any(few) else kept


def _affix_lookup(df: DataFrame, term_col: str, lists: Sequence[list[str]]) -> DataFrame:
    sent, at = df.sparkSession.sparkContext.broadcast([sorted(x) for x in lists]), df.columns.index(term_col)

    def run(batches):
        import ahocorasick

        begin, end, inside = sent.value
        words = ahocorasick.Automaton()
        for w in filter(None, inside):
            words.add_word(w, w)
        if len(words):
            words.make_automaton()
        edges = []  # prefixes and suffixes by their length
        for listed, cut in ((begin, lambda t, n: pc.utf8_slice_codeunits(t, 0, n)), (end, lambda t, n: pc.utf8_slice_codeunits(t, -n, None))):
            for n in sorted({len(w) for w in listed} - {0}):
                edges.append((cut, n, pa.array([w for w in listed if len(w) == n], pa.string())))
        for b in batches:
            if "" in (*begin[:1], *end[:1], *inside[:1]):  # sorted: it comes first
                b = b.slice(0, 0)
            for cut, n, listed in edges:  # a shorter term is no listed string of this length
                b = b.filter(pc.invert(pc.is_in(cut(b.column(at), n), value_set=listed)))
            if len(words):
                b = b.filter(pa.array([next(words.iter(t), None) is None for t in b.column(at).to_pylist()], pa.bool_()))
            yield b
        tk.give_back()

    return df.mapInArrow(run, df.schema)


def _affix_join(kept: DataFrame, term_col: str, lists: Sequence[DataFrame | None]) -> DataFrame:
    terms = kept.select(F.col(term_col).alias("_term")).distinct()
    hits = None
    for words, pieces in zip(lists, ("array(left(_term, _n))", "array(right(_term, _n))",
                                     "transform(sequence(1, length(_term) - _n + 1), i -> substring(_term, i, _n))")):
        if words is None:
            continue
        lengths = words.agg(F.collect_set(F.length("word")).alias("l")).scalar()  # as many as there are lengths
        each = terms.withColumn("_n", F.explode(lengths)).where("_n <= length(_term)")
        met = each.select("_term", F.explode(F.expr(f"case when _n = 0 then array('') else {pieces} end")).alias("word")).join(words, "word", "left_semi")
        hits = met.select("_term") if hits is None else hits.union(met.select("_term"))
    return kept.join(hits.distinct(), F.col(term_col) == F.col("_term"), "left_anti")


def _any_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def single_token_filter(df: DataFrame, pos_col: str = "pos",
                        drop_pos: Sequence[str] = K.SINGLE_TOKEN_DROP_POS) -> DataFrame:
    """drop one-token terms whose POS starts with ``nr`` or ``v``."""
    p0 = F.get(F.col(pos_col), 0)
    return df.where(~((F.size(pos_col) == 1) & _any_prefix(p0, drop_pos)))


def pos_pattern_filter(df: DataFrame, pos_col: str = "pos",
                       first_drop: Sequence[str] = K.FIRST_POS_DROP,
                       last_drop: Sequence[str] = K.LAST_POS_DROP,
                       any_drop: Sequence[str] = K.ANY_POS_DROP) -> DataFrame:
    """drop if the first POS starts with p, the last with f, or any POS
    with c/u/p/r."""
    p = F.col(pos_col)
    first, last = F.get(p, 0), F.element_at(p, -1)
    any_bad = F.exists(p, lambda x: _any_prefix(x, any_drop))
    bad = _any_prefix(first, first_drop) | _any_prefix(last, last_drop) | any_bad
    return df.where(~F.coalesce(bad, F.lit(False)))


def verb_tail_filter(df: DataFrame, pos_col: str = "pos", verb: str = K.VERB_POS) -> DataFrame:
    """drop terms whose last token's POS starts with ``v``."""
    return df.where(~F.coalesce(F.element_at(F.col(pos_col), -1).startswith(verb), F.lit(False)))


def threshold_split(pred: DataFrame, threshold: float = K.REPORT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(kept, filtered) = (``pred > t and length > 1``, ``pred <= t``)."""
    kept = pred.where((F.col("pred") > threshold) & (F.length("term") > 1))
    dropped = pred.where(F.col("pred") <= threshold)
    return kept, dropped


def top_n(df: DataFrame, order: list[Column], n: int = K.EVAL_TOP_N) -> DataFrame:
    """The first ``n`` rows (a top-N report; the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def rank_boost(df: DataFrame, trusted: DataFrame, order: list[Column],
               factor: float = K.RANK_BOOST) -> DataFrame:
    """0-based rank index, multiplied by ``factor`` for trusted terms,
    re-sorted by the new index (ties by term)."""
    r = global_rank(df, order, "_r")
    t = trusted.select(F.col("word").alias("term")).distinct().withColumn("_t", F.lit(True))
    x = r.join(t, "term", "left")
    idx = (F.col("_r") - 1).cast("double")
    return (x.withColumn("new_index", F.when(F.col("_t"), idx * factor).otherwise(idx))
            .drop("_r", "_t").orderBy("new_index", "term"))


def hit_counts(ranked_terms: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Size of the bag intersection of the ranked terms with the
    positive and the negative list (one row)."""
    def counts(df, c, out):
        return df.groupBy(F.col(c).alias("w")).agg(F.count(F.lit(1)).alias(out))

    x = counts(ranked_terms, "term", "t").join(counts(positives, "word", "p"), "w", "left").join(counts(negatives, "word", "n"), "w", "left")
    both = [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.least("t", c))), F.lit(0)).cast("bigint").alias(out)
            for c, out in (("p", "pos_hits"), ("n", "neg_hits"))]
    return x.agg(*both)


def threshold_report(predictions: DataFrame, threshold: float = K.REPORT_THRESHOLD, n: int = K.REPORT_TOP_N) -> dict[str, DataFrame]:
    """O7 / X10 as one job over (term, score, pred): ``ranked`` (best score first),
    ``kept`` (F7, best score first), ``dropped`` (least pred first) and ``diff``
    (U4 of the two top-``n`` lists)."""
    order = [F.desc("score"), F.asc("term")]
    kept, dropped = threshold_split(predictions, threshold)
    return {"ranked": predictions.orderBy(*order), "kept": kept.orderBy(*order), "dropped": dropped.orderBy("pred", "term"),
            "diff": top_n_diff(predictions, kept, order, n)}


def top_n_diff(candidates: DataFrame, filtered: DataFrame, order: list[Column],
               n: int = K.REPORT_TOP_N) -> DataFrame:
    """U4: symmetric difference of the two top-N lists, tagged with
    ``side`` = 'removed' (in the candidate top-N only) or 'added'."""
    a = top_n(candidates, order, n)
    b = top_n(filtered, order, n)
    removed = a.join(b.select("term"), "term", "left_anti").withColumn("side", F.lit("removed"))
    added = b.join(a.select("term"), "term", "left_anti").withColumn("side", F.lit("added"))
    return removed.unionByName(added)
