"""Registered queries: each pairs a Spark builder ``(spark, sf_dir) ->
DataFrame`` with the DuckDB oracle SQL that computes the same result.

Doubles are rounded to 6 places (and -0.0 folded into 0.0) in BOTH the Spark
output and the SQL so the cross-engine value hash is stable; the operators
themselves return full precision.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspark.functions import constants as K
from termspark.plans import corpus as C
from termspark.plans import jobs as J
from termspark.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places, -0.0 -> 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


r = O.r6
LINES_B = O.lines("B")

# ---------------------------------------------------------------------------
# corpus statistics (A1-A5) on the segmented corpus D2
# ---------------------------------------------------------------------------

TOK_CTE = f"tl AS (SELECT doc_id, line_no, {O.tokens('line')} AS toks FROM {LINES_B})"


@register("word_idf", f"""
WITH {TOK_CTE},
n AS (SELECT count(*) AS n FROM tl),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, line_no, unnest(toks) AS term FROM tl) GROUP BY term)
SELECT term, {r('ln((SELECT n FROM n) / df)')} AS idf FROM df""")
def q_word_idf(spark, sf):
    return r6(J.word_idf(spark, sf))


@register("char_idf", f"""
WITH {TOK_CTE},
n AS (SELECT count(*) AS n FROM tl),
ch AS (SELECT DISTINCT doc_id, line_no, unnest(string_split(t, '')) AS term
       FROM (SELECT doc_id, line_no, unnest(toks) AS t FROM tl)),
df AS (SELECT term, count(*) AS df FROM ch WHERE term <> '' GROUP BY term)
SELECT term, {r('ln((SELECT n FROM n) / df)')} AS idf FROM df""")
def q_char_idf(spark, sf):
    return r6(J.char_idf(spark, sf))


@register("term_freq", f"""
WITH {TOK_CTE}
SELECT term, count(*) AS freq FROM (SELECT unnest(toks) AS term FROM tl) GROUP BY term""")
def q_term_freq(spark, sf):
    return J.term_freq(spark, sf)


@register("char_freq", f"""
WITH {TOK_CTE},
ch AS (SELECT unnest(string_split(t, '')) AS term FROM (SELECT unnest(toks) AS t FROM tl))
SELECT term, count(*) AS freq FROM ch WHERE term <> '' GROUP BY term""")
def q_char_freq(spark, sf):
    return J.char_freq(spark, sf)


@register("bigram_freq", f"""
WITH {TOK_CTE},
bg AS (SELECT toks[i] || toks[i + 1] AS term
       FROM (SELECT toks, unnest(generate_series(1, len(toks) - 1)) AS i FROM tl WHERE len(toks) > 1))
SELECT term, count(*) AS freq FROM bg GROUP BY term""")
def q_bigram_freq(spark, sf):
    return J.bigram_freq(spark, sf)


# ---------------------------------------------------------------------------
# lines, segments, n-grams
# ---------------------------------------------------------------------------

@register("line_dedup", f"SELECT DISTINCT line FROM {LINES_B}")
def q_line_dedup(spark, sf):
    return C.distinct_lines(spark, sf, "B")


@register("segments", f"""
WITH {O.segments_ctes('B').lstrip()}
SELECT array_to_string(seg, ' ') AS segment, count(*) AS n FROM segs GROUP BY 1""")
def q_segments(spark, sf):
    s = C.segments(spark, sf, "B")
    return s.groupBy(F.array_join("seg", " ").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@register("stop_segments", f"""
WITH {O.segments_ctes('B', stop_only=True).lstrip()}
SELECT array_to_string(seg, ' ') AS segment, count(*) AS n FROM segs GROUP BY 1""")
def q_stop_segments(spark, sf):
    s = C.stop_segments(spark, sf, "B")
    return s.groupBy(F.array_join("seg", " ").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@register("ngram_context", f"""
WITH {O.occurrences_ctes('B').lstrip()}
SELECT gram, CAST(k AS BIGINT) AS k, prev, next, count(*) AS n FROM occ GROUP BY ALL""")
def q_ngram_context(spark, sf):
    return J.occurrences(spark, sf, "B")


@register("gram_freq", f"""
WITH {O.occurrences_ctes('B').lstrip()}
SELECT gram, count(*) AS freq FROM occ GROUP BY gram HAVING count(*) >= 5""")
def q_gram_freq(spark, sf):
    return J.gram_freq(spark, sf, "B")


@register("gram_total", f"""
WITH {O.occurrences_ctes('B').lstrip()}
SELECT CAST(sum(freq) AS BIGINT) AS total FROM (SELECT gram, count(*) AS freq FROM occ GROUP BY gram HAVING count(*) >= 5)""")
def q_gram_total(spark, sf):
    return J.gram_total(spark, sf)


@register("context_entropy", f"""
WITH {O.occurrences_ctes('B').lstrip()}{O.entropy_ctes()}
SELECT gram, freq, {r('left_entropy')} AS left_entropy, {r('right_entropy')} AS right_entropy
FROM ent WHERE freq >= 5""")
def q_context_entropy(spark, sf):
    return r6(J.gram_table(spark, sf).select("gram", "freq", "left_entropy", "right_entropy"))


@register("cohesion", f"""
WITH {O.cohesion_ctes('B').lstrip()}
SELECT gram, freq, {r('entropy')} AS entropy FROM coh""")
def q_cohesion(spark, sf):
    return r6(J.cohesion(spark, sf, "B"))


@register("cohesion_background", f"""
WITH {O.cohesion_ctes('A').lstrip()}
SELECT gram, freq, {r('entropy')} AS entropy FROM coh""")
def q_cohesion_bg(spark, sf):
    return r6(J.cohesion(spark, sf, "A"))


SCORED_B_CTES = (O.cohesion_ctes("B", "b_") + """,
b_freq AS (SELECT gram, count(*) AS freq FROM b_occ GROUP BY gram HAVING count(*) >= 5)"""
                 + O.pmi_ctes("b_coh", "b_freq", "b_pmi") + """,
b_scored AS (SELECT * FROM b_pmi WHERE pmi > 1)""")
SCORED_CTES = (O.cohesion_ctes("B", "b_") + ",\n" + O.cohesion_ctes("A", "a_").lstrip()
               + """,
b_freq AS (SELECT gram, count(*) AS freq FROM b_occ GROUP BY gram HAVING count(*) >= 5)"""
               + O.pmi_ctes("b_coh", "b_freq", "b_pmi") + O.pmi_ctes("a_coh", "b_freq", "a_pmi")
               + """,
b_scored AS MATERIALIZED (SELECT * FROM b_pmi WHERE pmi > 1),
a_scored AS MATERIALIZED (SELECT * FROM a_pmi WHERE pmi > 1)""")


@register("pmi", f"""
WITH {SCORED_B_CTES.lstrip()}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi FROM b_scored""")
def q_pmi(spark, sf):
    return r6(J.scored(spark, sf, "B"))


@register("pmi_stored", f"""
WITH {SCORED_B_CTES.lstrip()}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi FROM b_scored""")
def q_pmi_stored(spark, sf):
    return r6(J.scored_stored(spark, sf))


@register("merged_entropy", f"""
WITH {O.occurrences_ctes('B').lstrip()}{O.entropy_ctes()}
SELECT gram, freq, {r('left_entropy')} AS left_entropy, {r('right_entropy')} AS right_entropy
FROM ent WHERE freq >= 5""")
def q_merged_entropy(spark, sf):
    return r6(J.merged_entropy(spark, sf).where(F.col("freq") >= K.COHESION_MIN_FREQ))


@register("sorted_lookup", f"""
WITH {O.occurrences_ctes('B').lstrip()}, f AS (SELECT gram, count(*) AS freq FROM occ GROUP BY gram HAVING count(*) >= 5)
SELECT gram, freq FROM f WHERE gram BETWEEN {O.q(J.LOOKUP[0])} AND {O.q(J.LOOKUP[1])}""")
def q_sorted_lookup(spark, sf):
    return J.sorted_lookup(spark, sf)


@register("pmi_background", f"""
WITH {SCORED_CTES.lstrip()}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi FROM a_scored""")
def q_pmi_bg(spark, sf):
    return r6(J.scored(spark, sf, "A"))


@register("pmi_variant", f"""
WITH {O.cohesion_ctes('B', 'b_').lstrip()},
b_freq AS (SELECT gram, count(*) AS freq FROM b_occ GROUP BY gram HAVING count(*) >= 5)
{O.pmi_ctes('b_coh', 'b_freq', 'v_pmi', single='5.0', missing_zero=True)}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi FROM v_pmi WHERE pmi > 1""")
def q_pmi_variant(spark, sf):
    return r6(J.scored(spark, sf, "B", single_const=K.PMI_SINGLE_CONST_MISSING_ZERO, missing=0))


@register("pmi_missing", f"""
WITH {O.cohesion_ctes('B', 'b_').lstrip()},
s_freq AS (SELECT gram, count(*) AS freq FROM b_occ GROUP BY gram HAVING count(*) >= {J.SPARSE_MARGINALS})
{O.pmi_ctes('b_coh', 's_freq', 's_pmi', single=str(K.PMI_SINGLE_CONST_TRIE), missing_zero=True)}
SELECT gram, freq, {r('entropy')} AS entropy, CASE WHEN isinf(pmi) THEN pmi ELSE {r('pmi')} END AS pmi FROM s_pmi WHERE pmi > 1""")
def q_pmi_missing(spark, sf):
    return r6(J.scored_sparse(spark, sf))


# ---------------------------------------------------------------------------
# X6 corpus diff
# ---------------------------------------------------------------------------

DIFF_CTES = O.diff_ctes(SCORED_CTES.lstrip())
SCORE_COLS = ", ".join(f"{r(c)} AS {c}" for c in ["entropy", "pmi"])


@register("new_terms", f"""
WITH {DIFF_CTES}
SELECT gram, freq, {SCORE_COLS}, {r('sqrt(freq) * entropy * pmi * (1.0 / exp(abs(length(gram) - 4.5) * 0.3))')} AS score FROM nw""")
def q_new_terms(spark, sf):
    return r6(J.diff(spark, sf)["new"])


A_COLS = f"a_freq, {r('a_entropy')} AS a_entropy, {r('a_pmi')} AS a_pmi"


@register("risen_terms", f"""
WITH {DIFF_CTES}
SELECT gram, freq, {SCORE_COLS}, {A_COLS} FROM rk""")
def q_risen_terms(spark, sf):
    return r6(J.diff(spark, sf)["risen"])


@register("head_word_exclusions", f"""
WITH {DIFF_CTES}
SELECT gram, freq, {SCORE_COLS}, {A_COLS} FROM bt""")
def q_bg_top(spark, sf):
    return r6(J.diff(spark, sf)["bg_top"])


@register("diff_candidates", f"""
WITH {DIFF_CTES}
SELECT term, {r('score')} AS score FROM sc""")
def q_diff_candidates(spark, sf):
    return r6(J.diff(spark, sf)["candidates"])


@register("diff_features", f"""
WITH {DIFF_CTES}
SELECT term, freq, {SCORE_COLS} FROM sc""")
def q_diff_features(spark, sf):
    return r6(J.diff(spark, sf)["features"])


SURFACE_SQL = f"""
WITH {DIFF_CTES},
sf AS (SELECT replace(gram, ',', '') AS term, gram, freq, entropy, pmi,
       sqrt(freq) * entropy * pmi * (1.0 / exp(abs(length(gram) - 4.5) * 0.3)) AS score
       FROM al WHERE NOT (length(replace(gram, ',', '')) > 1
                          AND len(list_distinct(string_split(replace(gram, ',', ''), ''))) = 1))"""


@register("surface_candidates", f"""{SURFACE_SQL}
SELECT term, {r('score')} AS score FROM sf""")
def q_surface_candidates(spark, sf):
    """The original's comma-free surface form: a bag, equal forms are several rows."""
    return r6(J.diff(spark, sf, surface_joiner="")["candidates"])


@register("surface_candidates_dedup", f"""{SURFACE_SQL}
SELECT term, max({r('score')}) AS score FROM sf GROUP BY term""")
def q_surface_dedup(spark, sf):
    return r6(J.diff(spark, sf, surface_joiner="", dedup="max")["candidates"])


# ---------------------------------------------------------------------------
# X7 features
# ---------------------------------------------------------------------------

FEATURE_COLS = ", ".join(["term"] + [r(c) + " AS " + c for c in
                                      ["length", "char_idf_sum", "char_idf_avg", "char_idf_min",
                                       "char_idf_max", "word_idf_sum", "word_idf_avg", "word_idf_min",
                                       "word_idf_max", "hot_char_sum", "hot_char_avg", "hot_word_sum",
                                       "hot_word_avg"]])


@register("candidate_features", f"""
WITH {DIFF_CTES}{O.features_ctes('sc')}
SELECT {FEATURE_COLS} FROM feat""")
def q_candidate_features(spark, sf):
    return r6(J.features(spark, sf, J.diff(spark, sf)["candidates"]))


@register("training_features", f"""
WITH posl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
              WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')})),
negl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE {O.not_blank('w')}),
lab AS (SELECT word AS term, 1.0 AS label FROM posl UNION ALL SELECT word AS term, 0.0 AS label FROM negl)
{O.features_ctes('lab')}
SELECT {FEATURE_COLS}, lab.label FROM lab JOIN feat USING (term)""")
def q_training_features(spark, sf):
    from termspark.operators import features as fe
    pos, neg = J.positives(spark, sf), J.negatives(spark, sf)
    terms = pos.select(F.col("word").alias("term")).unionByName(neg.select(F.col("word").alias("term")))
    feats = J.features(spark, sf, terms)
    rows = fe.training_rows(pos, neg, feats)
    return r6(rows.select("term", *[c for c in rows.columns if c not in ("term", "label")], "label"))


@register("hot_words", f"""
WITH posw AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
              WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')}))
SELECT t AS term, count(*) AS hot FROM (SELECT unnest(regexp_extract_all(lower(word), {O.q(C.TOKEN_PATTERN)})) AS t FROM posw) GROUP BY t""")
def q_hot_words(spark, sf):
    return J.hot_tables(spark, sf)[1]


@register("hot_chars", f"""
WITH posw AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
              WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')}))
SELECT c AS term, count(*) AS hot FROM (SELECT unnest(string_split(word, '')) AS c FROM posw) WHERE c <> '' GROUP BY c""")
def q_hot_chars(spark, sf):
    return J.hot_tables(spark, sf)[0]


# ---------------------------------------------------------------------------
# X9 final list (J7, O2, F2-F5, A20, U3) / X10 threshold report
# ---------------------------------------------------------------------------

FINAL_CTES = DIFF_CTES + O.features_ctes("sc") + O.final_ctes()
POSNEG_CTES = f""",
posl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
         WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')})),
negl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE {O.not_blank('w')})"""


@register("final_terms", f"""
WITH {FINAL_CTES}
SELECT term, freq, {SCORE_COLS}, {r('pred')} AS pred, {r('final_score')} AS final_score FROM fin""")
def q_final_terms(spark, sf):
    return r6(J.final_terms(spark, sf))


@register("hit_counts", f"""
WITH {FINAL_CTES}{POSNEG_CTES},
top AS (SELECT term FROM fin ORDER BY final_score DESC, term LIMIT {J.EVAL_TOP_N})
SELECT (SELECT count(*) FROM (SELECT term FROM top INTERSECT ALL SELECT word FROM posl)) AS pos_hits,
       (SELECT count(*) FROM (SELECT term FROM top INTERSECT ALL SELECT word FROM negl)) AS neg_hits""")
def q_hit_counts(spark, sf):
    from termspark.operators import rank as rk
    top = rk.top_n(J.final_terms(spark, sf), [F.desc("final_score"), F.asc("term")], J.EVAL_TOP_N)
    return rk.hit_counts(top, J.positives(spark, sf), J.negatives(spark, sf))


PRED_CTES = DIFF_CTES + O.features_ctes("sc") + f""",
pd AS (SELECT s.term, s.score, 1.0 / (1.0 + exp(-(f.word_idf_avg - 4.0))) AS pred FROM sc s JOIN feat f USING (term))"""
PRED_COLS = f"term, {r('score')} AS score, {r('pred')} AS pred"


@register("threshold_kept", f"""
WITH {PRED_CTES}
SELECT {PRED_COLS} FROM pd WHERE pred > {K.REPORT_THRESHOLD} AND length(term) > 1""")
def q_threshold_kept(spark, sf):
    return r6(J.threshold_report(spark, sf)["kept"])


@register("threshold_dropped", f"""
WITH {PRED_CTES}
SELECT {PRED_COLS} FROM pd WHERE pred <= {K.REPORT_THRESHOLD}""")
def q_threshold_dropped(spark, sf):
    return r6(J.threshold_report(spark, sf)["dropped"])


@register("threshold_diff", f"""
WITH {PRED_CTES},
ta AS (SELECT * FROM pd ORDER BY score DESC, term LIMIT {J.REPORT_TOP_N}),
tb AS (SELECT * FROM (SELECT * FROM pd WHERE pred > {K.REPORT_THRESHOLD} AND length(term) > 1)
       ORDER BY score DESC, term LIMIT {J.REPORT_TOP_N})
SELECT {PRED_COLS}, 'removed' AS side FROM ta WHERE term NOT IN (SELECT term FROM tb)
UNION ALL
SELECT {PRED_COLS}, 'added' AS side FROM tb WHERE term NOT IN (SELECT term FROM ta)""")
def q_threshold_diff(spark, sf):
    return r6(J.threshold_report(spark, sf)["diff"])


@register("ranked_report", f"""
WITH {PRED_CTES}
SELECT {PRED_COLS} FROM pd""")
def q_ranked_report(spark, sf):
    return r6(J.threshold_report(spark, sf)["ranked"])


@register("rank_boost", f"""
WITH {PRED_CTES}{POSNEG_CTES},
rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, term, pred) - 1 AS idx FROM pd)
SELECT {PRED_COLS}, CASE WHEN term IN (SELECT word FROM posl) THEN idx * {K.RANK_BOOST} ELSE CAST(idx AS DOUBLE) END AS new_index FROM rb""")
def q_rank_boost(spark, sf):
    from termspark.operators import rank as rk
    p = J.predictions(spark, sf)
    return r6(rk.rank_boost(p, J.positives(spark, sf), [F.desc("score"), F.asc("term"), F.asc("pred")]))


# ---------------------------------------------------------------------------
# X11 keywords (P20, A16, O6, J9), X12 labels
# ---------------------------------------------------------------------------

def _kw_sql() -> str:
    k = J.KW
    canon = k["labels"][0]
    norm = "line"
    for lab in k["labels"][1:]:
        norm = f"replace({norm}, {O.q(lab)}, {O.q(canon)})"
    has = " OR ".join(f"contains(line, {O.q(lab)})" for lab in k["labels"])

    def first(expr, marks):
        xs = ", ".join(f"instr({expr}, {O.q(m)}) - 1" for m in marks)
        return f"coalesce(list_min(list_filter([{xs}], lambda i: i >= 0)), -1)"

    def drop_last(expr, sfx):
        cond = " OR ".join(f"ends_with({expr}, {O.q(s)})" for s in sfx)
        return f"CASE WHEN {cond} THEN substring({expr}, 1, length({expr}) - 1) ELSE {expr} END"

    excl = " OR ".join(f"contains(kw, {O.q(e)})" for e in k["exclude"])
    splits, last = [], "k4"
    for i, ch in enumerate(k["split_chars"]):
        bare = f"rtrim(kw, {O.q(ch)})"
        splits.append(f"k5_{i} AS (SELECT unnest(CASE WHEN kw = '' THEN [''] WHEN {bare} = '' THEN [] "
                      f"ELSE string_split({bare}, {O.q(ch)}) END) AS kw FROM {last})")
        last = f"k5_{i}"
    return f"""kl AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations),
k1 AS (SELECT {norm} AS n FROM kl WHERE {has}),
k2 AS (SELECT substring(n, instr(n, {O.q(canon)}) + {len(canon)}) AS kw FROM k1),
k3 AS (SELECT CASE WHEN {first('kw', k['end_markers'])} >= 0 THEN substring(kw, 1, {first('kw', k['end_markers'])}) ELSE kw END AS kw FROM k2),
k4 AS (SELECT {drop_last('kw', k['trailing_drop'])} AS kw FROM k3),
{", ".join(splits)},
k6 AS (SELECT {drop_last('kw', k['tail_drop'])} AS kw FROM {last}),
k7 AS (SELECT replace(CASE WHEN {first('kw', k['paren'])} >= 0 THEN substring(kw, 1, {first('kw', k['paren'])}) ELSE kw END,
                      {O.q(k['remove'])}, '') AS kw FROM k6),
kws AS (SELECT kw AS keyword FROM k7 WHERE NOT ({excl}) AND length(kw) <= {k['max_len']})"""


KW_CTE = _kw_sql()
LIST_CTES = f"""p1 AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
         WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')})),
p2 AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS w FROM part) WHERE {O.not_blank('w')}),
n1 AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE {O.not_blank('w')}),
n2 AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM conversations)
         WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')})),
tpos AS (SELECT word FROM p1 WHERE length(word) % 2 = 0)"""


@register("keywords", f"WITH {KW_CTE} SELECT keyword FROM kws")
def q_keywords(spark, sf):
    return J.keywords(spark, sf)


@register("keyword_freq", f"WITH {KW_CTE} SELECT keyword, count(*) AS freq FROM kws GROUP BY keyword")
def q_keyword_freq(spark, sf):
    from termspark.operators import keywords as kw
    return kw.keyword_freq(J.keywords(spark, sf))


@register("keywords_by_length", f"WITH {KW_CTE} SELECT DISTINCT keyword FROM kws")
def q_keywords_by_length(spark, sf):
    from termspark.operators import keywords as kw
    return kw.keywords_by_length(J.keywords(spark, sf))


@register("keyword_hits", f"""WITH {KW_CTE}, {LIST_CTES},
kd AS (SELECT DISTINCT keyword FROM kws)
SELECT 'pos' AS list, keyword FROM kd WHERE keyword IN (SELECT word FROM p1)
UNION ALL SELECT 'pos_trusted' AS list, keyword FROM kd WHERE keyword IN (SELECT word FROM p1) AND keyword IN (SELECT word FROM tpos)
UNION ALL SELECT 'neg' AS list, keyword FROM kd WHERE keyword IN (SELECT word FROM n2)""")
def q_keyword_hits(spark, sf):
    from termspark.operators import keywords as kw
    k = J.keywords(spark, sf)
    pos, neg, tp = J.label_lists(spark, sf)
    return (kw.list_hits(k, pos["pos1"]).select(F.lit("pos").alias("list"), "keyword")
            .unionByName(kw.list_hits(k, pos["pos1"], tp).select(F.lit("pos_trusted").alias("list"), "keyword"))
            .unionByName(kw.list_hits(k, neg["neg2"]).select(F.lit("neg").alias("list"), "keyword")))


@register("label_union", f"""WITH {LIST_CTES}
SELECT 'pos' AS list, word FROM (SELECT word FROM p1 UNION SELECT word FROM p2)
UNION ALL SELECT 'neg' AS list, word FROM (SELECT word FROM n1 UNION SELECT word FROM n2)
UNION ALL SELECT 'bag' AS list, word FROM (SELECT word FROM p1 UNION ALL SELECT word FROM n1)""")
def q_label_union(spark, sf):
    from termspark.operators import labels as lb
    pos, neg, _ = J.label_lists(spark, sf)
    return (lb.consolidate(list(pos.values())).select(F.lit("pos").alias("list"), "word")
            .unionByName(lb.consolidate(list(neg.values())).select(F.lit("neg").alias("list"), "word"))
            .unionByName(lb.bag_union(pos["pos1"], neg["neg1"]).select(F.lit("bag").alias("list"), "word")))


@register("label_conflicts", f"""WITH {LIST_CTES},
pos AS (SELECT word FROM p1 UNION SELECT word FROM p2),
neg AS (SELECT word FROM n1 UNION SELECT word FROM n2),
inter AS (SELECT word FROM pos WHERE word IN (SELECT word FROM neg)),
tn AS (SELECT word FROM inter WHERE word NOT IN (SELECT word FROM tpos))
SELECT 'neg1' AS list, word FROM n1 WHERE word NOT IN (SELECT word FROM tpos)
UNION ALL SELECT 'neg2' AS list, word FROM n2 WHERE word NOT IN (SELECT word FROM tpos)
UNION ALL SELECT 'pos1' AS list, word FROM p1 WHERE word NOT IN (SELECT word FROM tn)
UNION ALL SELECT 'pos2' AS list, word FROM p2 WHERE word NOT IN (SELECT word FROM tn)""")
def q_label_conflicts(spark, sf):
    from termspark.operators import labels as lb
    pos, neg, tp = J.label_lists(spark, sf)
    return lb.resolve_conflicts(pos, neg, tp)


@register("bag_intersection", f"""WITH {LIST_CTES}
SELECT word FROM (SELECT word FROM n2 UNION ALL SELECT word FROM p1)
INTERSECT ALL SELECT word FROM (SELECT word FROM p1 UNION ALL SELECT word FROM p1)""")
def q_bag_intersection(spark, sf):
    from termspark.operators import labels as lb
    pos, neg, _ = J.label_lists(spark, sf)
    return lb.bag_intersect(lb.bag_union(neg["neg2"], pos["pos1"]), lb.bag_union(pos["pos1"], pos["pos1"]))


@register("todo_minus_positives", f"""WITH {DIFF_CTES}, {LIST_CTES}
SELECT term, {r('score')} AS score FROM sc WHERE term NOT IN (SELECT word FROM p1)""")
def q_todo_minus_positives(spark, sf):
    from termspark.operators import labels as lb
    return r6(lb.list_difference(J.diff(spark, sf)["candidates"], J.positives(spark, sf), "term"))


@register("candidates_minus_lists", f"""WITH {DIFF_CTES}, {LIST_CTES}
SELECT DISTINCT term FROM sc WHERE term NOT IN (SELECT word FROM p1 UNION ALL SELECT word FROM p2 UNION ALL SELECT word FROM n1 UNION ALL SELECT word FROM n2)""")
def q_candidates_minus_lists(spark, sf):
    from termspark.operators import labels as lb
    pos, neg, _ = J.label_lists(spark, sf)
    return lb.minus_lists(J.diff(spark, sf)["candidates"], [*pos.values(), *neg.values()])


@register("rescue_nouns", f"""WITH {PRED_CTES}, {LIST_CTES},
nt AS (SELECT n2.word AS word, {O.tag_expr('n2.word', 'lx.tag')} AS tag FROM n2 LEFT JOIN {O.lexicon_values()} lx ON lx.word = n2.word)
SELECT pd.term, {r('pd.score')} AS score, {r('pd.pred')} AS pred FROM pd
WHERE pd.term IN (SELECT word FROM nt WHERE starts_with(tag, 'n') OR tag = 'vn') AND pd.score > -10000""")
def q_rescue_nouns(spark, sf):
    from termspark.operators import labels as lb
    _, neg, _ = J.label_lists(spark, sf)
    tagged = neg["neg2"].withColumn("_t", F.array("word"))
    tagged = tagged.withColumn("pos", C.tk.pos_tags("_t", C.POS_LEXICON, C.DEFAULT_POS, C.NONSCRIPT_POS,
                                                    C.SCRIPT_CLASS)).drop("_t")
    return r6(lb.rescue_nouns(tagged, J.predictions(spark, sf)))


# ---------------------------------------------------------------------------
# X14 audit (P1, A11-A14, P21, P22, F8) and scalar text functions
# ---------------------------------------------------------------------------

from termspark.functions import text as TX  # noqa: E402
from termspark.operators import keywords as KWO  # noqa: E402
from termspark.operators import pmi as PM  # noqa: E402
from termspark.operators import stats as ST  # noqa: E402

FULL = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(cp) for cp in range(0x21, 0x7F)) + " "
CLEAN_ALNUM = ("[" + TX.ASCII_PUNCT + TX.ASCII_ALNUM + TX.UNICODE_PUNCT + "　" + TX.SPACE + TX.CNTRL + "]")
CLEAN_NOALNUM = ("[" + TX.ASCII_PUNCT + TX.UNICODE_PUNCT + "　" + TX.SPACE + TX.CNTRL + "]")
SC = C.SCRIPT_CLASS


def _p_lines(spark, sf):
    pages = C.table(spark, sf, "pages")
    return pages.select(F.explode(F.split(F.replace("html", F.lit("<p>"), F.lit("\n<p>")), "\n")).alias("line"))


@register("tagged_extract", """
SELECT replace(replace(line, '<p>', ''), '</p>', '') AS line
FROM (SELECT unnest(string_split(replace(html, '<p>', chr(10) || '<p>'), chr(10))) AS line FROM pages)
WHERE starts_with(line, '<p>')""")
def q_tagged_extract(spark, sf):
    return KWO.extract_tagged(_p_lines(spark, sf), "line", "<p>", "</p>")


@register("gbk_extract", f"""
SELECT replace(replace(line, '<p>', ''), '</p>', '') AS line
FROM (SELECT translate(regexp_replace(line, '[^\\x00-\\x7F]', '', 'g'), {O.q(J.GBK_LETTERS[0])}, {O.q(J.GBK_LETTERS[1])}) AS line
      FROM (SELECT unnest(string_split(replace(html, '<p>', chr(10) || '<p>'), chr(10))) AS line FROM pages))
WHERE starts_with(line, '<p>')""")
def q_gbk_extract(spark, sf):
    return J.gbk_extract(spark, _p_lines(spark, sf), "<p>", "</p>")


@register("nonscript_chars", f"""
SELECT DISTINCT ch FROM (SELECT unnest(string_split({O.java_trim('line')}, '')) AS ch FROM {LINES_B})
WHERE ch <> '' AND NOT regexp_full_match(ch, {O.q('[' + SC + ']')})""")
def q_nonscript_chars(spark, sf):
    return ST.nonscript_chars(C.corpus_lines(spark, sf, "B"), "line", SC)


@register("nonscript_char_rank", f"""
WITH {TOK_CTE}
SELECT term, count(*) AS freq FROM (SELECT unnest(toks) AS term FROM tl)
WHERE length(term) = 1 AND NOT regexp_full_match(term, {O.q('[' + SC + ']')}) GROUP BY term""")
def q_nonscript_char_rank(spark, sf):
    return ST.nonscript_char_rank(J.term_freq(spark, sf), SC, "term", "freq")


@register("all_script_lines", f"""
SELECT DISTINCT {O.java_trim('lower(line)')} AS line FROM {LINES_B}
WHERE regexp_full_match({O.java_trim('lower(line)')}, {O.q('[' + SC + ' ]*')})""")
def q_all_script_lines(spark, sf):
    lines = C.corpus_lines(spark, sf, "B").select(F.lower("line").alias("line"))
    return ST.all_script_lines(lines, "line", SC + " ")


@register("duplicate_audit", f"""
SELECT count(*) AS total_lines, count(DISTINCT {O.java_trim('line')}) AS distinct_lines FROM {LINES_B}""")
def q_duplicate_audit(spark, sf):
    return ST.duplicate_audit(C.corpus_lines(spark, sf, "B"), "line", "n")


@register("kwic_pieces", f"""
WITH x AS (SELECT DISTINCT line FROM {LINES_B} WHERE contains(line, {O.q(J.KWIC_KEY)})),
c AS (SELECT regexp_replace(regexp_replace(translate(translate(translate(line, {O.q(FULL)}, {O.q(HALF)}), {O.q(J.VARIANTS[0])}, {O.q(J.VARIANTS[1])}),
            {O.q(J.TEST_STOP_CHARS)}, {O.q(',' * len(J.TEST_STOP_CHARS))}),
            {O.q('[' + K.EMOJI_CLASS + ']')}, ',', 'g'), {O.q('[^' + SC + ']')}, ',', 'g') AS l FROM x)
SELECT piece FROM (SELECT unnest(string_split(l, ',')) AS piece FROM c)
WHERE contains(piece, {O.q(J.KWIC_KEY)}) AND NOT contains(piece, {O.q(J.KWIC_EXCLUDE)})""")
def q_kwic(spark, sf):
    return KWO.kwic_pieces(C.corpus_lines(spark, sf, "B"), "line", J.KWIC_KEY, SC, J.TEST_STOP_CHARS, ",",
                           J.KWIC_EXCLUDE, J.VARIANTS)


@register("grep_tokens", f"""
WITH x AS (SELECT line FROM {LINES_B} WHERE contains(line, {O.q(J.KWIC_KEY)})),
c AS (SELECT regexp_replace(translate(translate(translate(line, {O.q(FULL)}, {O.q(HALF)}), {O.q(J.VARIANTS[0])}, {O.q(J.VARIANTS[1])}),
            {O.q(J.TEST_STOP_CHARS)}, {O.q(',' * len(J.TEST_STOP_CHARS))}), {O.q(CLEAN_NOALNUM)}, ',', 'g') AS l FROM x)
SELECT array_to_string({O.tokens('piece')}, ' ') AS tokens
FROM (SELECT unnest(string_split(l, ',')) AS piece FROM c) WHERE contains(piece, {O.q(J.KWIC_KEY)})""")
def q_grep_tokens(spark, sf):
    # Latin test text: the letters ARE the script, so the Alnum class is off
    lines = C.corpus_lines(spark, sf, "B")
    every = lines.select("line", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k"))  # each occurrence of a line
    return KWO.grep_tokens(every, "line", J.KWIC_KEY, J.word_units,
                           J.TEST_STOP_CHARS, ",", alnum=False, variants=J.VARIANTS)


@register("stop_edge_filter", f"""
WITH {DIFF_CTES}
SELECT term, {r('score')} AS score FROM sc
WHERE NOT ({' OR '.join(f"starts_with(term, {O.q(w)}) OR ends_with(term, {O.q(w)})" for w in C.STOP_WORDS)})""")
def q_stop_edge_filter(spark, sf):
    return r6(KWO.stop_edge_filter(J.diff(spark, sf)["candidates"], C.STOP_WORDS))


def _markers_sql(expr):
    xs = ", ".join(f"instr({expr}, {O.q(m)}) - 1" for m in J.MARKERS)
    return f"coalesce(list_min(list_filter([{xs}], lambda i: i >= 0)), -1)"


@register("text_functions", f"""
WITH x AS (SELECT DISTINCT line FROM {LINES_B}), y AS (SELECT line, translate(line, {O.q(J.ODD_CHARS[0])}, {O.q(J.ODD_CHARS[1])}) AS odd FROM x)
SELECT line,
  regexp_full_match(lower(line), {O.q('[' + SC + ' ]*')}) AS all_script,
  regexp_replace(line, {O.q('[^' + SC + ']')}, '*', 'g') AS non_script_masked,
  regexp_replace(odd, {O.q('[' + K.EMOJI_CLASS + ']')}, '*', 'g') AS emoji_masked,
  translate(odd, {O.q(FULL)}, {O.q(HALF)}) AS half_width,
  translate(line, {O.q(J.TEST_STOP_CHARS)}, {O.q('#' * len(J.TEST_STOP_CHARS))}) AS stop_masked,
  regexp_replace(line, {O.q(CLEAN_ALNUM)}, ',', 'g') AS class_cleaned,
  regexp_replace(string_split(line, chr(9))[1], {O.q(K.SPECIAL_KEY_CHARS)}, '', 'g') AS special_stripped,
  array_to_string(string_split(line, ',')[{K.TAIL_FIELD_START}:], '') AS tail_concat,
  reverse(line) AS reversed,
  CAST({_markers_sql('line')} AS BIGINT) AS first_marker
FROM y""")
def q_text_functions(spark, sf):
    # the tables hold no emoji or full-width text: some letters are turned into such
    x = C.distinct_lines(spark, sf, "B").withColumn("odd", F.translate("line", *J.ODD_CHARS))
    return r6(x.select(
        "line",
        TX.all_script(F.lower("line"), SC + " ").alias("all_script"),
        TX.replace_non_script("line", "*", SC).alias("non_script_masked"),
        TX.replace_emoji("odd", "*").alias("emoji_masked"),
        TX.half_width("odd").alias("half_width"),
        TX.mask_chars("line", J.TEST_STOP_CHARS, "#").alias("stop_masked"),
        TX.clean_classes("line", ",", alnum=True).alias("class_cleaned"),
        TX.strip_special("line").alias("special_stripped"),
        TX.tail_concat("line").alias("tail_concat"),
        TX.reverse_str("line").alias("reversed"),
        TX.first_marker_index("line", J.MARKERS).cast("bigint").alias("first_marker"),
    ))


@register("word_functions", f"""
WITH x AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(line, ' ')) AS w FROM {LINES_B}))
SELECT w, (length(w) > 1 AND len(list_distinct(string_split(w, ''))) = 1) AS is_reduplication,
  regexp_full_match(lower(w), '[a-z0-9]*') AS alnum_only,
  {r('1.0 / exp(abs(length(w) - 4.5) * 0.3)')} AS length_factor,
  regexp_full_match(w, {O.q('[' + SC + ']')}) AS is_script FROM x""")
def q_word_functions(spark, sf):
    words = C.distinct_lines(spark, sf, "B").select(F.explode(F.split("line", " ")).alias("w")).distinct()
    return r6(words.select("w", TX.is_reduplication("w").alias("is_reduplication"), TX.is_alnum_only("w").alias("alnum_only"),
                           TX.length_factor("w").alias("length_factor"), TX.is_script("w", SC).alias("is_script")))


# ---------------------------------------------------------------------------
# P3 modes and lookups by join; F3-F6 and F10 where they apply
# ---------------------------------------------------------------------------

def _token_counts(df):
    return df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("tokens_whitespace", f"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(rtrim(line, ' '), ' ')) AS token FROM (SELECT DISTINCT line FROM {LINES_B})) GROUP BY token""")
def q_tokens_whitespace(spark, sf):
    return _token_counts(C.distinct_lines(spark, sf).select(C.tk.tokenize("line", "whitespace", keep_empty=True).alias("tokens")))


@register("tokens_char", f"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS token FROM (SELECT DISTINCT line FROM {LINES_B})) WHERE token <> '' GROUP BY token""")
def q_tokens_char(spark, sf):
    return _token_counts(C.distinct_lines(spark, sf).select(C.tk.tokenize("line", "char").alias("tokens")))


@register("tokens_lexicon")
def q_tokens_lexicon(spark, sf):
    lines = C.distinct_lines(spark, sf).select(F.lower("line").alias("line"))
    return _token_counts(C.tk.tokenize_lexicon(lines, "line", J.positives(spark, sf)))


@register("pos_join", f"""
WITH t AS (SELECT unnest({O.tokens('line')}) AS word FROM (SELECT DISTINCT line FROM {LINES_B}))
SELECT t.word AS word, {O.tag_expr('t.word', 'lx.tag')} AS pos, count(*) AS n FROM t LEFT JOIN {O.lexicon_values()} lx ON lx.word = t.word GROUP BY ALL""")
def q_pos_join(spark, sf):
    lines = C.tokens_of(C.distinct_lines(spark, sf))
    t = C.tk.tag_tokens_join(lines, "line", "tokens", C.lexicon(spark), "pos", C.DEFAULT_POS, C.NONSCRIPT_POS, C.SCRIPT_CLASS)
    return (t.select(F.explode(F.arrays_zip("tokens", "pos")).alias("x")).select(F.col("x.tokens").alias("word"), "x.pos")
            .groupBy("word", "pos").agg(F.count(F.lit(1)).alias("n")))


@register("stop_segments_join", f"""
WITH {O.segments_ctes('B', stop_only=True).lstrip()}
SELECT array_to_string(seg, ' ') AS segment, count(*) AS n FROM segs GROUP BY 1""")
def q_stop_segments_join(spark, sf):
    stop = spark.createDataFrame([(w,) for w in C.STOP_WORDS], "word string")
    s = C.tk.explode_segments(C.tk.cut_words_join(C.tokens_of(C.distinct_lines(spark, sf)), "line", "tokens", stop))
    return s.groupBy(F.array_join("seg", " ").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def _rules_sql() -> str:
    begin, end, inside = (" OR ".join(f"{fn}(term, {O.q(w)})" for w in ws) for fn, ws in
                          (("starts_with", J.NO_BEGIN), ("ends_with", J.NO_END), ("contains", J.NO_IN)))

    def tags(i, prefixes):
        return "(" + " OR ".join(f"starts_with(tags[{i}], {O.q(p)})" for p in prefixes) + ")"
    some = " OR ".join(f"starts_with(x, {O.q(p)})" for p in K.ANY_POS_DROP)
    rules = {"affix": f"{begin} OR {end} OR {inside}", "single_token": f"len(tags) = 1 AND {tags(1, K.SINGLE_TOKEN_DROP_POS)}",
             "pos_pattern": f"{tags(1, K.FIRST_POS_DROP)} OR {tags('len(tags)', K.LAST_POS_DROP)} OR len(list_filter(tags, lambda x: {some})) > 0",
             "verb_tail": f"starts_with(tags[len(tags)], {O.q(K.VERB_POS)})",
             "reduplication": "length(replace(term, ' ', '')) > 1 AND len(list_distinct(string_split(replace(term, ' ', ''), ''))) = 1"}
    return f"""WITH {O.segments_ctes('B', stop_only=True).lstrip()},
bt AS (SELECT DISTINCT term FROM (SELECT unnest(seg) AS term FROM segs UNION ALL
       SELECT seg[i] || ' ' || seg[i + 1] AS term FROM (SELECT seg, unnest(generate_series(1, len(seg) - 1)) AS i FROM segs))
       WHERE regexp_full_match(term, {O.q('[' + SC + ' ]+')})),
tk2 AS (SELECT term, unnest(string_split(term, ' ')) AS tok, generate_subscripts(string_split(term, ' '), 1) AS i FROM bt),
tg2 AS (SELECT term, list({O.tag_expr('tok', 'lx.tag')} ORDER BY i) AS tags FROM tk2 LEFT JOIN {O.lexicon_values()} lx ON lx.word = tok GROUP BY term)
""" + " UNION ALL ".join(f"SELECT '{k}' AS rule, term FROM tg2 WHERE NOT ({v})" for k, v in rules.items())


@register("rule_filters", _rules_sql())
def q_rule_filters(spark, sf):
    return J.rule_filters(spark, sf)


def _affix_sql():
    """Rules from lists that are tables: prefixes from part types, suffixes from benchmark words, infixes from part names."""
    words = O.q(C.TOKEN_PATTERN)
    return f"""WITH {O.segments_ctes('B', stop_only=True).lstrip()},
bt AS (SELECT DISTINCT term FROM (SELECT unnest(seg) AS term FROM segs UNION ALL
       SELECT seg[i] || ' ' || seg[i + 1] AS term FROM (SELECT seg, unnest(generate_series(1, len(seg) - 1)) AS i FROM segs))
       WHERE regexp_full_match(term, {O.q('[' + SC + ' ]+')})),
b AS (SELECT DISTINCT left(word, 3) AS word FROM (SELECT unnest(regexp_extract_all(lower(p_type), {words})) AS word FROM part)),
e AS (SELECT DISTINCT right(word, 4) AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {words})) AS word FROM benchmark)),
i AS (SELECT DISTINCT substring(word, 2, 3) AS word FROM (SELECT unnest(regexp_extract_all(lower(p_name), {words})) AS word FROM part))
SELECT term FROM bt WHERE NOT EXISTS (SELECT 1 FROM b WHERE starts_with(term, word)) AND NOT EXISTS (SELECT 1 FROM e WHERE ends_with(term, word))
  AND NOT EXISTS (SELECT 1 FROM i WHERE contains(term, word))"""


@register("affix_lists", _affix_sql())
def q_affix_lists(spark, sf):
    from termspark.operators import rank as rk

    def words(table, column, cut):
        t = C.table(spark, sf, table).select(F.explode(J.word_units(F.lower(column))).alias("word"))
        return t.select(F.expr(cut).alias("word")).distinct()
    return rk.affix_filter_join(J.stop_bigrams(spark, sf).select("term"), "term", words("part", "p_type", "left(word, 3)"),
                                words("benchmark", "text", "right(word, 4)"), words("part", "p_name", "substring(word, 2, 3)"))


PHRASES = {"tion": "sion", "ti": "xi", "ment": "mant", "me": "mi", "on": "an", "ion": "yon", " de ": " of ", "de": "d'"}


@register("phrase_mapping", f"""
SELECT line, array_to_string(list_transform(regexp_extract_all(line, {O.q('|'.join(sorted(PHRASES, key=lambda p: -len(p))) + '|[^a-z ]+|(?s:.)')}),
  lambda x: CASE {' '.join(f"WHEN x = {O.q(a)} THEN {O.q(b)}" for a, b in PHRASES.items())} ELSE x END), '') AS mapped
FROM (SELECT DISTINCT line FROM {LINES_B})""")
def q_phrase_mapping(spark, sf):
    return C.distinct_lines(spark, sf, "B").select("line", TX.map_phrases("line", PHRASES).alias("mapped"))


def _keys_sql():
    return f"""WITH w AS (SELECT string_split(text, ' ') AS t FROM benchmark),
keys AS (SELECT DISTINCT key FROM (SELECT unnest(t) AS key FROM w UNION ALL
  SELECT t[i] || ' ' || t[i + 1] FROM (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM w) UNION ALL
  SELECT t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM (SELECT t, unnest(generate_series(1, len(t) - 2)) AS i FROM w)) WHERE length(key) >= 4),
x AS (SELECT key, line FROM (SELECT DISTINCT line FROM {LINES_B}) JOIN keys ON contains(line, key)),
c AS (SELECT key, regexp_replace(regexp_replace(translate(translate(translate(line, {O.q(FULL)}, {O.q(HALF)}), {O.q(J.VARIANTS[0])}, {O.q(J.VARIANTS[1])}),
            {O.q(J.TEST_STOP_CHARS)}, {O.q(',' * len(J.TEST_STOP_CHARS))}),
            {O.q('[' + K.EMOJI_CLASS + ']')}, ',', 'g'), {O.q('[^ ' + SC + ']')}, ',', 'g') AS l FROM x)
SELECT key, count(*) AS n, count(DISTINCT piece) AS n_distinct FROM (SELECT key, unnest(string_split(l, ',')) AS piece FROM c) WHERE contains(piece, key) GROUP BY key"""


@register("kwic_many", _keys_sql())
def q_kwic_many(spark, sf):
    found = J.kwic_many(spark, sf, counted=True)
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


# ---------------------------------------------------------------------------
# X13 char-mode miner
# ---------------------------------------------------------------------------

CHAR_CTES = f"""cl AS (SELECT lower(line) AS line FROM {LINES_B}),
cpc AS (SELECT p FROM (SELECT unnest(string_split(regexp_replace(translate(line, {O.q(J.TEST_STOP_CHARS)},
            {O.q(' ' * len(J.TEST_STOP_CHARS))}), {O.q(CLEAN_NOALNUM)}, ' ', 'g'), ' ')) AS p FROM cl)
        WHERE trim(p) <> '' AND regexp_full_match(p, {O.q('[' + SC + ']+')})),
ci AS (SELECT p, unnest(generate_series(1, length(p))) AS i FROM cpc),
ck AS (SELECT p, i, unnest(generate_series(1, least({J.CHAR_MAX_LEN - 1}, length(p) - i + 1))) AS k FROM ci),
cocc AS MATERIALIZED (SELECT substring(p, i, k) AS gram,
         CASE WHEN i = 1 THEN '$' ELSE substring(p, i - 1, 1) END AS prev,
         CASE WHEN i + k > length(p) THEN '$' ELSE substring(p, i + k, 1) END AS next FROM ck),
crc AS (SELECT gram, next AS ctx, count(*) AS c FROM cocc GROUP BY ALL),
clc AS (SELECT gram, prev AS ctx, count(*) AS c FROM cocc GROUP BY ALL),
cre AS MATERIALIZED (SELECT gram, freq, -sum(c / freq * log2(c / freq)) AS entropy
        FROM (SELECT gram, c, sum(c) OVER (PARTITION BY gram) AS freq FROM crc) GROUP BY gram, freq),
cle AS (SELECT gram, freq, -sum(c / freq * log2(c / freq)) AS entropy
        FROM (SELECT gram, c, sum(c) OVER (PARTITION BY gram) AS freq FROM clc) GROUP BY gram, freq),
cm AS (SELECT r.gram, r.freq, least(l.entropy, r.entropy) AS entropy FROM cre r JOIN cle l USING (gram)),
ctot AS (SELECT count(*) AS n FROM cre),
csp AS (SELECT gram, freq, entropy, unnest(generate_series(1, length(gram) - 1)) AS j FROM cm
        WHERE length(gram) > 1),
cpp AS (SELECT x.gram, x.freq, x.entropy, max(a.freq * b.freq) AS ff FROM csp x
        JOIN cre a ON a.gram = substring(x.gram, 1, x.j) JOIN cre b ON b.gram = substring(x.gram, x.j + 1)
        GROUP BY x.gram, x.freq, x.entropy),
cpmi AS (SELECT gram, freq, entropy, CASE WHEN qt > 0 THEN log2(qt) END AS pmi
         FROM (SELECT gram, freq, entropy, (CAST(freq AS BIGINT) * (SELECT n FROM ctot)) // CAST(ff AS BIGINT) AS qt FROM cpp)),
ptk AS (SELECT t FROM (SELECT unnest({O.tokens('line')}) AS t FROM {LINES_B}) WHERE regexp_full_match(t, {O.q('[' + SC + ']+')})),
pcs AS (SELECT substring(t, i, 1) AS ch, CASE WHEN i = 1 THEN 'b' WHEN i = length(t) THEN 'e' ELSE 'm' END AS slot
        FROM (SELECT t, unnest(generate_series(1, length(t))) AS i FROM ptk)),
ppr AS (SELECT ch, count(*) FILTER (WHERE slot = 'b') / count(*) AS p1, count(*) FILTER (WHERE slot = 'e') / count(*) AS p3
        FROM pcs GROUP BY ch),
cpp2 AS MATERIALIZED (SELECT m.*, CASE WHEN f.p1 IS NOT NULL AND l.p3 IS NOT NULL THEN least(f.p1, l.p3) ELSE -1.0 END AS pos_prob
         FROM cpmi m LEFT JOIN ppr f ON f.ch = substring(m.gram, 1, 1) LEFT JOIN ppr l ON l.ch = substring(m.gram, -1, 1))"""


@register("char_right_entropy", f"WITH {CHAR_CTES} SELECT gram, freq, {r('entropy')} AS entropy FROM cre")
def q_char_right(spark, sf):
    return r6(J.char_side(spark, sf, "right"))


@register("char_left_entropy", f"WITH {CHAR_CTES} SELECT gram, freq, {r('entropy')} AS entropy FROM cle")
def q_char_left(spark, sf):
    return r6(J.char_side(spark, sf, "left"))


@register("char_entropy_merge", f"WITH {CHAR_CTES} SELECT gram, freq, {r('entropy')} AS entropy FROM cm")
def q_char_merge(spark, sf):
    return r6(J.char_merged(J.materialize(J.char_entropies(spark, sf))))


@register("char_pmi", f"""WITH {CHAR_CTES}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi, {r('pos_prob')} AS pos_prob FROM cpp2
WHERE pmi IS NOT NULL""")
def q_char_pmi(spark, sf):
    return r6(J.char_scored(spark, sf).where(F.col("pmi").isNotNull()))


@register("char_terms", f"""WITH {CHAR_CTES}
SELECT gram, freq, {r('entropy')} AS entropy, {r('pmi')} AS pmi, {r('pos_prob')} AS pos_prob FROM cpp2
WHERE pmi >= {J.CHAR_FLOORS['min_pmi']} AND entropy >= {J.CHAR_FLOORS['min_entropy']} AND pos_prob >= {J.CHAR_FLOORS['min_pos_prob']}""")
def q_char_terms(spark, sf):
    return r6(PM.char_term_filter(J.char_scored(spark, sf), **J.CHAR_FLOORS))


# ---------------------------------------------------------------------------
# M4 classifier (MLlib; rows-only check: no SQL oracle for a fitted model)
# ---------------------------------------------------------------------------

@register("classify")
def q_classify(spark, sf):
    return r6(J.classify(spark, sf))


@register("classify_view", f"""
WITH {DIFF_CTES}
SELECT term, {r('score')} AS score, TRUE AS is_probability FROM sc""")
def q_classify_view(spark, sf):
    """What is certain of a fitted model's output: its rows, and that pred is a probability."""
    x = J.classify(spark, sf)
    return r6(x.select("term", "score", ((F.col("pred") >= 0) & (F.col("pred") <= 1)).alias("is_probability")))


@register("calibration_view", f"""
WITH posl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(C.TOKEN_PATTERN)})) AS w FROM benchmark)
              WHERE regexp_full_match(w, {O.q('[' + C.SCRIPT_CLASS + ']+')})),
negl AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE {O.not_blank('w')})
SELECT (SELECT count(*) FROM posl) + (SELECT count(*) FROM negl) AS n, (SELECT count(*) FROM posl) AS positives, TRUE AS sums_up""")
def q_calibration_view(spark, sf):
    """What is certain of a calibration: every labelled word is held out once, and the
    probabilities add up to the targets that they were fitted to."""
    x = J.calibration(spark, sf).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum(F.col("n") * F.col("mean_pred")).alias("p"))
    n1, n0 = F.col("positives"), F.col("n") - F.col("positives")
    targets = n1 * (n1 + 1) / (n1 + 2) + n0 / (n0 + 2)
    return x.select("n", "positives", (F.abs(F.col("p") - targets) < 0.001 * F.col("n")).alias("sums_up"))


@register("calibration")
def q_calibration(spark, sf):
    return r6(J.calibration(spark, sf))


# ---------------------------------------------------------------------------
# M2 + J8 rank-mode features, F6 verb-tail filter
# ---------------------------------------------------------------------------

RANK_LEXICAL = ["length", "char_idf_sum", "char_idf_avg", "word_idf_sum", "word_idf_avg",
                "hot_char_sum", "hot_char_avg", "hot_word_sum", "hot_word_avg"]
RANK_COLS = ", ".join(["term"] + [f"{r(c)} AS {c}" for c in RANK_LEXICAL]
                      + [c if c in ("ext5", "ext6", "ext7") else f"{r(c)} AS {c}" for c in (f"ext{i}" for i in range(1, 13))])
EXT_CTES = """,
gt AS (SELECT b.gram AS gram, b.freq AS freq, b.left_entropy AS l, b.right_entropy AS rt, coalesce(a.freq, 0) AS af,
              a.left_entropy AS al, a.right_entropy AS ar FROM b_ent b LEFT JOIN a_ent a ON a.gram = b.gram WHERE b.freq >= 5),
ext AS (SELECT replace(gram, ',', ' ') AS term, CAST(freq AS DOUBLE) AS ext1, CAST(af AS DOUBLE) AS ext2, l AS ext3, rt AS ext4,
        af > 0 AS ext5, contains(gram, ',') AS ext6, af >= 5 AS ext7, coalesce(al, 0.0) AS ext8, coalesce(ar, 0.0) AS ext9,
        af / freq AS ext10, CAST(length(gram) AS DOUBLE) AS ext11, abs(l - rt) AS ext12 FROM gt)"""


@register("rank_features", f"""
WITH {DIFF_CTES}{O.features_ctes('sc')}{EXT_CTES}
SELECT {RANK_COLS}, {r('score')} AS score FROM sc JOIN feat USING (term) JOIN ext USING (term)""")
def q_rank_features(spark, sf):
    return r6(J.rank_tables(spark, sf)[1])


@register("rank_training", f"""
WITH {SCORED_CTES.lstrip()}{POSNEG_CTES},
lab AS (SELECT word AS term, 1 AS label FROM posl UNION ALL SELECT word AS term, 0 AS label FROM negl)
{O.features_ctes('lab')}{EXT_CTES}
SELECT {RANK_COLS}, lab.label AS label FROM lab JOIN feat USING (term) JOIN ext USING (term)""")
def q_rank_training(spark, sf):
    return r6(J.rank_tables(spark, sf)[0])


@register("verb_tail_filter", f"""
WITH {DIFF_CTES},
vtk AS (SELECT term, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
        FROM (SELECT DISTINCT term, regexp_extract_all(lower(term), {O.q(C.TOKEN_PATTERN)}) AS toks FROM sc)),
vtg AS (SELECT vtk.term, list({O.tag_expr('vtk.tok', 'lx.tag')} ORDER BY vtk.i) AS tags
        FROM vtk LEFT JOIN {O.lexicon_values()} lx ON vtk.tok = lx.word GROUP BY vtk.term)
SELECT sc.term, {r('sc.score')} AS score FROM sc JOIN vtg USING (term) WHERE NOT starts_with(tags[len(tags)], 'v')""")
def q_verb_tail_filter(spark, sf):
    from termspark.operators import rank as rk
    x = J.term_pos(J.diff(spark, sf)["candidates"])
    return r6(rk.verb_tail_filter(x).drop("pos"))
