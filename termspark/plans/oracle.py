"""DuckDB SQL building blocks for the oracle queries.

The oracle formulations are deliberately independent of the Spark ones:
segments come from ``unnest`` + a running-sum window instead of array
arithmetic, entropy from the textbook ``-sum p log2 p`` instead of the
algebraic two-pass form, and so on.  Only the parameters (patterns, lists)
are shared.
"""
from __future__ import annotations

from collections.abc import Iterable

from termspark.functions import constants as K
from termspark.plans import corpus as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words: Iterable[str]) -> str:
    return ", ".join(q(w) for w in words)


def r6(expr: str) -> str:
    """Round a double to 6 places and fold -0.0 into 0.0."""
    return f"(round({expr}, 6) + 0.0)"


def not_blank(expr: str) -> str:
    return f"regexp_matches({expr}, '[^\\x00-\\x20]')"


def java_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def lines(corpus: str = "B") -> str:
    where = "WHERE lang <> 'en'" if corpus == "A" else ""
    return f"""(SELECT doc_id, line_no, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents {where}) WHERE {not_blank('line')})"""


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(C.TOKEN_PATTERN)})"


def script_full(expr: str) -> str:
    return f"regexp_full_match({expr}, {q('[' + C.SCRIPT_CLASS + ']+')})"


def lexicon_values() -> str:
    seen, rows = set(), []
    for pos, words in C.POS_LEXICON.items():
        for w in words:
            if w not in seen:
                seen.add(w)
                rows.append(f"({q(w)}, {q(pos)})")
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) v(word, tag))"


def tag_expr(tok: str, lex_tag: str) -> str:
    return (f"CASE WHEN NOT {script_full(tok)} THEN {q(C.NONSCRIPT_POS)} "
            f"ELSE coalesce({lex_tag}, {q(C.DEFAULT_POS)}) END")


def segments_ctes(corpus: str = "B", dedup: bool = True, stop_only: bool = False, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}segs(line, seg_id, seg)``."""
    p = prefix
    src = f"SELECT DISTINCT line FROM {lines(corpus)}" if dedup else f"SELECT line FROM {lines(corpus)}"
    if stop_only:
        cut = f"(tok IN ({lst(C.STOP_WORDS)}))"
    else:
        pos_cut = " OR ".join(f"starts_with(tag, {q(x)})" for x in K.CUT_POS_PREFIXES)
        cut = f"({pos_cut} OR NOT {script_full('tok')} OR tok IN ({lst(C.STOP_WORDS)}))"
    return f"""
{p}dl AS MATERIALIZED ({src}),
{p}tl AS (SELECT line, {tokens('line')} AS toks FROM {p}dl),
{p}tk AS (SELECT line, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {p}tl),
{p}tg AS (SELECT tk.line, tk.pos, tk.tok, {tag_expr('tk.tok', 'lx.tag')} AS tag
        FROM {p}tk tk LEFT JOIN {lexicon_values()} lx ON tk.tok = lx.word),
{p}cf AS (SELECT line, pos, tok, {cut} AS is_cut FROM {p}tg),
{p}sg AS (SELECT line, pos, tok, is_cut,
        sum(CASE WHEN is_cut THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY pos) AS seg_id FROM {p}cf),
{p}segs AS MATERIALIZED (SELECT line, seg_id, list(tok ORDER BY pos) AS seg FROM {p}sg WHERE NOT is_cut GROUP BY line, seg_id)"""


def occurrences_ctes(corpus: str = "B", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}occ(gram, k, prev, next)``."""
    p = prefix
    return segments_ctes(corpus, prefix=prefix) + f""",
{p}sp AS (SELECT seg, unnest(generate_series(1, len(seg))) AS i FROM {p}segs),
{p}gk AS (SELECT seg, i, unnest(generate_series(1, least(4, len(seg) - i + 1))) AS k FROM {p}sp),
{p}occ AS MATERIALIZED (SELECT array_to_string(seg[i:i + k - 1], ',') AS gram, k,
        CASE WHEN i = 1 THEN '$' ELSE seg[i - 1] END AS prev,
        CASE WHEN i + k > len(seg) THEN '$' ELSE seg[i + k] END AS next FROM {p}gk)"""


def entropy_ctes(prefix: str = "") -> str:
    """From ``{prefix}occ``: ``{prefix}ent(gram, freq, left_entropy, right_entropy)``."""
    p = prefix
    return f""",
{p}fr AS MATERIALIZED (SELECT gram, count(*) AS freq FROM {p}occ GROUP BY gram),
{p}lc AS (SELECT gram, prev AS ctx, count(*) AS c FROM {p}occ GROUP BY gram, prev),
{p}rc AS (SELECT gram, next AS ctx, count(*) AS c FROM {p}occ GROUP BY gram, next),
{p}le AS (SELECT x.gram, sum(CASE WHEN x.ctx = '$' THEN -log2(x.c / f.freq)
                 ELSE -(x.c / f.freq) * log2(x.c / f.freq) END) AS h
        FROM {p}lc x JOIN {p}fr f USING (gram) GROUP BY x.gram),
{p}re AS (SELECT x.gram, sum(CASE WHEN x.ctx = '$' THEN -log2(x.c / f.freq)
                 ELSE -(x.c / f.freq) * log2(x.c / f.freq) END) AS h
        FROM {p}rc x JOIN {p}fr f USING (gram) GROUP BY x.gram),
{p}ent AS MATERIALIZED (SELECT f.gram, f.freq, l.h AS left_entropy, r.h AS right_entropy
        FROM {p}fr f JOIN {p}le l USING (gram) JOIN {p}re r USING (gram))"""


def cohesion_ctes(corpus: str = "B", prefix: str = "") -> str:
    """``{prefix}coh(gram, freq, entropy)`` = A9 on the corpus."""
    p = prefix
    return occurrences_ctes(corpus, prefix) + entropy_ctes(prefix) + f""",
{p}coh AS MATERIALIZED (SELECT gram, freq, entropy FROM (
        SELECT gram, freq, CASE WHEN contains(gram, ',') THEN least(left_entropy, right_entropy)
               ELSE ln(freq) END AS entropy FROM {p}ent WHERE freq >= 5) WHERE entropy >= 1.5)"""


def pmi_ctes(scored: str, freqt: str, out: str, single: str = "0.8 * length(s.gram) + 0.5",
             missing_zero: bool = False) -> str:
    """``out(gram, freq, entropy, pmi)`` for ``scored(gram, freq, entropy)``
    with marginals ``freqt(gram, freq)``; no pmi floor applied."""
    join = "LEFT JOIN" if missing_zero else "JOIN"
    lf = "coalesce(a.freq, 0)" if missing_zero else "a.freq"
    rf = "coalesce(b.freq, 0)" if missing_zero else "b.freq"
    return f""",
{out}_tot AS (SELECT sum(freq) AS total FROM {freqt}),
{out}_sp AS (SELECT s.gram, s.freq, s.entropy, string_split(s.gram, ',') AS t,
        unnest(generate_series(1, len(string_split(s.gram, ',')) - 1)) AS j
        FROM {scored} s WHERE contains(s.gram, ',')),
{out}_pp AS (SELECT x.gram, x.freq, x.entropy, max({lf} * {rf}) AS ff
        FROM {out}_sp x {join} {freqt} a ON a.gram = array_to_string(x.t[1:x.j], ',')
        {join} {freqt} b ON b.gram = array_to_string(x.t[x.j + 1:], ',')
        GROUP BY x.gram, x.freq, x.entropy),
{out} AS (SELECT gram, freq, entropy,
        CASE WHEN ff = 0 THEN 'inf'::DOUBLE ELSE log2(freq * (SELECT total FROM {out}_tot) / ff) END AS pmi
        FROM {out}_pp
        UNION ALL
        SELECT s.gram, s.freq, s.entropy, CAST({single} AS DOUBLE) AS pmi
        FROM {scored} s WHERE NOT contains(s.gram, ','))"""


def diff_ctes(scored_ctes: str) -> str:
    """X6 on top of ``b_scored`` / ``a_scored``: ``nw`` (new), ``rs`` (risen),
    ``rk`` (risen kept), ``bt`` (excluded head words), ``sc`` (candidates)."""
    from termspark.plans import jobs as J
    return scored_ctes + f""",
bf AS MATERIALIZED (SELECT * FROM b_scored WHERE freq >= 5 AND entropy >= 2 AND pmi >= 1.5),
nw AS (SELECT * FROM bf WHERE gram NOT IN (SELECT gram FROM a_scored)),
rs AS (SELECT bf.*, a.freq AS a_freq, a.entropy AS a_entropy, a.pmi AS a_pmi
       FROM bf JOIN a_scored a USING (gram)
       WHERE a.freq * 10 < bf.freq AND (a.entropy < bf.entropy OR a.pmi < bf.pmi)),
tp AS (SELECT gram FROM (SELECT gram, row_number() OVER (ORDER BY freq DESC, gram) AS rn FROM a_scored)
       WHERE rn <= (SELECT count(*) FROM bf) // {J.HEAD_DIVISOR}),
rk AS (SELECT * FROM rs WHERE NOT (gram IN (SELECT gram FROM tp) AND NOT contains(gram, {q(J.PROTECTED)}))),
bt AS (SELECT * FROM rs WHERE gram IN (SELECT gram FROM tp) AND NOT contains(gram, {q(J.PROTECTED)})),
al AS (SELECT gram, freq, entropy, pmi FROM nw UNION ALL SELECT gram, freq, entropy, pmi FROM rk),
sc AS MATERIALIZED (SELECT replace(gram, ',', ' ') AS term, freq, entropy, pmi,
       sqrt(freq) * entropy * pmi * (1.0 / exp(abs(length(gram) - 4.5) * 0.3)) AS score
       FROM al WHERE NOT (length(replace(gram, ',', '')) > 1
                          AND len(list_distinct(string_split(replace(gram, ',', ''), ''))) = 1))"""


def features_ctes(terms: str, out: str = "feat") -> str:
    """13 filter features per distinct term of ``terms(term)`` -> ``out``."""
    pat = q(C.TOKEN_PATTERN)
    return f""",
f_tl AS MATERIALIZED (SELECT doc_id, line_no, {tokens('line')} AS toks FROM {lines('B')}),
f_n AS (SELECT count(*) AS n FROM f_tl),
widf AS (SELECT term, ln((SELECT n FROM f_n) / count(*)) AS idf
         FROM (SELECT DISTINCT doc_id, line_no, unnest(toks) AS term FROM f_tl) GROUP BY term),
cidf AS (SELECT term, ln((SELECT n FROM f_n) / count(*)) AS idf
         FROM (SELECT DISTINCT doc_id, line_no, unnest(string_split(t, '')) AS term
               FROM (SELECT doc_id, line_no, unnest(toks) AS t FROM f_tl)) WHERE term <> '' GROUP BY term),
posw AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), {pat})) AS w FROM benchmark)
         WHERE regexp_full_match(w, {q('[' + C.SCRIPT_CLASS + ']+')})),
hw AS (SELECT t AS term, count(*) AS hot FROM (SELECT unnest(regexp_extract_all(lower(word), {pat})) AS t FROM posw) GROUP BY t),
hc AS (SELECT c AS term, count(*) AS hot FROM (SELECT unnest(string_split(word, '')) AS c FROM posw) WHERE c <> '' GROUP BY c),
ft AS (SELECT DISTINCT term FROM {terms}),
fcu AS (SELECT term, unnest(string_split(term, '')) AS u FROM ft),
fwu AS (SELECT term, unnest(regexp_extract_all(lower(term), {pat})) AS u FROM ft),
s1 AS (SELECT x.term, sum(t.idf) AS s, count(t.idf) AS n, min(t.idf) AS mn, max(t.idf) AS mx
       FROM fcu x JOIN cidf t ON t.term = x.u GROUP BY x.term),
s2 AS (SELECT x.term, sum(t.idf) AS s, count(t.idf) AS n, min(t.idf) AS mn, max(t.idf) AS mx
       FROM fwu x JOIN widf t ON t.term = x.u GROUP BY x.term),
s3 AS (SELECT x.term, sum(t.hot) AS s, count(t.hot) AS n FROM fcu x JOIN hc t ON t.term = x.u GROUP BY x.term),
s4 AS (SELECT x.term, sum(t.hot) AS s, count(t.hot) AS n FROM fwu x JOIN hw t ON t.term = x.u GROUP BY x.term),
{out} AS MATERIALIZED (SELECT ft.term, CAST(length(ft.term) AS DOUBLE) AS length,
       coalesce(s1.s, 0.0) AS char_idf_sum, coalesce(s1.s, 0.0) / (coalesce(s1.n, 0) + 1e-8) AS char_idf_avg,
       coalesce(s1.mn, 0.0) AS char_idf_min, coalesce(s1.mx, 0.0) AS char_idf_max,
       coalesce(s2.s, 0.0) AS word_idf_sum, coalesce(s2.s, 0.0) / (coalesce(s2.n, 0) + 1e-8) AS word_idf_avg,
       coalesce(s2.mn, 0.0) AS word_idf_min, coalesce(s2.mx, 0.0) AS word_idf_max,
       CAST(coalesce(s3.s, 0) AS DOUBLE) AS hot_char_sum, coalesce(s3.s, 0) / (coalesce(s3.n, 0) + 1e-8) AS hot_char_avg,
       CAST(coalesce(s4.s, 0) AS DOUBLE) AS hot_word_sum, coalesce(s4.s, 0) / (coalesce(s4.n, 0) + 1e-8) AS hot_word_avg
       FROM ft LEFT JOIN s1 USING (term) LEFT JOIN s2 USING (term) LEFT JOIN s3 USING (term) LEFT JOIN s4 USING (term))"""


def final_ctes() -> str:
    """X9 on top of ``sc`` and ``feat``: ``fin(term, freq, entropy, pmi, pred, final_score)``."""
    from termspark.plans import jobs as J
    pat = q(C.TOKEN_PATTERN)
    any_bad = " OR ".join(f"starts_with(x, {q(p)})" for p in K.ANY_POS_DROP)
    f4 = " OR ".join(f"starts_with(tags[1], {q(p)})" for p in K.SINGLE_TOKEN_DROP_POS)
    f5a = " OR ".join(f"starts_with(tags[1], {q(p)})" for p in K.FIRST_POS_DROP)
    f5b = " OR ".join(f"starts_with(tags[len(tags)], {q(p)})" for p in K.LAST_POS_DROP)
    f3 = " OR ".join([f"starts_with(term, {q(w)})" for w in J.NO_BEGIN]
                     + [f"ends_with(term, {q(w)})" for w in J.NO_END]
                     + [f"contains(term, {q(w)})" for w in J.NO_IN])
    return f""",
pr AS (SELECT DISTINCT term, 1.0 / (1.0 + exp(-(word_idf_avg - 4.0))) AS pred FROM feat WHERE term IN (SELECT term FROM sc)),
fl AS (SELECT s.term, s.freq, s.entropy, s.pmi, p.pred,
       sqrt(s.freq) * sqrt(s.freq) * s.entropy * s.pmi * (1.0 / exp(abs(length(s.term) - 4.5) * 0.3)) * exp(p.pred) AS final_score
       FROM sc s JOIN pr p USING (term) WHERE p.pred >= 0.3 AND s.pmi >= 2 AND s.freq >= 20),
ftk AS (SELECT term, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
        FROM (SELECT DISTINCT term, regexp_extract_all(lower(term), {pat}) AS toks FROM fl)),
ftg AS (SELECT ftk.term, list({tag_expr('ftk.tok', 'lx.tag')} ORDER BY ftk.i) AS tags
        FROM ftk LEFT JOIN {lexicon_values()} lx ON ftk.tok = lx.word GROUP BY ftk.term),
fin AS (SELECT fl.* FROM fl JOIN ftg USING (term)
        WHERE NOT (len(tags) = 1 AND ({f4}))
          AND NOT ({f3})
          AND NOT ({f5a} OR {f5b} OR len(list_filter(tags, lambda x: {any_bad})) > 0))"""
