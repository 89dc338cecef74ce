"""Composite jobs (X1-X14) wired onto the driver's test tables.

Each function is a thin composition of operators; the operators carry the
semantics.  Nothing here collects rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import not_blank
from termspark.operators import cohesion as coh
from termspark.operators import compare as cmp
from termspark.operators import features as fe
from termspark.operators import growth as gr
from termspark.operators import index as ix
from termspark.operators import keywords as kw
from termspark.operators import labels as lb
from termspark.operators import model as md
from termspark.operators import ngrams as ng
from termspark.operators import pmi as pm
from termspark.operators import rank as rk
from termspark.operators import state as sv
from termspark.operators import stats as st
from termspark.operators import suffixes as sx
from termspark.plans import corpus as C
from termspark.session import checkpoint_dir, materialize
from termspark.sources import readers, sinks

# -- X1 corpus extraction ---------------------------------------------------------


def extract_corpus(spark: SparkSession, paths, out: str, encoding: str = "GBK", open_tag: str = K.CONTENT_OPEN,
                   close_tag: str = K.CONTENT_CLOSE, partitions: int = 128) -> None:
    """S1 -> P1 -> K3: the tagged lines of text files, tags removed, as text."""
    sinks.write_lines(tagged_lines(spark, paths, encoding, open_tag, close_tag), out, partitions)


def tagged_lines(spark: SparkSession, paths, encoding: str = "GBK", open_tag: str = K.CONTENT_OPEN, close_tag: str = K.CONTENT_CLOSE) -> DataFrame:
    """S1 -> P1."""
    return kw.extract_tagged(readers.read_lines(spark, paths, encoding), "line", open_tag, close_tag)


# letters that stand as characters of two bytes in the GBK files of the test tables
GBK_LETTERS = ("aeiou", "电力系统网")


def gbk_extract(spark: SparkSession, lines: DataFrame, open_tag: str, close_tag: str) -> DataFrame:
    """K3 -> S1 -> P1: lines (column ``line``, other than ASCII left out and vowels turned into
    characters of two bytes) written as GBK files to the shared folder and read back."""
    ascii_ = F.regexp_replace("line", r"[^\x00-\x7F]", "")
    path = shared_folder(spark, "gbk")
    sinks.write_lines(lines.select(F.translate(ascii_, *GBK_LETTERS).alias("line")), path, 4, "GBK")
    return tagged_lines(spark, path, "GBK", open_tag, close_tag)


# -- X2 corpus statistics ------------------------------------------------------


def word_idf(spark: SparkSession, sf: str) -> DataFrame:
    return st.idf(C.segmented_lines(spark, sf, "B"), "tokens", st.WORD, "n")


def char_idf(spark: SparkSession, sf: str) -> DataFrame:
    return st.idf(C.segmented_lines(spark, sf, "B"), "tokens", st.CHAR, "n")


def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return st.term_freq(C.segmented_lines(spark, sf, "B"), "tokens", "n")


def char_freq(spark: SparkSession, sf: str) -> DataFrame:
    return st.char_freq(C.segmented_lines(spark, sf, "B"), "tokens", "n")


def bigram_freq(spark: SparkSession, sf: str) -> DataFrame:
    return st.bigram_freq(C.segmented_lines(spark, sf, "B"), "tokens", "n")


# -- X3 / X4 / X5 cohesion, frequency, PMI --------------------------------------


def occurrences(spark: SparkSession, sf: str, corpus: str = "B") -> DataFrame:
    """N1 of the segments, counted: (gram, k, prev, next, n)."""
    return gr.dealt_contexts(weighted_lines(spark, sf, corpus), C.SCRIPT_CLASS, C.cut_words())


def weighted_lines(spark: SparkSession, sf: str, corpus: str = "B") -> DataFrame:
    """The distinct lines of a corpus in lower case, each with the weight 1 (``n``)."""
    return C.flagged_lines(spark, sf, corpus).select(F.lower("line").alias("line"), F.lit(1).alias("n"))


#: How often a segment occurs in each corpus, and the prefix of the corpus's columns.
WEIGHTS = {"B": "n", "A": "na"}
CORPORA = {"B": "", "A": "a_"}


def gram_freq(spark: SparkSession, sf: str, corpus: str = "B") -> DataFrame:
    """A6 of the segments."""
    return gr.dealt_grams(weighted_lines(spark, sf, corpus), C.SCRIPT_CLASS, C.cut_words(), K.COHESION_MIN_FREQ)


def gram_total(spark: SparkSession, sf: str) -> DataFrame:
    return coh.gram_total(gram_freq(spark, sf, "B"))


def gram_table(spark: SparkSession, sf: str, corpora: tuple[str, ...] = ("B", "A")) -> DataFrame:
    """(gram, freq, left_entropy, right_entropy, a_freq, a_left_entropy,
    a_right_entropy) of the grams that reach the frequency floor in the first corpus;
    the columns of a corpus that is not asked for are absent.  Contexts of rarer
    grams are never shuffled.  With B and A, which is part of it, one pass counts both."""
    counts = {"B": F.lit(1), "A": F.col("in_a").cast("long")}
    lines = C.flagged_lines(spark, sf, "B" if "B" in corpora else "A").select(
        F.lower("line").alias("line"), *[counts[c].alias(WEIGHTS[c]) for c in corpora])
    names = {CORPORA[c]: WEIGHTS[c] for c in corpora}
    sums, contexts = gr.dealt_sides(lines, names, C.SCRIPT_CLASS, C.cut_words(), C.common_tokens(spark, sf))
    return entropies_of(sums, contexts, names)


def side_entropies(seen: DataFrame, corpora: dict[str, str], min_freq: int = K.COHESION_MIN_FREQ) -> DataFrame:
    """A6-A8 of :func:`gr.windows` for grams that reach the floor in the first corpus."""
    return entropies_of(*gr.sorted_sides(seen, corpora, min_freq), corpora, min_freq)


def entropies_of(sums: DataFrame, contexts: DataFrame, corpora: dict[str, str], min_freq: int = K.COHESION_MIN_FREQ) -> DataFrame:
    return coh.context_entropy(None, ctx_counts=contexts, corpora=corpora, sums=sums).where(F.col(f"{next(iter(corpora))}freq") >= min_freq)


def cohesion(spark: SparkSession, sf: str, corpus: str = "B") -> DataFrame:
    """A9 of one corpus; the other one is not counted."""
    return coh.cohesion_from(gram_table(spark, sf, (corpus,)), prefix=CORPORA[corpus])


def scored_from(grams: DataFrame, corpus: str = "B", **pmi_kw) -> DataFrame:
    """X5 of a gram table; PMI marginals and total always come from the combined
    corpus B (as the original does)."""
    return pm.pmi(coh.cohesion_from(grams, prefix=CORPORA[corpus]), grams.select("gram", "freq"), **pmi_kw)


def scored(spark: SparkSession, sf: str, corpus: str = "B", **pmi_kw) -> DataFrame:
    """X5 for one corpus."""
    return scored_from(materialize(gram_table(spark, sf)), corpus, **pmi_kw)


# marginals of the J2 query: only grams this frequent, so that halves are missing
SPARSE_MARGINALS = 40


def scored_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """J2 with marginals that lack many halves: missing = 0, single = 10.0."""
    grams = materialize(gram_table(spark, sf))
    marginals = grams.where(F.col("freq") >= SPARSE_MARGINALS).select("gram", "freq")
    return pm.pmi(coh.cohesion_from(grams), marginals, single_const=K.PMI_SINGLE_CONST_TRIE, missing=0)


# -- stored intermediates: D7 for X5, the merged state of A7 ----------------------------

BUCKETS = 16


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, where the session names one."""
    folder = checkpoint_dir(spark)
    if not folder:
        raise ValueError("the session names no shared folder (spark.checkpoint.dir)")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` written as a bucketed table of its own in the shared folder, and read from it."""
    path = shared_folder(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    sinks.store_bucketed(df, table, path, key, buckets)
    return readers.stored(df.sparkSession, table)


def scored_stored(spark: SparkSession, sf: str) -> DataFrame:
    """X4 -> X5 by a stored table: the frequencies (D7) and entropies (D8) of B are written
    once, in buckets of the gram; PMI joins its halves to the stored frequencies."""
    grams = store(gram_table(spark, sf, ("B",)), "grams", "gram")
    return pm.pmi(coh.cohesion_from(grams), grams.select("gram", "freq"))


#: Keys that the lookup query asks for: grams between these two.
LOOKUP = ("m", "mz")


def sorted_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """D7 written as sorted tab-separated part files with a manifest; the grams of
    a range are read from the files that may hold them."""
    path = shared_folder(spark, "freq")
    grams = materialize(gram_freq(spark, sf))  # the sort reads them twice
    sinks.write_sorted(grams, path, [F.col("gram")], "tsv", manifest="gram")
    return readers.lookup(spark, path, "gram string, freq bigint", between=LOOKUP)


def context_state(lines: DataFrame) -> DataFrame:
    """(s, p, c): the windows of distinct lines (column ``line``), which hold all grams with
    their contexts, one row for a place instead of one for each gram and side."""
    return gr.string_windows(gr.weighted(C.segment_strings(lines))).withColumnRenamed("n", "c")


def merged_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """A7 partial and merged: the state of A is saved; the lines of B that it does not have
    are counted and merged into it, and entropy comes from the merged counts, for grams that
    reach the floor in them."""
    seen = store(C.distinct_lines(spark, sf, "A"), "lines", "line")
    state = store(context_state(seen), "contexts", "s")
    more = context_state(sv.new_lines(C.distinct_lines(spark, sf, "B"), seen))
    return side_entropies(sv.merge_counts(state, more), {"": "c"})


# -- X6 corpus diff ----------------------------------------------------------------

SURFACE_JOINER = " "  # Latin test text: a gram's surface form keeps a space
# J6 / O3 on the test tables: a larger share of A counts as its head, and a protected
# string that some of the head words hold (parameters; both outputs have rows)
HEAD_DIVISOR = 5
PROTECTED = "th"


def diff_from(grams: DataFrame, surface_joiner: str = SURFACE_JOINER, stored: bool = False, **how) -> dict[str, DataFrame]:
    """X6 of a gram table.  ``stored``: the scores of both corpora, which several joins and
    counts read, are worked out once, now."""
    how = {"divisor": HEAD_DIVISOR, "protected": PROTECTED} | how
    b, a = (scored_from(grams, corpus) for corpus in ("B", "A"))
    if stored:
        b, a = materialize(b), materialize(a)
    return cmp.diff_candidates(b, a, surface_joiner=surface_joiner, **how)


def diff(spark: SparkSession, sf: str, **how) -> dict[str, DataFrame]:
    return diff_from(materialize(gram_table(spark, sf)), stored=True, **how)


# -- word lists for the test tables (S3 semantics: non-blank, distinct) ------------


def positives(spark: SparkSession, sf: str) -> DataFrame:
    """Positive list: distinct script words of ``benchmark``."""
    return script_words(C.table(spark, sf, "benchmark"), "text")


def negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Negative list: distinct words of ``part.p_name``."""
    t = C.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return lb.word_list(t, "word")


def word_units(c):
    return C.tk.tokenize(F.lower(c), "regex", C.TOKEN_PATTERN)


def hot_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pos = positives(spark, sf)
    hw = st.hot_words(pos.select(word_units(F.col("word")).alias("tokens")), "tokens")
    hc = st.hot_chars(pos, "word")
    return hc, hw


def features(spark: SparkSession, sf: str, terms: DataFrame, mode: str = "filter") -> DataFrame:
    """Lexical features; the corpus is read once, for N and both document frequencies."""
    hc, hw = hot_tables(spark, sf)
    lines = C.corpus_lines(spark, sf, "B").select(F.lower("line").alias("line"), "n")
    df = materialize(st.line_document_freq(lines, "line", "n", C.SCRIPT_CLASS))
    return fe.term_features(terms, st.idf_from(df, st.CHAR), st.idf_from(df, st.WORD), hc, hw, word_units, mode)


def stand_in_predictions(feats: DataFrame, candidates: DataFrame) -> DataFrame:
    """Deterministic stand-in for classifier output (term, score, pred) so the
    final-list operators have an exact SQL oracle: a fixed logistic rule."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("word_idf_avg") - F.lit(4.0))))
    return candidates.join(feats.select("term", p.alias("pred")), "term", "inner").select("term", "score", "pred")


# -- X9 final list / X10 threshold report -------------------------------------------

# affix rules for the test tables (parameters of F3; invented)
NO_BEGIN = ["re"]
NO_END = ["ment"]
NO_IN = ["tion"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    cands = materialize(diff(spark, sf)["candidates"])
    return stand_in_predictions(features(spark, sf, cands), cands)


# O4 / U4 on the test tables: list lengths below the number of candidates
REPORT_TOP_N = 100
EVAL_TOP_N = 100


def threshold_report(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Ranked, kept, dropped and diff tables of the predictions."""
    return rk.threshold_report(materialize(predictions(spark, sf)), n=REPORT_TOP_N)


def term_pos(df: DataFrame, term_col: str = "term") -> DataFrame:
    t = df.withColumn("_toks", word_units(F.col(term_col)))
    return t.withColumn("pos", C.tk.pos_tags("_toks", C.POS_LEXICON, C.DEFAULT_POS, C.NONSCRIPT_POS,
                                             C.SCRIPT_CLASS)).drop("_toks")


def final_terms(spark: SparkSession, sf: str) -> DataFrame:
    """J7 -> O2 -> F2 -> F4 -> F3 -> F5, best first."""
    d = diff(spark, sf)
    terms = materialize(d["features"].withColumn("score", F.lit(0.0)))
    preds = stand_in_predictions(features(spark, sf, terms), terms)
    x = rk.final_score(rk.attach_predictions(terms.drop("score"), preds))
    x = term_pos(rk.final_floor(x))
    x = rk.single_token_filter(x)
    x = rk.affix_filter(x, "term", NO_BEGIN, NO_END, NO_IN)
    x = rk.pos_pattern_filter(x)
    return x.drop("pos").orderBy(F.desc("final_score"), "term")


def stop_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct one- and two-token terms of the stop-word segments (P5): unlike the
    candidates they still hold words of every tag, and repeated characters.  Terms of the script
    alone; other tokens, which P5 leaves in its segments, part them here."""
    grams = gr.dealt_grams(weighted_lines(spark, sf), C.SCRIPT_CLASS, C.STOP_WORDS, 1, 2, " ")
    return term_pos(grams.select(F.col("gram").alias("term")))


def rule_filters(spark: SparkSession, sf: str) -> DataFrame:
    """(rule, term): what each of F3, F4, F5, F6 and F10 keeps of the stop-word bigrams."""
    t = materialize(stop_bigrams(spark, sf))
    kept = {"affix": rk.affix_filter(t, "term", NO_BEGIN, NO_END, NO_IN), "single_token": rk.single_token_filter(t),
            "pos_pattern": rk.pos_pattern_filter(t), "verb_tail": rk.verb_tail_filter(t),
            "reduplication": cmp.reduplication_filter(t, "term", " ")}
    out = None
    for rule, df in kept.items():
        df = df.select(F.lit(rule).alias("rule"), "term")
        out = df if out is None else out.unionByName(df)
    return out


# -- X11 keywords / X12 label hygiene / X14 audit ---------------------------------------

# keyword-field parameters for the test tables (invented)
KW = dict(labels=["of ", "Of "], end_markers=[".", "?", "!"], trailing_drop=[";"],
          split_chars=[",", " "], tail_drop=["s"], paren=["("], remove="KeyWords",
          exclude=["\uF0B1", "\uF020"], max_len=12)
KWIC_KEY = "tion"
KWIC_EXCLUDE = "tions"
TEST_STOP_CHARS = "qxz"
MARKERS = ["ment", "tion", "eau"]
# characters that stand for each other (P10, passed to P21 and P22)
VARIANTS = ("éèê", "eee")
# letters turned into a full-width letter, an emoji and a private-use character, so that P9 and P10 have work
ODD_CHARS = ("jkw", "\uFF21\U0001F600\uE000")


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return kw.parse_keyword_fields(conversation_lines(spark, sf), "line", **KW)


def script_words(df: DataFrame, text_col: str) -> DataFrame:
    t = df.select(F.explode(word_units(F.col(text_col))).alias("word"))
    return t.where(F.col("word").rlike(rf"^[{C.SCRIPT_CLASS}]+\z")).distinct()


def label_lists(spark: SparkSession, sf: str) -> tuple[dict, dict, DataFrame]:
    pos = {"pos1": positives(spark, sf),
           "pos2": C.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
           .where(not_blank("word")).distinct()}
    neg = {"neg1": negatives(spark, sf),
           "neg2": script_words(C.table(spark, sf, "conversations"), "text")}
    true_pos = pos["pos1"].where(F.length("word") % 2 == 0)
    return pos, neg, true_pos


def search_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys for the many-key lookup: the words and the runs of two and three words of ``benchmark``."""
    t = C.table(spark, sf, "benchmark").select(F.split("text", " ").alias("t"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("t") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("t", i, k), " "))))
    return t.select(F.explode(runs).alias("key")).where(F.length("key") >= 4).distinct()


def kwic_many(spark: SparkSession, sf: str, counted: bool = False) -> DataFrame:
    """P21 for all search keys, one row for each key and piece where they are ``counted``.  More keys
    than travel to the tasks are looked up in an index: lines are numbered once, and it is cut from them
    where it is read, since its rows, each token of each line, are many times what the lines are."""
    keys = materialize(search_keys(spark, sf))
    lines = C.distinct_lines(spark, sf, "B").withColumn("id", F.monotonically_increasing_id())
    if keys.count() > kw.BROADCAST_KEYS:
        lines = materialize(lines)
    return kw.kwic_many(ix.token_index(lines), lines, keys, C.SCRIPT_CLASS + " ", stop_chars=TEST_STOP_CHARS, variants=VARIANTS, counted=counted)


# -- X13 char-mode miner --------------------------------------------------------------

CHAR_MAX_LEN = 6
# F9 on the test tables: no gram reaches all of the original's floors, so the entropy is not asked for (a parameter)
CHAR_FLOORS = {"min_pmi": 1.0, "min_entropy": 0.0, "min_pos_prob": 0.04}


def char_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The starts of the distinct pieces, with the pieces' number ``n``."""
    lines = C.corpus_lines(spark, sf, "B")
    found = lines.select("n", F.inline(F.array(F.struct(ng.char_pieces(F.lower("line"), C.SCRIPT_CLASS, TEST_STOP_CHARS, " ").alias("_p")))))
    pieces = found.select("n", F.explode("_p").alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))
    return sx.starts(pieces, "piece", CHAR_MAX_LEN)


def positional_prop(spark: SparkSession, sf: str) -> DataFrame:
    """Positional char table (ch, p1, p2, p3): share of a character's
    occurrences at the start / middle / end of the corpus's script words."""
    t = term_freq(spark, sf).select(F.col("term").alias("t"), F.col("freq").alias("n"))
    t = t.where(F.col("t").rlike(rf"^[{C.SCRIPT_CLASS}]+\z"))
    c = t.select("t", "n", F.posexplode(F.filter(F.split("t", ""), lambda x: x != "")).alias("i", "ch"))
    slot = (F.when(F.col("i") == 0, "b").when(F.col("i") == F.length("t") - 1, "e").otherwise("m"))
    g = c.groupBy("ch").agg(F.sum("n").alias("_n"), F.sum(F.when(slot == "b", F.col("n")).otherwise(0)).alias("_b"),
                            F.sum(F.when(slot == "m", F.col("n")).otherwise(0)).alias("_m"),
                            F.sum(F.when(slot == "e", F.col("n")).otherwise(0)).alias("_e"))
    return g.select("ch", (F.col("_b") / F.col("_n")).alias("p1"), (F.col("_m") / F.col("_n")).alias("p2"),
                    (F.col("_e") / F.col("_n")).alias("p3"))


def char_entropies(spark: SparkSession, sf: str) -> DataFrame:
    return sx.suffix_entropies(char_starts(spark, sf), CHAR_MAX_LEN)


def char_side(spark: SparkSession, sf: str, side: str) -> DataFrame:
    return char_entropies(spark, sf).select("gram", "freq", F.col(side).alias("entropy"))


def char_merged(both: DataFrame) -> DataFrame:
    """J13 over the two sides of one table."""
    return coh.merge_entropy(both.select("gram", "freq", F.col("right").alias("entropy")),
                             both.select("gram", "freq", F.col("left").alias("entropy")))


def char_scored(spark: SparkSession, sf: str) -> DataFrame:
    """J13 -> J3 -> J14; the test corpus is of Latin script, so grams of ASCII letters
    are kept."""
    both = materialize(char_entropies(spark, sf))
    scored = pm.char_pmi(char_merged(both), both.select("gram", "freq"), drop_alnum=False)
    return pm.positional_pos(scored, positional_prop(spark, sf))


# external features of the rank mode on the test tables: what the gram table says of a
# term in both corpora (it covers every candidate, and some of the training words)
def external_features(grams: DataFrame) -> DataFrame:
    """(term, ext1 .. ext12) with three booleans, keyed by the surface form."""
    f, a = F.col("freq").cast("double"), F.col("a_freq").cast("double")
    values = [f, a, F.col("left_entropy"), F.col("right_entropy"), F.col("a_freq") > 0, F.col("gram").contains(K.GRAM_JOINER),
              F.col("a_freq") >= K.COHESION_MIN_FREQ, F.coalesce("a_left_entropy", F.lit(0.0)), F.coalesce("a_right_entropy", F.lit(0.0)),
              a / f, F.length("gram").cast("double"), F.abs(F.col("left_entropy") - F.col("right_entropy"))]
    return grams.select(F.replace(F.col("gram"), F.lit(K.GRAM_JOINER), F.lit(SURFACE_JOINER)).alias("term"),
                        *[v.alias(c) for v, c in zip(values, fe.EXTERNAL_COLUMNS)])


def rank_tables(spark: SparkSession, sf: str, mode: str = "rank") -> tuple[DataFrame, DataFrame]:
    """M3 on the test tables: the (train, predict) rows of a mode."""
    grams = materialize(gram_table(spark, sf))
    cands = materialize(diff_from(grams, stored=True)["candidates"])
    return fe.choose(mode, positives(spark, sf), negatives(spark, sf), cands, lambda t, m: features(spark, sf, t, m), external_features(grams))


def classify(spark: SparkSession, sf: str, kind: str = "logistic") -> DataFrame:
    """Fit on the labelled words, score the candidates."""
    train, predict = rank_tables(spark, sf, "filter")
    model = md.train(materialize(train), fe.FILTER_FEATURES, kind)
    return md.predict(model, predict, kind)


def held_out(spark: SparkSession, sf: str, folds: int = 3) -> DataFrame:
    """(term, label, margin) of the labelled words, each under an SVM trained without its fold."""
    pos, neg = positives(spark, sf), negatives(spark, sf)
    words = pos.select(F.col("word").alias("term")).unionByName(neg.select(F.col("word").alias("term")))
    train = materialize(fe.training_rows(pos, neg, features(spark, sf, words)))
    return materialize(md.held_out_margins(train, fe.FILTER_FEATURES, folds=folds, max_iter=20))


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """M4: (bin, n, positives, mean_pred) of the held-out words by calibrated probability."""
    margins = held_out(spark, sf)
    return md.reliability(margins, md.platt(margins))
