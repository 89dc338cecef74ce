"""Predicates, lookups by join, checks that fail a query, rank mode, classifier, plans."""
import math

import pytest
from pyspark.sql import functions as F

from termspark.functions import text as TX
from termspark.operators import cohesion as coh
from termspark.operators import compare as cmp
from termspark.operators import features as fe
from termspark.operators import keywords as kw
from termspark.operators import labels as lb
from termspark.operators import model as md
from termspark.operators import pmi as pm
from termspark.operators import rank as rk
from termspark.operators import tokenize as tk

SF = "/root/testdata/sf0.001"


def test_end_of_string_is_not_a_line_end(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("abc\r",)], "s string")
    got = df.withColumn("t", F.array("s")).select(
        TX.all_script("s", "a-z").alias("a"), TX.is_alnum_only("s").alias("b"), TX.is_script(F.expr("substring(s, 3)"), "a-z").alias("c"),
        tk.pos_tags("t", None, "n", "w", "a-z").alias("p"))
    assert [(r.a, r.b, r.c, r.p) for r in got.collect()] == [(True, True, True, ["n"]), (False, False, False, ["w"]), (False, False, False, ["w"])]


def test_java_trim_and_blank(spark):
    df = spark.createDataFrame([(" \t x y \x0b",), ("\t",), ("",), (None,)], "s string")
    got = [(r.a, r.b) for r in df.select(TX.java_trim("s").alias("a"), TX.not_blank("s").alias("b")).collect()]
    assert got == [("x y", True), ("", False), ("", False), (None, None)]
    assert [r.word for r in lb.word_list(df, "s").collect()] == [" \t x y \x0b"]


def test_segments_keep_any_character(spark):
    df = spark.createDataFrame([(["a\x02b", "stop", "c\x01d"],), (["stop", "stop"],), ([],), (None,)], "tokens array<string>")
    got = tk.add_segments(df, "tokens", None, "segments", ["stop"], (), None)
    assert [r.segments for r in got.collect()] == [[["a\x02b"], ["c\x01d"]], [], [], None]


def test_lookups_by_join_keep_every_line(spark):
    df = spark.createDataFrame([(1, ["the", "cat", "!"]), (2, []), (3, ["dog"])], "id int, tokens array<string>")
    lex = spark.createDataFrame([("the", "d", 2), ("the", "x", 1), ("dog", "a", 1)], "word string, pos string, ord int")
    got = {r.id: r.pos for r in tk.tag_tokens_join(df, "id", "tokens", lex, "pos", "n", "w", "a-z").collect()}
    assert got == {1: ["x", "n", "w"], 2: [], 3: ["a"]}
    cut = {r.id: r.segments for r in tk.cut_words_join(df, "id", "tokens", lex).collect()}
    assert cut == {1: [["cat", "!"]], 2: [], 3: []}


def test_lexicon_match_by_automaton_and_by_join(spark):
    lex = spark.createDataFrame([("电力",), ("电力系统",), ("力系",), ("统一",), ("a b",), ("x",), (" y",)], "word string")
    df = spark.createDataFrame([(1, "电力系统一 a b x y"), (2, "电力系"), (3, ""), (4, None), (5, "电力系"), (6, "  ")], "id int, line string")
    want = {1: ["电力系统", "一", "a b", "x", "y"], 2: ["电力", "系"], 3: [], 4: None, 5: ["电力", "系"], 6: []}
    assert {r.id: r.tokens for r in tk.tokenize_lexicon(df, "line", lex).collect()} == want
    assert {r.id: r.tokens for r in tk.tokenize_lexicon(df, "line", lex, broadcast_words=0).collect()} == want
    assert {r.id: r.tokens for r in tk.tokenize_lexicon(df, "line", lex.where("false")).collect()}[2] == ["电", "力", "系"]


def test_whitespace_tokens_as_java_splits(spark):
    df = spark.createDataFrame([(" a  b  ",), ("  ",), ("",)], "s string")
    assert [r.t for r in df.select(tk.tokenize("s", "whitespace", keep_empty=True).alias("t")).collect()] == [["", "a", "", "b"], [], [""]]


def test_pmi_fails_on_a_missing_half(spark):
    scored = spark.createDataFrame([("a,b", 8, 3.0), ("c", 9, 3.0)], "gram string, freq bigint, entropy double")
    freq = spark.createDataFrame([("a", 16)], "gram string, freq bigint")
    with pytest.raises(Exception, match="no frequency for a part of gram"):
        pm.pmi(scored, freq, min_pmi=None).collect()
    full = freq.union(spark.createDataFrame([("b", 4), ("z", 108)], freq.schema))
    got = {r.gram: r.pmi for r in pm.pmi(scored, full, min_pmi=None, single_const=10.0).collect()}
    assert got == {"a,b": pytest.approx(math.log2(8 * 128 / 64)), "c": 10.0}


def test_two_corpora_in_one_aggregation(spark):
    rows = [("x", "$", "a", True), ("x", "p", "a", False), ("x", "q", "b", True), ("y", "$", "$", False)]
    occ = spark.createDataFrame(rows, "gram string, prev string, next string, in_a boolean")
    both = {r.gram: r for r in coh.context_entropy(None, ctx_counts=coh.side_contexts(occ, "in_a"), corpora={"": "c", "a_": "ca"}).collect()}
    for prefix, part in (("", occ), ("a_", occ.where("in_a"))):
        for r in coh.context_entropy(part).collect():
            b = both[r.gram]
            assert (b[prefix + "freq"], b[prefix + "left_entropy"], b[prefix + "right_entropy"]) == \
                (r.freq, pytest.approx(r.left_entropy), pytest.approx(r.right_entropy))
    assert both["y"].a_freq == 0 and both["y"].a_left_entropy is None


def test_top_k_with_ties(spark):
    rows = [(f"{c}{i:02d}", f) for c in "abc" for i in range(20) for f in [5 if c != "a" else 9]]
    a = spark.createDataFrame(rows, "gram string, freq bigint")
    ranked = [g for g, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for k in (0, 1, 20, 21, 37, 60, 99):
        assert sorted(r.gram for r in cmp.top_k_grams(a, k).collect()) == sorted(ranked[:k])


def test_head_words_kept_and_excluded(spark):
    a = spark.createDataFrame([("x", 9, 1.0, 1.0), ("xth", 8, 1.0, 1.0), ("y", 1, 1.0, 1.0)], "gram string, freq bigint, entropy double, pmi double")
    kept, out = cmp.head_word_split(a, a, 4, 2, "th")
    assert sorted(r.gram for r in kept.collect()) == ["xth", "y"] and [r.gram for r in out.collect()] == ["x"]


def test_predictions_are_checked_and_deterministic(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2)], "term string, freq int")
    p = spark.createDataFrame([("a", 0.9, 1), ("a", 0.2, 2), ("b", 0.5, 3)], "term string, pred double, ord int")
    assert {r.term: r.pred for r in rk.attach_predictions(f, p).collect()} == {"a": 0.2, "b": 0.5}
    with pytest.raises(Exception, match="candidate term without prediction"):
        rk.attach_predictions(f, p.where("term = 'a'")).collect()
    assert rk.attach_predictions(f, p.where("term = 'a'"), check=False).count() == 1


def test_hit_counts_are_bags(spark):
    t = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "term string")
    pos = spark.createDataFrame([("a",), ("a",), ("a",), ("c",)], "word string")
    r = rk.hit_counts(t, pos, pos.where("word = 'x'")).first()
    assert (r.pos_hits, r.neg_hits) == (3, 0)


def test_rules_keep_and_remove(spark):
    t = spark.createDataFrame([("x", ["v"]), ("x y", ["v", "n"]), ("p n", ["p", "n"]), ("n f", ["n", "f"]), ("n c n", ["n", "c", "n"]),
                               ("n v", ["n", "v"]), ("n", ["n"])], "term string, pos array<string>")

    def left(df):
        return sorted(r.term for r in df.collect())
    assert left(rk.single_token_filter(t)) == ["n", "n c n", "n f", "n v", "p n", "x y"]
    assert left(rk.pos_pattern_filter(t)) == ["n", "n v", "x", "x y"]
    assert left(rk.verb_tail_filter(t)) == ["n", "n c n", "n f", "p n", "x y"]
    assert left(rk.affix_filter(t, "term", ["x"], ["f"], [" c "])) == ["n", "n v", "p n"]
    g = spark.createDataFrame([("a,a",), ("a,b",), ("a",)], "gram string")
    assert sorted(r.gram for r in cmp.reduplication_filter(g, "gram").collect()) == ["a", "a,b"]
    c = spark.createDataFrame([("a", 1.0, 1.5, 0.04), ("b", 0.9, 2.0, 1.0), ("c", 2.0, 1.4, 1.0), ("d", 2.0, 2.0, 0.03), ("e", None, 2.0, 1.0)],
                              "gram string, pmi double, entropy double, pos_prob double")
    assert [r.gram for r in pm.char_term_filter(c).collect()] == ["a"]


def test_threshold_report(spark):
    p = spark.createDataFrame([("aa", 3.0, 0.9), ("b", 2.0, 0.9), ("cc", 1.0, 0.1), ("dd", 0.5, 0.95)], "term string, score double, pred double")
    t = rk.threshold_report(p, n=2)
    assert [r.term for r in t["ranked"].collect()] == ["aa", "b", "cc", "dd"]
    assert [r.term for r in t["kept"].collect()] == ["aa", "dd"] and [r.term for r in t["dropped"].collect()] == ["cc"]
    assert sorted((r.term, r.side) for r in t["diff"].collect()) == [("b", "removed"), ("dd", "added")]


def test_surface_forms_stay_a_bag_or_keep_the_best(spark):
    b = spark.createDataFrame([("ab,c", 9, 3.0, 2.0), ("a,bc", 9, 3.0, 3.0)], "gram string, freq bigint, entropy double, pmi double")
    a = b.where("false")
    bag = cmp.diff_candidates(b, a)["features"].collect()
    assert [r.term for r in bag] == ["abc", "abc"]
    best = cmp.diff_candidates(b, a, dedup="max")["features"].collect()
    assert [(r.term, r.pmi) for r in best] == [("abc", 3.0)]


def _feature_inputs(spark):
    pos = spark.createDataFrame([("aa",), ("ab",)], "word string")
    neg = spark.createDataFrame([("bb",), ("ab",)], "word string")
    cand = spark.createDataFrame([("ac", 5.0), ("bc", 1.0)], "term string, score double")
    idf = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "term string, idf double")
    hot = spark.createDataFrame([("a", 4), ("b", 1)], "term string, hot bigint")
    return pos, neg, cand, lambda t, m: fe.term_features(t, idf, idf, hot, hot, lambda c: F.split(c, ""), m)


def test_features_by_hand(spark):
    *_, features = _feature_inputs(spark)
    r = features(spark.createDataFrame([("abz",), ("z",)], "term string"), "filter").where("term = 'abz'").first()
    assert (r.length, r.char_idf_sum, r.char_idf_min, r.char_idf_max, r.hot_char_sum) == (3.0, 3.0, 1.0, 2.0, 5.0)
    assert r.char_idf_avg == pytest.approx(1.5, abs=1e-6) and r.hot_word_avg == pytest.approx(2.5, abs=1e-6)
    z = features(spark.createDataFrame([("z",)], "term string"), "rank").first()
    assert (z.char_idf_sum, z.char_idf_avg, z.hot_word_sum) == (0.0, 0.0, 0.0) and "char_idf_min" not in z.asDict()


def test_dataset_chooser(spark):
    pos, neg, cand, features = _feature_inputs(spark)
    train, predict = fe.choose("filter", pos, neg, cand, features)
    assert sorted((r.term, r.label) for r in train.collect()) == [("aa", 1.0), ("ab", 0.0), ("ab", 1.0), ("bb", 0.0)]
    assert train.schema["label"].dataType.simpleString() == "double" and len(predict.columns) == 15
    ext = spark.createDataFrame([(t, *[float(i) for i in range(4)], True, False, True, *[0.5] * 5) for t in ("aa", "ac", "bc")], fe.external_schema())
    train, predict = fe.choose("rank", pos, neg, cand, features, ext)
    assert [(r.term, r.label) for r in train.collect()] == [("aa", 1)] and train.schema["label"].dataType.simpleString() == "int"
    assert [t for c, t in train.dtypes if c in fe.EXTERNAL_BOOLEAN] == ["boolean"] * 3
    assert predict.count() == 2 and len(predict.columns) == 2 + 9 + 12
    with pytest.raises(Exception, match="candidate term without external features"):
        fe.choose("rank", pos, neg, cand, features, ext.where("term <> 'bc'"))[1].collect()
    with pytest.raises(ValueError):
        fe.choose("other", pos, neg, cand, features)


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_classifier_separates(spark, kind):
    rows = [(f"t{i}", float(i % 2), float(i % 2) * 3 + (i % 7) * 0.1, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "term string, label double, x double, y double").withColumn("score", F.lit(1.0))
    out = {r.term: r.pred for r in md.predict(md.train(df, ["x", "y"], kind), df, kind).collect()}
    assert all((out[t] > 0.5) == (label == 1.0) and 0 <= out[t] <= 1 for t, label, _, _ in rows)


def test_candidates_minus_lists(spark):
    c = spark.createDataFrame([("d",), ("b",), ("a",), ("b",)], "term string")
    lists = [spark.createDataFrame([(w,)], "word string") for w in "axyz"]
    assert [r.term for r in lb.minus_lists(c, lists).collect()] == ["b", "d"]


def test_variant_mapping_and_odd_characters(spark):
    df = spark.createDataFrame([("電力Ａ系统\U0001F600电力x\uE000的",)], "line string")
    got = [r.piece for r in kw.kwic_pieces(df, "line", "力", variants=("電", "电"), script_class=TX.K.SCRIPT_CLASS_CJK).collect()]
    assert got == ["电力", "电力"]
    assert df.select(TX.half_width(TX.replace_emoji("line", "*")).alias("x")).first().x == "電力A系统*电力x*的"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("build, pattern", [
    (lambda J, C, s: C.segments(s, SF), "regexp_replace"), (lambda J, C, s: J.word_idf(s, SF), "regexp_extract_all"),
    (lambda J, C, s: C.stop_segments(s, SF), "regexp_extract_all"), (lambda J, C, s: J.term_freq(s, SF), "regexp_extract_all"),
    (lambda J, C, s: J.bigram_freq(s, SF), "regexp_extract_all"), (lambda J, C, s: J.char_starts(s, SF), "regexp_replace")])
def test_text_is_evaluated_once(spark, build, pattern):
    from termspark.plans import corpus as C
    from termspark.plans import jobs as J
    assert _optimized(build(J, C, spark)).count(pattern) == 1


def test_building_a_query_starts_no_job(spark):
    from termspark.plans import jobs as J
    spark.sparkContext.setJobGroup("lazy", "lazy")
    for build in (J.word_idf, J.term_freq, J.occurrences, J.char_starts):
        build(spark, SF)
    grams = spark.createDataFrame([("a", 9, 3.0, 3.0, 9, 3.0, 3.0)], "gram string, freq bigint, left_entropy double, right_entropy double, "
                                  "a_freq bigint, a_left_entropy double, a_right_entropy double")
    J.diff_from(grams)
    # one job for each time a table's schema is read
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) <= 4
    spark.sparkContext.setJobGroup("", "")
