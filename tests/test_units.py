"""Hand-computed unit fixtures (FIXTURES.md) for the core operators."""
import math

from pyspark.sql import functions as F

from termspark.functions import text as TX
from termspark.operators import cohesion as coh
from termspark.operators import compare as cmp
from termspark.operators import keywords as kw
from termspark.operators import labels as lb
from termspark.operators import ngrams as ng
from termspark.operators import pmi as pm
from termspark.operators import ranking as rk
from termspark.operators import tokenize as tk


def test_four_token_segment_gives_ten_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "seg array<string>")
    rows = {(r.gram, r.prev, r.next) for r in ng.ngrams_with_context(df).collect()}
    assert len(rows) == 10
    assert ("a,b", "$", "c") in rows
    assert ("a,b,c,d", "$", "$") in rows
    assert ("d", "c", "$") in rows


def test_long_segment_is_linear(spark):
    df = spark.createDataFrame([([f"t{i}" for i in range(3000)],)], "seg array<string>")
    assert ng.ngrams_with_context(df).count() == 4 * 3000 - 6


def _occ(spark, rows):
    return spark.createDataFrame(rows, "gram string, k bigint, prev string, next string")


def test_edge_only_gram_has_zero_left_entropy(spark):
    occ = _occ(spark, [("x", 1, "$", "a"), ("x", 1, "$", "b"), ("x", 1, "$", "c"), ("x", 1, "$", "d")])
    r = coh.context_entropy(occ).collect()[0]
    assert r.freq == 4 and abs(r.left_entropy) < 1e-12 and abs(r.right_entropy - 2.0) < 1e-12
    # README variant: every edge occurrence is a distinct neighbour -> log2 T
    r2 = coh.context_entropy(occ, edge="distinct").collect()[0]
    assert abs(r2.left_entropy - 2.0) < 1e-12


def test_mixed_contexts_entropy(spark):
    occ = _occ(spark, [("x", 1, "$", "n"), ("x", 1, "$", "n"), ("x", 1, "p", "n"), ("x", 1, "q", "n")])
    r = coh.context_entropy(occ).collect()[0]
    assert abs(r.left_entropy - 2.0) < 1e-12


def test_context_sums_equal_freq(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["a", "b"],)], "seg array<string>")
    occ = ng.ngrams_with_context(df)
    cc = coh.side_contexts(occ)
    sums = {(r.gram, r.side): r.s for r in cc.groupBy("gram", "side").agg(F.sum("c").alias("s")).collect()}
    freq = {r.gram: r.freq for r in coh.gram_freq(occ, 0).collect()}
    for g, f in freq.items():
        assert sums[(g, 0)] == f and sums[(g, 1)] == f


def test_pmi_and_single_token(spark):
    scored = spark.createDataFrame([("a,b", 8, 3.0), ("abc", 7, 2.0)], "gram string, freq bigint, entropy double")
    freq = spark.createDataFrame([("a", 16), ("b", 4)], "gram string, freq bigint")
    out = {r.gram: r.pmi for r in pm.pmi(scored, freq, 128, min_pmi=None).collect()}
    assert abs(out["a,b"] - 4.0) < 1e-12
    assert abs(out["abc"] - 2.9) < 1e-12


def test_pmi_variant_missing_part_gives_inf(spark):
    scored = spark.createDataFrame([("a,b,c,a,c,b", 30, 3.0)], "gram string, freq bigint, entropy double")
    freq = spark.createDataFrame([("a", 10), ("b", 3), ("c", 3)], "gram string, freq bigint")
    r = pm.pmi(scored, freq, 1000, single_const=5.0, missing=0, min_pmi=None).collect()[0]
    assert math.isinf(r.pmi)


def test_length_factor_and_reduplication(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("ab",), ("xxxx",), ("xx",), ("x",)], "w string")
    r = {x.w: (x.lf, x.red) for x in df.select("w", TX.length_factor("w").alias("lf"),
                                                TX.is_reduplication("w").alias("red")).collect()}
    assert abs(r["abcd"][0] - math.exp(-0.15)) < 1e-12
    assert abs(r["abcde"][0] - math.exp(-0.15)) < 1e-12
    assert abs(r["ab"][0] - math.exp(-0.75)) < 1e-12
    assert r["xxxx"][1] and r["xx"][1] and not r["x"][1]


def test_rising_term_is_strict(spark):
    a = spark.createDataFrame([("t", 1, 1.0, 1.0), ("u", 1, 1.0, 1.0)], "gram string, freq bigint, entropy double, pmi double")
    b = spark.createDataFrame([("t", 10, 2.0, 2.0), ("u", 11, 2.0, 2.0)], "gram string, freq bigint, entropy double, pmi double")
    assert [r.gram for r in cmp.risen_terms(b, a).collect()] == ["u"]


def test_bag_intersection(spark):
    a = spark.createDataFrame([("a",), ("a",), ("b",)], "word string")
    b = spark.createDataFrame([("a",), ("a",), ("c",)], "word string")
    assert sorted(r.word for r in lb.bag_intersect(a, b).collect()) == ["a", "a"]


def test_segments_fused_equals_general(spark):
    lines = spark.createDataFrame([("The cat and the dog, of mine sat.",), ("x  y z",), ("",), ("!!",)], "line string")
    lex = {"c": ["and"], "p": ["of"], "v": ["sat"]}
    stop = ["the"]
    t = lines.withColumn("tokens", tk.tokenize(F.lower("line"), "regex", tk.LATIN_TOKEN_PATTERN))
    t = t.withColumn("pos", tk.pos_tags("tokens", lex, "n", "w", tk.LATIN_SCRIPT_CLASS))
    g = tk.add_segments(t, "tokens", "pos", "segments", stop, ["w", "c", "u", "p", "r"], tk.LATIN_SCRIPT_CLASS)
    f = tk.segment_lines(lines, F.lower("line"), tk.LATIN_SCRIPT_CLASS, tk.cut_words(lex, stop), keep=["line"])
    a = {r.line: r.segments for r in g.select("line", "segments").collect()}
    b = {r.line: r.segments for r in f.collect()}
    assert a == b
    assert a["The cat and the dog, of mine sat."] == [["cat"], ["dog"], ["mine", "sat"]]


def test_global_rank_is_total(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("f"), F.col("id").cast("string").alias("g"))
    r = rk.global_rank(df.repartition(5), [F.desc("f"), F.asc("g")])
    ranks = sorted(x.rank for x in r.collect())
    assert ranks == list(range(1, 1001))
    best = r.where("rank = 1").collect()[0]
    assert best.f == 6


def test_keyword_parse_reference_defaults(spark):
    line = "摘要 关键词：电力系统，继电保护（装置）；中图分类号 TM7"
    df = spark.createDataFrame([(line,)], "line string")
    got = sorted(r.keyword for r in kw.parse_keyword_fields(df, "line").collect())
    assert got == ["电力系统", "继电保护"]
    # Java's split: empty pieces stay unless they end a split, and are keywords too
    df3 = spark.createDataFrame([("关键词：，甲，：乙，",), ("关键词：",)], "line string")
    assert sorted(r.keyword for r in kw.parse_keyword_fields(df3, "line").collect()) == ["", "", "", "乙", "甲"]
    # the full-width semicolon is not a separator: one keyword, paren cut
    df2 = spark.createDataFrame([("关键词：电力系统；继电保护（装置）；KeyWords 中图分类号",)], "line string")
    assert [r.keyword for r in kw.parse_keyword_fields(df2, "line").collect()] == ["电力系统；继电保护"]


def test_emoji_and_script(spark):
    df = spark.createDataFrame([("a☀bc",), (None,)], "s string")
    r = df.select(TX.replace_emoji("s", "*").alias("x")).collect()
    assert r[0].x == "a*b*c" and r[1].x is None
    df2 = spark.createDataFrame([("电力",), ("电a",), ("",)], "s string")
    out = [x.ok for x in df2.select(TX.all_script("s").alias("ok")).collect()]
    assert out == [True, False, True]


def test_conflict_resolution(spark):
    p = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    n = spark.createDataFrame([("b",), ("c",), ("d",)], "word string")
    tp = spark.createDataFrame([("b",)], "word string")
    out = {(r.list, r.word) for r in lb.resolve_conflicts({"pos": p}, {"neg": n}, tp).collect()}
    assert out == {("pos", "a"), ("pos", "b"), ("neg", "c"), ("neg", "d")}


def test_char_pmi_integer_division(spark):
    merged = spark.createDataFrame([("éa", 6, 2.0), ("é", 9, 2.0)], "gram string, freq bigint, entropy double")
    freq = spark.createDataFrame([("é", 9), ("a", 2), ("éa", 6)], "gram string, freq bigint")
    assert {x.gram for x in pm.char_pmi(merged.union(spark.createDataFrame([("ab", 1, 1.0)], merged.schema)),
                                        freq.union(spark.createDataFrame([("b", 1), ("ab", 1)], freq.schema)), drop_alnum=False).collect()} == {"éa", "ab"}
    r = {x.gram: x.pmi for x in pm.char_pmi(merged, freq).collect()}
    # total = 3 rows; floor(6 * 3 / 18) = 1 -> log2(1) = 0; single chars dropped
    assert r == {"éa": 0.0}
