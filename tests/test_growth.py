"""Level-wise growth, stored and merged state, lookups, suffix runs, calibration, affix and key joins."""
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termspark.functions import text as TX
from termspark.operators import cohesion as coh
from termspark.operators import growth as gr
from termspark.operators import index as ix
from termspark.operators import keywords as kw
from termspark.operators import model as md
from termspark.operators import ngrams as ng
from termspark.operators import pmi as pm
from termspark.operators import rank as rk
from termspark.operators import state as sv
from termspark.operators import stats as st
from termspark.operators import suffixes as sx
from termspark.operators import tokenize as tk
from termspark.sources import readers, sinks


def segments(n=300, seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e"] + [f"w{i}" for i in range(60)]
    weights = [20, 15, 12, 9, 8] + [1] * 60
    return [rng.choices(words, weights, k=rng.randint(1, 9)) for _ in range(n)]


def grams_of(segs):
    out = []
    for s in segs:
        p = ["$", *s, "$"]
        out += [(",".join(p[i:i + k]), p[i - 1], p[i + k]) for k in range(1, 5) for i in range(1, len(s) - k + 2)]
    return out


def places(spark, segs, **how):
    return gr.places(gr.weighted(spark.createDataFrame([(s,) for s in segs], "seg array<string>")), **how)


# ---- A6 / A7 level by level -----------------------------------------------------------------

@pytest.mark.parametrize("floor", [1, 5])
def test_grown_grams_are_those_that_reach_the_floor(spark, floor):
    segs = segments()
    want = {g: n for g, n in Counter(g for g, _, _ in grams_of(segs)).items() if n >= floor}
    got = gr.frequent_grams(places(spark, segs), floor).collect()
    assert {r["gram"]: r["freq"] for r in got} == want
    assert all(r["k"] == r["gram"].count(",") + 1 for r in got)


def test_no_context_of_a_rare_gram_is_counted(spark):
    segs = segments()
    occ = grams_of(segs)
    freq = Counter(g for g, _, _ in occ)
    at = places(spark, segs)
    kept = gr.frequent_grams(at, 5)
    met = gr.kept_occurrences(at, kept)
    # as many occurrences as the kept grams have, and not one more
    assert met.agg(F.sum("n")).first()[0] == sum(n for n in freq.values() if n >= 5) < len(occ)
    contexts = gr.context_counts(met, {"c": "n"})
    left, right = Counter((g, p) for g, p, _ in occ if freq[g] >= 5), Counter((g, n) for g, _, n in occ if freq[g] >= 5)
    assert {(r["gram"], r["side"], r["ctx"]): r["c"] for r in contexts.collect()} == \
        {(g, 0, c): n for (g, c), n in left.items()} | {(g, 1, c): n for (g, c), n in right.items()}
    # the same entropies as over all occurrences
    every = ng.ngrams_with_context(spark.createDataFrame([(s,) for s in segs], "seg array<string>"))
    want = {r["gram"]: r for r in coh.context_entropy(every).where("freq >= 5").collect()}
    got = {r["gram"]: r for r in coh.context_entropy(None, ctx_counts=contexts).collect()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        assert tuple(r) == (g, want[g]["freq"], pytest.approx(want[g]["left_entropy"], abs=1e-9), pytest.approx(want[g]["right_entropy"], abs=1e-9))


def test_candidates_need_both_parts(spark):
    """'a,b' is frequent only as a beginning and 'b,c' not at all: 'a,b,c' is never counted."""
    segs = [["a", "b"]] * 5 + [["a", "b", "c"]] * 2 + [["c"]] * 5
    got = {r["gram"]: r["freq"] for r in gr.frequent_grams(places(spark, segs), 5).collect()}
    assert got == {"a": 7, "b": 7, "c": 7, "a,b": 7}


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize("floor", [1, 5])
def test_one_pass_over_sorted_windows_equals_the_levels(spark, monkeypatch, chunk, floor):
    """Chunks of a few rows: most runs reach over a chunk's end."""
    monkeypatch.setattr(gr, "CHUNK", chunk)
    segs = segments(150) + [["a"]] * 9
    table = spark.createDataFrame([(s, i % 3 == 0) for i, s in enumerate(segs)], "seg array<string>, in_a boolean")
    counts = {"n": F.count(F.lit(1)), "na": F.count_if("in_a")}
    at = gr.places(gr.weighted(table, counts=counts), weights=["n", "na"])
    contexts = gr.context_counts(gr.kept_occurrences(at, gr.frequent_grams(at, floor), weights=["n", "na"]), {"n": "n", "na": "na"})
    want = coh.context_entropy(None, ctx_counts=contexts, corpora={"": "n", "a_": "na"})
    short = gr.places(gr.weighted(table, counts=counts, joiner=","), weights=["n", "na"])
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(chunk, 10000)))
        sums, ends = gr.sorted_sides(gr.windows(short, weights=["n", "na"]), {"": "n", "a_": "na"}, floor)
        got = coh.context_entropy(None, ctx_counts=ends, corpora={"": "n", "a_": "na"}, sums=sums).where(F.col("freq") >= floor).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    norm = lambda rows: sorted(tuple(None if x is None else round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in rows)
    assert norm(got) == norm(want.collect()) and len(got) > 20


def test_a_place_is_shuffled_once(spark, monkeypatch, tmp_path):
    """No join and no exchange for each level of grams."""
    from termspark.plans import jobs
    spark.createDataFrame([(i, "the cat sat on\nmat hat cat", "en") for i in range(9)], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    plans, real = [], gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    jobs.gram_table(spark, str(tmp_path)).collect()
    jobs.merged_entropy(spark, str(tmp_path)).collect()
    assert [p.count("RepartitionByExpression") for p in plans] == [1, 1] and not any("LeftSemi" in p for p in plans)


# ---- stored tables, merged state ------------------------------------------------------------

def test_pmi_reads_stored_frequencies_where_they_lie(spark, tmp_path):
    grams = gr.frequent_grams(places(spark, segments()), 1).select("gram", "freq").withColumn("entropy", F.lit(2.0))
    sinks.store_bucketed(grams, "stored_freq", str(tmp_path / "t"), "gram", 4)
    table = readers.stored(spark, "stored_freq")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = pm.pmi(table, table.select("gram", "freq"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scans = [i for i, x in enumerate(lines) if "Scan parquet" in x and "Bucketed: true" in x]
        assert len(scans) >= 3
        # the stored side of each join: between its scan and the join there is no exchange
        depth = lambda s: max(s.find("+- "), s.find(":- "))
        free = 0
        for i in scans:
            above, d = [], depth(lines[i])
            for x in reversed(lines[:i]):
                if depth(x) < d:
                    above.append(x)
                    d = depth(x)
                    if "Join" in x:
                        break
            free += not any("Exchange" in x for x in above) and any("Join" in x for x in above)
        assert free >= 2
        got = {r["gram"]: r["pmi"] for r in out.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {r["gram"]: r["pmi"] for r in pm.pmi(grams, grams.select("gram", "freq")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got)
    spark.sql("DROP TABLE stored_freq")


def test_merged_state_equals_one_pass(spark):
    old, new = segments(120, 2), segments(90, 3)
    state = lambda segs: gr.context_counts(gr.occurrences(places(spark, segs)), {"c": "n"})
    merged = coh.context_entropy(None, ctx_counts=sv.merge_counts(state(old), state(new)))
    whole = coh.context_entropy(None, ctx_counts=state(old + new))
    norm = lambda d: sorted((r["gram"], r["freq"], round(r["left_entropy"], 9) + 0.0, round(r["right_entropy"], 9) + 0.0) for r in d.collect())
    assert norm(merged) == norm(whole)


def test_lines_that_the_state_has_are_not_counted_again(spark):
    lines = lambda *x: spark.createDataFrame([(i,) for i in x], "line string")
    assert sorted(r.line for r in sv.new_lines(lines("a", "b", "b", "c"), lines("a", "d")).collect()) == ["b", "c"]


# ---- segments and windows as strings --------------------------------------------------------

def test_segments_matched_in_one_expression_equal_those_cut_from_words(spark):
    rng = random.Random(8)
    words = ["the", "a", "an", "ana", "tha", "the.", "y+", "été", "of", "often", "x9", "--", "", " ", "A", "The"]
    lines = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "-", "\t", ""]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", " ", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    for cut in (["the", "a", "an", "of", "été", "y+"], []):
        old = tk.segment_lines(df, F.lower("line"), tk.LATIN_SCRIPT_CLASS, cut, keep=["id"])
        want = old.select("id", F.explode("segments").alias("s")).select("id", F.array_join("s", ",").alias("seg"))
        got = tk.segment_rows(df, F.lower("line"), tk.LATIN_SCRIPT_CLASS, cut, joiner=",", keep=["id"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # no stack for each word of a long segment
    long = spark.createDataFrame([("word " * 50_000,)], "line string")
    assert [len(r.seg) for r in tk.segment_rows(long, F.col("line"), tk.LATIN_SCRIPT_CLASS, ["the"]).collect()] == [5 * 50_000 - 1]


def test_windows_of_strings_equal_the_windows_of_places(spark):
    segs = [list(s) for s in dict.fromkeys(map(tuple, segments()))] + [["w"] * 5000]
    df = spark.createDataFrame([(s, i % 3) for i, s in enumerate(segs)], "seg array<string>, n long")
    want = gr.windows(gr.places(df))
    got = gr.string_windows(df.withColumn("seg", F.array_join("seg", ",")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_gram_table_runs_no_lambda_over_text(spark):
    from termspark.plans import corpus, jobs
    lines = spark.createDataFrame([("the red fox", 1)], "line string, n long")
    plan = gr.string_windows(gr.weighted(corpus.segment_strings(lines)))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_extract_all") == 1
    assert jobs.context_state(lines).columns == ["s", "p", "c"]


# ---- chunks of lines as arrays --------------------------------------------------------------

ODD = ["the", "été", "İx", "a-b", "x×y", "÷ß", "中文 字", "\U0001F600", "ÿø", "A", "  ", " ", "\t", ".", "ΑΣ", "é", "-", "w1", "w2", "cat", "hat", "mat"]


def odd_lines(n=400, seed=4):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(ODD) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)})


def test_document_frequencies_of_chunks_equal_those_of_token_arrays(spark, monkeypatch):
    """Terms of a line are counted without a row for each token: no explode above the lines."""
    monkeypatch.setattr(st, "CHAR_LINES", 7)
    df = spark.createDataFrame([(x, i % 3 + 1) for i, x in enumerate(odd_lines())], "line string, n long").select(F.lower("line").alias("line"), "n")
    tokens = df.select("n", tk.tokenize(F.col("line"), "regex", tk.LATIN_TOKEN_PATTERN).alias("tokens"))
    got = st.line_document_freq(df, "line", "n", tk.LATIN_SCRIPT_CLASS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.document_freq(tokens, "tokens", "n").collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert st.line_document_freq(df.where("false"), "line", "n", tk.LATIN_SCRIPT_CLASS).collect() == []


@pytest.mark.parametrize("chunk", [200, 8_000_000])
@pytest.mark.parametrize("hot", [[], ["cat", "hat", "w"]])
def test_places_dealt_out_by_their_first_token_equal_sorted_windows(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(tk, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tk, "PIECES", 5)
    lines = [(x, 1, i % 2) for i, x in enumerate(odd_lines() + ["cat", "cat hat mat"] * 7 + ["the", ""])]
    df = spark.createDataFrame(lines, "line string, n long, na long").select(F.lower("line").alias("line"), "n", "na")
    both = {"": "n", "a_": "na"}
    segs = tk.segment_rows(df, F.col("line"), tk.LATIN_SCRIPT_CLASS, ["the"], "seg", ",", ["n", "na"])
    windows = gr.string_windows(gr.weighted(segs, counts={"n": F.sum("n"), "na": F.sum("na")}), weights=["n", "na"])
    rows = []
    for sums, ends in (gr.sorted_sides(windows, both), gr.dealt_sides(df, both, tk.LATIN_SCRIPT_CLASS, ["the"], hot)):
        found = coh.context_entropy(None, ctx_counts=ends, corpora=both, sums=sums).where("freq >= 5").collect()
        rows.append(sorted(tuple(None if x is None else round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in found))
    assert rows[0] == rows[1] and len(rows[0]) > 20
    assert ends.count() == 0 if not hot else {r.gram for r in ends.select("gram").distinct().collect()} == set(hot) & {r[0] for r in rows[0]}


def test_the_gram_table_has_no_row_for_each_place(spark, monkeypatch, tmp_path):
    """A row that is shuffled holds a chunk's places of a bucket."""
    from termspark.plans import jobs
    spark.createDataFrame([(i, "\n".join(odd_lines(60, i)), "en") for i in range(9)], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    plans, real = [], gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    assert jobs.gram_table(spark, str(tmp_path)).count() > 20
    above = plans[0].split("RepartitionByExpression")
    assert len(above) == 2 and "w#" in above[1].split("Aggregate")[0] and "regexp_extract_all" not in plans[0] and "Generate" not in above[1].split("Aggregate")[0]


def weighted_odd_lines(spark):
    rows = [(x, i % 3 + 1) for i, x in enumerate(odd_lines() + ["cat", "cat hat mat", "the cat cat cat cat cat the"] * 7 + ["the", "", None])]
    return spark.createDataFrame(rows, "line string, n long").select(F.lower("line").alias("line"), "n")


@pytest.mark.parametrize("chunk", [200, 8_000_000])
@pytest.mark.parametrize("floor", [1, 5])
def test_grams_dealt_out_in_chunks_equal_the_levels(spark, monkeypatch, chunk, floor):
    monkeypatch.setattr(tk, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tk, "PIECES", 5)
    df = weighted_odd_lines(spark)
    segs = tk.segment_rows(df, F.col("line"), tk.LATIN_SCRIPT_CLASS, ["the"], "seg", ",", ["n"]).withColumn("seg", F.split("seg", ","))
    want = gr.frequent_grams(gr.places(gr.weighted(segs, counts={"n": F.sum("n")})), floor).collect()
    got = gr.dealt_grams(df, tk.LATIN_SCRIPT_CLASS, ["the"], floor).collect()
    assert sorted(map(tuple, got)) == sorted((r["gram"], r["freq"]) for r in want) and len(got) > 20
    assert {r["gram"].count(",") for r in got} == {0, 1, 2, 3}
    two = gr.dealt_grams(df, tk.LATIN_SCRIPT_CLASS, ["the"], floor, max_len=2, joiner=" ").collect()
    assert sorted(map(tuple, two)) == sorted((r["gram"].replace(",", " "), r["freq"]) for r in want if r["k"] < 3)


@pytest.mark.parametrize("chunk", [200, 8_000_000])
def test_contexts_dealt_out_in_chunks_equal_those_of_each_segment(spark, monkeypatch, chunk):
    monkeypatch.setattr(tk, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tk, "PIECES", 5)
    df = weighted_odd_lines(spark)
    segs = tk.segment_rows(df, F.col("line"), tk.LATIN_SCRIPT_CLASS, ["the"], "seg", ",", ["n"]).withColumn("seg", F.split("seg", ","))
    want = ng.ngrams_with_context(segs, keep=["n"]).groupBy("gram", "k", "prev", "next").agg(F.sum("n").alias("n")).collect()
    got = gr.dealt_contexts(df, tk.LATIN_SCRIPT_CLASS, ["the"])
    assert got.columns == ["gram", "k", "prev", "next", "n"] and len(want) > 200
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert gr.dealt_contexts(df.where("false"), tk.LATIN_SCRIPT_CLASS, ["the"]).count() == 0


@pytest.mark.parametrize("name", ["gram_freq", "occurrences"])
def test_gram_counts_have_no_row_for_each_place(spark, tmp_path, name):
    """One exchange of lines and one of rows that hold a chunk's places of a bucket; no level by level, no aggregation of grams."""
    from termspark.plans import jobs
    spark.createDataFrame([(i, "\n".join(odd_lines(60, i)), "en") for i in range(9)], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    out = getattr(jobs, name)(spark, str(tmp_path))
    above = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(above) == 2 and "w#" in above[1].split("Aggregate")[0] and "Aggregate" not in above[0]
    assert "Join" not in above[1] and "Generate" not in above[1].split("Aggregate")[0] and out.count() > 20


def test_stop_bigrams_of_chunks_equal_those_of_stop_segments(spark, tmp_path):
    """No row for each token of a line on the way."""
    from termspark.plans import corpus as C
    from termspark.plans import jobs
    rows = [(i, "\n".join(odd_lines(60, i) + ["die Katze", "la 1 cat the hat", "été . mat"]), "en") for i in range(5)] + [(9, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = ng.ngrams_with_context(C.stop_segments(spark, str(tmp_path)), "seg", 2, " ")
    want = {r.gram for r in grams.where(F.col("gram").rlike(rf"^[{C.SCRIPT_CLASS} ]+\z")).collect()}
    got = jobs.stop_bigrams(spark, str(tmp_path))
    assert sorted(r.term for r in got.collect()) == sorted(want) and len(want) > 50
    plan = got.select("term")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan and "Generate" not in plan.split("Aggregate")[0]


def test_the_sorted_table_rests_on_grams_counted_once(spark, monkeypatch, tmp_path):
    """What is checkpointed on the way are the kept grams alone, not the segments and not the levels."""
    from termspark.plans import jobs
    spark.createDataFrame([(i, "\n".join(odd_lines(60, i) + ["mat mat"] * 2), "en") for i in range(9)], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for m in (gr, jobs):
        monkeypatch.setattr(m, "materialize", lambda df, real=m.materialize: kept.append(df.columns) or real(df))
    got = jobs.sorted_lookup(spark, str(tmp_path)).collect()
    assert kept == [["gram", "freq"]]
    assert sorted(map(tuple, got)) == sorted(map(tuple, jobs.gram_freq(spark, str(tmp_path)).where(F.col("gram").between(*jobs.LOOKUP)).collect())) and got


# ---- GBK files, manifest --------------------------------------------------------------------

def test_gbk_round_trip_over_several_splits(spark, tmp_path):
    from termspark.plans import jobs
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.legacy.javaCharsets", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    lines = [f"<p>电{i}力 系{i % 7}统网</p>" if i % 3 else f"行{i}" for i in range(5000)]
    try:
        spark.conf.set("spark.sql.legacy.javaCharsets", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        path = str(tmp_path / "gbk")
        sinks.write_lines(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), path, encoding="GBK")
        back = readers.read_lines(spark, path, "GBK")
        assert back.rdd.getNumPartitions() > 5
        assert sorted(r.line for r in back.collect()) == sorted(lines)
        got = jobs.tagged_lines(spark, path, "GBK", "<p>", "</p>")
        assert sorted(r.line for r in got.collect()) == sorted(x[3:-4] for x in lines if x.startswith("<p>"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_characters_that_a_charset_lacks(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("é🙂电",), ("",)], "line string"), str(tmp_path / "x"), encoding="gbk")
    assert sorted(r.line for r in readers.read_lines(spark, str(tmp_path / "x"), "gbk").collect()) == ["", "é?电"]
    (tmp_path / "bad").write_bytes(b"ok\n\xff\xfe\n")
    assert [r.line[:2] for r in readers.read_lines(spark, str(tmp_path / "bad"), "gbk").collect()][0] == "ok"


def test_lookup_opens_the_files_that_may_hold_the_keys(spark, tmp_path):
    path = str(tmp_path / "freq")
    rows = [(f"k{i:04d}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "gram string, freq bigint").repartition(6)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows become one file
        sinks.write_sorted(df, path, [F.col("gram")], "tsv", manifest="gram")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    manifest = readers.read_manifest(spark, path).orderBy("low").collect()
    assert len(manifest) == 4 and sum(r["n"] for r in manifest) == 1000
    assert all(a["high"] < b["low"] for a, b in zip(manifest, manifest[1:]))
    schema = "gram string, freq bigint"
    one = readers.lookup(spark, path, schema, ["k0500", "absent"])
    assert [tuple(r) for r in one.collect()] == [("k0500", 500)] and len(one.inputFiles()) == 1
    some = readers.lookup(spark, path, schema, between=("k0100", "k0110"))
    assert sorted(r["freq"] for r in some.collect()) == list(range(100, 111)) and len(some.inputFiles()) < 4
    assert readers.lookup(spark, path, schema, ["zzz"]).count() == 0 and readers.lookup(spark, path, schema).count() == 0
    assert sorted(tuple(r) for r in readers.read_tsv(spark, path, schema).collect()) == rows  # the manifest is not in the way


# ---- character grams ------------------------------------------------------------------------

@pytest.mark.parametrize("batch", [7, 10_000])
def test_suffix_runs_equal_the_counts_of_all_grams(spark, batch):
    rng = random.Random(4)
    pieces = list({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(150)}) + ["", "漢漢字"]
    df = spark.createDataFrame([(p, 1 + i % 4) for i, p in enumerate(pieces)], "piece string, n bigint")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        at = sx.starts(df, "piece", 5)
        got = {r["gram"]: (r["freq"], round(r["left"], 9) + 0.0, round(r["right"], 9) + 0.0) for r in sx.suffix_entropies(at, 5, 3).collect()}
        rows = sum(len(p) for p in pieces)
        assert at.count() == rows  # one row for each start
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    occ = ng.char_ngrams_with_next(df.where("piece <> ''"), "piece", 5, keep=["n"])
    assert occ.count() > 2.9 * rows
    want = {r["gram"]: (r["freq"], round(r["left"], 9) + 0.0, round(r["right"], 9) + 0.0) for r in coh.char_entropies(occ, "n").collect()}
    assert got == want


# ---- calibration ----------------------------------------------------------------------------

def test_platt_equals_newton(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.7 * m - 0.4)))).astype(float)
    a, b = md.platt(spark.createDataFrame([(float(u), float(v)) for u, v in zip(m, y)], "margin double, label double"))
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    x = np.stack([m, np.ones(400)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (t - p))
    assert (-a, -b) == (pytest.approx(w[0], abs=1e-4), pytest.approx(w[1], abs=1e-4))


def test_calibrated_output_is_near_the_share_of_positives(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(float)
    rows = spark.createDataFrame([(f"t{i}", 0.0, float(u), float(v), float(l)) for i, ((u, v), l) in enumerate(zip(x, y))],
                                 "term string, score double, f1 double, f2 double, label double")
    margins = md.held_out_margins(rows, ["f1", "f2"], folds=3).cache()
    assert margins.count() == 1500 and margins.select("term").distinct().count() == 1500
    bins = md.reliability(margins, md.platt(margins), 5).collect()
    assert sum(r["n"] for r in bins) == 1500
    assert all(abs(r["positives"] / r["n"] - r["mean_pred"]) < 0.12 for r in bins if r["n"] > 60)
    pred = [r["pred"] for r in md.predict_calibrated(md.train_calibrated(rows, ["f1", "f2"], folds=3), rows).collect()]
    assert min(pred) > 0 and max(pred) < 1 and abs(np.mean(pred) - y.mean()) < 0.03


# ---- lists, phrases and keys of any number --------------------------------------------------

def test_affix_join_equals_the_filter(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(word(rng.randint(0, 7)),) for _ in range(300)] + [(None,)]
    begin, end, inside = ([word(rng.randint(2, 5)) for _ in range(6)] for _ in range(3))
    df = spark.createDataFrame(terms, "term string")
    table = lambda words: spark.createDataFrame([(w,) for w in words + [None]], "word string")
    got = rk.affix_filter_join(df, "term", table(begin), table(end), table(inside))
    want = rk.affix_filter(df, "term", begin, end, inside)
    assert sorted(r.term for r in got.collect()) == sorted(r.term for r in want.collect())
    assert rk.affix_filter_join(df, "term").count() == 300 and rk.affix_filter_join(df, "term", table([""])).count() == 0
    assert rk.affix_filter_join(df, "term", table([])).count() == 300
    # what the plan holds does not grow with the list
    plan = lambda n: rk.affix_filter_join(df, "term", spark.range(n).select(F.col("id").cast("string").alias("word")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(5000)) < len(plan(5)) + 50


def test_affix_lists_that_travel_and_lists_that_are_joined_give_the_same(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("aé中\U0001F600 ") for _ in range(n))
    terms = [word(rng.randint(0, 7)) for _ in range(300)] * 2 + ["", None]
    lists = [[word(rng.randint(1, 3)) for _ in range(9)] for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i long, term string")
    table = lambda words: spark.createDataFrame([(w,) for w in words + words[:2] + [None]], "word string")
    number = sum(len(set(x)) for x in lists)
    for args, kept in ((lists, None), ([lists[0], None, lists[2]], None), ([[], [""], []], 0), ([None, None, [""]], 0), ([[], [], []], 601)):
        given = [None if x is None else table(x) for x in args]
        want = sorted((r.i, r.term) for r in rk.affix_filter(df, "term", *[x or [] for x in args]).where("term is not null").collect())
        for most in (number, 0):
            got = rk.affix_filter_join(df, "term", *given, broadcast_words=most)
            assert got.columns == ["i", "term"] and sorted(map(tuple, got.collect())) == want
        assert kept is None or len(want) == kept
    assert 0 < len(rk.affix_filter_join(df, "term", *map(table, lists)).collect()) < 600
    assert "Join" not in rk.affix_filter_join(df, "term", *map(table, lists))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in rk.affix_filter_join(df, "term", *map(table, lists), broadcast_words=number - 1)._jdf.queryExecution().optimizedPlan().toString()


def test_edge_stop_words_as_lists(spark):
    df = spark.createDataFrame([("the end",), ("ends the",), ("a theory b",), ("none",)], "term string")
    stop = spark.createDataFrame([("the",)], "word string")
    want = kw.stop_edge_filter(df, ["the"])
    assert sorted(r.term for r in rk.affix_filter_join(df, "term", stop, stop).collect()) == sorted(r.term for r in want.collect())


def test_phrases_are_mapped_leftmost_longest(spark):
    mapping = {"ab": "X", "abc": "Y", "bc": "Z", "d.": "(", "[e]": "E", "計算": "计算机"}
    texts = ["abcabab", "bcab", "d.dd.[e]e", "計算計", "", None, "🙂ab🙂\nabc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(TX.map_phrases("t", mapping)).collect()]
    assert got == ["YXX", "ZX", "(d(Ee", "计算机計", "", None, "🙂X🙂\nY"]
    assert spark.createDataFrame([("ab",)], "t string").select(TX.map_phrases("t", {})).first()[0] == "ab"


def test_keys_by_the_index_equal_a_search_of_every_line(spark):
    rng = random.Random(7)
    words = ["ab", "abc", "b", "cab", "xx", "aabb"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(80)] + ["a  b", " ab", "ab "]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    keys = ["ab", "b c", "ab ab", "b xx a", "cab", "abc abc abc", "a  b", " ab", "ab ", "zz", "b", ""]
    kd = spark.createDataFrame([(k,) for k in keys + ["ab", None]], "key string")
    got = {(r["key"], r["id"]) for r in ix.find_keys(ix.token_index(df), df, kd).collect()}
    assert got == {(k, i) for k in keys if k for i, l in enumerate(lines) if k in l}


def test_many_keys_give_what_each_key_gives(spark):
    lines = spark.createDataFrame([(0, "the station, motion; x"), (1, "a motion of motions"), (2, "none")], "id long, line string")
    keys = ["motion", "station", "on"]
    got = kw.kwic_many(ix.token_index(lines), lines, spark.createDataFrame([(k,) for k in keys], "key string"), "a-z", stop_chars="q").collect()
    want = [(k, r.piece) for k in keys for r in kw.kwic_pieces(lines, "line", k, "a-z", "q").collect()]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_keys_as_one_automaton_give_what_the_index_gives(spark, monkeypatch):
    rng = random.Random(8)
    words = ["été", "ete", "tion", "s tion", "Motion", "ra,ra", "ｅｔｅ", "qtion", "\U0001F600", "a", ""]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["ete", "été", "ete, été", ""]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(lines))), "id long, line string")
    keys = ["ete", "été", "tion", "s tion", "on a", " ", "ra", "ra,ra", "ti", "e", "zz", "ete tion ra"]
    kd = spark.createDataFrame([(k,) for k in keys + ["ra", "", None]], "key string")
    how = {"script_class": "a-zà-ÿ ", "stop_chars": "q", "variants": ("é", "e")}
    monkeypatch.setattr(kw, "HELD_PIECES", 7)
    monkeypatch.setattr(tk, "CHUNK_BYTES", 500)
    rows = lambda **more: kw.kwic_many(ix.token_index(df), df, kd, **how, **more)
    want = Counter((k, r.piece) for k in keys for r in kw.kwic_pieces(df, "line", k, **how).collect())
    assert len({k for k, _ in want}) > 6
    for most in (len(keys), len(keys) - 1):
        assert Counter(tuple(r) for r in rows(broadcast_keys=most).collect()) == want
        assert sorted(tuple(r) for r in rows(broadcast_keys=most, counted=True).collect()) == sorted((*k, n) for k, n in want.items())
    none = kw.kwic_many(ix.token_index(df), df, kd.limit(0), **how, counted=True)
    assert none.columns == ["key", "piece", "n"] and none.count() == 0


def test_a_line_is_not_joined_with_its_keys(spark):
    lines = spark.createDataFrame([(i, f"the nation of nations {i}") for i in range(20)], "id long, line string")
    keys = spark.createDataFrame([("nation",), ("of nations",)], "key string")
    plan = kw.kwic_many(ix.token_index(lines), lines, keys, "a-z ")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_pairs_of_key_and_line_are_shuffled_once(spark):
    lines = spark.createDataFrame([(i, f"the nation of nations {i}") for i in range(20)], "id long, line string")
    keys = spark.createDataFrame([("nation",), ("of nations",)], "key string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        found = ix.find_keys(ix.token_index(lines), lines, keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["key"], r["id"]) for r in found.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted((k, i) for k in ("nation", "of nations") for i in range(20))
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(key" not in plan.split("REPARTITION_BY_COL")[0]


# ---- corpus diff -----------------------------------------------------------------------------

def test_scores_of_the_diff_are_worked_out_once(spark):
    from termspark.plans import jobs as J
    words = [f"{c}{d}" for c in "pqrst" for d in "uvwxy"]
    rows = [(w, 20 + i, 3.0, 3.0, 6 + i % 3, 2.0, 2.0) for i, w in enumerate(words)]
    rows += [(f"{x},{y}", 9, 3.0, 3.0, 0, None, None) for x, y in zip(words, words[1:])]
    grams = spark.createDataFrame(rows, "gram string, freq long, left_entropy double, right_entropy double, "
                                        "a_freq long, a_left_entropy double, a_right_entropy double")
    out = J.diff_from(grams, stored=True)["candidates"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "Generate" not in plan  # no split of a gram, no scan of the gram table
    got = {r["term"] for r in out.collect()}
    assert {f"{x} {y}" for x, y in zip(words, words[1:])} <= got
    assert got == {r["term"] for r in J.diff_from(grams)["candidates"].collect()}
