"""Round trips for the scans and sinks."""
import os

from pyspark.sql import functions as F

from termspark.operators import keywords as kw
from termspark.sources import readers as R
from termspark.sources import sinks as W


def test_gbk_scan_and_tag_extract(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "corpus.txt")
    with open(p, "wb") as f:
        f.write("<content>电力系统</content>\n<url>x</url>\n<content>继电保护</content>\n".encode("gbk"))
    lines = R.read_lines(spark, p, "GBK")
    got = sorted(r.line for r in kw.extract_tagged(lines, "line").collect())
    assert got == ["电力系统", "继电保护"]


def test_gbk_scan_keeps_every_line(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "lines.txt")
    lines = ["甲", "", "乙\x01丙", "  ", "丁"]
    with open(p, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode("gbk"))
    assert [r.line for r in R.read_lines(spark, p, "GBK").collect()] == lines


def test_extract_corpus_job(spark, tmpdir_run):
    from termspark.plans import jobs
    p, out = os.path.join(tmpdir_run, "c.txt"), os.path.join(tmpdir_run, "x1")
    with open(p, "wb") as f:
        f.write("<content>电力系统</content>\n<url>x</url>\n<content></content>\n".encode("gbk"))
    jobs.extract_corpus(spark, p, out, partitions=3)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["", "电力系统"]


def test_word_list_blank_and_order(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "w.txt")
    open(p, "w").write("b\n\t\n\x0b \na\nb\n")
    got = R.read_word_list(spark, p, ordered=True).orderBy("ord")
    assert [r.word for r in got.collect()] == ["b", "a"]


def test_word_list_scan(spark, tmpdir_run):
    a, b = os.path.join(tmpdir_run, "a.txt"), os.path.join(tmpdir_run, "b.txt")
    open(a, "w").write("x\r\n \ny\n x\n")
    open(b, "w").write("y\nz\n")
    got = sorted(r.word for r in R.read_word_list(spark, [a, b]).collect())
    assert got == [" x", "x", "y", "z"]


def test_exact_fields_and_tsv(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "idf.tsv")
    open(p, "w").write("a\t1.5\nbad\nb\t2.0\textra\nc\t0.5\n")
    df = R.read_exact_fields(spark, p, ["term", "idf"], ["string", "double"])
    assert sorted((r.term, r.idf) for r in df.collect()) == [("a", 1.5), ("c", 0.5)]
    t = R.read_tsv(spark, p, "term string, idf double")
    assert sorted((r.term, r.idf) for r in t.collect()) == [("a", 1.5), ("c", 0.5)]
    # Java's split drops empty fields at the end: "d<TAB>" has one field, "e<TAB>1<TAB>" two
    open(p, "w").write("d\t\ne\t1\t\n\t\n\n")
    assert [(r.term, r.idf) for r in R.read_exact_fields(spark, p, ["term", "idf"], ["string", "double"]).collect()] == [("e", 1.0)]


def test_external_features_header(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "ext.tsv")
    open(p, "w").write("term\tf1\tf2\n电力\ttrue\t0.5\n")
    df = R.read_tsv(spark, p, "term string, f1 boolean, f2 double", header=True)
    assert [r.asDict() for r in df.collect()] == [{"term": "电力", "f1": True, "f2": 0.5}]
    open(p, "w").write("term\tf1\tf2\nbad\n电力\ttrue\t0.5\nlong\ttrue\t1\t2\n")
    assert [r.term for r in R.read_tsv(spark, p, "term string, f1 boolean, f2 double", header=True).collect()] == ["电力"]


def test_predictions_scan(spark, tmpdir_run):
    p = os.path.join(tmpdir_run, "pred.csv")
    open(p, "w").write("电力,1.5,0.9\n继电,0.5,0.1\n")
    assert R.read_predictions(spark, p).where(F.col("pred") > 0.8).count() == 1


def test_sorted_sinks_round_trip(spark, tmpdir_run):
    df = spark.range(0, 100).select((F.col("id") % 10).alias("f"), F.col("id").cast("string").alias("g"))
    out = os.path.join(tmpdir_run, "k1")
    W.write_sorted(df, out, [F.desc("f"), F.asc("g")], fmt="tsv")
    files = sorted(x for x in os.listdir(out) if x.startswith("part-"))
    rows = [line.rstrip("\n").split("\t") for f in files for line in open(os.path.join(out, f))]
    assert rows == sorted(rows, key=lambda r: (-int(r[0]), r[1])) and rows[0] == ["9", "19"] and len(rows) == 100
    out2 = os.path.join(tmpdir_run, "k2")
    W.write_sorted(df, out2, [F.desc("f"), F.asc("g")])
    assert spark.read.parquet(out2).count() == 100
    out3 = os.path.join(tmpdir_run, "k3")
    W.write_lines(df.select("g"), out3, 4)
    assert spark.read.text(out3).count() == 100
