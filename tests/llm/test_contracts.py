"""What the operators promise of groups, short items, scores, odd rows and bare workers."""
import os
import random
import subprocess
import sys
import textwrap
import zlib

import brute
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"),
       (7, LONG), (8, LONG + " tail"), (9, "é ü 漢字 🙂 mail a@b.co"), (10, "x" * 5000)]


def documents(spark, rows):
    """The columns of documents, and others named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "k") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, node int, score double, _id string")


# ---- sharding -------------------------------------------------------------------------------

def groups_kept_whole(rows, shards):
    size, of = {}, {}
    for r in rows:
        size[r["k"]] = size.get(r["k"], 0) + r["size"]
        of.setdefault(r["k"], set()).add(r["shard"])
    bound = max(max(r["size"] for r in rows), sum(r["size"] for r in rows) / shards / 128)
    return [k for k, s in size.items() if s <= bound and len(of[k]) > 1], sum(s <= bound for s in size.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_equal_texts_share_a_shard(spark, sf):
    from termspark.llm.queries import op1
    folder = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1(spark, folder).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(40))
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())
    torn, small = groups_kept_whole([{"k": texts[r["doc_id"]], "size": r["size"], "shard": r["shard"]} for r in rows], 40)
    assert not torn and small > 100


def test_groups_across_ranges_share_a_shard(spark):
    """Groups near the bound beside one that fills many shards, with few ranges and many samples a range."""
    from termspark.llm.shard import assign_shards
    rng = random.Random(2)
    rows = [(i, "hot", 40) for i in range(2000)] + [(3000 + i, f"g{i // 30}", rng.randint(10, 60)) for i in range(1500)] + [(9000, "one", 1500)]
    df = spark.createDataFrame(rows, "doc_id long, k string, size long")
    out = assign_shards(df, 20, key="k", size="size", tie=["doc_id"]).collect()
    assert len(out) == len(rows)
    torn, small = groups_kept_whole(out, 20)
    assert not torn and small > 30
    sizes = [sum(r["size"] for r in out if r["shard"] == k) for k in range(20)]
    assert max(sizes) - min(sizes) <= 4 * 1500


def test_write_shards(spark, tmp_path):
    from termspark.llm.shard import write_shards
    df = documents(spark, ODD).select("doc_id", F.col("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.lit(9).alias("slot"))
    write_shards(df, 3, str(tmp_path / "out"), key="t", size="size", tie=["doc_id"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r["doc_id"]), r["t"]) for r in back.collect() if r["t"] is not None) == sorted((str(i), t) for i, t in ODD if t is not None)
    assert back.count() == len(ODD) and set(back.columns) == {"doc_id", "t", "size", "law", "shard", "slot"}


# ---- secrets, personal data, decontamination -----------------------------------------------------

def test_random_runs_from_twelve_characters(spark):
    from termspark.llm import secrets
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["configuration", "serverhandler", "theother", "connection", "request_handler", "integration", "another", "station"]
    rows = [(i, "token = " + "".join(rng.choices(letters, k=32)) + " " + " ".join(rng.choices(words, k=60))) for i in range(200)]
    rows += [(1000, "see Zq7Xp2Lk9Wv4Jt8H now"), (1001, "see integration station now"), (1002, "clé:éZq7Xp2Lk9Wv4Jt8Hé")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(m["start"], m["stop"]) for m in r["markov"]] for r in secrets.find_secrets(df, secrets.train(df)).collect()}
    assert got[1000] == [(4, 20)] and got[1001] == [] and got[1002] == [(5, 21)]


def test_empty_tables_of_native_scans(spark):
    from termspark.llm import pii, secrets
    none = documents(spark, ODD).where("false")
    assert secrets.digests(secrets.find_secrets(none, secrets.train(none))).count() == 0
    assert pii.digests(pii.find_pii(none)).count() == 0 and pii.redact(none).count() == 0


def test_scores_of_findings_are_returned(spark):
    from termspark.llm import pii
    df = spark.createDataFrame([(1, "mail: a@b.co and 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.digests(pii.find_pii(df)).collect()}
    spans, scores = got[1]
    assert len(spans.split(",")) == len(scores.split(",")) == 2
    assert float(scores.split(",")[0]) == pytest.approx(pii.PRIOR["email"] + pii.CONTEXT_SCORE) and got[2] == ("", "")


def test_short_items_are_found_inside_documents(spark):
    from termspark.llm.decontaminate import contaminated, decontaminate
    items = [(1, "Short answer here"), (2, "one"), (3, "a b c d"), (4, "one two three four five six"), (5, None)]
    rows = ODD + [(20, "the short ANSWER here it is"), (21, "short answer not here"), (22, "x one two three four five six y"), (23, LONG + " a b c d " + LONG)]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contaminated(documents(spark, rows), it).collect()), key=str)
    want = []
    for d, t in rows:  # row by row: ids repeat
        want += [(d, i, n, m) for (_, i), (n, m) in brute.contaminated([(d, t)], items).items()]
    assert got == sorted(want, key=str) and {(20, 1), (22, 2), (23, 3), (6, 3)} <= {g[:2] for g in got}
    assert {r["doc_id"] for r in decontaminate(documents(spark, rows), it).collect()} == {d for d, _ in rows} - {w[0] for w in want}


# ---- whole rows through the filters, and the pipeline's stages -----------------------------------

def test_keep_clean_keeps_columns_and_odd_rows(spark):
    from termspark.llm import toxicity
    model = toxicity.fit(documents(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    clean = toxicity.keep_clean(documents(spark, ODD), model)  # score 0.5 everywhere
    assert clean.columns == documents(spark, ODD).columns and clean.count() == len(ODD)
    twice = documents(spark, ODD).select("doc_id", "text", "lang", F.col("source").alias("lang"))
    assert toxicity.keep_clean(twice, model).columns == ["doc_id", "text", "lang", "lang"]
    assert toxicity.keep_clean(documents(spark, ODD), model, least=0.4).count() == 0
    assert toxicity.keep_clean(documents(spark, []), model).count() == 0
    assert toxicity.tag(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_stage_on_odd_rows_and_on_none(spark, rows):
    import corpus_pipeline
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
        ids = sorted(str(r["doc_id"]) for r in got)
        if name in ("toxicity", "personal_data", "byte_level_bpe"):
            assert ids == sorted(str(i) for i, _ in rows)
        if name == "near_duplicates" and rows:
            # the copies 6, 6 and null leave one, 4 and 5 are equal, 7 and 8 near; texts without words stay
            assert ids == sorted(map(str, [1, 2, 3, 4, 6, 7, 9, 10]))


def test_pipeline_needs_a_shared_folder(monkeypatch, spark):
    import corpus_pipeline
    monkeypatch.setattr(corpus_pipeline, "checkpoint_dir", lambda s: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        corpus_pipeline.run(spark, SF)


# ---- executors without the package --------------------------------------------------------------

def test_workers_need_no_copy_of_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path alone."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as E
        from termspark.session import local_session
        spark = local_session(4, 4, driver_memory="3g", checkpoint_dir={str(tmp_path / "shared")!r})

        def bare(batches):
            try:
                import termspark
                raise SystemExit("the workers have the package")
            except ModuleNotFoundError:
                yield from batches

        spark.range(1).mapInArrow(bare, "id long").collect()
        for name, query in E.queries().items():
            if name == "pipeline" or name.startswith("op"):
                query(spark, {SF!r}).write.format("noop").mode("overwrite").save()
                print("ran", name, flush=True)
    """)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME_CONF")}
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO]
    if kept:
        env["PYTHONPATH"] = os.pathsep.join(kept)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran ") == 14, done.stdout[-500:] + done.stderr[-3000:]
