"""Repeated passages, source divergence and hard negatives against plain Python."""
import math
import os
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))


def clash(spark, rows):
    """Texts beside columns named like the operators' own."""
    return spark.createDataFrame([(i, t, 1, "k", [1], 2) for i, t in rows], "doc_id long, text string, shard int, batch string, masks array<int>, n long")


# ---- substring dedup ------------------------------------------------------------------------

def without_repeats(rows, window):
    """{position in rows: (n_words, removed spans, kept)}; rows in order of (id, position)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        w = SPACE.findall(rows[k][1] or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        spans, s = [], None
        for i, g in enumerate(gone + [False]):
            if g and s is None:
                s = i
            elif not g and s is not None:
                spans.append((s, i))
                s = None
        out[k] = (len(w), spans, " ".join(x for x, g in zip(w, gone) if not g))
    return out


def check_repeats(spark, rows, window, **how):
    from termspark.llm.repeats import remove_repeats
    got = remove_repeats(clash(spark, rows), window=window, **how).collect()
    want = without_repeats(rows, window)
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], [tuple(s) for s in r["removed"]], r["kept"]) for r in got)
    assert mine == sorted((rows[k][0] is None, rows[k][0] or 0, n, sum(e - s for s, e in spans), spans, kept) for k, (n, spans, kept) in want.items())


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, small):
    """Passages, near copies, periodic texts; also with tiny batches and shards and every
    anchor of four occurrences dealt out by its windows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        if i % 9 == 0:
            w += ["again"] * rng.randint(1, 25)
        if i % 11 == 0:
            w += ["tick", "tock"] * 8
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    how = dict(batch_words=60, shard_keys=20, shard_words=150, hot=3) if small else {}
    check_repeats(spark, rows, 6, anchor=3, **how)


def test_repeats_on_odd_rows(spark):
    copy = "a b c d e f g h i j k l m n o p q r s t u v"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, copy), (6, copy), (None, copy + " end"), (7, LONG),
            (8, "head " + LONG), (9, "é ü 漢字 🙂 " * 12), (10, "x" * 5000), (11, copy.upper()), (12, "a\x1cb c " * 40)]
    check_repeats(spark, rows, 20)


def test_repeats_of_an_empty_table(spark):
    check_repeats(spark, [], 20)


def test_repeats_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_repeats(spark, rows, 20)
    from termspark.llm.queries import op11
    got = {r["doc_id"]: r["kept_sha256"] for r in op11(spark, SF).collect()}
    assert got == {rows[k][0]: brute.sha(kept) for k, (_, _, kept) in without_repeats(rows, 20).items()}


def test_automaton_gives_matching_statistics():
    from termspark.llm.automaton import SuffixAutomaton
    rng = random.Random(1)
    for _ in range(60):
        known = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        a = SuffixAutomaton()
        for s in known:
            a.add(s)
        assert len(a) <= 2 * sum(map(len, known)) + 1
        parts = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}
        text = [rng.randrange(4) for _ in range(20)]
        assert a.matching(text) == [max(n for n in range(i + 2) if tuple(text[i + 1 - n:i + 1]) in parts) for i in range(len(text))]


# ---- source divergence ----------------------------------------------------------------------

def audit(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, spread = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for no, (text, lang, source) in enumerate(docs):
        terms = [t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(terms)
        for t in terms:
            spread[lang][t].add(no)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for t, where in spread[lang].items() if len(where) >= least]
        sources = sorted({d[2] for d in docs if d[1] == lang})
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        total = Counter()
        for s in sources:
            total.update(count[lang, s])
        p, q = {s: share(count[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, value, r + 1) for r, (value, i) in enumerate(items[:top] if part == "term" else items)}
    return out


def check_audit(spark, rows, least, top, **how):
    from termspark.llm.divergence import divergence
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, chunk string")
    got = divergence(d, least=least, top=top, **how).select("lang", "source", "part", "item", "value", "rank").collect()
    want = audit(rows, least, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, small):
    """Terms that only all chunks together bring to the least number of documents, chunks of
    several terms, groups without terms, a language without kept terms; also with tiny batches."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "qrstuv"] + ["Éa", "漢字"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) + rng.choice(["", ",", ".", "!", "-x", "1", "-" + rng.choice(words)]) for _ in range(rng.randint(0, 14)))
        rows.append((text, rng.choice("EF"), f"s{min(rng.randrange(9), 5)}"))
    rows += [("", "E", "empty"), (None, "E", "none"), ("only once here", "G", "a"), ("...", "G", "b"), ("same same", None, None),
             ("K k", "K", "z")] + [(f"rare{'!' * i} rare", "E", "s1") for i in range(7)]
    check_audit(spark, rows, 5, 3, **(dict(batch_words=30, shard_bytes=200) if small else {}))


def test_divergence_of_no_and_of_bare_rows(spark):
    check_audit(spark, [], 2, 3)
    check_audit(spark, [(None, None, None), (None, None, "s"), ("\n", "x", "s")], 2, 3)
    check_audit(spark, [(LONG, "x", "s"), (LONG + " tail", "x", "t"), (LONG, "x", "t"), ("é" * 9000, "x", "t")], 2, 10)


def test_shares_are_exact_beyond_64_bits():
    from termspark.llm.divergence import apart, shares
    big = np.array([[12_345_678_901_234, 0]])
    assert shares(big, np.array([[10**17 + 1]]), 7).tolist() == [[1 + 10**9 * 12_345_678_901_236 // (10**17 + 15), 1 + 2 * 10**9 // (10**17 + 15)]]
    assert apart(np.array([1_000_000_001]), np.array([1])).tolist() == [(10**9) ** 2 // (10**9 + 2)]


# ---- hard negatives -------------------------------------------------------------------------

def mined(rows, every, positives, negatives):
    use = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x])
        use[i] = min(use.get(i, row), row)
    out = set()
    for a, (la, xa) in use.items():
        if a % every:
            continue
        scored = sorted((-sum(u * v for u, v in zip(xa, x)), i, l) for i, (l, x) in use.items() if i != a and len(x) == len(xa))
        for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
            fit = [s for s in scored if s[2] != la and -80 * ps <= -100 * s[0] <= -100 * ps][:negatives]
            out |= {(a, p, r + 1, n, -ps, -s) for r, (s, n, _) in enumerate(fit)}
    return out


def check_mined(spark, rows, **how):
    from termspark.llm.negatives import hard_negatives
    d = spark.createDataFrame([(i, x, l, 1, "x") for i, x, l in rows], "vec_id long, embedding array<float>, label int, shard int, x string")
    got = hard_negatives(d, every=5, positives=3, negatives=4, **how).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = mined(rows, 5, 3, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def vectors(n, dim, seed, copies=0):
    """Clusters, and copies of one vector under all labels."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dim))
    x = middle[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dim))
    x[:copies] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, dict(shard_rows=60, anchors=3, words=5, sample=50)])
def test_negatives_equal_brute_force(spark, how):
    check_mined(spark, vectors(500, 8, 1, copies=150), **how)


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 2) + [(100, None, 1), (105, [], 1), (110, [nan, 1.0, 1.0, 1.0], 1), (115, [1.0, None, 1.0, 1.0], 1), (120, [inf] * 4, 2), (None, [1.0] * 4, 1),
                                (125, [1.0] * 4, None), (130, [0.0] * 4, 3), (135, [1.0], 1), (140, [0.5], 1), (145, [0.5], 2), (5, [0.1, 0.2, 0.3, 0.4], 4),
                                (5, [0.1, 0.2, 0.3, 0.4], 4), (-5, [0.3] * 4, 4), (150, [-0.4] * 4, 5)]
    check_mined(spark, rows)
    check_mined(spark, [])
    check_mined(spark, [(5, [0.5, 0.5], 1)])


def test_index_stops_before_it_has_read_everything():
    from termspark.llm.negatives import MultiIndex, _kmeans
    x = np.array([v[1] for v in vectors(4000, 8, 4)]) * 256
    rng = np.random.default_rng(0)
    index = MultiIndex(np.arange(4000), np.arange(4000) % 3, x, tuple(_kmeans(h, 32, 8, rng) for h in (x[:, :4], x[:, 4:])))
    read = 0
    for rows, bound in index.visits(x[17], 64):
        assert (index.x[np.setdiff1d(np.arange(4000), rows)] @ x[17]).max() <= max(bound, (index.x @ x[17]).max())
        read += len(rows)
        if bound < 0.9 * (x[17] @ x[17]):
            break
    assert read < 2000
