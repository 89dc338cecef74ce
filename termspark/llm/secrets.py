"""Secret scan with SQL functions alone: fixed rules, and Markov models.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, give every long token a log-likelihood ratio; tokens whose
ratio is high are reported as kind ``markov``.  The models are trained from
labelled samples of the corpus itself: what the fixed rules capture is labelled
random, the words of documents are labelled ordinary.  Training reads a bounded
sample of documents and counts character pairs with a group-by; the model is one
number for each pair of ASCII characters (16,384 at most).
"""
from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import bucket_below, only
from termspark.llm.spans import joined, literal, with_spans

# The base rules.  Kinds with a least length match it in the pattern
# itself, which drops exactly the matches that are too short; an assignment keeps
# its plain pattern, because a match that fails takes its characters with it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
ASSIGN_LEAST = 12
#: Runs that the Markov models are asked about: as long as an assignment's value, whatever stands beside them.
TOKEN = r"[A-Za-z0-9+/_=-]{12,}+"
#: Natural logarithm of the likelihood ratio from which a token is reported.
LEAST_RATIO = 12.0
#: Documents that the models are trained on: for random strings, for ordinary words.
TRAIN_RANDOM, TRAIN_WORDS = 20_000, 2_000
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _pairs(df: DataFrame, col: str) -> DataFrame:
    """(pair, n): counts of neighbouring characters a, b as 128 * a + b."""
    codes = df.select(F.expr(f"transform(split({col}, ''), c -> ascii(c))").alias("c"))
    both = codes.select(F.explode(F.expr(
        "zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> a * 128 + b)")).alias("pair"))
    return both.where("pair between 0 and 16383").groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          random_docs: int = TRAIN_RANDOM, word_docs: int = TRAIN_WORDS) -> list[float]:
    """The log-likelihood ratio of each character pair (index 128 * a + b).

    Smoothed by one count for each symbol, so without samples a model is uniform
    and the ratio 0.
    """
    base = only(docs, doc_id, text).select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    n = base.count()
    captured = (with_spans(base.where(bucket_below(F.col("id"), random_docs, n)), "t", RULES)
                .select(F.explode(F.expr(f"""concat(
                    filter(transform(assign, m -> regexp_extract(m.s, {literal(ASSIGN)}, 2)), v -> length(v) >= {ASSIGN_LEAST}),
                    transform(access, m -> m.s), transform(hex, m -> m.s))""")).alias("v")))
    words = (base.where(bucket_below(F.col("id"), word_docs, n))
             .select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z_]{2,}(?![A-Za-z0-9])"), 0)).alias("v")))

    def model(df):
        counts = {r["pair"]: r["n"] for r in _pairs(df, "v").collect()}  # at most 16,384 rows
        out = {}
        for a in SYMBOLS:
            row = [counts.get(128 * ord(a) + ord(b), 0) + 1 for b in SYMBOLS]
            for b, c in zip(SYMBOLS, row):
                out[128 * ord(a) + ord(b)] = math.log(c / sum(row))
        return out

    rand, ordinary = model(captured), model(words)
    return [rand[i] - ordinary[i] if i in rand else 0.0 for i in range(128 * 128)]


def find_secrets(docs: DataFrame, ratios: list[float], *, doc_id: str = "doc_id", text: str = "text",
                 least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, assign, access, hex, markov): arrays of spans (start, stop in code
    points, stop exclusive; s the match), one row per document row.

    The first three are the fixed rules' leftmost non-overlapping matches that
    pass (an assignment's value has 12 or more characters); markov holds the long
    tokens whose log-likelihood ratio reaches ``least_ratio``, also where a fixed
    rule has found them.  A null text counts as empty; ids may be null or repeat;
    other columns are left aside.
    """
    base = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = with_spans(base, "t", RULES | {"markov": TOKEN})
    table = f"from_json({literal(json.dumps([round(x, 6) for x in ratios]))}, 'array<double>')"
    ratio = f"""aggregate(transform(array(transform(split(m.s, ''), c -> ascii(c))), c -> zip_with(
            slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> get({table}, a * 128 + b)))[0],
            cast(0 as double), (x, y) -> x + coalesce(y, 0))"""
    return found.select(
        "doc_id", F.expr(f"filter(assign, m -> length(regexp_extract(m.s, {literal(ASSIGN)}, 2)) >= {ASSIGN_LEAST})").alias("assign"),
        "access", "hex", F.expr(f"filter(markov, m -> {ratio} >= {float(least_ratio)})").alias("markov"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the fixed rules, the hash of their spans, and all spans, by start
    and then by kind in the order assign, access, hex, markov."""
    kinds = ("assign", "access", "hex", "markov")

    def ordered(some):
        return "array_sort(concat(" + ", ".join(
            f"transform({k}, m -> named_struct('start', m.start, 'rank', {i}, 'stop', m.stop, 'kind', '{k}'))"
            for i, k in enumerate(kinds) if k in some) + "))"

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.expr(ordered(kinds[:3])).alias("base"), F.expr(ordered(kinds)).alias("all")).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_markov")
