"""Lexical features for the term classifier.

Features are a function of the term string alone, so they are computed once
per DISTINCT term and joined back to the (bag) term table.  A lookup is: explode the
term's units -> equi-join the lookup table (AQE chooses broadcast when it is small)
-> ``groupBy(term)`` with sum / count / min / max.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K

FILTER_FEATURES = ["length", "char_idf_sum", "char_idf_avg", "char_idf_min", "char_idf_max",
                   "word_idf_sum", "word_idf_avg", "word_idf_min", "word_idf_max",
                   "hot_char_sum", "hot_char_avg", "hot_word_sum", "hot_word_avg"]
RANK_FEATURES = ["length", "char_idf_sum", "char_idf_avg", "word_idf_sum", "word_idf_avg",
                 "hot_char_sum", "hot_char_avg", "hot_word_sum", "hot_word_avg"]


def chars_of(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def lookup_stats(terms: DataFrame, units: Callable[[Column], Column], table: DataFrame,
                 key: str, value: str, prefix: str, with_min_max: bool = True,
                 eps: float = K.AVG_EPS) -> DataFrame:
    """For each distinct term, ``sum``, ``sum / (n + eps)`` and (optionally)
    ``min`` / ``max`` of the table values of its units (every occurrence
    counts; units absent from the table are skipped; 0 when none match)."""
    u = terms.select("term", F.posexplode(units(F.col("term"))).alias("_i", "_u"))
    t = table.select(F.col(key).alias("_u"), F.col(value).cast("double").alias("_v"))
    j = u.join(t, "_u", "inner")
    aggs = [F.sum("_v").alias("_s"), F.count("_v").alias("_n")]
    if with_min_max:
        aggs += [F.min("_v").alias("_mn"), F.max("_v").alias("_mx")]
    g = j.groupBy("term").agg(*aggs)
    out = terms.join(g, "term", "left")
    s = F.coalesce(F.col("_s"), F.lit(0.0))
    n = F.coalesce(F.col("_n"), F.lit(0))
    cols = [F.col(c) for c in terms.columns if c != "term"]
    res = [F.col("term"), *cols, s.alias(f"{prefix}_sum"), (s / (n + F.lit(eps))).alias(f"{prefix}_avg")]
    if with_min_max:
        res += [F.coalesce("_mn", F.lit(0.0)).alias(f"{prefix}_min"),
                F.coalesce("_mx", F.lit(0.0)).alias(f"{prefix}_max")]
    return out.select(*res)


def term_features(terms: DataFrame, char_idf: DataFrame, word_idf: DataFrame,
                  hot_chars: DataFrame, hot_words: DataFrame,
                  word_units: Callable[[Column], Column], mode: str = "filter") -> DataFrame:
    """M1 (``mode='filter'``: 13 features) / M2 (``'rank'``: 9 lexical ones)
    for the distinct terms of ``terms`` (a ``term`` column).

    The four lookups are one: units tagged by family are joined to one table of
    (family, unit, value) and aggregated once per term."""
    if mode not in ("filter", "rank"):
        raise ValueError(mode)
    chars, words = F.lit("c"), F.lit("w")
    table = None
    for fam, t, value in ((chars, char_idf, "idf"), (words, word_idf, "idf"), (chars, hot_chars, "hot"), (words, hot_words, "hot")):
        t = t.select(fam.alias("_fam"), F.col("term").alias("_u"), *[(F.col(v).cast("double") if v == value else F.lit(None).cast("double")).alias(f"_{v}") for v in ("idf", "hot")])
        table = t if table is None else table.unionByName(t)
    table = table.groupBy("_fam", "_u").agg(F.max("_idf").alias("_idf"), F.max("_hot").alias("_hot"))
    d = terms.select("term").distinct()
    c, w = chars_of(F.col("term")), word_units(F.col("term"))
    tagged = F.concat(F.transform(c, lambda x: F.struct(chars.alias("_fam"), x.alias("_u"))),
                      F.transform(w, lambda x: F.struct(words.alias("_fam"), x.alias("_u"))))
    units = d.select(F.inline(F.array(F.struct("term", tagged.alias("_a"))))).select("term", F.explode_outer("_a").alias("_x")).select("term", "_x.*")
    j = units.join(table, ["_fam", "_u"], "left")
    aggs, cols = [], []
    for fam, name in (("c", "char"), ("w", "word")):
        for v in ("idf", "hot"):
            x, p = F.when(F.col("_fam") == fam, F.col(f"_{v}")), f"{name}_{v}" if v == "idf" else f"hot_{name}"
            s, n = F.coalesce(F.sum(x), F.lit(0.0)), F.count(x)
            aggs += [s.alias(f"{p}_sum"), (s / (n + F.lit(K.AVG_EPS))).alias(f"{p}_avg")]
            if v == "idf":
                aggs += [F.coalesce(F.min(x), F.lit(0.0)).alias(f"{p}_min"), F.coalesce(F.max(x), F.lit(0.0)).alias(f"{p}_max")]
    g = j.groupBy("term").agg(*aggs).withColumn("length", F.length("term").cast("double"))
    return g.select("term", *(FILTER_FEATURES if mode == "filter" else RANK_FEATURES))


def training_rows(positives: DataFrame, negatives: DataFrame, features: DataFrame, int_label: bool = False) -> DataFrame:
    """Train rows: positives labelled 1 and negatives 0 (bag union, a word in both
    lists appears twice), each with its features; M1 has a double label, M2 an int."""
    kind = "int" if int_label else "double"
    lab = (positives.select(F.col("word").alias("term"), F.lit(1).cast(kind).alias("label"))
           .unionByName(negatives.select(F.col("word").alias("term"), F.lit(0).cast(kind).alias("label"))))
    return lab.join(features, "term", "inner")


def prediction_rows(candidates: DataFrame, features: DataFrame) -> DataFrame:
    """Predict rows: candidate (term, score) with its features."""
    return candidates.join(features, "term", "inner")


#: External features: 12 columns, three of them boolean (columns 5 to 7 of the file, counted from 0 with the term as column 0).
EXTERNAL_COLUMNS = [f"ext{i}" for i in range(1, 13)]
EXTERNAL_BOOLEAN = EXTERNAL_COLUMNS[4:7]


def external_schema() -> str:
    return "term string, " + ", ".join(f"{c} {'boolean' if c in EXTERNAL_BOOLEAN else 'double'}" for c in EXTERNAL_COLUMNS)


def train_with_external(rows: DataFrame, external: DataFrame) -> DataFrame:
    """J8, train side: rows whose term has external features, with these."""
    return rows.join(external, "term", "inner")


def predict_with_external(rows: DataFrame, external: DataFrame) -> DataFrame:
    """J8, predict side: every row with its external features; a term without any
    fails the query, as the original throws."""
    cols = [c for c in external.columns if c != "term"]
    x = rows.join(external.withColumn("_known", F.lit(True)), "term", "left")
    error = F.raise_error(F.concat(F.lit("candidate term without external features: "), F.col("term")))
    checked = F.when(F.col("_known").isNull(), error.cast(external.schema[cols[0]].dataType)).otherwise(F.col(cols[0]))
    return x.withColumn(cols[0], checked).drop("_known")


def choose(mode: str, positives: DataFrame, negatives: DataFrame, candidates: DataFrame, features: Callable[[DataFrame, str], DataFrame],
           external: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M3: the (train, predict) tables of ``filter`` or ``rank``.

    ``features(terms, mode)`` builds the lexical features.  ``filter``: double label,
    13 features.  ``rank``: int label, 9 features and the 12 external ones, without
    which a training word is left out and a candidate fails the query.
    """
    words = positives.select(F.col("word").alias("term")).unionByName(negatives.select(F.col("word").alias("term")))
    feats = features(words.unionByName(candidates.select("term")), mode)
    train, predict = training_rows(positives, negatives, feats, mode == "rank"), prediction_rows(candidates, feats)
    if mode == "filter":
        return train, predict
    if external is None:
        raise ValueError("rank needs external features")
    return train_with_external(train, external), predict_with_external(predict, external)
