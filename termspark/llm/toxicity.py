"""Toxicity by a linear-chain conditional random field over a document's words.

Labelled tokens.  Only documents carry labels, so tokens get theirs from them: a
word is a cue when it turns up in toxic documents far more often than in others.
A document counts once for a word, by the (word before, word) context of its first
occurrence, and each context once, so copies of a text do not add up; cues inside toxic documents are toxic tokens, all other tokens are not.

Model.  Two states; one emission weight for each cue and one for all other words,
four transition weights, fitted by maximum likelihood with an L2 penalty.  Forward
and backward passes give the marginal of the toxic state for each cue; a run of k
other words between cues is the k-th power of one 2x2 matrix, which has a closed
form, so the exact marginals cost as much as there are cues, not words.

Document score.  A logistic regression over the marginals (the greatest, their sum,
their sum per word), fitted on the same training documents.  The offending
offsets are the spans of the tokens whose marginal reaches ``span_at``.

Fitting takes at most about ``max_train`` labelled documents, chosen by the hash
of their ids; scoring takes every document.  Labels, language, source and ids are
no inputs of a score.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import bucket_below, crc_of_id, keep_rows, only, slices

#: Bound on the labelled documents that the model is fitted on.
MAX_TRAIN = 20_000
#: Words that are cues at most, their least association (G squared) and ratio of rates.
MAX_CUES, LEAST_G2, LEAST_LIFT = 2_000, 20.0, 4.0
WORD = rb"[a-z\x80-\xff]+"


@dataclass
class Model:
    cues: dict[bytes, int]   # word -> emission index, from 1
    emission: np.ndarray     # weight of the toxic state; index 0: all other words
    transition: np.ndarray   # 2x2 weights
    document: np.ndarray     # logistic regression over _features

    def parts(self) -> tuple:
        """What a broadcast carries: workers may not have this class's module."""
        return self.cues, self.emission, self.transition, self.document


def _power(m: np.ndarray):
    """k -> m^k up to a factor, for a positive 2x2 matrix."""
    values, vectors = np.linalg.eig(m)
    lead = int(np.argmax(values.real))
    v, inverse = vectors.real, np.linalg.inv(vectors.real)
    p, q = np.outer(v[:, lead], inverse[lead]), np.outer(v[:, 1 - lead], inverse[1 - lead])
    ratio = float(values.real[1 - lead] / values.real[lead])
    p, q = p.tolist(), q.tolist()

    def at(k: int):
        r = ratio ** k
        return [[p[i][j] + r * q[i][j] for j in (0, 1)] for i in (0, 1)]
    return at


class Tagger:
    """Marginals of the toxic state at the cues of a text."""

    def __init__(self, model: Model):
        self.model, self.find = model, re.compile(WORD)
        self.weight = [(1.0, math.exp(x)) for x in model.emission]
        # moving on to another word: transition, then its emission
        self.step = np.exp(model.transition).tolist()
        self.run = _power(np.exp(model.transition) * np.array([1.0, math.exp(model.emission[0])])[None, :])

    def cues(self, text: bytes | None) -> tuple[int, list[tuple[int, int]]]:
        """Number of words, and (place, emission index) of the cues."""
        if not text:
            return 0, []
        words, cues = self.find.findall(text.lower()), self.model.cues
        return len(words), [(i, cues[w]) for i, w in enumerate(words) if w in cues]

    def marginals(self, n: int, cues: list[tuple[int, int]]) -> list[float]:
        if not cues:
            return []
        forward, f, before = [], [1.0, 1.0], -1
        for i, c in cues:
            if i - before > 1:
                f = _row(f, self.run(i - before - 1)) if before >= 0 else _row(self._first(), self.run(i - 1))
            f = _row(f, self.step) if i else f
            f = _norm([f[0] * self.weight[c][0], f[1] * self.weight[c][1]])
            forward.append(f)
            before = i
        out, b, after = [], [1.0, 1.0], n
        for (i, c), f in zip(reversed(cues), reversed(forward)):
            if after - i > 1:
                b = _norm(_col(self.run(after - i - 1), b))
            one, zero = f[1] * b[1], f[0] * b[0]
            out.append(one / (one + zero))
            b = _norm(_col(self.step, [b[0] * self.weight[c][0], b[1] * self.weight[c][1]]))
            after = i
        return out[::-1]

    def _first(self) -> list[float]:
        return [self.weight[0][0], self.weight[0][1]]

    def spans(self, text: bytes, cues, marginals, least: float) -> list[dict]:
        """Code-point offsets of the cues whose marginal reaches ``least``."""
        want = {i: p for (i, _), p in zip(cues, marginals) if p >= least}
        out, at, points = [], 0, 0
        for i, m in enumerate(self.find.finditer(text.lower())) if want else ():
            if i in want:
                points += len(text[at:m.start()].decode("utf-8", "replace"))
                size = len(text[m.start():m.end()].decode("utf-8", "replace"))
                out.append({"start": points, "end": points + size, "p": want[i]})
                at, points = m.end(), points + size
        return out

    def score(self, n: int, marginals: list[float]) -> float:
        x = float(np.dot(self.model.document, _features(n, marginals)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _row(f, m):
    return _norm([f[0] * m[0][0] + f[1] * m[1][0], f[0] * m[0][1] + f[1] * m[1][1]])


def _col(m, b):
    return [m[0][0] * b[0] + m[0][1] * b[1], m[1][0] * b[0] + m[1][1] * b[1]]


def _norm(x):
    s = x[0] + x[1]
    return [max(x[0] / s, 0.0), max(x[1] / s, 0.0)]


def _features(n: int, marginals: list[float]) -> list[float]:
    """Constant; the surest cue and all cues together, in log-odds; the expected number
    of toxic words, and their share."""
    odds = [max(-4.0, min(12.0, math.log(p + 1e-9) - math.log(1 - p + 1e-9))) for p in marginals]
    total = sum(marginals)
    return [1.0, max(odds, default=-4.0) / 4, math.log1p(sum(max(o, 0.0) for o in odds)), math.log1p(total), min(1.0, 10 * total / max(n, 1))]


def _fit_chain(windows: list[tuple[list[int], list[int]]], cues: int, l2: float = 0.05, rounds: int = 120):
    """Emission and transition weights from (emission indexes, states) windows."""
    emission, transition = np.zeros(cues + 1), np.zeros((2, 2))
    emission[0] = -3.0
    if not windows:
        return emission, transition
    size = max(len(x) for x, _ in windows)
    x, y = np.zeros((len(windows), size), np.int64), np.zeros((len(windows), size), np.int64)
    on = np.zeros((len(windows), size), bool)
    for i, (a, b) in enumerate(windows):
        x[i, :len(a)], y[i, :len(a)], on[i, :len(a)] = a, b, True
    pair_on = on[:, 1:]
    seen_e = np.bincount(x[on], weights=y[on], minlength=cues + 1)
    seen_t = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair_on).sum() for j in (0, 1)] for i in (0, 1)], float)
    params = np.concatenate([emission, transition.ravel()])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        e, a = params[:cues + 1], np.exp(params[cues + 1:].reshape(2, 2))
        w = np.stack([np.ones(x.shape), np.exp(np.clip(e[x], -30, 30))], -1)
        f = np.empty(w.shape)
        f[:, 0] = w[:, 0] / w[:, 0].sum(-1, keepdims=True)
        for k in range(1, size):
            g = (f[:, k - 1] @ a) * w[:, k]
            f[:, k] = np.where(on[:, k, None], g / g.sum(-1, keepdims=True), f[:, k - 1])
        b, expect_e, expect_t = np.ones((len(x), 2)), np.zeros(cues + 1), np.zeros((2, 2))
        for k in range(size - 1, -1, -1):
            m = f[:, k] * b
            m /= m.sum(-1, keepdims=True)
            expect_e += np.bincount(x[:, k], weights=m[:, 1] * on[:, k], minlength=cues + 1)
            if k:
                wb = w[:, k] * b
                joint = f[:, k - 1, :, None] * a[None] * wb[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                expect_t += (joint * on[:, k, None, None]).sum(0)
                nb = wb @ a.T
                b = np.where(on[:, k, None], nb / nb.sum(-1, keepdims=True), b)
        slope = np.concatenate([seen_e - expect_e, (seen_t - expect_t).ravel()]) / len(x) - l2 * params / len(x)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        params = params + 0.25 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-9)
    return params[:cues + 1], params[cues + 1:].reshape(2, 2)


def _fit_documents(x: np.ndarray, y: np.ndarray, l2: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def _windows(n: int, cues: list[tuple[int, int]], toxic: int, side: int = 2, gap: int = 5):
    """Runs of cues that lie near each other, with some of the words around."""
    lo = 0
    for k in range(1, len(cues) + 1):
        if k < len(cues) and cues[k][0] - cues[k - 1][0] <= gap and k - lo < 16:
            continue
        start, stop = max(0, cues[lo][0] - side), min(n, cues[k - 1][0] + side + 1)
        x = [0] * (stop - start)
        for i, c in cues[lo:k]:
            x[i - start] = c
        yield x, [int(bool(c) and toxic) for c in x]
        lo = k


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Fits the model on labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    Labels that are null or not 0 or 1, and labels that contradict each other for
    one id, are left out; labels of unknown documents count nothing.  Without any
    usable label every document gets the score 0.5.
    """
    spark = docs.sparkSession
    marks = (only(labels, doc_id, label).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
             .where("id is not null and y in (0, 1)").where(F.pmod(crc_of_id("id"), F.lit(3)) != 1)
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z"))
    some = marks.where(bucket_below(F.col("id"), max_train, marks.count()))
    # about max_train rows
    train = only(docs, doc_id, text).select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t")) \
        .join(F.broadcast(some), "id").select("t", "y")

    def contexts(batches):
        find = re.compile(WORD)
        for b in slices(batches, 1024):
            got = set()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = find.findall((t or b"").lower())
                first = dict(zip(reversed(words), reversed([b""] + words[:-1])))  # each word's first context in the text
                got.update((before, w, y) for w, before in first.items())
            cols = list(zip(*got)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.int32())], ["before", "word", "y"])

    seen = (train.mapInArrow(contexts, "before binary, word binary, y int").distinct()
            .groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).persist())
    sums = seen.agg(F.sum("a"), F.sum("b")).first()
    ta, tb = float(sums[0] or 0), float(sums[1] or 0)
    if ta and tb:
        rate = ta / (ta + tb)
        a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
        g2 = 2 * (F.when(a > 0, a * F.log(a / (n * rate))).otherwise(0) + F.when(b > 0, b * F.log(b / (n * (1 - rate)))).otherwise(0))
        lift = ((a + 0.5) / (ta + 1)) / ((b + 0.5) / (tb + 1))
        rows = (seen.withColumn("g", g2).where((F.col("g") >= LEAST_G2) & (lift >= LEAST_LIFT))
                .orderBy(F.desc("g"), "word").limit(MAX_CUES).collect())
    else:
        rows = []
    seen.unpersist()
    cues = {bytes(r["word"]): i + 1 for i, r in enumerate(rows)}
    sent = spark.sparkContext.broadcast(cues)

    def found(batches):
        tagger = Tagger(Model(sent.value, np.zeros(len(sent.value) + 1), np.zeros((2, 2)), np.zeros(5)))
        for b in slices(batches):
            out = [(y, *tagger.cues(t)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([[i for i, _ in o[2]] for o in out], pa.list_(pa.int32())),
                pa.array([[c for _, c in o[2]] for o in out], pa.list_(pa.int32()))], ["y", "n", "at", "cue"])

    hits = train.mapInArrow(found, "y int, n long, at array<int>, cue array<int>").collect()  # about max_train rows
    hits = sorted((r["y"], r["n"], tuple(zip(r["at"], r["cue"]))) for r in hits)
    emission, transition = _fit_chain([w for y, n, c in hits for w in _windows(n, list(c), y)], len(cues))
    model = Model(cues, emission, transition, np.zeros(5))
    tagger = Tagger(model)
    if hits:
        x = np.array([_features(n, tagger.marginals(n, list(c))) for _, n, c in hits])
        model.document = _fit_documents(x, np.array([h[0] for h in hits], float))
    return model


def tag(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", span_at: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): one row per document row.

    spans are the offending words (start, end, p) in code points, end exclusive.
    A null or empty text has no spans and the score of a text without cues; a
    null id stays null; other columns are left aside.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        tagger = Tagger(Model(*sent.value))
        for b in slices(batches):
            scores, spans = [], []
            for t in b.column(1).to_pylist():
                n, cues = tagger.cues(t)
                p = tagger.marginals(n, cues)
                scores.append(tagger.score(n, p))
                spans.append(tagger.spans(t, cues, p, span_at) if cues else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)],
                                             ["doc_id", "score", "spans"])

    return only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")) \
        .mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")


def keep_clean(docs: DataFrame, model: Model, *, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``least``.

    A null or empty text has the score of a text without cues; repeated rows are judged
    each for itself and alike; columns may have any name, also one that occurs twice; an
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def start():
        tagger = Tagger(Model(*sent.value))

        def keep(texts):
            return [tagger.score(n, tagger.marginals(n, c)) < least for n, c in map(tagger.cues, texts)]
        return keep

    return keep_rows(docs, text, start)
