"""Language-model scores from an Elias-Fano n-gram trie spread over the cluster.

The model has n-grams up to ``order`` words with Dirichlet smoothing:

    p(w | uv) = c(uvw) / (c(uv) + mu)  +  mu / (c(uv) + mu) * p(w | v)
    p1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))

It sums to one over the vocabulary and one unknown word.  The first term is what
the trie holds, quantised; the second comes from the level below.  A text's first
word has the start as its only context.

Neither the vocabulary nor the trie has to fit into one machine.  Documents are
packed once into batches (word hashes, a stream of local word numbers).  A batch
asks the shard of each of its distinct words, and then, level by level, the shard of
each of its distinct n-grams (context, word), in one compact message for each shard; a
shard answers with the number of the n-gram, which is the context of the next level.  It adds up what the
training documents counted, builds its part of the trie, answers every batch by
trie lookups, and forgets it.  So everything that crosses the network is counted
per batch beforehand, and a word or word pair that is everywhere costs one entry a
batch.  N-grams of a frequent context are dealt out by context and word, all others
by the context, so no context is held by one task that a task cannot hold; every batch
knows from the shards' answers how often a context is there, so no list of the
frequent ones is needed.  Batches and answers lie by batch in the shared folder, where each
level reads them without moving them.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import WordHash, crc_of_id, delta, doc_words, lay_out, mix64, only, pack_ints, slices, unpack_ints
from termspark.llm.trie import ABSENT, STEPS, Trie

#: Tokens of a batch; words and n-grams of a shard (before summing up).
BATCH_TOKENS, SHARD_WORDS, SHARD_PAIRS = 1_000_000, 1_500_000, 1_500_000
#: Bytes of text whose batches lie in one place.
BUCKET_BYTES = 48 << 20
#: Weight of the unigram model, in tokens.
MU = 20.0
# Reserved words: none of them can occur, for they hold white space.
END, START = b" ", b"\n"


_PACKED = "batch long, docs int, tokens long, train_docs long, train_tokens long, words long, " \
          "ids binary, known_ids binary, held binary, sizes binary, stream binary, hashes binary, counts binary"


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Documents as batches of about ``batch_tokens`` tokens: distinct word hashes in
    order of their first use, a stream of numbers into them (each text followed by the
    end token), and how often each occurs in training documents."""

    def run(batches):
        from itertools import chain

        from pyspark import TaskContext

        part, no, seen = TaskContext.get().partitionId(), 0, WordHash()

        def close(ids, held, texts):
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            local: dict[bytes, int] = {}
            number = local.setdefault
            stream = np.fromiter((number(w, len(local)) for w in chain.from_iterable((*t, END) for t in texts)), np.uint32, int(sizes.sum()))
            hashes = np.fromiter(map(seen.__getitem__, local), np.uint64, len(local))
            train = ~np.array(held, bool)
            counts = np.bincount(stream[np.repeat(train, sizes)], minlength=len(local))
            known = np.array([i is not None for i in ids], np.uint8)
            row = [part << 24 | no, len(ids), len(stream), int(train.sum()), int(counts.sum()), len(local),
                   pack_ints(np.array([i or 0 for i in ids], np.int64)), known.tobytes(), np.array(held, np.uint8).tobytes(),
                   pack_ints(sizes), pack_ints(stream), hashes.tobytes(), pack_ints(counts.astype(np.uint32))]
            types = [pa.int64(), pa.int32()] + [pa.int64()] * 4 + [pa.binary()] * 7
            names = [c.split()[0] for c in _PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        ids, held, texts, size = [], [], [], 0
        for b in slices(batches):
            for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids.append(i)
                held.append(h)
                texts.append(doc_words(t))
                size += len(texts[-1]) + 1
                if size >= batch_tokens:
                    yield close(ids, held, texts)
                    ids, held, texts, size, no = [], [], [], 0, no + 1
        if ids:
            yield close(ids, held, texts)

    rows = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("i"), (F.pmod(crc_of_id(doc_id), F.lit(10)) == 0).alias("h"),
                                           F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, _PACKED)


def _hash_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(h) % np.uint64(shards)).astype(np.int64)


def _cuts(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


def vocabulary(packed: DataFrame, shards: int) -> DataFrame:
    """What the shards answer to each batch about its words, in the batch's order by
    (shard, hash): ``ids`` (frequent words have small ones) and training ``counts``; each
    shard says in its first answer how many words ``v`` it knows."""

    def ask(batches):
        for b in batches:
            for batch, h, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                h, c = np.frombuffer(h, np.uint64), unpack_ints(c, np.uint32)
                s = _hash_shard(h, shards)
                order = np.lexsort((h, s))
                cut = _cuts(s[order], shards)
                parts = [(k, order[x:y]) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in parts], pa.int32()), pa.array([batch] * len(parts), pa.int64()),
                    pa.array([h[o].tobytes() for _, o in parts], pa.binary()), pa.array([pack_ints(c[o]) for _, o in parts], pa.binary())],
                    ["shard", "batch", "hashes", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        shard, batch = t.column("shard")[0].as_py(), t.column("batch").to_pylist()
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        counts = np.concatenate([unpack_ints(x, np.uint32) for x in t.column("counts").to_pylist()])
        word, inv = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inv, weights=counts, minlength=len(word)).astype(np.int64)
        rank = np.empty(len(word), np.int64)
        rank[np.lexsort((word, -total))] = np.arange(len(word))
        ids = rank * shards + shard
        ends = np.cumsum([0] + [len(h) for h in hashes])
        mine = [inv[x:y] for x, y in zip(ends, ends[1:])]
        return pa.table({
            "batch": pa.array(batch, pa.int64()), "shard": pa.array([shard] * len(batch), pa.int32()),
            "ids": pa.array([pack_ints(ids[m]) for m in mine], pa.binary()), "counts": pa.array([pack_ints(total[m]) for m in mine], pa.binary()),
            "v": pa.array([int((total > 0).sum())] + [0] * (len(batch) - 1), pa.int64())})

    asked = packed.select("batch", "hashes", "counts").mapInArrow(ask, "shard int, batch long, hashes binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, shard int, ids binary, counts binary, v long")


class _Level:
    """The n-grams of one length in a batch: positions ``at`` in its stream, number of the
    n-gram at each (``inverse``), and of each distinct one the context (``back``) and word."""

    def __init__(self, at: np.ndarray, context: np.ndarray, stream: np.ndarray, n: int):
        self.at = at
        grams, self.inverse = np.unique(context * n + stream[at], return_inverse=True)
        self.back, self.word = grams // n, grams % n
        self.ids = self.counts = self.codes = None


class _Batch:
    """A packed batch with what the shards said about its words and n-grams: ``levels``
    of 2 to ``order`` words, of which the last may still be without answers."""

    def __init__(self, row: dict, replies: list[dict], shards: int, pair_shards: int, hot_above: int, train_docs: int, order: int):
        replies = sorted(replies, key=lambda r: r["shard"])

        def said(level, col, kind):
            got = [unpack_ints(r[col], kind) for r in replies if r["level"] == level and r[col] is not None]
            return np.concatenate([np.empty(0, kind), *got])

        h = np.frombuffer(row["hashes"], np.uint64)
        by = np.lexsort((h, _hash_shard(h, shards)))
        self.gid, self.count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        self.gid[by], self.count[by] = said(1, "ids", np.int64), said(1, "counts", np.int64)
        self.stream = unpack_ints(row["stream"], np.uint32).astype(np.int64)
        self.sizes = unpack_ints(row["sizes"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        n = len(h)
        place = np.arange(len(self.stream)) - np.repeat(self.first, self.sizes)
        before = np.roll(self.stream, 1)  # local number of the context; n: start of a text
        before[self.first] = n
        # the start has id 0 (all others are moved up by one), so it is a context like any other
        context_id, context_count = np.append(self.gid + 1, 0), np.append(self.count, train_docs)
        self.levels = []
        for k in range(2, order + 1):
            if k == 2:
                g = _Level(np.arange(len(self.stream)), before, self.stream, n)
            else:  # a context that training did not have leaves the level below as it is
                last = self.levels[-1]
                number = np.full(len(self.stream), -1)
                number[last.at] = np.where(last.counts > 0, np.arange(len(last.counts)), -1)[last.inverse]
                at = np.flatnonzero((place >= k - 2) & (np.roll(number, 1) >= 0))
                g = _Level(at, number[at - 1], self.stream, n)
                context_id, context_count = last.ids, last.counts
            self.levels.append(g)
            g.u, g.w = context_id[g.back], self.gid[g.word]
            # contexts that training has very often: every batch knows their count from the shards
            count = context_count[g.back]
            g.often = np.where(count > hot_above, count, 0)
            g.order, g.cut = _pair_order(g.u, g.w, g.often > 0, pair_shards)
            for name, kind in (("codes", np.uint16), ("counts", np.int64), ("ids", np.int64)):
                got = said(k, name, kind)
                if len(got) == len(g.order):
                    value = np.empty(len(got), kind)
                    value[g.order] = got
                    setattr(g, name, value)


def _by_pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Order of pairs of non-negative numbers by (u, w); as one number a pair, where it fits."""
    width = int(w.max(initial=0)) + 1
    if (int(u.max(initial=0)) + 1) * width >= 1 << 63:
        return np.lexsort((w, u))
    return np.argsort(u * width + w)


def _pair_order(u: np.ndarray, w: np.ndarray, often: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs by (shard, u, w), and the shards' cuts in it; a pair whose context is
    there ``often`` goes by context and word."""
    mixed = u.astype(np.uint64)
    mixed[often] = mix64(mixed[often]) ^ w[often].astype(np.uint64)
    s = _hash_shard(mixed, shards)
    order = _by_pair(u, w)
    # a stable sort of 16-bit numbers takes one pass
    order = order[np.argsort(s[order].astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")]
    return order, _cuts(s[order], shards)


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mu: float = MU, batch_tokens: int = BATCH_TOKENS,
          shard_words: int = SHARD_WORDS, shard_pairs: int = SHARD_PAIRS, order: int = 2) -> DataFrame:
    """One row per document row: (doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score).

    The model is trained on all documents whose crc32(doc_id as text) mod 10 is not 0
    (a null id counts as the empty text) and scores every document, whole.  Tokens are
    the words (A-Z lower-cased, runs without white space) and one end; a null or
    blank text has the end alone.  n_known counts tokens seen in training,
    train_tokens all training tokens N; base_score is the log10 probability under
    p1, score under the model of ``order`` words (2 or more).  Words are told apart by 64-bit hashes.  Other
    columns are left aside; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # what belongs to a batch lies by batch, so that no level moves it again
    bytes_ = only(docs, text).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES))
    packed = lay_out(pack(docs, doc_id=doc_id, text=text, batch_tokens=batch_tokens), "batch", buckets)
    size = packed.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "words", "train_docs", "train_tokens")]).first()
    total, train_docs = size["train_tokens"], size["train_docs"]
    word_shards, pair_shards = max(16, -(-size["words"] // shard_words)), max(16, -(-size["tokens"] // shard_pairs))
    hot_above = max(1, size["tokens"] // (8 * pair_shards))
    # the answers of all levels are one table, so that no level deals out those before it
    cols, place = ["batch", "shard", "level", "ids", "counts", "codes"], f"laid_out_{uuid.uuid4().hex}"
    words = vocabulary(packed, word_shards).withColumns({"level": F.lit(1), "codes": F.lit(None).cast("binary")})
    replies = lay_out(words.select(*cols, "v"), "batch", buckets, place)
    known = replies.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]

    def asker(level):
        def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
            u_, w_, c_, o_, s_, b_ = [], [], [], [], [], []
            rows = right.to_pylist()
            for row in left.to_pylist():
                b = _Batch(row, rows, word_shards, pair_shards, hot_above, train_docs, level)
                g = b.levels[-1]
                seen = np.bincount(g.inverse, weights=np.repeat(~b.held, b.sizes)[g.at], minlength=len(g.u)).astype(np.uint32)
                for k, (x, y) in enumerate(zip(g.cut, g.cut[1:])):
                    if y > x:
                        o = g.order[x:y]
                        s_.append(k)
                        b_.append(row["batch"])
                        u_.append(pack_ints(delta(g.u[o])))
                        w_.append(pack_ints(g.w[o]))
                        c_.append(pack_ints(seen[o]))
                        o_.append(pack_ints(g.often[o]))
            return pa.table({"shard": pa.array(s_, pa.int32()), "batch": pa.array(b_, pa.int64()), "u": pa.array(u_, pa.binary()),
                             "w": pa.array(w_, pa.binary()), "c": pa.array(c_, pa.binary()), "often": pa.array(o_, pa.binary())})
        return ask

    def answerer(level):
        def answer(t: pa.Table) -> pa.Table:
            t = t.sort_by("batch")
            shard = t.column("shard")[0].as_py()
            us = [np.cumsum(unpack_ints(x, np.int64)) for x in t.column("u").to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in us])
            u = np.concatenate(us)
            w = np.concatenate([unpack_ints(x, np.int64) for x in t.column("w").to_pylist()])
            c = np.concatenate([unpack_ints(x, np.uint32) for x in t.column("c").to_pylist()])
            del us
            # one sort of all pairs by (context, word): the batches' pairs come as sorted runs
            by = _by_pair(u, w)
            su, sw = u[by], w[by]
            new_u = np.append(True, su[1:] != su[:-1])[:len(su)]
            new = new_u.copy()
            new[1:] |= sw[1:] != sw[:-1]
            first = np.flatnonzero(new)
            inv = np.empty(len(u), np.int64)
            inv[by] = np.cumsum(new) - 1
            c = np.add.reduceat(c[by].astype(np.int64), first)
            ku, kw, context = su[first], sw[first], np.cumsum(new_u[first]) - 1
            per = np.bincount(context, weights=c)
            often = np.concatenate([unpack_ints(x, np.int64) for x in t.column("often").to_pylist()])
            some = np.flatnonzero(often > 0)
            per[context[inv[some]]] = often[some]  # of a frequent context this shard has a part
            del by, su, sw, new_u, new, often
            have = c > 0
            trie = Trie.from_buffer(Trie.build(ku[have], kw[have], c[have] / (per[context[have]] + mu)).to_bytes())
            codes = trie.lookup(ku, kw)[inv]
            parts = list(zip(ends, ends[1:]))
            out = {"batch": t.column("batch").to_pylist(), "ids": [None] * len(parts), "counts": [None] * len(parts),
                   "codes": [pack_ints(codes[x:y]) for x, y in parts]}
            if level < order:  # the next level's contexts, numbered in the order of the shard's trie
                ids = np.arange(len(ku)) * pair_shards + shard
                out |= {"ids": [pack_ints(ids[inv[x:y]]) for x, y in parts], "counts": [pack_ints(c[inv[x:y]]) for x, y in parts]}
            return pa.table({"batch": pa.array(out["batch"], pa.int64()), "shard": pa.array([shard] * len(out["batch"]), pa.int32()),
                             "level": pa.array([level] * len(out["batch"]), pa.int32()),
                             **{k: pa.array(out[k], pa.binary()) for k in ("ids", "counts", "codes")}})
        return answer

    for level in range(2, order + 1):
        asked = packed.groupBy("batch").cogroup(replies.select(*cols).groupBy("batch")).applyInArrow(
            asker(level), "shard int, batch long, u binary, w binary, c binary, often binary")
        said = asked.groupBy("shard").applyInArrow(answerer(level), "batch long, shard int, level int, ids binary, counts binary, codes binary")
        replies = lay_out(said.select(*cols, F.lit(0).cast("long").alias("v")), "batch", buckets, place, replies)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        out = []
        for row in left.to_pylist():
            b = _Batch(row, rows, word_shards, pair_shards, hot_above, train_docs, order)
            p1 = (b.count + 0.1) / (total + 0.1 * (known + 1))
            p, seen = p1[b.stream], np.append(b.count, train_docs)  # training count of each context
            for g in b.levels:
                back = mu / (seen + mu)
                high = np.where(g.codes == ABSENT, 0.0, 10.0 ** (-g.codes.astype(float) / STEPS))
                p[g.at] = high[g.inverse] + back[g.back][g.inverse] * p[g.at]
                seen = g.counts
            starts = b.first
            out.append(pa.table({
                "doc_id": pa.array(np.where(np.frombuffer(row["known_ids"], np.uint8) > 0, unpack_ints(row["ids"], np.int64), 0), pa.int64(),
                                   mask=np.frombuffer(row["known_ids"], np.uint8) == 0),
                "held_out": pa.array(b.held), "n_tokens": pa.array(b.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((b.count > 0)[b.stream].astype(np.int64), starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(b.sizes), total), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(p1)[b.stream], starts), pa.float64()),
                "score": pa.array(np.add.reduceat(np.log10(p), starts), pa.float64())}))
        return pa.concat_tables(out)

    return packed.groupBy("batch").cogroup(replies.select(*cols).groupBy("batch")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
