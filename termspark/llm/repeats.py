"""Substring dedup: spans of words that stood earlier go.

A window is ``window`` consecutive words of one document.  A word goes when a window
that covers it has the words of a window that starts earlier (in a document with a
smaller id, or before it in the same one).

The reference of this search is the corpus itself, so it comes in shards, each a
suffix automaton over words.  A shard that were broadcast to every document would make
the work documents x shards, which grows with the square of the corpus; so a shard
meets only the pieces of documents that can match it:

1. ``ask``: every window has an anchor, its ``anchor``-gram with the smallest hash.  Equal
   windows have equal anchors, and some six neighbouring windows share theirs.  Anchors
   that occur once in the corpus settle their windows: they are unique.
2. ``offer``: windows of a repeated anchor that stand side by side make a piece.  Pieces
   go to the shard of their anchor; of equal pieces in a batch only the first, the rest is
   removed whatever the shard says.  An anchor with more than ``hot`` occurrences
   is dealt out by its windows instead, each a piece of its own, so that no common
   passage fills a shard.
3. ``judge``: a shard streams its pieces in the order of the corpus through its automaton.
   Where the matching statistics reach the window length, the window stood earlier; what
   is new in a piece is then added to the automaton.
4. ``spans``: the windows found join into maximal spans, which are removed.

Documents are packed once into batches; everything that crosses the network is
counted per batch beforehand.  Between two of these steps a batch or a shard is one
row or group, of a size that does not grow with the corpus.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.automaton import SuffixAutomaton
from termspark.llm.common import WordHash, delta, materialize, mix64, only, pack_bytes, pack_ints, slices, unpack_bytes, unpack_ints

#: Words of a window, words of an anchor (a mask of 16 bits holds the windows of a piece).
WINDOW, ANCHOR = 20, 10
#: Words of a batch; anchors asked of a shard; words of pieces in a shard; occurrences of an anchor dealt out whole.
BATCH_WORDS, SHARD_KEYS, SHARD_WORDS, HOT = 1_000_000, 2_000_000, 300_000, 5_000
#: Place of a null id: after all others.
LAST = np.iinfo(np.int64).max

_PACKED = "batch long, words long, ids binary, known binary, sizes binary, vocabulary binary, stream binary"


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batch_words: int = BATCH_WORDS) -> DataFrame:
    """Documents as batches of about ``batch_words`` words, in the order of their ids:
    distinct words in order of their first use and a stream of numbers into them."""

    def run(batches):
        from itertools import chain

        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0

        def close(rows):
            rows.sort(key=lambda r: LAST if r[0] is None else r[0])
            sizes = np.array([len(r[1]) for r in rows], np.int64)
            local: dict[bytes, int] = {}
            number = local.setdefault
            stream = np.fromiter((number(w, len(local)) for w in chain.from_iterable(r[1] for r in rows)), np.uint32, int(sizes.sum()))
            values = [part << 24 | no, len(stream), pack_ints(np.array([r[0] or 0 for r in rows], np.int64)),
                      np.array([r[0] is not None for r in rows], np.uint8).tobytes(), pack_ints(sizes),
                      pack_bytes(b" ".join(local)), pack_ints(stream)]
            types = [pa.int64()] * 2 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], [c.split()[0] for c in _PACKED.split(", ")])

        rows, size = [], 0
        for b in slices(batches):
            for i, t in zip(*(b.column(k).to_pylist() for k in range(2))):
                rows.append((i, t.split() if t else []))
                size += len(rows[-1][1])
                if size >= batch_words:
                    yield close(rows)
                    rows, size, no = [], 0, no + 1
        if rows:
            yield close(rows)

    return only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t")).mapInArrow(run, _PACKED)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a stream of word hashes."""
    acc = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        acc *= np.uint64(0x9FB21C651E98DF25)
        acc += h[i:len(acc) + i]
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


class Batch:
    """A packed batch: word hashes, windows, anchors and the pieces they make."""

    def __init__(self, row: dict, seen: WordHash, window: int, anchor: int):
        raw = unpack_bytes(row["vocabulary"])
        self.id, self.vocabulary = row["batch"], raw.split(b" ") if raw else []
        self.stream = unpack_ints(row["stream"], np.uint32)
        self.sizes = unpack_ints(row["sizes"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8) > 0
        self.ids = np.where(self.known, unpack_ints(row["ids"], np.int64), LAST)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.window = window
        self.hashes = np.fromiter(map(seen.__getitem__, self.vocabulary), np.uint64, len(self.vocabulary))[self.stream]
        self.whole = _grams(self.hashes, window)
        left = np.repeat(self.first + self.sizes, self.sizes) - np.arange(len(self.stream))  # words from here to the document's end
        ok = left[:len(self.whole)] >= window
        grams = _grams(self.hashes, anchor)
        best, at = grams[:len(self.whole)].copy(), np.arange(len(self.whole))
        for d in range(1, window - anchor + 1):
            other = grams[d:d + len(best)]
            less = other < best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + d
        starts = np.flatnonzero(ok)
        run = np.flatnonzero(np.concatenate(([True], (np.diff(at[starts]) != 0) | (np.diff(starts) != 1)))) if len(starts) else starts
        self.start = starts[run]  # of each piece in the stream
        self.count = np.diff(np.append(run, len(starts)))  # windows of it
        self.key = best[self.start]

    def asked(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, how often each, their order by (shard, anchor) and the shards' cuts in it."""
        keys, self.inverse, n = np.unique(self.key, return_inverse=True, return_counts=True)
        shard = keys % np.uint64(shards)
        order = np.lexsort((keys, shard))
        return keys, n, order, np.searchsorted(shard[order], np.arange(shards + 1))

    def offered(self, codes: np.ndarray, shards: int):
        """By what the shards said about each distinct anchor (0 once, 1 repeated, 2 hot):
        the pieces to compare as (start, windows), which of them are the first of their
        content here, their order by (shard, start), and the shards' cuts."""
        code = codes[self.inverse]
        hot = np.flatnonzero(code == 2)
        alone = np.repeat(self.start[hot], self.count[hot]) + (np.arange(self.count[hot].sum()) - np.repeat(np.cumsum(self.count[hot]) - self.count[hot], self.count[hot]))
        some = code == 1
        start = np.concatenate((self.start[some], alone))
        count = np.concatenate((self.count[some], np.ones(len(alone), np.int64)))
        key = np.concatenate((self.key[some], self.whole[alone]))
        by = np.argsort(start, kind="stable")
        start, count, key = start[by], count[by], key[by]
        content = mix64(self.whole[start] ^ mix64(self.whole[start + count - 1] + count.astype(np.uint64)))
        first = np.zeros(len(start), bool)
        first[np.unique(content, return_index=True)[1]] = True
        sent = np.flatnonzero(first)
        shard = mix64(key[sent]) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        return start, count, first, sent[order], np.searchsorted(shard[order], np.arange(shards + 1))


def judge(pieces: list[tuple], window: int) -> list[int]:
    """For pieces (words, windows) in the order of the corpus, the mask of the windows
    whose words stood earlier, bit by bit from the first."""
    known, out = SuffixAutomaton(), []
    for words, n in pieces:
        reach = known.matching(words)
        fresh = [j for j in range(n) if reach[j + window - 1] < window]
        mask = (1 << n) - 1
        if fresh:
            known.add(words[fresh[0]:fresh[-1] + window])
            own = set()
            for j in range(n):
                w = tuple(words[j:j + window])
                if reach[j + window - 1] < window and w not in own:
                    mask ^= 1 << j
                own.add(w)
        out.append(mask)
    return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   batch_words: int = BATCH_WORDS, shard_keys: int = SHARD_KEYS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """One row per document row: (doc_id, n_words, n_removed, kept, removed): the words that
    stay, joined by one space, and the removed spans as word numbers (start, end
    exclusive).

    Words are runs of anything but the six ASCII white-space characters, unchanged, and
    are told apart by 64-bit hashes.  Windows are judged on the input, not on what is
    left.  A null or blank text has no words and keeps the empty text; a text shorter than
    the window keeps all.  A null id counts as later than all others.  Rows with the same
    id have no order of their own: they count in the order in which they are read, so of
    equal rows one stays whole.  Other columns are left aside; an empty table gives no rows.
    """
    if not anchor <= window <= anchor + 15:
        raise ValueError("a piece has at most 16 windows: anchor <= window <= anchor + 15")
    packed = materialize(pack(docs, doc_id=doc_id, text=text, batch_words=batch_words))
    size = packed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    key_shards = max(8, -(-size // (6 * shard_keys)))

    def ask(batches):
        seen = WordHash()
        for t in batches:
            for row in t.to_pylist():
                b = Batch(row, seen, window, anchor)
                keys, n, order, cut = b.asked(key_shards)
                parts = [(k, order[x:y]) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in parts], pa.int32()), pa.array([b.id] * len(parts), pa.int64()),
                    pa.array([pack_ints(delta(keys[o])) for _, o in parts], pa.binary()), pa.array([pack_ints(n[o].astype(np.uint32)) for _, o in parts], pa.binary())],
                    ["shard", "batch", "keys", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack_ints(x, np.uint64)) for x in t.column("keys").to_pylist()]
        ends = np.cumsum([0] + [len(k) for k in keys])
        n = np.concatenate([unpack_ints(x, np.uint32) for x in t.column("counts").to_pylist()])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(key))
        code = ((total > 1).astype(np.uint8) + (total > hot))[inverse]
        return pa.table({"batch": t.column("batch").cast(pa.int64()), "shard": t.column("shard").cast(pa.int32()),
                         "codes": pa.array([pack_ints(code[x:y]) for x, y in zip(ends, ends[1:])], pa.binary()),
                         "repeated": pa.array([int(n[x:y][code[x:y] > 0].sum()) for x, y in zip(ends, ends[1:])], pa.int64())})

    codes = packed.mapInArrow(ask, "shard int, batch long, keys binary, counts binary").groupBy("shard").applyInArrow(
        answer, "batch long, shard int, codes binary, repeated long")
    codes = materialize(codes)
    repeated = codes.agg(F.coalesce(F.sum("repeated"), F.lit(0))).first()[0]
    shards = max(8, -(-repeated * (window + 5) // shard_words))

    def said(b: Batch, rows: list[dict]):
        """The batch's pieces to compare, by its answers."""
        rows = sorted((r for r in rows if r["codes"] is not None), key=lambda r: r["shard"])
        keys, _, order, _ = b.asked(key_shards)
        value = np.zeros(len(keys), np.uint8)
        if rows:
            value[order] = np.concatenate([unpack_ints(r["codes"], np.uint8) for r in rows])
        return b.offered(value, shards)

    def offer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], right.to_pylist()
        for row in left.to_pylist():
            b = Batch(row, WordHash(), window, anchor)
            start, count, _, order, cut = said(b, rows)
            doc = np.searchsorted(b.first, start, side="right") - 1
            for k, (x, y) in enumerate(zip(cut, cut[1:])):
                if y == x:
                    continue
                o = order[x:y]
                long = count[o] + window - 1
                at = np.repeat(start[o], long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                words, index = np.unique(b.hashes[at], return_inverse=True)
                out.append((k, b.id, pack_ints(b.ids[doc[o]]), pack_ints(start[o]), pack_ints(count[o].astype(np.uint8)),
                            words.tobytes(), pack_ints(index.astype(np.uint32))))
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "batch", "ids", "start", "count", "words", "index"])

    def decide(t: pa.Table) -> pa.Table:
        batches, parts = t.column("batch").to_pylist(), []
        words = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        number = np.unique(np.concatenate(words), return_inverse=True)[1]
        ends = np.cumsum([0] + [len(w) for w in words])
        for i, (index, ids, start, count) in enumerate(zip(*(t.column(c).to_pylist() for c in ("index", "ids", "start", "count")))):
            parts.append((number[ends[i]:ends[i + 1]][unpack_ints(index, np.uint32)], unpack_ints(ids, np.int64), unpack_ints(start, np.int64),
                          unpack_ints(count, np.uint8).astype(np.int64)))
        flat = np.concatenate([p[0] for p in parts])
        ids, start, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        batch = np.repeat(np.array(batches, np.int64), [len(p[1]) for p in parts])
        stop = np.cumsum(count + window - 1)
        order = np.lexsort((start, batch, ids))
        masks = np.empty(len(order), np.uint16)
        masks[order] = judge([(flat[stop[i] - count[i] - window + 1:stop[i]].tolist(), int(count[i])) for i in order], window)
        cut = np.cumsum([0] + [len(p[1]) for p in parts])
        return pa.table({"batch": pa.array(batches, pa.int64()), "shard": t.column("shard").cast(pa.int32()),
                         "masks": pa.array([pack_ints(masks[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())})

    def spans(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], right.to_pylist()
        for row in left.to_pylist():
            b = Batch(row, WordHash(), window, anchor)
            start, count, first, order, _ = said(b, rows)
            mask = np.full(len(start), 0xFFFF, np.uint16)
            replies = sorted((r for r in rows if r["masks"] is not None), key=lambda r: r["shard"])
            if replies:
                mask[order] = np.concatenate([unpack_ints(r["masks"], np.uint16) for r in replies])
            edge = np.zeros(len(b.stream) + 1, np.int64)
            for j in range(window - anchor + 1):
                gone = start[(count > j) & (mask >> j & 1 > 0)] + j
                edge[gone] += 1
                edge[gone + window] -= 1
            cover = np.cumsum(edge)[:-1] > 0
            kept, removed, n = [], [], []
            for f, s in zip(b.first, b.sizes):
                c = cover[f:f + s]
                n.append(int(c.sum()))
                kept.append(b" ".join([b.vocabulary[w] for w in (b.stream[f:f + s][~c] if n[-1] else b.stream[f:f + s]).tolist()]))
                turn = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0])))).tolist() if n[-1] else []
                removed.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2])])
            out.append(pa.table({
                "doc_id": pa.array(np.where(b.known, b.ids, 0), pa.int64(), mask=~b.known), "n_words": pa.array(b.sizes, pa.int64()),
                "n_removed": pa.array(n, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}))
        return pa.concat_tables(out)

    offered = packed.groupBy("batch").cogroup(codes.groupBy("batch")).applyInArrow(
        offer, "shard int, batch long, ids binary, start binary, count binary, words binary, index binary")
    masks = offered.groupBy("shard").applyInArrow(decide, "batch long, shard int, masks binary")
    none = F.lit(None).cast("binary")
    replies = codes.select("batch", "shard", "codes", none.alias("masks")).unionByName(masks.select("batch", "shard", none.alias("codes"), "masks"))
    return packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        spans, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
