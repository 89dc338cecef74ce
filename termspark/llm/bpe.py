"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one BPE encoding, and the last token
of that encoding is all that has to be stored: the rest is the stored encoding
of the shorter prefix.  A token t that ends at position i is that last token
exactly when the pair (last token of the prefix before t, t) is stable, that
is, when BPE would never merge across their border.  So one pass over the
positions, looking at the tokens that end there, encodes in linear time; an
append goes on from the stored prefix, and an edit re-encodes from its place on.

Stability is decided by running the merges of both tokens backwards: at each
moment only the right edge of the left token and the left edge of the right one
touch, and a merge of the two must not come before either is absorbed.

Ids are those of the rank file, for each match of the splitting pattern
separately, without special tokens.
"""
from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.common import only, slices, worker_cache

#: Pieces remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 300_000
NEVER = 1 << 60


class Vocabulary:
    """The tokens of a rank file and what prefix encoding needs to know of them."""

    def __init__(self, rank_file: bytes):
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.left, self.right, self.born = {}, {}, {}
        self.usable = set()
        for token, r in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = self._merge(token, r)
            self.born[r] = r if len(token) > 1 else -1
            if len(token) == 1:
                self.usable.add(r)
            elif len(parts) == 2:
                self.left[r], self.right[r] = self.ranks[parts[0]], self.ranks[parts[1]]
                self.usable.add(r)
        self.ends = ahocorasick.Automaton()
        for r in self.usable:
            t = self.bytes[r]
            self.ends.add_word(t.decode("latin-1"), (len(t), r))
        self.ends.make_automaton()
        self.size = {r: len(t) for r, t in self.bytes.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """The parts of a token after all merges of a lower rank."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if r >= below:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stable(self, a: int, b: int) -> bool:
        """True if BPE of the bytes of a, b gives the two tokens a, b."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, x_gone, y_gone, good = a, b, NEVER, NEVER, True
        while True:
            c = self.ranks.get(self.bytes[x] + self.bytes[y])
            # on equal ranks the merge further left comes first
            if c is not None and self.born[x] < c < x_gone and self.born[y] < c <= y_gone:
                good = False
                break
            if self.born[x] < 0 and self.born[y] < 0:
                break
            if self.born[y] >= self.born[x]:
                y_gone, y = self.born[y], self.left[y]
            else:
                x_gone, x = self.born[x], self.right[x]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good


    def encode(self, data: bytes) -> tuple[int, ...]:
        """The last tokens of all prefixes of one short piece, and the encoding they give."""
        last, known, stable = [-1] * len(data), self.pairs.get, self.stable
        for end, (n, t) in self.ends.iter(data.decode("latin-1")):
            if last[end] < 0:
                before = end - n
                if before < 0:
                    last[end] = t
                else:
                    good = known((last[before], t))
                    if good is None:
                        good = stable(last[before], t)
                    if good:
                        last[end] = t
        at, out, size = len(data) - 1, [], self.size
        while at >= 0:
            out.append(last[at])
            at -= size[last[at]]
        return tuple(out[::-1])


class PrefixEncoding:
    """The encoding of every prefix of a byte string that grows or is edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Goes on from what is stored; no earlier position changes."""
        start = len(self.last)
        self.data += more
        last, stable, size = self.last, self.v.stable, self.v.bytes
        last.extend([-1] * len(more))
        # tokens that end after ``start`` begin at most one longest token before it
        longest = max(map(len, size.values())) if start else 0
        base = max(0, start - longest)
        for end, (n, t) in self.v.ends.iter(self.data[base:].decode("latin-1")):
            end += base
            if end < start or last[end] >= 0:
                continue
            before = end - n
            if before < 0 or (last[before] >= 0 and stable(last[before], t)):
                last[end] = t

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replaces data[start:stop]; prefixes up to ``start`` are kept, and so are
        the last tokens behind the edit once they agree with the old ones over one
        longest token (from there on both depend on the same bytes and tokens)."""
        tail, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        longest = max(map(len, self.v.bytes.values()))
        at, same = 0, 0
        while at < len(tail):
            step = tail[at:at + longest]
            self.append(step)
            agree = self.last[len(self.last) - len(step):] == old[at:at + len(step)]
            at += len(step)
            same = same + len(step) if agree else 0
            if same >= 2 * longest:
                self.data += tail[at:]
                self.last += old[at:]
                return

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes (default: all)."""
        at, out = (len(self.last) if length is None else length) - 1, []
        while at >= 0:
            out.append(self.last[at])
            at -= len(self.v.bytes[self.last[at]])
        return out[::-1]


class PieceCache(dict):
    """piece -> its ids; a piece that is a token is that token."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ranks.get(data)
        ids = (whole,) if whole is not None else self.v.encode(data)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(data) <= 256:
            self[piece] = ids
        return ids


class TextEncoder:
    """Texts to ids: each match of the pattern separately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.split, self.pieces = regex.compile(pattern).findall, PieceCache(vocabulary)

    def __call__(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []


def _in_worker(sent, pattern: str) -> TextEncoder:
    kept = worker_cache("bpe")
    key = (hash(sent.value), pattern)
    if kept.get("key") != key:
        kept |= {"key": key, "encoder": TextEncoder(Vocabulary(sent.value), pattern)}
    return kept["encoder"]


def send_vocabulary(spark: SparkSession, rank_path: str):
    """The rank file (one line a token, bounded by the vocabulary) for the tasks."""
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each document row's whole text.

    A null text counts as empty and has no ids; ids of documents may be null or
    repeat; other columns are left aside; an empty table gives no rows.
    """
    sent = send_vocabulary(docs.sparkSession, rank_path)

    def run(batches):
        for b in slices(batches):
            yield _encoded(sent, pattern, b)

    return _plain(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))


def _encoded(sent, pattern: str, b: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, ids) of a batch (doc_id, text), in a worker."""
    encoder, values, ends = _in_worker(sent, pattern), [], [0]
    for t in b.column(1).to_pylist():
        ids = encoder(t)
        values.append(np.array(ids, np.int32))
        ends.append(ends[-1] + len(ids))
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])


def _decoded(sent, b: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, ids, decoded) of a batch (doc_id, ids), in a worker."""
    kept = worker_cache("bpe-bytes")
    if kept.get("key") != (key := hash(sent.value)):
        by = {int(b): base64.b64decode(a) for a, b in map(bytes.split, sent.value.splitlines()) if a}
        size = np.array([len(by.get(i, b"")) for i in range(max(by, default=-1) + 1)], np.int64)
        kept |= {"key": key, "size": size, "start": np.cumsum(size) - size,
                 "bytes": np.frombuffer(b"".join(by.get(i, b"") for i in range(len(size))), np.uint8)}
    size, start, table = kept["size"], kept["start"], kept["bytes"]
    lists = b.column(1)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    counts = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    n = size[ids]
    at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    data, ends = table[at].tobytes(), np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
    out = [data[x:y] if ok else None for x, y, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())]
    return pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids give null."""
    sent = send_vocabulary(encoded.sparkSession, rank_path)

    def run(batches):
        for b in slices(batches):
            yield _decoded(sent, b)

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): :func:`encode` and then :func:`decode`, in one worker a task."""
    sent = send_vocabulary(docs.sparkSession, rank_path)

    def run(batches):
        for b in slices(batches):
            yield _decoded(sent, _encoded(sent, pattern, b))

    return _plain(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and the columns ``more``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more)
