"""Grams that reach a frequency floor, grown level by level, and their contexts.

A gram is never more frequent than its parts.  So grams of k tokens are counted only at
places where both their first and their last k - 1 tokens reached the floor, and
contexts are counted only for grams that reached it: most grams of a corpus are rare,
and neither they nor their neighbours are shuffled with their contexts.

The state between levels is the table of kept grams.  Places find their grams in it by
semi joins, which AQE turns into broadcasts while the table is small and otherwise into
shuffles whose skewed keys it splits.  Equal segments are one row with a weight.

Where contexts are wanted as well, :func:`sorted_sides` finds the grams and their contexts
in one pass: a place is shuffled once, not once a level and once a gram.  :func:`dealt_sides`
does so from lines: places are dealt out by their first token, many to a row; :func:`dealt_grams`
and :func:`dealt_contexts` do the same for counts alone.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import sql_str
from termspark.operators import tokenize as tk
from termspark.session import materialize


#: Rows of sorted windows that a task takes at a time.
CHUNK = 200_000


def weighted(segments: DataFrame, seg_col: str = "seg", counts: Mapping[str, object] | None = None, joiner: str | None = None) -> DataFrame:
    """Equal segments as one row with how often they occur: ``n``, or the aggregates
    ``counts`` (name -> column).  With a ``joiner`` that no token holds, segments are
    shuffled as one string, which is shorter."""
    counts = counts or {"n": F.count(F.lit(1))}
    aggs = [c.alias(name) for name, c in counts.items()]
    if joiner is None:
        return segments.groupBy(seg_col).agg(*aggs)
    whole = segments.withColumn(seg_col, F.array_join(seg_col, joiner)).groupBy(seg_col).agg(*aggs)
    return whole.withColumn(seg_col, F.split(seg_col, re.escape(joiner), -1))


def places(segments: DataFrame, seg_col: str = "seg", max_len: int = K.MAX_GRAM_LEN, boundary: str = K.BOUNDARY,
           weights: Sequence[str] = ("n",)) -> DataFrame:
    """One row for each token of a segment: ``_w`` holds the token before, up to ``max_len``
    tokens from here on and the token after them (``boundary`` at the segment's
    edges); ``weights`` come along.  A gram of k tokens starts here if ``_w`` has k + 2."""
    b = sql_str(boundary)
    padded = segments.select(F.inline(F.array(F.struct(*weights, F.expr(f"concat(array({b}), {seg_col}, array({b}))").alias("_p")))))
    return padded.select(*weights, F.explode(F.expr(
        f"transform(sequence(1, size(_p) - 2), i -> slice(_p, i, least({max_len + 2}, size(_p) - i + 1)))")).alias("_w"))


def _gram(start: int, k: int, joiner: str):
    return F.array_join(F.slice("_w", start, k), joiner)


def frequent_grams(at: DataFrame, min_freq: int = K.COHESION_MIN_FREQ, max_len: int = K.MAX_GRAM_LEN,
                   joiner: str = K.GRAM_JOINER, weight: str = "n") -> DataFrame:
    """A6 level by level: (gram, k, freq) of all grams that occur at least ``min_freq`` times
    at the :func:`places`.  Each level is materialised; with a floor of 1 or less
    every gram stays."""
    levels: list[DataFrame] = []
    for k in range(1, max_len + 1):
        rows = at.select("_w", weight).where(F.size("_w") >= k + 2)
        if k > 1:
            last = levels[-1].select(F.col("gram").alias("_part"))
            for start in (2, 3):  # the first and the last k - 1 tokens
                rows = rows.withColumn("_part", _gram(start, k - 1, joiner)).join(last, "_part", "left_semi").drop("_part")
        counted = rows.select(_gram(2, k, joiner).alias("gram"), weight).groupBy("gram").agg(F.sum(weight).alias("freq"))
        levels.append(materialize(counted.where(F.col("freq") >= min_freq).select("gram", F.lit(k).cast("bigint").alias("k"), "freq")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def occurrences(at: DataFrame, max_len: int = K.MAX_GRAM_LEN, joiner: str = K.GRAM_JOINER, weights: Sequence[str] = ("n",)) -> DataFrame:
    """(gram, prev, next, weights): every gram of every place with the tokens beside it."""
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len), F.size("_w") - 2))).alias("_k")
    return at.select("_w", *weights, k).select(
        F.array_join(F.slice("_w", F.lit(2), F.col("_k")), joiner).alias("gram"), F.col("_w").getItem(0).alias("prev"),
        F.expr("_w[_k + 1]").alias("next"), *weights)


def kept_occurrences(at: DataFrame, grams: DataFrame, max_len: int = K.MAX_GRAM_LEN, joiner: str = K.GRAM_JOINER,
                     weights: Sequence[str] = ("n",)) -> DataFrame:
    """The :func:`occurrences` of the grams of a table, and no others."""
    return occurrences(at, max_len, joiner, weights).join(grams.select("gram"), "gram", "left_semi")


def context_counts(occ: DataFrame, weights: Mapping[str, str]) -> DataFrame:
    """A7 in long form: (gram, side, ctx, counts), side 0 the token before, 1 the token after;
    ``weights`` maps each count to the column it sums up."""
    sides = occ.select("gram", *dict.fromkeys(weights.values()), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("prev").alias("ctx")),
        F.struct(F.lit(1).alias("side"), F.col("next").alias("ctx")))).alias("_x"))
    return sides.groupBy("gram", "_x.side", "_x.ctx").agg(*[F.sum(w).alias(c) for c, w in weights.items()])


def windows(at: DataFrame, joiner: str = K.GRAM_JOINER, weights: Sequence[str] = ("n",)) -> DataFrame:
    """(s, p, weights): the :func:`places` as strings, ``p`` the token before, ``s`` the tokens from
    there on and the one after them, joined.  Every gram that starts there is a beginning of ``s``
    with a joiner behind it; tokens hold no joiner."""
    return at.select(F.array_join(F.expr("slice(_w, 2, size(_w) - 1)"), joiner).alias("s"), F.col("_w").getItem(0).alias("p"), *weights)


def string_windows(segments: DataFrame, seg_col: str = "seg", max_len: int = K.MAX_GRAM_LEN, joiner: str = K.GRAM_JOINER,
                   boundary: str = K.BOUNDARY, weights: Sequence[str] = ("n",)) -> DataFrame:
    """:func:`windows` of segments that are strings (tokens joined by ``joiner``, none empty).
    A place takes a slice of the segment's tokens, which are split once."""
    b = sql_str(boundary + joiner), sql_str(joiner + boundary)
    padded = segments.select(F.inline(F.array(F.struct(*weights, F.split(F.expr(f"concat({b[0]}, {seg_col}, {b[1]})"), re.escape(joiner), -1).alias("_p")))))
    at = padded.select(*weights, "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 2)).alias("_i"))
    return at.select(F.array_join(F.slice("_p", F.col("_i") + 1, max_len + 1), joiner).alias("s"), F.get("_p", F.col("_i") - 1).alias("p"), *weights)


def _sums(prefixes: Sequence[str]) -> list[str]:
    return [f"{c} {'double' if c[-1] == '1' else 'long'}" for p in prefixes for c in (f"{p}freq", *(f"_{p}{s}{x}" for s in "lr" for x in "01e"))]


def _side_runs(s: pa.Array, p: pa.Array, weights: list[np.ndarray], min_freq: int, max_len: int, joiner: str, boundary: str) -> tuple[list[tuple], list[tuple]]:
    """Of sorted windows: (gram, sums) of each complete run whose first weight reaches the floor, and
    (gram, side, ctx, counts) of the runs at the ends, a few of each length, which may go on beyond."""
    lists = pc.split_pattern(s, joiner)
    starts = lists.offsets.to_numpy().astype(np.int64)
    codes = pa.concat_arrays([lists.values.slice(starts[0], starts[-1] - starts[0]), p.cast(pa.string())]).dictionary_encode()
    names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    edge = names.index(boundary) if boundary in names else -1
    starts, size, before = starts[:-1] - starts[0], np.diff(starts), codes[len(codes) - len(s):]
    sums, ends, rows = [], [], np.arange(len(s))
    changed = np.zeros(len(s), bool)  # whether a row begins a run, before runs of this length are looked at
    alive = np.ones(len(s), bool)  # rows of a complete run below the floor go: a longer gram is no more frequent
    for k in range(1, max_len + 1):
        stay = alive & (size[rows] >= k + 1)  # a gram of k tokens has a token after it
        new = np.zeros(stay.sum(), bool)
        if not len(new):
            break
        # a change at a row that goes counts for the next row that stays
        steps = np.cumsum(changed)[stay]
        rows, new[1:] = rows[stay], steps[1:] != steps[:-1]
        token = codes[starts[rows] + k - 1]
        new[1:] |= token[1:] != token[:-1]
        changed = new
        run = np.cumsum(new)
        last, first = int(run[-1]), np.flatnonzero(np.r_[True, new[1:]])
        freq = [np.bincount(run, weights=w[rows]).astype(np.int64) for w in weights]
        kept = freq[0] >= min_freq
        kept[[0, last]] = False
        wanted = kept.copy()
        wanted[[0, last]] = True
        alive = wanted[run]
        mine = np.flatnonzero(alive)
        stats = []
        for side, ctx in enumerate((before[rows[mine]], codes[starts[rows[mine]] + k])):
            pair, inverse = np.unique(run[mine] * len(names) + ctx, return_inverse=True)
            of, ctx = pair // len(names), pair % len(names)
            counts = [np.bincount(inverse, weights=w[rows[mine]]).astype(np.int64) for w in weights]
            for c in counts:
                inner, log = np.where(ctx == edge, 0, c), np.log(np.maximum(c, 1)) / np.log(2.0)
                at_edge = np.bincount(of, weights=np.where(ctx == edge, c, 0), minlength=last + 1).astype(np.int64)
                stats.append((np.bincount(of, weights=inner, minlength=last + 1).astype(np.int64), np.bincount(of, weights=inner * log, minlength=last + 1), at_edge))
            for j in np.flatnonzero((of == 0) | (of == last)).tolist():
                row = rows[first[of[j]]]
                ends.append((joiner.join(names[c] for c in codes[starts[row]:starts[row] + k]), side, names[ctx[j]], *[int(c[j]) for c in counts]))
        for r in np.flatnonzero(kept).tolist():
            row, out = rows[first[r]], []
            for i, f in enumerate(freq):
                out.append(int(f[r]))
                for side in (0, 1):
                    s0, s1, e = stats[side * len(weights) + i]
                    out += [int(s0[r]), float(s1[r]), int(e[r]) or None]
            sums.append((joiner.join(names[c] for c in codes[starts[row]:starts[row] + k]), *out))
    return sums, ends


def sorted_sides(seen: DataFrame, corpora: Mapping[str, str], min_freq: int = K.COHESION_MIN_FREQ, max_len: int = K.MAX_GRAM_LEN,
                 joiner: str = K.GRAM_JOINER, boundary: str = K.BOUNDARY) -> tuple[DataFrame, DataFrame]:
    """A6 and A7 of :func:`windows` in one pass, for ``cohesion.context_entropy``: the sums of grams
    whose first weight reaches ``min_freq``, and the counts of the contexts of the others that may
    reach it.  ``corpora`` maps a prefix to a weight, as there.

    A range partitioning and a sort put equal beginnings side by side, so a gram is a run of
    rows.  A run inside a chunk of rows is complete: below the floor it goes, else it leaves one
    row.  The runs at a chunk's ends leave their contexts, which are added up."""
    weights = list(dict.fromkeys(corpora.values()))
    kinds = ["gram string", "side int", "ctx string", *[f"{w} long" for w in weights], *_sums(corpora)]
    lined = seen.select("s", "p", *weights).repartitionByRange("s", "p").sortWithinPartitions("s")
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [(x.split()[0], types[x.split()[1]]) for x in kinds]
    pick = [weights.index(w) for w in corpora.values()]
    none, empty = (None,) * (2 + len(weights)), (None,) * len(_sums(corpora))

    def run(batches):
        def chunks():
            held, n = [], 0
            for b in batches:
                held, n = [*held, b], n + b.num_rows
                if n >= CHUNK:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held).combine_chunks()

        for t in chunks():
            counts = [t.column(2 + i).to_numpy() for i in range(len(weights))]
            sums, ends = _side_runs(t.column(0).chunk(0), t.column(1).chunk(0), counts, min_freq, max_len, joiner, boundary)
            # sums come by weight; a prefix takes those of its weight
            rows = [(r[0], *none, *[x for i in pick for x in r[1 + 7 * i:8 + 7 * i]]) for r in sums] + [(*e, *empty) for e in ends]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    found = materialize(lined.mapInArrow(run, ", ".join(kinds)))
    ends = found.where("side is not null").groupBy("gram", "side", "ctx").agg(*[F.sum(w).alias(w) for w in weights])
    return found.where("side is null").drop("side", "ctx", *weights), ends


#: Buckets of places for each partition, and the parts that places of a very common token go to.
BUCKETS, PARTS = 16, 16


#: Spreads the hashes of a place's tokens.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chunk_segments(t: pa.Table, kinds: np.ndarray, cut: pa.Array, joiner: str):
    """The distinct segments of a chunk of lines with weights: the names of its tokens, the name's number of
    each token, the bytes of tokens with a joiner behind each and the places where they begin and end, the first
    token and the number of tokens of each segment, their weights.  None where there is no segment."""
    data, at = tk.line_bytes(t.column(0).combine_chunks())
    start, end, kind, line = tk.token_places(data, at, kinds)
    word = np.flatnonzero(kind == tk.SCRIPT)
    words = tk.pieces(data, start[word], end[word]).dictionary_encode()
    names, code = words.dictionary.cast(pa.string()), words.indices.to_numpy()
    mine = ~pc.is_in(names, value_set=cut).to_numpy(zero_copy_only=False)[code]
    word, code = word[mine], code[mine]  # tokens of segments
    if not len(word):
        return None
    # a segment goes on where the token before it is in it, too
    new = np.r_[True, (np.diff(word) != 1) | (np.diff(line[word]) != 0)]
    # each token with a joiner behind it; equal segments of the chunk become one
    text, at = tk.gathered(data, start[word], end[word] - start[word] + 1)
    text[at[1:] - 1] = ord(joiner)
    first = np.flatnonzero(new)
    whole = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[at[first], at[-1]].astype(np.int64)), pa.py_buffer(text)).dictionary_encode()
    same, n = whole.indices.to_numpy(), len(whole.dictionary)
    weights = [np.bincount(same, weights=c.to_numpy()[line[word[first]]], minlength=n).astype(np.int64) for c in t.columns[1:]]
    one = np.zeros(n, np.int64)
    one[same[::-1]] = np.arange(len(same))[::-1]
    return names, code, text, at, first[one], np.diff(np.r_[first, len(word)])[one], weights


def _bucket_rows(bucket: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, weights: list[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    """(bucket, w, weights) of pieces of a text that end with a joiner: those of a bucket in one row, each ended by
    a newline instead."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    w, ends = tk.gathered(text, start[order], length[order])
    w[ends[1:] - 1] = ord("\n")
    rows = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
    cuts = np.r_[rows, len(bucket)].astype(np.int32)
    blobs = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends[cuts].astype(np.int64)), pa.py_buffer(w)).cast(pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in weights]
    return pa.RecordBatch.from_arrays([pa.array(bucket[rows]), blobs, *lists], ["bucket", "w", *names])


def _dealt(t: pa.Table, kinds: np.ndarray, cut: pa.Array, hot: pa.Array | None, buckets: int, max_len: int, joiner: str, boundary: str) -> pa.RecordBatch | None:
    """(bucket, w, weights) of a chunk of lines with weights: the places of its distinct segments as
    strings "token before, up to ``max_len`` tokens, token after", each ended by a newline, those of a
    bucket in one row.  A bucket goes by the first token, of a very common one by the second, too; where ``hot``
    is None by the token before and the first two."""
    found = _chunk_segments(t, kinds, cut, joiner)
    if found is None:
        return None
    names, code, text, at, first, size, weights = found
    n = len(first)
    token = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
    # the tokens between two boundaries
    end = np.cumsum(size + 2)
    here = np.arange(len(token)) + 2 * np.repeat(np.arange(n), size) + 1
    start, length = np.full(end[-1], len(text)), np.full(end[-1], len(boundary.encode()) + 1)
    start[here], length[here] = at[token], (at[1:] - at[:-1])[token]
    padded, at = tk.gathered(np.r_[text, np.frombuffer((boundary + joiner).encode(), np.uint8)], start, length)
    last = np.minimum(here + max_len, np.repeat(end - 1, size))
    number = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object))
    after = np.zeros(end[-1], np.uint64)
    after[here] = number[code[token]]
    if hot is None:
        bucket = (after[here - 1] * _MIX + after[here]) * _MIX + after[here + 1]
    else:
        part = np.where(pc.is_in(names, value_set=hot).to_numpy(zero_copy_only=False)[code[token]], after[here + 1] % PARTS, 0).astype(np.uint64)
        bucket = after[here] + part * _MIX
    of = np.repeat(np.arange(n), size)
    return _bucket_rows((bucket % np.uint64(buckets)).astype(np.int32), padded, at[here - 1], at[last + 1] - at[here - 1], [x[of] for x in weights], t.column_names[1:])


def _dealt_grams(t: pa.Table, kinds: np.ndarray, cut: pa.Array, buckets: int, max_len: int, joiner: str) -> pa.RecordBatch | None:
    """(bucket, w, weight) of a chunk of lines with a weight, as :func:`_dealt`: each token by itself, once, and the
    up to ``max_len`` tokens from each place on, two at least, in a bucket by the first two."""
    found = _chunk_segments(t, kinds, cut, joiner)
    if found is None:
        return None
    names, code, text, at, first, size, (weight,) = found
    token = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
    number = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object))
    weight = np.repeat(weight, size)
    each = np.bincount(code[token], weights=weight, minlength=len(names)).astype(np.int64)
    any_ = np.full(len(names), -1)
    any_[code[token]] = token
    used = np.flatnonzero(any_ >= 0)
    last = np.minimum(token + max_len, np.repeat(first + size, size))
    more = np.flatnonzero(last - token > 1)
    one, two, last = any_[used], token[more], last[more]
    bucket = np.r_[number[used], number[code[two]] * _MIX + number[code[two + 1]]] % np.uint64(buckets)
    return _bucket_rows(bucket.astype(np.int32), text, np.r_[at[one], at[two]], np.r_[at[one + 1] - at[one], at[last] - at[two]],
                        [np.r_[each[used], weight[more]]], t.column_names[1:])


def _bucket_places(w: pa.Array, joiner: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The names of a bucket's tokens, the name's number of each token, the first token and the number of tokens of
    each place."""
    data = tk.line_bytes(w)[0][:-4].copy()
    ends = np.flatnonzero((data == ord(joiner)) | (data == ord("\n")))
    stop = np.flatnonzero(data[ends] == ord("\n"))
    data[ends] = ord(joiner)
    words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.r_[0, ends + 1].astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    names, code = pc.utf8_slice_codeunits(words.dictionary, 0, -1).cast(pa.string()), words.indices.to_numpy().astype(np.int64)
    first = np.r_[0, stop[:-1] + 1]
    return names, code, first, stop + 1 - first


def _joined(names: pa.Array, codes: list[np.ndarray], joiner: str) -> pa.Array:
    tokens = [names.take(pa.array(c)) for c in codes]
    return pc.binary_join_element_wise(*tokens, joiner) if len(tokens) > 1 else tokens[0]


def _bucket_grams(w: pa.Array, weight: np.ndarray, min_freq: int, max_len: int, joiner: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(grams, counts) of each length in a bucket of :func:`_dealt_grams`, of those that reach the floor."""
    names, code, first, size = _bucket_places(w, joiner)
    tokens = [np.where(size >= k, code[np.minimum(first + k - 1, len(code) - 1)], -1) for k in range(1, max_len + 1)]
    order = np.lexsort(tokens[::-1])
    rows, longer = order[size[order] == 1], order[size[order] > 1]
    for k in range(1, max_len + 1):
        if k > 1:
            rows = longer = longer[size[longer] >= k]
        if not len(rows):
            continue
        new = np.r_[True, np.logical_or.reduce([np.diff(t[rows]) != 0 for t in tokens[:k]])]
        head, n = rows[new], np.add.reduceat(weight[rows], np.flatnonzero(new))
        wanted = n >= min_freq
        yield _joined(names, [t[head[wanted]] for t in tokens[:k]], joiner), n[wanted]
        if k > 1:  # a longer gram is no more frequent
            longer = rows[wanted[np.cumsum(new) - 1]]


def _bucket_contexts(w: pa.Array, weight: np.ndarray, max_len: int, joiner: str) -> Iterator[list]:
    """[grams, k, tokens before, tokens after, counts] of each length in a bucket of :func:`_dealt`."""
    names, code, first, size = _bucket_places(w, joiner)
    tokens = [np.where(size > k, code[np.minimum(first + k, len(code) - 1)], -1) for k in range(max_len + 2)]
    rows = np.lexsort(tokens[::-1])
    for k in range(1, max_len + 1):
        rows = rows[size[rows] >= k + 2]
        if not len(rows):
            return
        new = np.r_[True, np.logical_or.reduce([np.diff(t[rows]) != 0 for t in tokens[:k + 2]])]
        before, *gram, after = [t[rows[new]] for t in tokens[:k + 2]]
        yield [_joined(names, gram, joiner), pa.array(np.full(len(before), k)), names.take(pa.array(before)), names.take(pa.array(after)),
               pa.array(np.add.reduceat(weight[rows], np.flatnonzero(new)))]


def _bucket_runs(w: pa.Array, weights: list[np.ndarray], hot: pa.Array, min_freq: int, max_len: int, joiner: str, boundary: str):
    """Of the places of a bucket: for each gram length (grams, sums by weight) of the grams whose first
    weight reaches the floor, all of whose places are here, and (grams, side, ctx, counts) of very common tokens,
    which have places elsewhere."""
    names, code, first, size = _bucket_places(w, joiner)
    edge = pc.index(names, boundary).as_py()
    common = pc.is_in(names, value_set=hot).to_numpy(zero_copy_only=False)
    tokens = [np.where(size > k, code[np.minimum(first + k, len(code) - 1)], -1) for k in range(1, max_len + 1)]
    rows = np.lexsort(tokens[::-1])
    for k in range(1, max_len + 1):
        rows = rows[size[rows] >= k + 2]  # a gram of k tokens has a token before and one after it
        if not len(rows):
            return
        new = np.r_[True, np.logical_or.reduce([np.diff(t[rows]) != 0 for t in tokens[:k]])]
        run, head = np.cumsum(new) - 1, rows[new]
        freq = [np.bincount(run, weights=x[rows]).astype(np.int64) for x in weights]
        open_ = common[tokens[0][head]] if k == 1 else np.zeros(len(head), bool)
        wanted = open_ | (freq[0] >= min_freq)  # a longer gram is no more frequent
        mine = wanted[run]
        rows, run, head, open_, freq = rows[mine], (np.cumsum(wanted) - 1)[run[mine]], head[wanted], open_[wanted], [f[wanted] for f in freq]
        grams = _joined(names, [t[head] for t in tokens[:k]], joiner)
        sums, closed = [[f] for f in freq], pa.array(~open_)
        for side, ctx in enumerate((code[first[rows]], code[first[rows] + k + 1])):
            pair, inverse = np.unique(run * len(names) + ctx, return_inverse=True)
            of, ctx = pair // len(names), pair % len(names)
            counts = [np.bincount(inverse, weights=x[rows]).astype(np.int64) for x in weights]
            for c, out in zip(counts, sums):
                inner = np.where(ctx == edge, 0, c)
                at_edge = np.bincount(of, weights=np.where(ctx == edge, c, 0), minlength=len(head)).astype(np.int64)
                out += [np.bincount(of, weights=inner, minlength=len(head)).astype(np.int64),
                        np.bincount(of, weights=inner * (np.log(np.maximum(c, 1)) / np.log(2.0)), minlength=len(head)), at_edge]
            some = np.flatnonzero(open_[of])
            if len(some):
                yield grams.take(pa.array(of[some])), None, np.full(len(some), side, np.int32), names.take(pa.array(ctx[some])), [c[some] for c in counts]
        yield grams.filter(closed), [[x[~open_] for x in out] for out in sums], None, None, None


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, of batches sorted by it."""
    held, now = [], None
    for b in batches:
        bucket = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x < y and bucket[x] != now:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, now = [], bucket[x]
            if x < y:
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _through_buckets(lines: DataFrame, weights: Sequence[str], deal, run, schema: str) -> DataFrame:
    """Lines dealt out by ``deal(chunk, buckets)``, a row for each chunk and bucket, and read by ``run(batches)``,
    whose batches are sorted by bucket."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches):
        for t in tk.chunks(batches):
            out = deal(t, BUCKETS * parts)
            if out is not None:
                yield out
            del t, out  # before the next chunk is read
            tk.give_back()

    def counted(batches):
        yield from run(batches)
        tk.give_back()

    dealt = lines.select("line", *[F.col(w).cast("long").alias(w) for w in weights]) \
        .mapInArrow(chunks, ", ".join(["bucket int", "w string", *[f"{w} array<long>" for w in weights]]))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, schema)


def dealt_grams(lines: DataFrame, script_class: str, words_that_cut: Sequence[str], min_freq: int = K.COHESION_MIN_FREQ,
                max_len: int = K.MAX_GRAM_LEN, joiner: str = K.GRAM_JOINER, weight: str = "n") -> DataFrame:
    """P3+P4 and A6 of lines (``line`` with a weight): (gram, freq) of the grams that reach the floor, as
    :func:`frequent_grams` of the places of their segments; with a floor of 1 every gram.

    Segments are cut from chunks of lines as arrays.  A place is shuffled once, without the tokens beside it, in a
    row for each chunk and bucket of its first two tokens, a token by itself once a chunk; so all places of a gram
    meet, and its count in a bucket is whole."""
    cut = pa.array(list(words_that_cut), pa.string())

    def deal(t, buckets):
        return _dealt_grams(t, tk.char_kinds(script_class), cut, buckets, max_len, joiner)

    def run(batches):
        for t in _by_bucket(batches):
            for grams, n in _bucket_grams(t.column(1).combine_chunks(), t.column(2).combine_chunks().flatten().to_numpy(), min_freq, max_len, joiner):
                yield pa.RecordBatch.from_arrays([grams, pa.array(n)], ["gram", "freq"])

    return _through_buckets(lines, [weight], deal, run, "gram string, freq long")


def dealt_contexts(lines: DataFrame, script_class: str, words_that_cut: Sequence[str], max_len: int = K.MAX_GRAM_LEN,
                   joiner: str = K.GRAM_JOINER, boundary: str = K.BOUNDARY, weight: str = "n") -> DataFrame:
    """P3+P4 and N1 of lines (``line`` with a weight): (gram, k, prev, next, n), each gram with the tokens beside it,
    as ``ngrams.ngrams_with_context`` of their segments gives them, and how often they occur.

    A place is shuffled once, not once for each gram that starts there: those that are equal have the token
    before, the first and the next token in common, and meet in the bucket of these."""
    cut = pa.array(list(words_that_cut), pa.string())

    def deal(t, buckets):
        return _dealt(t, tk.char_kinds(script_class), cut, None, buckets, max_len, joiner, boundary)

    def run(batches):
        for t in _by_bucket(batches):
            for cols in _bucket_contexts(t.column(1).combine_chunks(), t.column(2).combine_chunks().flatten().to_numpy(), max_len, joiner):
                yield pa.RecordBatch.from_arrays(cols, ["gram", "k", "prev", "next", "n"])

    return _through_buckets(lines, [weight], deal, run, "gram string, k long, prev string, next string, n long")


def dealt_sides(lines: DataFrame, corpora: Mapping[str, str], script_class: str, words_that_cut: Sequence[str], hot: Sequence[str] = (),
                min_freq: int = K.COHESION_MIN_FREQ, max_len: int = K.MAX_GRAM_LEN, joiner: str = K.GRAM_JOINER,
                boundary: str = K.BOUNDARY) -> tuple[DataFrame, DataFrame]:
    """P3+P4, A6 and A7 of lines (``line`` with the weights of ``corpora``), as :func:`sorted_sides`
    of the windows of their segments.

    Segments and places are cut from chunks of lines as arrays.  A place goes to a bucket by its first
    token, so all places of a gram meet in one; a row holds a chunk's places of a bucket, and buckets
    are sorted one at a time.  Places of the tokens ``hot``, very common ones, are dealt out by the next
    token as well: longer grams still meet, and the contexts of these tokens alone are added up."""
    weights = list(dict.fromkeys(corpora.values()))
    cut, hot = pa.array(list(words_that_cut), pa.string()), pa.array(list(hot), pa.string())
    kinds = ["gram string", "side int", "ctx string", *[f"{w} long" for w in weights], *_sums(corpora)]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in kinds])
    pick = [weights.index(w) for w in corpora.values()]

    def deal(t, buckets):
        return _dealt(t, tk.char_kinds(script_class), cut, hot, buckets, max_len, joiner, boundary)

    def run(batches):
        for t in _by_bucket(batches):
            counted = [t.column(2 + i).combine_chunks().flatten().to_numpy() for i in range(len(weights))]
            for grams, sums, side, ctx, counts in _bucket_runs(t.column(1).combine_chunks(), counted, hot, min_freq, max_len, joiner, boundary):
                def none(kind):
                    return pa.nulls(len(grams), kind)
                if sums is None:
                    cols = [side, ctx, *counts, *[none(f.type) for f in schema][3 + len(weights):]]
                else:  # no place at the edge is null
                    cols = [none(pa.int32()), none(pa.string()), *[none(pa.int64()) for _ in weights]]
                    cols += [pa.array(x, mask=(x == 0) if i in (3, 6) else None) for j in pick for i, x in enumerate(sums[j])]
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip([grams, *cols], schema)], schema=schema)

    found = materialize(_through_buckets(lines, weights, deal, run, ", ".join(kinds)))
    ends = found.where("side is not null").groupBy("gram", "side", "ctx").agg(*[F.sum(w).alias(w) for w in weights])
    return found.where("side is null").drop("side", "ctx", *weights), ends
