"""Source divergence audit by chunk factorization.

Which terms set a source apart from its language, and how far do two sources of a
language lie from each other?  Terms are runs of letters; splitting texts into them
is the dear part.  So documents are only cut at white space, and:

1. ``count``: a batch counts its white-space chunks per document and adds them up per
   chunk and (language, source): occurrences, documents, and the row numbers of the documents
   where they are fewer than ``least``;
2. ``tokenize``: counts meet by chunk; each globally distinct chunk is split into its
   terms once, and the terms are joined back to the counts of their chunk;
3. ``settle``: counts meet by term.  The number of documents of a term is asked for one
   purpose, whether it reaches ``least``.  A term has at least as many documents as any of
   its chunks, which settles all common terms.  The documents of a rarer term have
   their row numbers there, and distinct ones are counted;
4. ``compare``: each part of the kept terms sums up how far the sources of a language
   lie apart over its terms and keeps the best terms of each source.

Between these steps counts travel as packed arrays, one message a batch or shard and
receiver.  Everything is a count, a sum or an integer division of integers, so the
result is exact.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspark.llm.common import WordHash, materialize, only, pack_bytes, pack_ints, slices, unpack_bytes, unpack_ints

#: A term is a run of these: A-Z, a-z and whatever is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term has at least, ranks of part 'term'.
LEAST, TOP = 10, 10
#: Words of a batch, bytes of text for each shard, numbers in a matrix of terms and sources.
BATCH_WORDS, SHARD_BYTES, MATRIX = 1_000_000, 16 << 20, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries by (chunk or term, group): number of the word and of the group, occurrences, documents
#: (exact below ``least``), and how many row numbers there are for it (all of its documents, or none).
_MESSAGE = "shard int, words binary, groups binary, word binary, of binary, n binary, docs binary, listed binary, rows binary"
_ARRAYS = {"word": np.uint32, "of": np.uint32, "n": np.int64, "docs": np.int64, "listed": np.uint32, "rows": np.int64}


class Counts:
    """Entries of a message, or of several read as one."""

    def __init__(self, words: list[bytes], groups: list, arrays: dict[str, np.ndarray]):
        self.words, self.groups, self.arrays = words, groups, arrays

    @classmethod
    def read(cls, t: pa.Table) -> Counts:
        number: dict[bytes, int] = {}
        named: dict[tuple, int] = {}
        parts: dict[str, list] = {name: [] for name in _ARRAYS}
        for i in range(t.num_rows):
            row = {c: t.column(c)[i].as_py() for c in t.column_names}
            raw = unpack_bytes(row["words"])
            place = np.fromiter((number.setdefault(w, len(number)) for w in (raw.split(b" ") if raw else [])), np.int64)
            group = np.array([named.setdefault(tuple(g), len(named)) for g in json.loads(row["groups"])], np.int64)
            for name, kind in _ARRAYS.items():
                a = unpack_ints(row[name], kind).astype(np.int64)
                parts[name].append(place[a] if name == "word" else group[a] if name == "of" else a)
        return cls(list(number), list(named), {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in parts.items()})

    def messages(self, seen: WordHash, shards: int) -> pa.RecordBatch:
        """One message for each shard, by the hash of the word."""
        a = self.arrays
        shard_of = np.fromiter(map(seen.__getitem__, self.words), np.uint64, len(self.words)) % np.uint64(shards)
        shard = shard_of[a["word"]]
        by, by_row = np.argsort(shard, kind="stable"), np.argsort(np.repeat(shard, a["listed"]), kind="stable")
        cut = np.searchsorted(shard[by], np.arange(shards + 1))
        ends = np.concatenate(([0], np.cumsum(a["listed"][by])))
        rows, out = a["rows"][by_row], []
        groups = json.dumps(self.groups).encode()
        for k, (x, y) in enumerate(zip(cut, cut[1:])):
            if y > x:
                o = by[x:y]
                used, word = np.unique(a["word"][o], return_inverse=True)
                values = {name: a[name][o] for name in _ARRAYS if name != "rows"} | {"word": word, "rows": rows[ends[x]:ends[y]]}
                out.append([k, pack_bytes(b" ".join([self.words[w] for w in used.tolist()])), groups,
                            *[pack_ints(values[name].astype(kind)) for name, kind in _ARRAYS.items()]])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary() if i else pa.int32()) for i in range(3 + len(_ARRAYS))],
                                          [c.split()[0] for c in _MESSAGE.split(", ")])

    def summed(self, word: np.ndarray, words: list[bytes], times: np.ndarray, entry: np.ndarray, least: int, add: bool = False) -> Counts:
        """The entries ``entry`` under other words, summed up by (word, group), ``times`` as many
        occurrences of each.  Documents add up where no two entries share any (``add``);
        otherwise there are as many as one entry or the rows say, which is exact below ``least``."""
        a, g = self.arrays, max(1, len(self.groups))
        key, at = np.unique(word * g + a["of"][entry], return_inverse=True)
        n, docs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.add.at(n, at, a["n"][entry] * times)
        (np.add if add else np.maximum).at(docs, at, a["docs"][entry])
        first = np.cumsum(a["listed"]) - a["listed"]
        long = a["listed"][entry]
        owner = np.repeat(at, long)
        row = a["rows"][np.repeat(first[entry], long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)]
        order = np.lexsort((row, owner))
        owner, row = owner[order], row[order]
        fresh = np.append(True, (np.diff(owner) != 0) | (np.diff(row) != 0))[:len(row)]
        owner, row = owner[fresh], row[fresh]
        docs = np.maximum(docs, np.bincount(owner, minlength=len(key)))
        some = docs[owner] < least
        owner, row = owner[some], row[some]
        return Counts(words, self.groups, {"word": key // g, "of": key % g, "n": n, "docs": docs,
                                           "listed": np.bincount(owner, minlength=len(key)), "rows": row})


def batch_counts(docs: list[tuple], first_row: int, least: int) -> Counts:
    """Step 1 for documents (language, source, chunks); their rows are numbered from ``first_row``."""
    from itertools import chain

    named: dict[tuple, int] = {}
    group = np.array([named.setdefault((d[0], d[1]), len(named)) for d in docs], np.int64)
    order = np.argsort(group, kind="stable")
    local: dict[bytes, int] = {}
    number = local.setdefault
    sizes = np.array([len(docs[k][2]) for k in order], np.int64)
    stream = np.fromiter((number(w, len(local)) for w in chain.from_iterable(docs[k][2] for k in order)), np.int64, int(sizes.sum()))
    pair, n = np.unique(stream * len(docs) + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    word, doc = pair // len(docs), pair % len(docs)
    of = group[order][doc]
    start = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(of) != 0))[:len(word)])
    docs_of = np.diff(np.append(start, len(word)))
    listed = np.where(docs_of < least, docs_of, 0)
    rows = (order[doc] + first_row)[np.repeat(docs_of < least, docs_of)]
    return Counts(list(local), list(named), {
        "word": word[start], "of": of[start], "n": np.add.reduceat(n, start) if len(start) else n, "docs": docs_of,
        "listed": listed, "rows": rows})


def kept_terms(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST,
               batch_words: int = BATCH_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The terms that at least ``least`` documents of a language have, in parts: (lang, v,
    sources, totals, terms, term, source, n); v terms, the parts' sources with the
    occurrences of its terms in each, and for each (term, source) how often."""
    def value(c):
        return F.coalesce(F.col(c), F.lit(""))

    plain = only(docs, text, lang, source).select(value(text).cast("binary").alias("t"), value(lang).alias("g"), value(source).alias("s"))
    shards = max(8, -(-(plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // shard_bytes))

    def count(batches):
        from pyspark import TaskContext

        seen, found, words, row = WordHash(), [], 0, TaskContext.get().partitionId() << 40
        for b in slices(batches):
            for t, g, s in zip(*(b.column(k).to_pylist() for k in range(3))):
                found.append((g, s, t.split()))
                words += len(found[-1][2])
                if words >= batch_words:
                    yield batch_counts(found, row, least).messages(seen, shards)
                    row, found, words = row + len(found), [], 0
        if found:
            yield batch_counts(found, row, least).messages(seen, shards)

    def tokenize(t: pa.Table) -> pa.Table:
        counts = Counts.read(t)
        k = np.arange(len(counts.arrays["word"]))
        # documents in different batches are different ones
        whole = counts.summed(counts.arrays["word"], counts.words, np.ones(len(k), np.int64), k, least, add=True)
        find, number, chunk, term = re.compile(rb"[a-z\x80-\xff]+").findall, {}, [], []
        for i, w in enumerate(counts.words):
            for x in find(w.lower()):
                chunk.append(i)
                term.append(number.setdefault(x, len(number)))
        pair, times = np.unique(np.array(chunk, np.int64) * max(1, len(number)) + np.array(term, np.int64), return_counts=True)
        chunk, term = pair // max(1, len(number)), pair % max(1, len(number))
        first = np.searchsorted(chunk, np.arange(len(counts.words) + 1))
        many = np.diff(first)[whole.arrays["word"]]  # terms of each entry's chunk
        entry = np.repeat(np.arange(len(many)), many)
        at = np.repeat(first[whole.arrays["word"]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return pa.Table.from_batches([whole.summed(term[at], list(number), times[at], entry, least).messages(WordHash(), shards)])

    def settle(t: pa.Table) -> pa.Table:
        counts = Counts.read(t)
        k = np.arange(len(counts.arrays["word"]))
        a = counts.summed(counts.arrays["word"], counts.words, np.ones(len(k), np.int64), k, least).arrays
        langs = sorted({g[0] for g in counts.groups})
        lang_of = np.array([langs.index(g[0]) for g in counts.groups], np.int64)
        key, at = np.unique(a["word"] * len(langs) + lang_of[a["of"]], return_inverse=True) if len(a["word"]) else (np.empty(0, np.int64),) * 2
        # a document has one source, so those of a language's sources add up
        keep = np.bincount(at, weights=a["docs"], minlength=len(key)) >= least
        out = []
        for i, name in enumerate(langs):
            mine = np.flatnonzero(keep[at] & (lang_of[a["of"]] == i))
            if len(mine):
                used, term = np.unique(a["word"][mine], return_inverse=True)
                of, source_ = np.unique(a["of"][mine], return_inverse=True)
                n = a["n"][mine]
                out.append([name, len(used), [counts.groups[g][1] for g in of.tolist()], np.bincount(source_, weights=n).astype(np.int64).tolist(),
                            pack_bytes(b" ".join([counts.words[w] for w in used.tolist()])), pack_ints(term.astype(np.uint32)),
                            pack_ints(source_.astype(np.uint32)), pack_ints(n)])
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())] + [pa.binary()] * 4
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                        names=["lang", "v", "sources", "totals", "terms", "term", "source", "n"])

    by_chunk = plain.mapInArrow(count, _MESSAGE).groupBy("shard").applyInArrow(tokenize, _MESSAGE)
    return by_chunk.groupBy("shard").applyInArrow(
        settle, "lang string, v long, sources array<string>, totals array<long>, terms binary, term binary, source binary, n binary")


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 V)), exact: in whole numbers of Python where
    64 bits are not enough."""
    if counts.max(initial=0) < 9_000_000_000 and totals.max(initial=0) < 1 << 61:
        return 1 + 1_000_000_000 * (counts + 2) // (totals + 2 * kept)
    exact = 1 + 1_000_000_000 * (counts.astype(object) + 2) // (totals.astype(object) + 2 * kept)
    return exact.astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP,
               batch_words: int = BATCH_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (lang, source).

    Part 'pair': how far each other source of the language lies from this one, the sum over
    all kept terms of f = floor((p - q)^2 / (p + q)) with p = 1 + floor(10^9 (count + 2) /
    (N + 2 V)); all ranks.  Part 'term': the ``top`` kept terms that the source has more of
    than its language, by f.  Rank 1 has the largest value; equal values by item in
    UTF-8 order.

    Null text, lang and source count as ''.  Every row is a document, also where rows
    agree in their id or in everything.  A group without terms has N = 0 and takes part in
    the pairs; a language without kept terms has pairs of value 0 and no terms.  Texts of
    any length are read whole; other columns are left aside; an empty table gives no rows.
    """
    kept = materialize(kept_terms(docs, text=text, lang=lang, source=source, least=least, batch_words=batch_words, shard_bytes=shard_bytes))
    groups = only(docs, lang, source).select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    whole = kept.groupBy("lang").agg(F.sum("v").alias("v"))
    n_of = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")) \
        .agg(F.sum("x.totals").alias("total"))
    # all sources of a language in one row: as many as the pairs of the result have on one side
    sources = materialize(groups.join(n_of, ["lang", "source"], "left").na.fill(0, ["total"]).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all")).join(whole, "lang", "left").na.fill(0, ["v"]))

    def compare(batches):
        for b in batches:
            for of in b.to_pylist():
                names, totals = [s["source"] for s in of["all"]], np.array([s["total"] for s in of["all"]], np.int64)
                number = {n: i for i, n in enumerate(names)}
                words = [w.decode() for w in unpack_bytes(of["terms"]).split(b" ")]
                row = unpack_ints(of["term"], np.uint32).astype(np.int64)
                column = np.array([number[s] for s in of["sources"]], np.int64)[unpack_ints(of["source"], np.uint32)]
                n = unpack_ints(of["n"], np.int64)
                pairs, best, some = np.zeros((len(names),) * 2, np.int64), [[] for _ in names], max(1, MATRIX // len(names))
                for start in range(0, len(words), some):
                    x, y = np.searchsorted(row, [start, start + some])  # terms are numbered in their order
                    count = np.zeros((min(some, len(words) - start), len(names)), np.int64)
                    count[row[x:y] - start, column[x:y]] = n[x:y]
                    p = shares(count, totals, of["v"])
                    q = shares(count.sum(1), totals.sum(), of["v"])
                    for i in range(len(names)):
                        pairs[i, i + 1:] += apart(p[:, i:i + 1], p[:, i + 1:]).sum(0)
                        more = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                        value = apart(p[more, i], q[more])
                        if len(more) > top:  # whoever lies below the top values is not among them
                            least_of = np.partition(value, len(value) - top)[len(value) - top]
                            more, value = more[value >= least_of], value[value >= least_of]
                        best[i] = sorted(best[i] + [(-v, words[start + m]) for m, v in zip(more.tolist(), value.tolist())])[:top]
                pairs += pairs.T
                out = [("term", s, w, -v) for s, found in zip(names, best) for v, w in found]
                out += [("pair", s, t, int(pairs[i, j])) for i, s in enumerate(names) for j, t in enumerate(names) if i != j]
                yield pa.RecordBatch.from_arrays([pa.array([of["lang"]] * len(out), pa.string())] + [
                    pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                    ["lang", "part", "source", "item", "value"])

    parts = kept.drop("v").join(sources, "lang").repartition("terms").select("lang", "all", "v", "sources", "terms", "term", "source", "n").mapInArrow(
        compare, "lang string, part string, source string, item string, value long")
    one = sources.select("lang", F.explode("all.source").alias("source"), F.col("all.source").alias("others"))
    none = one.select("lang", F.lit("pair").alias("part"), "source", F.explode("others").alias("item"), F.lit(0).cast("long").alias("value")) \
        .where("item <> source")
    summed = parts.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = summed.withColumn("rank", F.row_number().over(by_value)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.total + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN l USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
whole AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM whole)
WHERE part = 'pair' OR rank <= {TOP}"""
