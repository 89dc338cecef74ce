"""Tokenise, tag and cut lines into segments.

Everything on the main path is row-local: a line's tokens, tags and segments are
computed inside the row with JVM array expressions, so no shuffle happens between
the line scan and the n-gram aggregation.  A lexicon or stop list given as a Python
mapping or sequence becomes an ``IN (...)`` list that the optimizer turns into a
hash-set lookup; a list of any size is given as a DataFrame and joined
(``tag_tokens_join``, ``cut_words_join``, ``tokenize_lexicon``).
"""
from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspark.functions import constants as K
from termspark.functions.text import col, sql_str

# A token is either a run of script letters or a run of other non-space
# characters; the latter are cut points (punctuation, digits, symbols).
LATIN_SCRIPT_CLASS = "a-zà-öø-ÿ"
LATIN_TOKEN_PATTERN = f"[{LATIN_SCRIPT_CLASS}]+|[^{LATIN_SCRIPT_CLASS} ]+"

# Dictionaries up to this many words travel to the tasks as one automaton; larger
# ones are joined.
BROADCAST_WORDS = 500_000
# A very common word is dealt out over this many keys in the lookup joins.
SALTS = 16


def _in_list(expr: str, words: Iterable[str]) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "false"
    return f"({expr} IN ({', '.join(sql_str(w) for w in words)}))"


def _once(df: DataFrame, *cols: Column) -> DataFrame:
    """``df.select(cols)`` as the output of a generator, so that no later filter or
    lambda makes Catalyst evaluate a column's expression a second time."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def dedup_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Exact line dedup (partial aggregation removes map-side copies)."""
    return df.select(line_col).dropDuplicates([line_col])


def tokenize(c, mode: str = "regex", pattern: str = LATIN_TOKEN_PATTERN,
             keep_empty: bool = False) -> Column:
    """P3 (whitespace / char / regex modes) as a Column of array<string>.

    * ``whitespace``: split on single spaces; empty tokens dropped unless
      ``keep_empty`` (then trailing empties are dropped as Java's split does).
    * ``char``: one token per character.
    * ``regex``: every match of ``pattern``.
    Use ``tokenize_lexicon`` for dictionary longest-match segmentation.
    """
    c = col(c)
    if mode == "whitespace":
        if keep_empty:
            cut = F.regexp_replace(c, r" +\z", "")
            return F.when((cut == "") & (c != ""), F.array().cast("array<string>")).otherwise(F.split(cut, " "))
        return F.filter(F.split(c, " "), lambda t: t != "")
    if mode == "char":
        return F.filter(F.split(c, ""), lambda t: t != "")
    if mode == "regex":
        return F.regexp_extract_all(c, F.lit(pattern), 0)
    raise ValueError(f"unknown tokenize mode {mode!r}")


def tokenize_lexicon(df: DataFrame, line_col: str, lexicon: DataFrame, out: str = "tokens",
                     broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """P3 lexicon mode: forward longest match against a dictionary (``word`` column).

    At each place the longest dictionary word starting there is a token, else one
    character; spaces outside words are dropped; a null line gives null.  Words of one
    character or with a leading space change nothing.  A dictionary of up to
    ``broadcast_words`` words is one automaton in each task; a larger one is joined
    to the lines' substrings.  The result is the same.
    """
    words = lexicon.select("word").where("length(word) > 1 and not startswith(word, ' ')").distinct()
    if words.count() > broadcast_words:
        return _match_by_join(df, line_col, words, out)
    sent = df.sparkSession.sparkContext.broadcast([r["word"] for r in words.collect()])
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        import ahocorasick

        longest = ahocorasick.Automaton()
        for w in sent.value:
            longest.add_word(w, len(w))
        if sent.value:
            longest.make_automaton()

        def cut(line):
            if line is None:
                return None
            tokens, at = [], 0
            for end, n in longest.iter_long(line) if sent.value else ():
                tokens.extend(line[at:end + 1 - n].replace(" ", ""))
                tokens.append(line[end + 1 - n:end + 1])
                at = end + 1
            tokens.extend(line[at:].replace(" ", ""))
            return tokens

        for pdf in batches:
            pdf[out] = [cut(x) for x in pdf[line_col]]
            yield pdf

    return df.mapInPandas(run, schema)


def _match_by_join(df: DataFrame, line_col: str, words: DataFrame, out: str) -> DataFrame:
    """Longest match without shipping the dictionary: substrings of distinct lines that
    are as long as some word, joined to the words; then one walk over each line."""
    lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect())  # a row a length
    lines = df.select(F.col(line_col).alias("_line")).where("_line is not null").distinct()
    places = lines.select("_line", F.explode(F.expr("sequence(1, greatest(length(_line), 1))")).alias("_i"))
    subs = places.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("_i") + F.col("_n") - 1 <= F.length("_line")) \
        .select("_line", "_i", "_n", F.expr("substring(_line, _i, _n)").alias("word"))
    best = subs.join(words, "word", "left_semi").groupBy("_line", "_i").agg(F.max("_n").alias("_n"))
    hits = best.groupBy("_line").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_n"))).alias("_at"))
    walked = lines.join(hits, "_line", "left").select("_line", F.expr("""aggregate(sequence(1, length(_line)),
        named_struct('next', 1, 'out', cast(array() as array<string>)),
        (a, i) -> case when i < a.next then a
          when _at is not null and _at[i] is not null then named_struct('next', i + _at[i], 'out', concat(a.out, array(substring(_line, i, _at[i]))))
          when substring(_line, i, 1) = ' ' then named_struct('next', i + 1, 'out', a.out)
          else named_struct('next', i + 1, 'out', concat(a.out, array(substring(_line, i, 1)))) end,
        a -> a.out)""").alias(out)).where("length(_line) > 0") \
        .union(lines.where("length(_line) = 0").select("_line", F.array().cast("array<string>")))
    return df.join(walked, F.col(line_col) == F.col("_line"), "left").drop("_line")


def pos_tags(tokens_col: str, lexicon: Mapping[str, Sequence[str]] | None = None,
             default_pos: str = "n", nonscript_pos: str = "w",
             script_class: str = K.SCRIPT_CLASS_CJK) -> Column:
    """POS of every token: lexicon lookup (first listed tag wins), tokens with
    any non-script character get ``nonscript_pos``, the rest ``default_pos``."""
    branches = []
    for pos, words in (lexicon or {}).items():
        branches.append(f"WHEN {_in_list('t', words)} THEN {sql_str(pos)}")
    case = (f"CASE WHEN NOT (t rlike {sql_str('^[' + script_class + ']+' + chr(92) + 'z')}) "
            f"THEN {sql_str(nonscript_pos)} {' '.join(branches)} ELSE {sql_str(default_pos)} END")
    return F.expr(f"transform({tokens_col}, t -> {case})")


def _found_words(df: DataFrame, id_col: str, tokens_col: str, words: DataFrame) -> DataFrame:
    """(id, word, other columns of ``words``): the listed words among each line's
    distinct tokens.  Both sides are salted by the line, so a word that is in every
    line is no single join key; AQE broadcasts the list where it is small."""
    t = df.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(tokens_col)).alias("_t")) \
        .withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)))
    w = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return t.join(w, (t["_t"] == w["word"]) & (t["_salt"] == w["_salt"])).select("_id", *words.columns)


def tag_tokens_join(df: DataFrame, id_col: str, tokens_col: str, lexicon_df: DataFrame,
                    out: str = "pos", default_pos: str = "n", nonscript_pos: str | None = None,
                    script_class: str | None = None) -> DataFrame:
    """POS lookup as a join, for a lexicon ``(word, pos)`` of any size.

    A word listed with several tags gets the one with the smallest ``ord`` (if the
    lexicon has that column), else the smallest tag.  Every line stays, one without
    tokens with an empty array.  With ``nonscript_pos`` and ``script_class`` tokens with any
    other character get that tag.  ``id_col`` must name a line.
    """
    first = F.min_by("pos", "ord") if "ord" in lexicon_df.columns else F.min("pos")
    lex = lexicon_df.groupBy("word").agg(first.alias("pos"))
    found = _found_words(df, id_col, tokens_col, lex).groupBy("_id") \
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "pos"))).alias("_tags"))
    j = df.join(found, F.col(id_col) == F.col("_id"), "left")
    tag = f"coalesce(_tags[t], {sql_str(default_pos)})"
    if nonscript_pos and script_class:
        tag = f"CASE WHEN NOT (t rlike {sql_str('^[' + script_class + ']+' + chr(92) + 'z')}) THEN {sql_str(nonscript_pos)} ELSE {tag} END"
    return j.select(*df.columns, F.expr(f"transform({tokens_col}, t -> {tag})").alias(out))


def cut_words_join(df: DataFrame, id_col: str, tokens_col: str, words: DataFrame, out: str = "segments") -> DataFrame:
    """P5 with a stop list (``word`` column) of any size: the runs between stop words."""
    found = _found_words(df, id_col, tokens_col, words.select("word").distinct()).groupBy("_id") \
        .agg(F.collect_list("word").alias("_cuts"))
    j = df.join(found, F.col(id_col) == F.col("_id"), "left")
    flags = F.expr(f"transform({tokens_col}, t -> coalesce(array_contains(_cuts, t), false))")
    return _segments(j, [F.col(c) for c in df.columns], F.col(tokens_col), flags, out)


def cut_flags_sql(tok: str, pos: str | None, stop_words: Sequence[str],
                  cut_pos_prefixes: Sequence[str], script_class: str | None) -> str:
    """SQL predicate over a token expression ``tok`` (and its tag ``pos``)
    that is true at a segment cut: POS prefix, non-script character, or stop
    word."""
    conds = []
    if pos and cut_pos_prefixes:
        conds.extend(f"startswith({pos}, {sql_str(p)})" for p in cut_pos_prefixes)
    if script_class:
        conds.append(f"NOT ({tok} rlike {sql_str('^[' + script_class + ']+' + chr(92) + 'z')})")
    if stop_words:
        conds.append(_in_list(tok, stop_words))
    return "(" + " OR ".join(conds) + ")" if conds else "false"


def _segments(df: DataFrame, keep: list[Column], tokens: Column, flags: Column, out: str) -> DataFrame:
    """Runs of tokens between flagged ones, which are dropped, by position alone: a
    token may hold any character.  Tokens, flags and cut positions are each computed
    once a row, so the cost is linear in the line."""
    a = _once(df, *keep, tokens.alias("_t"), flags.alias("_f"))
    names = [c for c in a.columns if c not in ("_t", "_f")]
    cuts = "filter(transform(_f, (f, i) -> CASE WHEN f THEN i END), x -> x IS NOT NULL)"
    b = _once(a, *[F.col(c) for c in names], F.col("_t"), F.expr(f"concat(array(-1), {cuts}, array(size(_t)))").alias("_b"))
    runs = ("filter(zip_with(slice(_b, 1, size(_b) - 1), slice(_b, 2, size(_b) - 1), "
            "(x, y) -> slice(_t, x + 2, y - x - 1)), s -> size(s) > 0)")
    return _once(b, *[F.col(c) for c in names if c != out], F.expr(f"CASE WHEN _t IS NOT NULL THEN {runs} END").alias(out))


def add_segments(df: DataFrame, tokens_col: str = "tokens", pos_col: str | None = None,
                 out: str = "segments", stop_words: Sequence[str] = (),
                 cut_pos_prefixes: Sequence[str] = K.CUT_POS_PREFIXES,
                 script_class: str | None = K.SCRIPT_CLASS_CJK) -> DataFrame:
    """Cut the token array at cut tokens (which are dropped) and keep the
    non-empty runs between them.  P5 (stop words only) is
    ``cut_pos_prefixes=(), script_class=None``."""
    if pos_col:
        cut = cut_flags_sql("t", "p", stop_words, cut_pos_prefixes, script_class)
        flags = F.expr(f"zip_with({tokens_col}, {pos_col}, (t, p) -> coalesce({cut}, false))")
    else:
        cut = cut_flags_sql("t", None, stop_words, cut_pos_prefixes, script_class)
        flags = F.expr(f"transform({tokens_col}, t -> coalesce({cut}, false))")
    return _segments(df, [F.col(c) for c in df.columns], F.col(tokens_col), flags, out)


def explode_segments(df: DataFrame, segments_col: str = "segments", out: str = "seg", keep: Sequence[str] = ()) -> DataFrame:
    return _once(df, *[F.col(c) for c in keep], F.col(segments_col).alias("_s")).select(*keep, F.explode("_s").alias(out))


def cut_words(lexicon: Mapping[str, Sequence[str]] | None, stop_words: Sequence[str],
              cut_pos_prefixes: Sequence[str] = K.CUT_POS_PREFIXES) -> list[str]:
    """Words that always cut: stop words plus lexicon words whose (first
    listed) tag starts with a cut prefix."""
    tag: dict[str, str] = {}
    for pos, words in (lexicon or {}).items():
        for w in words:
            tag.setdefault(w, pos)
    cut = [w for w, p in tag.items() if any(p.startswith(x) for x in cut_pos_prefixes)]
    return list(dict.fromkeys(list(stop_words) + cut))


# Marks cuts and joins words inside one line of a script; both characters are outside
# every script class, and what is outside the class has become a cut before they come in.
_CUT = "\x01"
_SEP = "\x02"


def segment_lines(df: DataFrame, line: Column, script_class: str, words_that_cut: Sequence[str],
                  out: str = "segments", keep: Sequence[str] = ()) -> DataFrame:
    """P3+P4 fused for regex-tokenised scripts: every run of non-script,
    non-space characters becomes a cut marker at the line level (one regex
    per line), the line is split into words, cut words (one hash-set lookup
    each) become markers, and the segments are the runs between markers.

    Same result as ``tokenize(regex) -> pos_tags -> add_segments`` when the
    default tag of a script word does not cut, at a fraction of the cost.
    """
    marked = F.regexp_replace(line, f"[^{script_class} ]+", f" {_CUT} ")
    words = _once(df, *[F.col(c) for c in keep], F.split(marked, " +").alias("_w"))
    inl = _in_list("t", words_that_cut)
    segments = F.expr(
        f"filter(transform(split(array_join(transform(_w, t -> CASE WHEN {inl} THEN '{_CUT}' ELSE t END), "
        f"'{_SEP}'), '{_CUT}'), p -> filter(split(p, '{_SEP}'), x -> x != '')), s -> size(s) > 0)")
    return words.select(*keep, segments.alias(out))


def _any_of(words: Iterable[str]) -> str:
    """A pattern of the words, which may hold any character; words that begin alike share
    their beginning, so that a place in a text is compared once and not once a word."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [("" if ch.isalnum() else "\\") + ch + pattern(below) for ch, below in node.items() if ch]
        if not parts:
            return ""
        rest = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return rest + ("?" if "" in node else "")

    return pattern(tree)


def segment_rows(df: DataFrame, line: Column, script_class: str, words_that_cut: Sequence[str],
                 out: str = "seg", joiner: str = " ", keep: Sequence[str] = ()) -> DataFrame:
    """P3+P4 as :func:`segment_lines`, one row per segment, its tokens joined by ``joiner``.

    One expression matches whole segments: words of the script that are no cut words, with
    spaces between them.  Each character is looked at once, no array of words is built
    for a line, and the possessive repeats need no stack however long a segment is."""
    words = [w for w in dict.fromkeys(words_that_cut) if re.fullmatch(f"[{script_class}]+", w)]  # others are no word
    word = (f"(?!(?:{_any_of(words)})(?![{script_class}]))" if words else "") + f"[{script_class}]++"
    found = F.regexp_extract_all(line, F.lit(f"(?<![{script_class}]){word}(?: ++{word})*+"), F.lit(0))
    rows = _once(df, *[F.col(c) for c in keep], found.alias("_s")).select(*keep, F.explode("_s").alias("_s"))
    one_space = F.when(F.contains("_s", F.lit("  ")), F.regexp_replace("_s", " +", joiner)).otherwise(F.replace("_s", F.lit(" "), F.lit(joiner)))
    return rows.select(*keep, one_space.alias(out))


# -- tokens of Arrow batches --------------------------------------------------------------

#: Bytes of lines that a task takes at a time, and pieces of them that are copied at a time.
CHUNK_BYTES, PIECES = 8_000_000, 100_000
SPACE, SCRIPT, OTHER = 0, 1, 2


@functools.lru_cache(maxsize=4)
def char_kinds(script_class: str) -> np.ndarray:
    """``SPACE``, ``SCRIPT`` or ``OTHER`` of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for m in re.finditer(f"[{script_class}]+", "".join(map(chr, range(0x110000)))):
        kinds[m.start():m.end()] = SCRIPT
    kinds[ord(" ")] = SPACE
    return kinds


def give_back() -> None:
    """Memory that a worker has freed goes back to the system: workers stay, and wait, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task put together to about ``CHUNK_BYTES`` each."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.nbytes
        if n >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def line_bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, with four zeros behind them, and the places where its lines begin and end."""
    lines = lines.cast(pa.large_string())
    _, at, data = lines.buffers()
    at = np.frombuffer(at, np.int64)[lines.offset:lines.offset + len(lines) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.r_[data, np.zeros(4, np.uint8)], at - at[0]


def wide_chars(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the characters of two and more bytes, and their code points."""
    at = np.flatnonzero(data >= 0xC0)
    b, n1, n2, n3 = (data[at + i].astype(np.int32) for i in range(4))
    n1, n2, n3 = n1 & 63, n2 & 63, n3 & 63
    return at, np.where(b < 0xE0, (b & 31) << 6 | n1, np.where(b < 0xF0, (b & 15) << 12 | n1 << 6 | n2, (b & 7) << 18 | n1 << 12 | n2 << 6 | n3))


def token_places(data: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P3 of :func:`line_bytes`: (first byte, byte behind, kind, line) of each token in order, the
    matches of ``[script]+|[^script ]+``."""
    total = int(at[-1])
    kind = kinds[:256][data]
    wide, code = wide_chars(data)
    of, width = kinds[code], 2 + (code >= 0x800) + (code >= 0x10000)
    for i in range(4):
        kind[wide[width > i] + i] = of[width > i]
    new = np.ones(total, bool)
    new[1:] = kind[1:total] != kind[:total - 1] if total else []
    new[at[:-1][at[:-1] < total]] = True
    start = np.flatnonzero(new)
    end, kind = np.r_[start[1:], total][:len(start)], kind[start]
    mine = kind != SPACE
    start, end, kind = start[mine], end[mine], kind[mine]
    return start, end, kind, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces, one behind the other, and the places where pieces begin and end."""
    at = np.r_[0, np.cumsum(size)]
    out = np.empty(at[-1], np.uint8)
    for i in range(0, len(size), PIECES):
        j = min(i + PIECES, len(size))
        out[at[i]:at[j]] = data[np.arange(at[i], at[j]) + np.repeat(start[i:j] - at[i:j], size[i:j])]
    return out, at


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Pieces of the bytes as strings."""
    got, at = gathered(data, start, end - start)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(got))
