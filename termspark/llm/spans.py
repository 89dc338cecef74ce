"""Offsets of regular-expression matches with SQL functions alone.

``regexp_extract_all`` gives the leftmost non-overlapping matches and ``split``
with the same pattern the text between them; the running sum of their lengths
(in code points) gives each match's offsets.  The sum is taken in blocks of 256
matches, so its cost is linear also where a text has very many.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,stop:bigint,s:string,before:string,after:string>"
BLOCK = 256
#: Code points on either side of a match that are kept as its context.
CONTEXT = 40


def literal(text: str) -> str:
    """A raw SQL string literal."""
    quote = '"""' if False else "'"
    return "'" + text.replace("\\", "\\\\").replace(quote, "\\'") + "'"


def _runs() -> str:
    inner = f"""aggregate(slice(zip, b * {BLOCK} + 1, {BLOCK}),
        named_struct('pos', acc.pos, 'out', cast(array() as array<{SPAN}>)),
        (a, x) -> named_struct('pos', a.pos + x.lp + x.lm, 'out', concat(a.out, array(named_struct(
            'start', a.pos + x.lp, 'stop', a.pos + x.lp + x.lm, 's', x.s, 'before', x.b, 'after', x.f)))))"""
    return f"""flatten(aggregate(sequence(0, (size(zip) - 1) div {BLOCK}),
        named_struct('pos', 0L, 'out', cast(array() as array<array<{SPAN}>>)),
        (acc, b) -> transform(array({inner}), r -> named_struct('pos', r.pos, 'out', concat(acc.out, array(r.out))))[0],
        acc -> acc.out))"""


def _context(zip_: str) -> str:
    """The pieces next to each match become the text next to it: where one is shorter than
    CONTEXT, the matches and pieces beyond it follow.  No match is empty, so CONTEXT of them do."""
    return f"""transform({zip_}, (x, i) -> named_struct('lp', x.lp, 'lm', x.lm, 's', x.s,
        'b', case when i = 0 or length(x.b) >= {CONTEXT} then x.b else right(concat(array_join(transform(
            slice({zip_}, greatest(i - {CONTEXT - 1}, 1), least(i, {CONTEXT})), y -> concat(y.b, right(y.s, {CONTEXT}))), ''), x.b), {CONTEXT}) end,
        'f', case when i = size({zip_}) - 1 or length(x.f) >= {CONTEXT} then x.f else left(concat(x.f, array_join(transform(
            slice({zip_}, i + 2, {CONTEXT}), y -> concat(left(y.s, {CONTEXT}), y.f)), '')), {CONTEXT}) end))"""


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds one column for each name in ``patterns``: array<SPAN> of its matches in
    order of their start (null text: no matches).  ``patterns`` must not match the
    empty string.  The matches keep the CONTEXT code points of the text on
    either side of them, whatever matches lie there."""
    keep = df.columns
    found = df.select("*", *[F.coalesce(F.regexp_extract_all(F.col(text), F.lit(p), 0), F.array().cast("array<string>")).alias(f"_m_{k}")
                             for k, p in patterns.items()])
    pieces = found.select("*", *[F.expr(f"case when size(_m_{k}) > 0 then split({text}, {literal(p)}, -1) end").alias(f"_p_{k}")
                                 for k, p in patterns.items()])
    zipped = pieces.select(*keep, *[F.expr(f"""case when size(_m_{k}) > 0 then zip_with(
        zip_with(slice(_p_{k}, 1, size(_m_{k})), slice(_p_{k}, 2, size(_m_{k})), (p, q) -> named_struct('p', p, 'q', q)), _m_{k},
        (x, s) -> named_struct('lp', cast(length(x.p) as bigint), 'lm', cast(length(s) as bigint), 's', s,
                               'b', right(x.p, {CONTEXT}), 'f', left(x.q, {CONTEXT}))) end""").alias(f"_z_{k}") for k in patterns])
    zipped = zipped.select(*keep, *[F.expr(_context(f"_z_{k}")).alias(f"_z_{k}") for k in patterns])
    return zipped.select(*keep, *[F.expr(f"case when _z_{k} is null then cast(array() as array<{SPAN}>) else {_runs().replace('zip,', f'_z_{k},').replace('size(zip)', f'size(_z_{k})')} end").alias(k)
                                  for k in patterns])


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas; spans have kind, start, stop."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
