"""Personal data with SQL functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod-97 for account numbers, ranges and digit counts for the others), and context
words within 40 code points before or after raise a span's score.  Spans of the
base kinds always stay; spans of the further kinds are reported from ``least`` on:
an account number needs its checksum, a social number needs a context word.

The base patterns are written with possessive quantifiers and with the start of a
run as left border, which match what the plain forms match, in linear time and
without recursion on very long runs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import only
from termspark.llm.spans import joined, literal, with_spans

# Patterns, priors and context words.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|server|host|address|login",
    "card": "card|visa|master|amex|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": r"ssn|social|security|tax",
}
CONTEXT_SCORE, LEAST = 0.3, 0.5


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL for the Luhn check of a string of digits."""
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) ->
        case when i % 2 = 0 then cast(c as int) when cast(c as int) > 4 then 2 * cast(c as int) - 9 else 2 * cast(c as int) end),
        0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"""


def mod97(s: str) -> str:
    """SQL for the mod-97 check of an account number of upper-case letters and digits."""
    return f"""aggregate(transform(split(concat(substring({s}, 5), left({s}, 4)), ''), c -> ascii(c)), 0, (a, x) ->
        case when x between 48 and 57 then (a * 10 + x - 48) % 97 when x between 65 and 90 then (a * 100 + x - 55) % 97 else a end) = 1"""


#: SQL over a span m: does the validator confirm it?
VALID = {
    "email": "true",
    "ip": "forall(split(m.s, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"length({_digits('m.s')}) between 13 and 19 and {luhn(_digits('m.s'))}",
    "phone": f"length({_digits('m.s')}) between 9 and 15",
    "iban": f"length(replace(m.s, ' ', '')) between 15 and 34 and {mod97("replace(m.s, ' ', '')")}",
    "ssn": "m.s not rlike '^(000|666|9)' and m.s not rlike '^...-00' and m.s not rlike '-0000$'",
}


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, findings): one row per document row; findings hold (kind, start,
    stop, score) by kind in the order of PATTERNS, then by start; offsets are code
    points, stop exclusive.

    A null text counts as empty; ids may be null or repeat; other columns are left
    aside; a span that fails its validator is dropped and not tried again.
    """
    base = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return _findings(base, "t", least).select("doc_id", "findings")


def _findings(df: DataFrame, text: str, least: float) -> DataFrame:
    found = with_spans(df, text, PATTERNS)

    def scored(k):
        words = literal(f"(?i){CONTEXT_WORDS[k]}")
        spans = f"""transform(filter({k}, m -> {VALID[k]}), m -> named_struct('kind', '{k}', 'start', m.start, 'stop', m.stop, 'score',
            {PRIOR[k]}D + case when m.before rlike {words} or m.after rlike {words} then {CONTEXT_SCORE}D else 0D end))"""
        return spans if k in BASE else f"filter({spans}, m -> m.score >= {float(least)}D)"

    return found.select(*df.columns, F.expr("concat(" + ", ".join(map(scored, PATTERNS)) + ")").alias("findings"))


def redact(docs: DataFrame, *, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with the findings in ``text`` replaced by <KIND>; spans that overlap
    are replaced as one, named after the one that starts first (the earlier kind
    on a tie).  All rows and columns stay; null texts stay null."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    t = f"c{names.index(text)}"
    hits = _findings(inner, t, least).withColumn("ordered", F.expr("array_sort(transform(findings, (f, i) -> named_struct('start', f.start, 'rank', i, 'stop', f.stop, 'kind', f.kind)))"))
    merged = hits.withColumn("merged", F.expr("""aggregate(ordered, cast(array() as array<struct<start:bigint,stop:bigint,kind:string>>),
        (a, x) -> case when size(a) > 0 and element_at(a, -1).stop > x.start
          then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,
               'stop', greatest(element_at(a, -1).stop, x.stop), 'kind', element_at(a, -1).kind)))
          else concat(a, array(named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind))) end)"""))
    clean = F.expr(f"""case when size(findings) = 0 then {t} else concat(
        array_join(transform(merged, (x, i) -> concat(
            substring({t}, cast(case when i = 0 then 0 else merged[i - 1].stop end as int) + 1,
                      cast(x.start - case when i = 0 then 0 else merged[i - 1].stop end as int)), '<', upper(x.kind), '>')), ''),
        substring({t}, cast(element_at(merged, -1).stop as int) + 1)) end""")
    return merged.select(*[(clean if f"c{i}" == t else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans, and their scores in the
    same order (``scores``: numbers, comma-joined)."""
    base = F.expr("filter(findings, f -> f.kind in ('email', 'ip', 'card', 'phone'))")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
        F.expr("array_join(transform(findings, f -> cast(round(f.score, 2) as string)), ',')").alias("scores"))
