"""The registered queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm import bpe, chat, divergence, lm, negatives, pii, secrets, shard, toxicity
from termspark.llm.caps import near_vectors
from termspark.llm.common import crc_of_id, table
from termspark.llm.decontaminate import contaminated
from termspark.llm.near_dup import near_duplicates
from termspark.llm.repeats import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


#: Fixed values of the queries.
SHARDS, LEAST_TOXIC, VOCABULARY, ORDER = 40, 0.7, "byte_bpe_50k.tiktoken", 3


@register("op1_sharding")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64("text").alias("text_hash"))
    out = shard.assign_shards(slim, SHARDS, key="text_hash", size="size", tie=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op2_secret_scan")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    return secrets.digests(secrets.find_secrets(docs, secrets.train(docs)))


@register("op3_lm_scoring")
def op3(spark, sf):
    return lm.score(table(spark, sf, "documents"), order=ORDER)


@register("op4_minhash_near_dup")
def op4(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).drop("node", "group")


#: Words as DuckDB SQL: A-Z lowered, runs of anything but the six ASCII white-space characters.
_WORDS = (r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x20\x09-\x0D]+')")


def _shingles(key: str, tbl: str) -> str:
    return f"""SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
        ELSE array_to_string(w[i:i + 4], ' ') END AS s, least(len(w), 5) AS k
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
            FROM (SELECT {key}, {_WORDS.format(t='text')} AS w FROM {tbl}) WHERE len(w) > 0)"""


@register("op6_decontamination", f"""
WITH q AS ({_shingles('item_id', 'benchmark')}),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s, k
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents), (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (s, k) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item""")
def op6(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op5_byte_bpe")
def op5(spark, sf):
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.round_trip(table(spark, sf, "documents"), path, public_tokenizers.PATTERN))


@register("op7_pii")
def op7(spark, sf):
    return pii.digests(pii.find_pii(table(spark, sf, "documents")))


@register("op8_toxicity")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    tagged = toxicity.tag(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return tagged.select("doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"),
                         "score", (F.col("score") >= LEAST_TOXIC).cast("int").alias("predicted"), "spans")


@register("op9_embedding_near_dup")
def op9(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))


@register("op10_chat_formatting", chat.ORACLE_SQL)
def op10(spark, sf):
    return chat.rotate(table(spark, sf, "conversations"))


@register("op11_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
cover AS (SELECT doc_id, words.i, word, max(gone.i) OVER (PARTITION BY doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
          FROM words LEFT JOIN gone USING (doc_id, i)),
per AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
        FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)""")
def op11(spark, sf):
    out = remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op12_source_divergence", divergence.ORACLE_SQL)
def op12(spark, sf):
    return divergence.divergence(table(spark, sf, "documents"))


@register("op13_hard_negatives", negatives.ORACLE_SQL)
def op13(spark, sf):
    return negatives.hard_negatives(table(spark, sf, "embeddings"))
