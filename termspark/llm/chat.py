"""Chat formatting by perspective rotation.

A dialogue of several parties is rendered once for each participant: that
speaker's turns become the assistant's, all other speakers become named users,
and system turns stay what they are.  The training mask covers the assistant's
texts with their end marks and nothing else.

The result has one row for each perspective and turn, with the turn's rendering
and its place in the whole rendering; so a dialogue of any length is spread over
rows, and nothing gathers it.  The places are running sums, taken first inside
chunks of turns and then over the chunks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that share one running sum.
CHUNK = 256
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def _escaped(c: Column) -> Column:
    """A text or name can't forge a header or an end mark."""
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """(conv_id, perspective, turn, seq, role, name, rendered, start, stop,
    mask_start, mask_stop): offsets in code points of the perspective's rendering.

    A participant is a distinct ``role`` value other than ``system``; a dialogue
    without any (system turns alone) has no perspective and gives no rows.  A null
    role is the participant ``unknown``, a null text is empty, a null conv_id is a
    dialogue of its own, and turns go by number (nulls first), then role, then
    text; repeated rows are repeated turns.  ``mask_start`` and ``mask_stop`` are
    null where nothing is trained on.  Other columns are left aside.
    """
    base = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    people = base.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = base.join(people, base["conv_id"].eqNullSafe(people["c"])).drop("c")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    out_role = F.when(system, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~system & ~own, F.col("speaker"))
    head = F.concat(F.lit("<|"), out_role, F.when(name.isNotNull(), F.concat(F.lit(" name="), _escaped(name))).otherwise(F.lit("")), F.lit("|>\n"))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", "t", out_role.alias("role"), name.alias("name"), head.alias("head"),
                       F.concat(_escaped(F.col("t")), F.lit(END)).alias("body"), own.alias("own"),
                       F.floor(F.col("turn") / chunk).alias("k"))
    rows = rows.withColumn("n", (F.length("head") + F.length("body")).cast("long"))
    sums = rows.groupBy("conv_id", "perspective", "k").agg(F.sum("n").alias("kn"), F.count("*").alias("kc"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("k").alias("kk"),
                       F.coalesce(F.sum("kn").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("kc").over(before), F.lit(0)).alias("s"))
    inside = Window.partitionBy("conv_id", "perspective", "k").orderBy("turn", "speaker", "t")
    placed = (rows.withColumn("e", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("i", F.row_number().over(inside) - 1))
    joined = placed.join(sums, placed["conv_id"].eqNullSafe(sums["c"]) & (placed["perspective"] == sums["p"]) & placed["k"].eqNullSafe(sums["kk"]))
    start = F.col("b") + F.col("e") - F.col("n")
    return joined.select(
        "conv_id", "perspective", "turn", (F.col("s") + F.col("i")).cast("long").alias("seq"), "role", "name",
        F.concat("head", "body").alias("rendered"), start.alias("start"), (F.col("b") + F.col("e")).alias("stop"),
        F.when(F.col("own"), start + F.length("head")).alias("mask_start"), F.when(F.col("own"), F.col("b") + F.col("e")).alias("mask_stop"))


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendering, masks): whole renderings, for dialogues that
    fit into a row; masks are the (start, stop) that are trained on."""
    turn = F.struct("seq", "rendered", "mask_start", "mask_stop")
    return rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("a")).select(
        "conv_id", "perspective", F.array_join(F.col("a.rendered"), "").alias("rendering"),
        F.transform(F.filter("a", lambda x: x["mask_start"].isNotNull()),
                    lambda x: F.struct(x["mask_start"].alias("start"), x["mask_stop"].alias("stop"))).alias("masks"))


ORACLE_SQL = r"""
WITH base AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS t FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM base WHERE speaker <> 'system'),
r AS (SELECT conv_id, perspective, turn, speaker, t, speaker = perspective AS own,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN speaker NOT IN ('system', perspective) THEN speaker END AS name
      FROM base JOIN people ON conv_id IS NOT DISTINCT FROM c),
h AS (SELECT *, '<|' || role || coalesce(' name=' || replace(name, '<|', '<\|'), '') || '|>' || chr(10) AS head,
        replace(t, '<|', '<\|') || '<|end|>' || chr(10) AS body FROM r),
w AS (SELECT *, CAST(sum(length(head) + length(body)) OVER o AS BIGINT) AS stop, row_number() OVER o - 1 AS seq FROM h
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, t ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, seq, role, name, head || body AS rendered,
  stop - length(head) - length(body) AS start, stop,
  CASE WHEN own THEN stop - length(body) END AS mask_start, CASE WHEN own THEN stop END AS mask_stop
FROM w"""
