"""Operator 4, chat formatting for preferences: pairs of conversations that part after a common beginning.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered
once as the prompt; the turns after it become two completions. Masked completions: next to each completion stands the
list of its turns' character spans with a mask, 1 where a loss counts (turns of the assistant), 0 elsewhere.

Turns are first gathered to one row for each conversation, then joined to the list of pairs on either side, so a
conversation that a third of all pairs share is replicated by the join alone, which Spark can split; nothing is
compared but the two members of a pair. answered_otherwise() makes pairs of a table without preferences: every
conversation, chosen, and the same with the last answer of the next one, rejected.

Defined results: turns are ordered by number, ties by role and text, null numbers first; a null role or text counts as
the empty string; conversations without turns aren't there, and pairs that name one are left out; equal conversations
give two empty completions; repeated pairs give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEARNED = "assistant"
TURN = ("<|", "|>\n", "\n<|end|>\n")


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row for each conversation. A conversation is one unit of work, as in every chat format."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common(a: str, b: str) -> Column:
    """How many turns two conversations begin with in common."""
    parts = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(F.transform(parts, lambda same: ~F.coalesce(same, F.lit(False))), True)
    return F.when(first > 0, first - 1).otherwise(F.size(parts)).cast("int")


def rendered(turns: Column) -> Column:
    a, b, c = map(F.lit, TURN)
    return F.array_join(F.transform(turns, lambda t: F.concat(a, t["role"], b, t["text"], c)), "")


def masks(turns: Column, learned: str = LEARNED) -> Column:
    """array<struct<start, end, mask>>: each turn's span in the rendered completion, its header outside the loss."""
    a, b, c = map(len, TURN)
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + (a + b + c)
    before = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0), lambda n, t: n + size(t))
    return F.transform(
        turns,
        lambda t, i: F.struct(
            (before(i) + F.length(t["role"]) + (a + b)).alias("start"),
            (before(i) + size(t)).alias("end"),
            F.when(t["role"] == learned, 1).otherwise(0).alias("mask"),
        ),
    )


def preferences(turns: DataFrame, pairs: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row for each of pairs (chosen, rejected: conv_ids): prompt, completions and their masks."""
    own = gathered(turns)
    side = lambda k: own.select(F.col("conv_id").alias(k), F.col("turns").alias(f"{k}_turns"))
    return formatted(pairs.select("chosen", "rejected").join(side("chosen"), "chosen").join(side("rejected"), "rejected"), learned)


def formatted(both: DataFrame, learned: str = LEARNED) -> DataFrame:
    """The columns of preferences() for rows of chosen, rejected, chosen_turns and rejected_turns."""
    both = both.withColumn("n_common", common("chosen_turns", "rejected_turns"))
    rest = lambda k: F.slice(f"{k}_turns", F.col("n_common") + 1, F.size(f"{k}_turns"))
    return both.select(
        "chosen",
        "rejected",
        F.col("n_common").cast("long").alias("n_common"),
        rendered(F.slice("chosen_turns", F.lit(1), F.col("n_common"))).alias("prompt"),
        *(x for k in ("chosen", "rejected") for x in (rendered(rest(k)).alias(f"{k}_completion"), masks(rest(k), learned).alias(f"{k}_masks"))),
    )


def answered_otherwise(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """chosen, rejected, chosen_turns, rejected_turns: each conversation, and the same where its last turn of the learned
    role has the text of the one of conversation conv_id + 1 (none: empty). The rejected one's number is -1 - conv_id."""
    own = gathered(turns.where("conv_id is not null"))
    at = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == learned, i))), F.lit(-1))
    own = own.withColumn("at", at)
    others = own.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("at"))["text"].alias("other"))
    both = own.join(others, "conv_id", "left")
    changed = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("at"), F.coalesce("other", F.lit(""))).otherwise(t["text"]).alias("text")))
    return both.select(F.col("conv_id").alias("chosen"), (-1 - F.col("conv_id")).alias("rejected"), F.col("turns").alias("chosen_turns"), changed.alias("rejected_turns"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda k: F.concat_ws(",", F.transform(f"{k}_masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"), m["mask"].cast("string"))))
    out = formatted(answered_otherwise(table(spark, sf_dir, "conversations")))
    return out.select("chosen", "rejected", "n_common", "prompt", "chosen_completion", "rejected_completion", said("chosen").alias("chosen_masks"), said("rejected").alias("rejected_masks"))


SQL = """
WITH t AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) AS at FROM t),
b AS (
  SELECT l.conv_id AS chosen, -1 - l.conv_id AS rejected, l.turns AS ct,
    list_transform(range(1, len(l.turns) + 1), lambda i: CASE WHEN i = l.at THEN struct_pack(role := l.turns[i].role, txt := coalesce(o.turns[o.at].txt, '')) ELSE l.turns[i] END) AS rt
  FROM l LEFT JOIN l o ON o.conv_id = l.conv_id + 1),
c AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(ct), len(rt)) + 1), lambda i: ct[i] IS NOT DISTINCT FROM rt[i]), false) - 1, len(ct)) AS n FROM b),
d AS (SELECT *, ct[n + 1:] AS cr, rt[n + 1:] AS rr FROM c)
SELECT chosen, rejected, CAST(n AS BIGINT) AS n_common,
  coalesce(array_to_string(list_transform(ct[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.txt || chr(10) || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(cr, lambda x: '<|' || x.role || '|>' || chr(10) || x.txt || chr(10) || '<|end|>' || chr(10)), ''), '') AS chosen_completion,
  coalesce(array_to_string(list_transform(rr, lambda x: '<|' || x.role || '|>' || chr(10) || x.txt || chr(10) || '<|end|>' || chr(10)), ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(range(1, len(cr) + 1), lambda i: CAST(coalesce(list_sum(list_transform(cr[1:i - 1], lambda x: length(x.role) + length(x.txt) + 14)), 0) + length(cr[i].role) + 5 AS BIGINT) || ':' || CAST(coalesce(list_sum(list_transform(cr[1:i], lambda x: length(x.role) + length(x.txt) + 14)), 0) AS BIGINT) || ':' || CASE WHEN cr[i].role = 'assistant' THEN 1 ELSE 0 END), ','), '') AS chosen_masks,
  coalesce(array_to_string(list_transform(range(1, len(rr) + 1), lambda i: CAST(coalesce(list_sum(list_transform(rr[1:i - 1], lambda x: length(x.role) + length(x.txt) + 14)), 0) + length(rr[i].role) + 5 AS BIGINT) || ':' || CAST(coalesce(list_sum(list_transform(rr[1:i], lambda x: length(x.role) + length(x.txt) + 14)), 0) AS BIGINT) || ':' || CASE WHEN rr[i].role = 'assistant' THEN 1 ELSE 0 END), ','), '') AS rejected_masks
FROM d
"""

QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLES = {"op4_chat_formatting": SQL}
