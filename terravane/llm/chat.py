"""Preference formatting of chat conversations.

A pair is a chosen and a rejected conversation.  Their longest common turn prefix is rendered once as
the prompt; what follows in each is rendered as its completion, with a mask that names the stretches a
model is trained on: the assistant's texts with their end marks.  Masks are "start:length" in characters
of the completion, joined by ";".  All of it is DataFrame functions.

Defined cases: turns are ordered by turn number, null first, then role and text; null roles and texts are
rendered empty, and equal nulls count as common; rows without a conversation id belong to no pair and
are left out; a pair with one conversation only has no common prefix and a null completion on the
other side; equal conversations have empty completions.  A pair is one output row, so its turns
meet in one row; that group is one training example and no larger than it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import table

OPEN, MIDDLE, CLOSE, TRAINED = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Stretches of the trained turns in the rendered text."""
    head = len(OPEN) + len(MIDDLE)

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + head + F.length(turn["role"])
        size = F.length(turn["text"]) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), size.cast("string"))
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + size).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, empty, add, lambda state: state["spans"]), ";")


def format_preferences(turns: DataFrame) -> DataFrame:
    """From (pair_id, side, conv_id, turn, role, text), side being chosen or rejected, one row per pair."""
    # nulls in front become a struct field, so that a null and an empty text stay different turns
    said = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.col("role").isNull().alias("r"), F.col("text").isNull().alias("t")).alias("absent"),
    )
    sides = turns.groupBy("pair_id").agg(
        *[
            column
            for side in ("chosen", "rejected")
            for column in (
                F.array_sort(F.collect_list(F.when(F.col("side") == side, said))).alias(side),
                F.min(F.when(F.col("side") == side, F.col("conv_id"))).alias(f"{side}_id"),
            )
        ]
    )
    shorter = F.least(F.size("chosen"), F.size("rejected"))

    def same(i: Column) -> Column:
        a, b = F.get("chosen", i), F.get("rejected", i)
        return (a["role"] == b["role"]) & (a["text"] == b["text"]) & (a["absent"] == b["absent"])

    differs = F.array_position(F.transform(F.sequence(F.lit(0), shorter - 1), same), F.lit(False))
    common = (
        F.when(shorter == 0, F.lit(0)).when(differs == 0, shorter).otherwise(differs.cast("int") - 1).cast("int")
    )
    cut = sides.withColumn("n_common_turns", common)
    ends = {}
    for side in ("chosen", "rejected"):
        rest = F.slice(side, F.col("n_common_turns") + 1, F.size(side))
        there = F.size(side) > 0
        ends[f"{side}_completion"] = F.when(there, _rendered(rest))
        ends[f"{side}_mask"] = F.when(there, _mask(rest))
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common_turns",
        _rendered(F.slice("chosen", F.lit(1), F.col("n_common_turns"))).alias("prompt"),
        *[column.alias(name) for name, column in ends.items()],
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """The table names no preferences: even ids stand for chosen, the next odd ids for rejected."""
    ids = F.col("conv_id").cast("long")
    return conversations.where(ids.isNotNull()).select(
        F.floor(ids / 2).cast("long").alias("pair_id"),
        F.when(F.pmod(ids, F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        ids.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(neighbours_as_pairs(table(spark, sf_dir, "conversations")))


SQL = """
with said as (
  select floor(conv_id / 2)::BIGINT as pair_id, conv_id % 2 <> 0 as lost, conv_id,
         role is null as no_role, text is null as no_text,
         coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null),
sizes as (
  select pair_id, max(case when not lost then conv_id end) as chosen_id, max(case when lost then conv_id end) as rejected_id,
         count(*) filter (not lost) as n_chosen, count(*) filter (lost) as n_rejected
  from said group by pair_id),
differing as (
  select a.pair_id, min(a.place) as place
  from said a join said b on a.pair_id = b.pair_id and a.place = b.place and not a.lost and b.lost
  where a.role <> b.role or a.text <> b.text or a.no_role <> b.no_role or a.no_text <> b.no_text
  group by a.pair_id),
common as (
  select s.*, coalesce(d.place - 1, least(n_chosen, n_rejected))::INT as n_common
  from sizes s left join differing d using (pair_id)),
rendered as (
  select c.pair_id, s.lost, s.place, s.role, place <= n_common as shared,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece,
         length(role) as role_size, length(text) as text_size
  from said s join common c using (pair_id)),
placed as (
  select *, coalesce(sum(length(piece)) over (partition by pair_id, lost, shared order by place
                     rows between unbounded preceding and 1 preceding), 0) as begins
  from rendered),
gathered as (
  select pair_id,
         coalesce(string_agg(piece, '' order by place) filter (shared and not lost), '') as prompt,
         coalesce(string_agg(piece, '' order by place) filter (not shared and not lost), '') as chosen,
         coalesce(string_agg(piece, '' order by place) filter (not shared and lost), '') as rejected,
         coalesce(string_agg((begins + 13 + role_size)::BIGINT || ':' || (text_size + 11), ';' order by place)
                  filter (not shared and not lost and role = 'assistant'), '') as chosen_mask,
         coalesce(string_agg((begins + 13 + role_size)::BIGINT || ':' || (text_size + 11), ';' order by place)
                  filter (not shared and lost and role = 'assistant'), '') as rejected_mask
  from placed group by pair_id)
select pair_id, chosen_id, rejected_id, n_common as n_common_turns, prompt,
       case when n_chosen > 0 then chosen end as chosen_completion,
       case when n_chosen > 0 then chosen_mask end as chosen_mask,
       case when n_rejected > 0 then rejected end as rejected_completion,
       case when n_rejected > 0 then rejected_mask end as rejected_mask
from common join gathered using (pair_id)
"""
