"""Chat formatting by perspective rotation: each participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1024  # turn numbers that one row spans at most
END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Renders turns (conv_id, turn, role, text) once for each participant, who is the assistant; others are named users.

    Participants are the distinct roles but system, whose turns are rendered as such for everyone. A row spans `segment`
    turn numbers, so no dialogue is gathered whole in one task; shorter dialogues are one row. Returns conv_id,
    participant, segment (from 0), n_turns, text, and mask: spans of characters (start, end exclusive) to learn from, which
    are the participant's messages with their end marks. A null role is the user "unknown" and no participant; null texts
    are empty; "<|" within a text becomes "< |", and in a role's name "|>" becomes "| >" too, so that neither can pass for a mark; ties in turn go by role and text, a null
    turn is first; repeated rows are repeated messages; conversations without a participant, and null conv_ids, give no rows.
    """
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.col("role").isNull().alias("nameless"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    speakers = rows.where(~F.col("nameless") & (F.col("role") != "system")).select("conv_id", F.col("role").alias("participant")).distinct()
    own = (F.col("role") == F.col("participant")) & ~F.col("nameless")
    named = F.replace(F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), named, F.lit("|>\n")))
    views = rows.join(speakers, "conv_id").select(
        "conv_id", "participant", F.greatest(F.floor(F.col("turn") / segment), F.lit(0)).cast("long").alias("segment"),
        F.struct("turn", "role", "text", head.alias("head"), own.alias("own")).alias("m"),
    )
    groups = views.groupBy("conv_id", "participant", "segment").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    text = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["text"], F.lit(END))), "")
    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(kind)

    def step(a, m):
        start = a["at"] + F.length(m["head"])
        end = start + F.length(m["text"]) + len(END)
        span = F.struct(start.alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out")).cast(kind)

    return groups.select("conv_id", "participant", "segment", F.size("ms").alias("n_turns"), text.alias("text"), F.aggregate("ms", empty, step)["out"].alias("mask"))


def op5_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; mask as start:end, comma-joined."""
    found = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "participant", "segment", F.col("n_turns").cast("long").alias("n_turns"), "text", mask.alias("mask"))


OP5_SQL = """
WITH r AS (SELECT conv_id, coalesce(turn, -1)::bigint AS turn, coalesce(role, 'unknown') AS role, role IS NULL AS nameless,
                  replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS participant FROM r WHERE NOT nameless AND role <> 'system'),
v AS (SELECT r.conv_id, participant, greatest(floor(turn / 1024.0), 0)::bigint AS segment, turn, role, text, (role = participant AND NOT nameless) AS own,
             CASE WHEN role = participant AND NOT nameless THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
                  ELSE '<|user:' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head FROM r JOIN s USING (conv_id)),
p AS (SELECT *, length(head) + length(text) + 8 AS n, sum(length(head) + length(text) + 8) OVER w AS upto, row_number() OVER w AS k FROM v
      WINDOW w AS (PARTITION BY conv_id, participant, segment ORDER BY turn, role, text, head, own ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, segment, count(*)::bigint AS n_turns, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg((upto - n + length(head))::bigint::varchar || ':' || (upto - 1)::bigint::varchar, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, participant, segment
"""
