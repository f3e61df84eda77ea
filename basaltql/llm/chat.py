"""Chat formatting (operator 7): cumulative-snapshot collapse, then rendering.

Logs often hold a conversation several times, each time with more turns.  A rolling hash over (role, text)
gives every turn the hash of all turns up to it.  A conversation is dropped if its last prefix hash is a
prefix hash of a longer conversation, or of an equal one with a smaller conv_id; the maximal ones are rendered.
Both sides of the anti-join have a prefix once, so no common beginning is gathered in a task.

Turns go in the order of (turn, role, text); a null role or text differs from an empty one in the hash and is
rendered as empty.  Exactly repeated rows count once.  Rows without conv_id are ignored; extra columns are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _turn(x) -> F.Column:
    """The digest of one turn."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.sha2(F.concat_ws("\x1f", part(x["role"]), part(x["text"])), 256)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (ordered array), prefixes (the rolling hash after each turn)."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    rolled = F.aggregate("turns", F.array().cast("array<string>"), lambda done, x: F.concat(done, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), _turn(x))))))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", rolled.alias("prefixes"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that no other continues or repeats."""
    every = conversations(turns)
    # Equal conversations have one last prefix; partial aggregation leaves its least conv_id, whatever their number.
    whole = every.groupBy(F.element_at("prefixes", -1).alias("prefix")).agg(F.min("conv_id").alias("conv_id"))
    continued = every.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("prefix")).distinct()
    return every.join(whole.join(continued, "prefix", "left_anti"), "conv_id", "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: the maximal conversations in a plain chat template."""
    line = F.transform("turns", lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n")))
    return maximal(turns).select("conv_id", "n_turns", F.array_join(line, "").alias("rendered"))


#: The same, in DuckDB's SQL: a conversation goes if another begins with all its turns.
SQL = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n_turns,
         list(coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM rows GROUP BY conv_id)
SELECT a.conv_id, a.n_turns, a.rendered FROM convs a
WHERE NOT EXISTS (
  SELECT 1 FROM convs b
  WHERE b.turns[1] = a.turns[1] AND b.conv_id <> a.conv_id AND b.turns[1:a.n_turns] = a.turns
    AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id)))
"""
