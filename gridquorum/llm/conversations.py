"""Chat formatting of maximal conversations.

Logs hold snapshots of one conversation that grow turn by turn.  All native:

1. Turns are put in order (turn, role, text) and numbered; equal rows count once.
2. Rolling prefix hashes: the hash of a prefix is the XOR of its turns' position
   hashes, twice with different seeds (128 bits), a running window aggregate.
3. Conversations with one full hash are one; the smallest conv_id stands for it.
4. An anti-join of full hashes with the hashes of strict prefixes leaves the maximal
   conversations; both sides are distinct, so a common first turn is one row.
5. These are rendered: ``<|role|>``, the text, ``<|end|>``, each on its own line.
   ``<|`` in a text is written ``<||`` and a bar in a role twice, so that no text can pass
   for a turn and different conversations render differently.

Cases.  Null role is ``unknown``, null text empty; a row with a null conv_id belongs to no
other and is a conversation of one turn with a null id; null turn comes first; ties of turn
go by role, text; equal rows count once, those without a conv_id too; very long texts
are copied whole; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: one row for each maximal conversation."""
    work = Work(conversations.sparkSession, "chats")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # rows without a conversation need no order, so they do not meet in one task
    placed = turns.where("conv_id is not null").withColumn("i", F.row_number().over(order)).unionByName(turns.where("conv_id is null").withColumn("i", F.lit(1)))
    seeded = placed.select("conv_id", "i", "role", "text", *[F.xxhash64(F.lit(seed), "i", "role", "text").alias(f"t{seed}") for seed in (1, 2)])
    so_far = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = seeded.where("conv_id is not null").select("conv_id", "i", "role", "text", F.bit_xor("t1").over(so_far).alias("h1"), F.bit_xor("t2").over(so_far).alias("h2"))
    lone = seeded.where("conv_id is null").select("conv_id", "i", "role", "text", F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    prefixes = work.save(rolled.unionByName(lone), "prefixes")

    role, text = F.replace("role", F.lit("|"), F.lit("||")), F.replace("text", F.lit("<|"), F.lit("<||"))
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))
    named = prefixes.where("conv_id is not null")
    whole = named.groupBy("conv_id").agg(F.max(F.struct("i", "h1", "h2")).alias("last"), F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"))
    whole = whole.select("conv_id", F.col("last.i").alias("n_turns"), "last.h1", "last.h2", F.concat_ws("", "lines.line").alias("rendered"))
    alone = prefixes.where("conv_id is null").select("conv_id", F.col("i").alias("n_turns"), "h1", "h2", line.alias("rendered"))
    whole = work.save(whole.unionByName(alone), "whole")
    one = whole.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.min("rendered").alias("rendered"))
    strict = named.select("conv_id", "i", "h1", "h2").join(whole.select("conv_id", "n_turns"), "conv_id").where("i < n_turns")
    strict = strict.select("h1", "h2", F.col("i").alias("n_turns")).distinct()
    return one.join(strict, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) END AS i,
    coalesce(CAST(conv_id AS VARCHAR), 'lone ' || row_number() OVER ()) AS conv,
    '<|' || replace(role, '|', '||') || '|>' || chr(10) || replace(text, '<|', '<||') || chr(10) || '<|end|>' || chr(10) AS line FROM turns),
prefixes AS (
  SELECT conv_id, i, string_agg(line, '') OVER (PARTITION BY conv ORDER BY i) AS said,
    count(*) OVER (PARTITION BY conv) AS n_turns FROM placed),
one AS (
  SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE i = n_turns GROUP BY said, n_turns)
SELECT conv_id, n_turns, n_copies, said AS rendered FROM one
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = one.said AND p.i < p.n_turns AND p.i = one.n_turns)
"""
