"""Chat formatting after cumulative snapshots are collapsed; DataFrame functions only.

Logs often hold a conversation several times, each snapshot with the turns so far. Each turn gets two rolling hashes of
the conversation up to it (the exclusive or of hashes of position, role and text). A conversation whose last hash is
another's hash at the same position, before that one's end, is a prefix of it and goes, by an anti-join with the distinct
prefix hashes; of equal conversations the smallest conv_id stays. The maximal ones are then rendered.

Edge cases: turns are ordered by turn, then role and text, and numbered anew, so gaps don't matter and a turn that is
logged twice counts twice; a null role or text differs from an empty one when conversations are compared, and is
rendered as "unknown" and as nothing; turns whose conv_id is null are left out; an empty table gives an empty result. A conversation is
one row of the result, so its turns meet in one task; texts and conversations of any length are rendered whole, as far as a row can hold them.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

# The marks around a turn.
START, STOP = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, last, a, b): for each turn the hashes of the conversation up to it; last marks the final one."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null").withColumn("place", F.row_number().over(order))
    parts = (F.col("place"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = rows.select("conv_id", "place", "turn", "role", "text", F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(7), *reversed(parts)).alias("y"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = rows.select("conv_id", "place", F.lead("place").over(order).isNull().alias("last"), F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"))
    return rolled


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of a longer one, one of each set of equals."""
    rolled = tables.keep(prefixes(turns))
    whole = rolled.where("last").groupBy("a", "b", F.col("place").alias("n_turns")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = rolled.where("not last").select("a", "b", F.col("place").alias("n_turns")).distinct()
    return whole.join(longer, ["a", "b", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): the maximal conversations as marked-up text."""
    kept = maximal(turns)
    one = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(STOP + "\n"))
    chats = turns.where("conv_id is not null").join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("turn", "role", "text", one.alias("shown")).alias("t"))
    chats = chats.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["shown"]), "").alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "chat")
