"""Chat formatting with collapse of cumulative snapshots.

A log may hold a conversation again and again as it grows. Each turn gets a hash of its place, role and
text; the running exclusive-or of these is a hash of the prefix up to that turn, kept twice with different
seeds (128 bits). A conversation whose whole hash is a proper prefix of another one, of the same number of
turns, is a snapshot and is removed by an anti join; of equal conversations the smallest id stays. What is
left is rendered. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

# fixed values: the markers of the rendered form
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), n (turns of the conversation), p and q (prefix hashes), role, text.

    Turns are ordered by number, then role, then text, nulls first; repeated rows are turns each.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(order))
    for name, seed in (("p", 1), ("q", 2)):
        # a null hashes as nothing, so the flags keep it apart from an empty string
        one = F.xxhash64(F.lit(seed), "i", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        rows = rows.withColumn(name, F.bit_xor(one).over(so_far))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))


def maximal(turns: DataFrame) -> DataFrame:
    """Of ``numbered`` turns (stored), the conversations that no other one continues: conv_id, copies."""
    whole = turns.filter(F.col("i") == F.col("n")).groupBy("n", "p", "q")
    whole = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # one row per distinct prefix, however many conversations begin with it
    begun = turns.filter(F.col("i") < F.col("n")).select(F.col("i").cast("long").alias("n"), "p", "q").distinct()
    return whole.join(begun, ["n", "p", "q"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of the kept conversations.

    Null roles and texts are rendered as empty. A conversation is one text, so its turns meet in one row.
    """
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(BREAK), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    own = turns.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")))
    own = own.select("t.conv_id", "t.i", "k.copies", piece.alias("piece"))
    rendered = own.groupBy("conv_id", "copies").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("pieces"))
    return rendered.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.col("copies").cast("long").alias("copies"),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("text"),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered. Rows without conv_id are one conversation, without an id.

    With a null id among equal conversations the smallest id that is not null stays. Extra columns are
    ignored; an empty table gives no rows.
    """
    turns = stored(numbered(conversations), "chat-turns")
    return render(turns, maximal(turns))


def op8_chat_formatting(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
   role, text FROM conversations),
 prefixes AS (SELECT conv_id, i, list([role, text]) OVER (PARTITION BY conv_id ORDER BY i) AS turns,
   count(*) OVER (PARTITION BY conv_id) AS n FROM t),
 whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE i = n GROUP BY turns),
 kept AS (SELECT * FROM whole WHERE turns NOT IN (SELECT turns FROM prefixes WHERE i < n))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies,
 array_to_string(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x[1], '') || chr(10) || coalesce(x[2], '') || '<|im_end|>' || chr(10)), '') AS text
FROM kept
"""
