"""Chat formatting by perspective rotation, with DataFrame functions.

For every participant of a conversation (each speaker but the system) the dialogue is rendered with that speaker as
assistant and the others as named users, one row a turn: the chunk of text, where it lies in the dialogue, and the part
of it that is trained on. Chunks in order of `place` make the dialogue; a dialogue is never gathered in one row or task:
its places and offsets are sums over blocks of turns, added to sums within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that one task puts in order.
BLOCK_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def unmarked(text: Column) -> Column:
    """Text in which no mark can be forged: `<|` is parted by a blank."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, perspective, place, turn, speaker, chunk, start, end, mask_start, mask_end.

    Offsets are in code points, ends exclusive; the mask holds an assistant turn's words and its closing mark, and is
    null for other turns. Turns go by number, rows of the same turn by speaker and the text's digest, missing numbers
    first. Null text is empty, a null role the speaker "unknown"; rows without conv_id make one conversation. Repeated
    rows are turns of their own. Marks in what is said, or in a speaker's name, are parted (`<|` becomes `< |`) and line ends
    in a name become blanks, so that nobody's words pass for another's turn. A conversation in which only the system speaks has no participant and no rows.

    Other columns are not looked at; texts may be of any length; an empty table gives no rows.

    Places and offsets need lengths only; texts are shuffled once, each different row's, and joined at the end.
    """
    speaker, text = F.coalesce("role", F.lit("unknown")), unmarked(F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", speaker.alias("speaker"), text.alias("text"), F.md5(text).alias("digest"))
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", written("conv_id"), written("turn"), "digest", "speaker")))
    texts = rows.groupBy(F.col("key").alias("text_key")).agg(F.first("text").alias("text"))
    lengths = rows.select("conv_id", "turn", "speaker", "digest", "key", F.length("text").cast("long").alias("length"))
    lengths = lengths.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long"))
    seats = lengths.where("speaker != 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = lengths.join(seats, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    tag = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise(F.concat(F.lit("user name="), unmarked(F.regexp_replace("speaker", "[\r\n]", " "))))
    head = F.concat(F.lit(OPEN), tag, F.lit("\n"))
    sized = seen.withColumn("size", F.length(head) + F.col("length") + len(CLOSE) + 1)
    sums = sized.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_turns"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("block_size").over(over), F.lit(0)).alias("size_ahead"), F.coalesce(F.sum("block_turns").over(over), F.lit(0)).alias("turns_ahead"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "digest")
    placed = sized.withColumn("n", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("size_ahead") + F.col("upto")
    start = end - F.col("size")
    return joined.join(texts, F.col("key") == F.col("text_key")).select(
        "conv_id",
        "perspective",
        (F.col("turns_ahead") + F.col("n") - 1).cast("long").alias("place"),
        "turn",
        "speaker",
        F.concat(head, F.col("text"), F.lit(CLOSE + "\n")).alias("chunk"),
        start.alias("start"),
        end.alias("end"),
        F.when(own, start + F.length(head)).alias("mask_start"),
        F.when(own, end - 1).alias("mask_end"),
    )


def op4(conversations: DataFrame) -> DataFrame:
    return rotate(conversations)


ORACLE = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
seats AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM rows WHERE speaker <> 'system'),
heads AS (
  SELECT *, '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || replace(regexp_replace(speaker, '[\r\n]', ' ', 'g'), '<|', '< |') END || chr(10) AS head
  FROM rows JOIN seats ON conv_id IS NOT DISTINCT FROM c),
chunks AS (SELECT *, head || text || '{CLOSE}' || chr(10) AS chunk FROM heads),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place,
         CAST(sum(length(chunk)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM chunks WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text)))
SELECT conv_id, perspective, place, turn, speaker, chunk, "end" - length(chunk) AS start, "end",
       CASE WHEN speaker = perspective THEN "end" - length(chunk) + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN "end" - 1 END AS mask_end
FROM placed
"""
