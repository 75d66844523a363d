"""Preference formatting of chat data (operator 1), by DataFrame operations only.

Two conversations make a pair: the chosen and the rejected one. Their longest common turn prefix is rendered once, as the
prompt; what follows is rendered as two completions. The result is one row for each rendered message, with its place in
its segment and whether its characters count in the loss (assistant messages of completions), so a conversation of any
length is never gathered into one value.

A turn of a pair is common if both sides have the same messages there and all earlier turns are common; messages are
compared as they are, one by one. Exact repeats of a row count once; several messages at one turn are ordered by role, then
text. Null role: `unknown`; null text: empty. Rows without a conversation id or turn belong to no pair and are left out. A
side without messages leaves the prompt empty; equal sides are all prompt. Empty table: no rows.

The table of conversations has no pairs, so the query makes them: a conversation as it is is the chosen side; on the rejected
side the answers at its last assistant turn are those at the last assistant turn of its neighbour (id with the lowest bit
turned), or none if that has no answer. Conversations without an assistant turn pair with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def format_pairs(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, side 0 chosen or 1 rejected, turn, role, text) to rendered messages of prompt, chosen, rejected."""
    rows = turns.select("pair_id", "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("pair_id is not null and turn is not null").distinct()
    on = lambda s: F.max(F.when(F.col("side") == s, True)).isNotNull()
    messages = rows.groupBy("pair_id", "turn", "role", "text").agg((on(0) & on(1)).alias("both"))
    cut = messages.groupBy("pair_id").agg(F.min(F.when(~F.col("both"), F.col("turn"))).alias("cut"))
    segment = F.when(F.col("cut").isNull() | (F.col("turn") < F.col("cut")), "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    rendered = rows.join(cut, "pair_id").withColumn("segment", segment).where("segment <> 'prompt' or side = 0")
    rendered = rendered.withColumn("rendered", F.concat(F.lit(OPEN), "role", F.lit(CLOSE), "text", F.lit(END)))
    order = Window.partitionBy("pair_id", "segment").orderBy("turn", "role", "text")
    return rendered.select(
        "pair_id", "segment", "turn", "role", "rendered",
        ((F.col("segment") != "prompt") & (F.col("role") == "assistant")).alias("in_loss"),
        (F.sum(F.char_length("rendered")).over(order) - F.char_length("rendered")).alias("start"),
        F.char_length("rendered").cast("long").alias("n_chars"),
    )


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text): each conversation, and the same with its neighbour's last answers."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.where("conv_id is not null and turn is not null")
    answers = F.col("role") == "assistant"
    last = rows.where(answers).groupBy("conv_id").agg(F.max("turn").alias("last"))
    marked = rows.join(last, "conv_id", "left").withColumn("final", F.coalesce(answers & (F.col("turn") == F.col("last")), F.lit(False)))
    other = marked.where("final").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), "role", "text")
    sides = (
        rows.withColumn("side", F.lit(0)),
        marked.where("not final").drop("last", "final").withColumn("side", F.lit(1)),
        other.join(last.withColumnRenamed("last", "turn"), "conv_id").withColumn("side", F.lit(1)),
    )
    chosen, rest, replaced = (x.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", "text") for x in sides)
    return chosen.unionByName(rest).unionByName(replaced)


def op1_preference(conversations: DataFrame) -> DataFrame:
    """All conversations as chosen sides, paired with themselves under another conversation's last answer."""
    return format_pairs(with_other_answers(conversations))


SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
final AS (SELECT id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY id),
sides AS (
  SELECT id AS pair_id, 0 AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.id, 1, turn, role, text FROM t LEFT JOIN final USING (id) WHERE NOT coalesce(role = 'assistant' AND turn = last, false)
  UNION ALL
  SELECT mine.id, 1, mine.last, t.role, t.text
  FROM t JOIN final AS own ON t.id = own.id AND t.turn = own.last AND t.role = 'assistant' JOIN final AS mine ON mine.id = xor(t.id, 1)),
r AS (SELECT DISTINCT pair_id, side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM sides),
cells AS (
  SELECT pair_id, turn, list(struct_pack(role := role, text := text) ORDER BY role, text) FILTER (side = 0) AS a,
         list(struct_pack(role := role, text := text) ORDER BY role, text) FILTER (side = 1) AS b
  FROM r GROUP BY pair_id, turn),
cut AS (SELECT pair_id, min(CASE WHEN a IS DISTINCT FROM b THEN turn END) AS cut FROM cells GROUP BY pair_id),
s AS (
  SELECT r.pair_id, r.turn, r.role, r.text, r.side,
         CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS segment,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered
  FROM r JOIN cut USING (pair_id))
SELECT pair_id, segment, turn, role, rendered, segment <> 'prompt' AND role = 'assistant' AS in_loss,
       CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, segment ORDER BY turn, role, text) - length(rendered) AS BIGINT) AS start,
       CAST(length(rendered) AS BIGINT) AS n_chars
FROM s WHERE segment <> 'prompt' OR side = 0
"""
