"""Conversations as training text, with Spark expressions only.

A conversation's turns are collected as structs and sorted; array functions look at
each one's neighbours and merge adjacent turns of one role into one block, whose
parts stay apart by a marker, so that the original turns can be read back.  The
parts' places in the text follow from running sums:

    <turn:ROLE>TEXT<part>TEXT</turn>\\n

Inside roles and texts the backslash becomes ``\\0``, ``<`` becomes ``\\1`` and, in
roles, ``>`` becomes ``\\2``; no text can then hold a marker, and the change is
undone exactly.  The loss mask is a list of code point spans of the formatted
text, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "</turn>\n"
PART = "<part>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    """The inverse of escape; a backslash in escaped text stands only before 0, 1 or 2."""
    for code, char in (("\\1", "<"), ("\\2", ">"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\2"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: (conv_id, formatted, loss_spans, n_blocks).

    Turns are in the order (turn, role, text), null turns first; repeated rows
    are turns of their own.  Null roles and texts count as empty strings, rows
    with a null conv_id form one conversation, and an empty table gives no rows.
    loss_spans is array<struct<start,length>> in code points from 0, one span for
    each assistant turn, the empty ones included.  A conversation is one row of
    the result, so it must fit in one; the work grows with its length.  Other
    columns of df, whatever their names, are ignored.  That one row bounds a
    conversation, that of null keys too, to 2 GB.
    """
    turns = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def part(turn: Column, i: Column) -> Column:
        """What a turn adds to the text: a run of one role opens where the turn before has another one, and closes likewise."""
        opens, closes = (F.coalesce(F.get("turns", i + step)["role"] != turn["role"], F.lit(True)) for step in (-1, 1))
        return F.struct(
            opens.alias("opens"), (turn["role"] == ASSISTANT).alias("loss"),
            F.when(opens, F.concat(F.lit("<turn:"), _escape_role(turn["role"]), F.lit(">"))).otherwise(F.lit(PART)).alias("before"),
            escape(turn["text"]).alias("body"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("after"),
        )

    # The places of the parts are running sums; the rows stay in the partitions that the grouping has made.
    parts = sorted_turns.select("conv_id", F.posexplode(F.transform("turns", part)).alias("n", "part")).select("conv_id", "n", "part.*")
    sizes = [F.length(c) for c in ("before", "body", "after")]
    upto = F.sum(sizes[0] + sizes[1] + sizes[2]).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    spanned = parts.withColumn("span", F.struct((upto - sizes[1] - sizes[2]).cast("int").alias("start"), sizes[1].alias("length")))
    chats = spanned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "before", "body", "after", "loss", "span"))).alias("parts"), F.count_if("opens").alias("n_blocks"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: p["span"]).alias("loss_spans"),
        "n_blocks",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from the formatted text and the spans alone.

    turns is array<struct<role,text>> as before formatting, loss_texts the
    unescaped texts under the loss mask, in order.
    """
    blocks = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring_index(F.substr(block, F.lit(len("<turn:") + 1)), ">", 1))
        body = F.substr(block, F.instr(block, ">") + 1)
        return F.transform(F.split(body, PART), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that imitates markers, read back from their formatted form."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    back = read_back(format_chats(chats.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), ordered AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(text) - length(replace(replace(text, '\', ''), '<', ''))
      + CASE WHEN opens THEN 7 + length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) ELSE 6 END
      + CASE WHEN closes THEN 8 ELSE 0 END)::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM ordered GROUP BY conv_id
"""
