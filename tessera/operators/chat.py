"""Chat-style training rows from tasks and their solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import user_prompt


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_rows(tasks: DataFrame, language: str, prompt: str, code: str, signature: Column, source: str) -> DataFrame:
    """id, family, split, language, source and the conversation of each task."""
    conversation = F.array(message("user", user_prompt(F.col(prompt), language.capitalize(), signature)), message("assistant", F.col(code)))
    return tasks.select("id", "family", "split", F.lit(language).alias("language"), F.lit(source).alias("source"), conversation.alias("conversations"))


def render(conversation: Column, template: str = "<{role}>\n{content}\n") -> Column:
    """A conversation as one text, each message put into the template."""
    def one(m: Column) -> Column:
        parts, rest = [], template
        for name in ("role", "content"):
            before, _, rest = rest.partition("{" + name + "}")
            parts += [F.lit(before), m[name]]
        return F.concat(*parts, F.lit(rest))

    return F.array_join(F.transform(conversation, one), "")


def collect_turns(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, conversations): the turns of each conversation as messages, in order."""
    sorted_turns = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conv).agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("conversations"))
