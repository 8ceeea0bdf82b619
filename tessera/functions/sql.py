"""The column functions as temporary SQL functions, so that queries in SQL can call them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import classify, text
from tessera.operators.arms import error_kind

_STRING, _NUMBER, _FLAG = "string", "double", "boolean"

_CHAT = "array<struct<role:string,content:string>>"

#: Name, arguments with their types, and the column function.
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "has_only_words": ({"text": _STRING}, text.has_only_words),
    "is_reserved": ({"name": _STRING}, text.is_reserved),
    "is_standard_variant": ({"name": _STRING}, text.is_standard_variant),
    "sanitize_identifier": ({"name": _STRING}, text.sanitize_identifier),
    "restore_identifier": ({"name": _STRING}, text.restore_identifier),
    "strip_text": ({"text": _STRING}, text.strip),
    "single_line": ({"text": _STRING}, text.single_line),
    "compact": ({"text": _STRING}, text.compact),
    "crate_name": ({"name": _STRING}, text.crate_name),
    "function_name": ({"source": _STRING}, text.function_name),
    "strip_contract": ({"prompt": _STRING}, text.strip_contract),
    "with_contract": ({"prompt": _STRING, "signature": _STRING}, text.with_contract),
    "clean_generation": ({"text": _STRING}, text.clean_generation),
    "uses_verbatim": ({"text": _STRING}, text.uses_verbatim),
    "safe_ratio": ({"part": _NUMBER, "whole": _NUMBER}, text.safe_ratio),
    "round6": ({"value": _NUMBER}, text.round6),
    "failure_phase": ({"transform_ok": _FLAG, "compile_ok": _FLAG, "test_ok": _FLAG}, classify.failure_phase),
    "evaluation_class": ({"message": _STRING, "phase": _STRING}, classify.evaluation_class),
    "report_class": ({"message": _STRING, "phase": _STRING}, classify.report_class),
    "error_kind": ({"error": _STRING}, error_kind),
    "code_signature": ({"source": _STRING, "name": _STRING}, text.code_signature),
    "wordy_signature": ({"source": _STRING, "name": _STRING}, text.wordy_signature),
    "wordy_prompt": ({"task": _STRING, "signature": _STRING}, lambda task, signature: text.user_prompt(task, "wordy", signature)),
    "expected_value": ({"family": _STRING, "prompt": _STRING}, text.expected_value),
    "first_message": ({"conversation": _CHAT, "wanted": _STRING}, text.first_message),
    "resolve_path": ({"base": _STRING, "path": _STRING}, text.resolve_path),
    "tokens": ({"text": _STRING}, text.tokens),
    "read_escapes": ({"body": _STRING}, text.read_escapes),
    "escape_item": ({"text": _STRING}, text.escape_item),
    "unescape_item": ({"text": _STRING}, text.unescape_item),
}

#: Name, arguments, and the array of structs whose elements are the rows; the first column of the rows is their place.
TABLES: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "token_rows": ({"text": _STRING}, text.tokens),
    "expected_rows": ({"family": _STRING, "prompt": _STRING}, text.expected_value),
}

_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?P<name>[-+*/%=<>!&|^~]+|\b(?:and|or|in|not))(?=\()", re.DOTALL)


def sql_text(column: Column) -> str:
    """A column as SQL: it prints as one but for operators, which it writes as functions, and whose names need quotes."""
    printed = str(column).removeprefix("Column<'").removesuffix("'>")
    return _OPERATOR.sub(lambda m: f"`{m['name']}`" if m["name"] else m[0], printed)


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; the optimizer puts their expressions in place of the calls.

    Functions of arrays of structs are there as tables too, for `FROM t, LATERAL token_rows(text)`,
    which is planned as one pass over t without a join.  Spark plans a LEFT JOIN LATERAL of them as an
    inner one, so where rows without elements shall stay, use LATERAL VIEW OUTER on the array function.
    """

    def parts(arguments: dict[str, str], function: Callable[..., Column]):
        declared = ", ".join(f"{a} {kind}" for a, kind in arguments.items())
        body = function(*map(F.col, arguments))
        return declared, sql_text(body), spark.createDataFrame([], declared).select(body).schema[0].dataType

    for name, (arguments, function) in FUNCTIONS.items():
        declared, body, kind = parts(arguments, function)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {kind.simpleString()} RETURN {body}")
    for name, (arguments, function) in TABLES.items():
        declared, body, kind = parts(arguments, function)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.elementType)
        fields = ", ".join(f"item.`{f.name}`" for f in kind.elementType)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS TABLE(pos INT, {columns}) RETURN SELECT pos, {fields} FROM posexplode({body}) AS rows(pos, item)")
    return [*FUNCTIONS, *TABLES]
