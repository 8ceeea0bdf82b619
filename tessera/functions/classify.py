"""Phases and classes of failures.

There are two sets of rules, one for a single evaluation and one for reports over
several; they differ on purpose and give different counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failure_phase(transform_ok: Column, compile_ok: Column, test_ok: Column) -> Column:
    """The first phase that failed, null if none did; a missing flag counts as failed."""
    def bad(c: Column) -> Column:
        return ~F.coalesce(c, F.lit(False))

    return F.when(bad(transform_ok), "transform").when(bad(compile_ok), "compile").when(bad(test_ok), "test")


def failed(transform_ok: Column, compile_ok: Column, test_ok: Column) -> Column:
    return failure_phase(transform_ok, compile_ok, test_ok).isNotNull()


def _named(label: Column, names: dict[str, str] | None) -> Column:
    """The label under another name, where there is one."""
    if not names:
        return label
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label), label)


def _rules(text: Column, *rules: tuple[str, tuple[str, ...]]) -> Column:
    """The class of the first rule all of whose strings the text contains."""
    out = None
    for name, parts in rules:
        hit = F.lit(True)
        for part in parts:
            hit = hit & F.contains(text, F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# The messages of compilers and converters that these rules look for.
_BUILD_RULES = (
    ("name_resolution", ("expected value, found crate",)),
    ("name_resolution", ("cannot find",)),
    ("wrong_signature_or_call", ("this function takes", "argument")),
    ("type_mismatch", ("mismatched types",)),
    ("parse_error", ("unexpectedtoken",)),
    ("parse_error", ("parse error",)),
)


def evaluation_class(message: Column, phase: Column, names: dict[str, str] | None = None) -> Column:
    """The failure class within one evaluation; names gives classes other names."""
    text = F.lower(F.coalesce(message, F.lit("")))
    transform = _rules(text, ("wordy_parse_error", ("unexpectedtoken",)), ("wordy_parse_error", ("parse error",)), ("conversion_error", ("oxidation failed",)))
    build = _rules(text, *_BUILD_RULES, ("missing_function", ("no function definition found",)), ("behavior_assertion", ("assertion failed",)))
    return _named(F.when(text == "", "none").when(phase == "transform", F.coalesce(transform, F.lit("transform_other"))).otherwise(F.coalesce(build, F.lit("other"))), names)


def report_class(message: Column, phase: Column, names: dict[str, str] | None = None) -> Column:
    """The failure class in reports over several evaluations; names gives classes other names."""
    text = F.lower(F.coalesce(message, F.lit("")))
    build = _rules(text, *_BUILD_RULES, ("closure_return_shape", ("expected `i32`, found closure",)))
    return _named(F.when(text == "", "none").when(phase == "transform", "wordy_parse_or_convert").otherwise(F.coalesce(build, F.lit("other"))), names)
