import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions import text as T
from tessera.functions.classify import evaluation_class, failure_phase, report_class
from tessera.operators.tokens import token_table


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "out"), [("type", "user_type"), ("Type", "user_Type"), ("Some", "Some"), ("count", "count"), ("", "")])
def test_sanitize(spark, name, out):
    assert value(spark, T.sanitize_identifier(F.col("a")), a=name) == out


def test_restore(spark):
    assert value(spark, T.restore_identifier(F.col("a")), a="user_type") == "type"
    assert value(spark, T.restore_identifier(F.col("a")), a="user_user_id") == "user_id"


@pytest.mark.parametrize(("text", "ok"), [("call f with x", True), ("a & b", False), ("a::b", False), ("a:b", True), ("x-y", False), (None, None)])
def test_has_only_words(spark, text, ok):
    assert value(spark, T.has_only_words(F.col("a")), a=text) is ok


def test_lines_are_cut_by_different_rules(spark):
    assert value(spark, T.single_line(F.col("a")), a="x" * 221) == "x" * 217 + "..."
    assert value(spark, T.single_line(F.col("a")), a="x" * 220) == "x" * 220
    assert value(spark, T.compact(F.col("a")), a="x" * 301) == "x" * 300 + "..."
    assert value(spark, T.compact(F.col("a")), a=" a\n\tb\u00a0c ") == "a b c"


def test_crate_name(spark):
    assert value(spark, T.crate_name(F.col("a")), a="") == "task"
    assert value(spark, T.crate_name(F.col("a")), a="1-b") == "task_1_b"


def test_function_name_prefers_public(spark):
    code = "fn helper(x: i32) {}\npub fn main_one(x: i32) -> i32 {\n x }\n"
    assert value(spark, T.function_name(F.col("a")), a=code) == "main_one"
    assert value(spark, T.function_name(F.col("a")), a="fn only(x: i32) {}") == "only"
    assert value(spark, T.function_name(F.col("a")), a="fn generic<T>(x: T) {}") is None


def test_code_signature(spark):
    code = "pub fn a(x: i32) -> i32 {\n x }\npub fn b_1(y:\ti32)   -> i32 {\n y }\n"
    assert value(spark, T.code_signature(F.col("c"), F.col("n")), c=code, n="b_1") == "pub fn b_1(y: i32) -> i32"
    assert value(spark, T.code_signature(F.col("c"), F.col("n")), c=code, n="none") == "pub fn a(x: i32) -> i32"
    assert value(spark, T.code_signature(F.col("c"), F.col("n")), c="struct X;", n="x") is None


def test_wordy_signature(spark):
    code = "function other\nbegin\nend function\n\nfunction f_1\n    takes x of i32\n\n    returns i32\nbegin\n    x\nend function"
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c=code, n="f_1") == "function f_1 | takes x of i32 | returns i32"
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c=code, n="zzz") == "function other"
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c="nothing", n="zzz") is None
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c="begin\nfunction a\nfunction f\n\n x", n="f") == "function f | x"
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c="function a\nfunction b", n=None) == "function a | function b"
    assert value(spark, T.wordy_signature(F.col("c"), F.col("n")), c=None, n="f") is None
    # The lines are taken apart once, however often they are named.
    plan = spark.range(1).select(T.wordy_signature(F.col("id").cast("string"), F.lit("f")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_strip_contract(spark):
    marker = T.CONTRACT_MARKER
    assert value(spark, T.strip_contract(F.col("a")), a=f"# T\n\nDo it.\n\n{marker}\n`old`\nKeep.\n\nAfter\n") == "# T\n\nDo it.\n\nAfter"
    assert value(spark, T.strip_contract(F.col("a")), a=f"# T\n\n{marker}\n`old`") == "# T"
    assert value(spark, T.strip_contract(F.col("a")), a=" plain ") == "plain"


def test_user_prompt_without_signature(spark):
    got = value(spark, T.user_prompt(F.col("a"), "Rust", F.lit(None).cast("string")), a="Task")
    assert got == "Task\n\nWrite only valid Rust code for this task. Do not include explanations."


def test_with_contract_is_idempotent(spark):
    once = value(spark, T.with_contract(F.col("a"), F.lit("pub fn f()")), a="Task")
    assert value(spark, T.with_contract(F.col("a"), F.lit("pub fn f()")), a=once) == once
    assert T.CONTRACT_MARKER in once


@pytest.mark.parametrize(("raw", "out"), [("```rust\nfn a() {}\n```", "fn a() {}"), ("  fn a() {}\n", "fn a() {}"), ("x ```\ny\n```", "x ```\ny\n```"), ("```\n\n```", "")])
def test_clean_generation(spark, raw, out):
    assert value(spark, T.clean_generation(F.col("a")), a=raw) == out


def test_expected_value(spark):
    def got(family, prompt):
        found = value(spark, T.expected_value(F.col("f"), F.col("p")), f=family, p=prompt)
        return found and [(x["call"], x["value"]) for x in found]

    assert got("closure_shift_const", "adds 5 to input") == [("7", "12")]
    assert got("result_unwrap_or_const", "returns 9.") == [("Ok(123)", "123"), ('Err(String::from("x"))', "9")]
    assert got("vec_pop_basic", "from `vec![1, 2, 3]`") == [("", "Some(3)")]
    assert got("vec_pop_basic", "nothing") is None
    assert got("other", "adds 5 to input") is None


def test_rounding_and_ratio(spark):
    row = spark.createDataFrame([(5e-7, 3, 0)], "x double, a long, b long")
    assert row.select(T.round6(F.col("x")), T.safe_ratio(F.col("a"), F.col("b"))).first() == (0.0, 0.0)


@pytest.mark.parametrize(("path", "out"), [("/x/y", "/x/y"), ("a/../b.md", "/base/b.md"), ("./c", "/base/c")])
def test_resolve_path(spark, path, out):
    assert value(spark, T.resolve_path(F.lit("/base"), F.col("a")), a=path) == out


def tokens_by_hand(text):
    """One character at a time."""
    out, at = [], 0
    here = lambda k=0: text[at + k] if at + k < len(text) else ""
    while at < len(text):
        c = here()
        if c == "\n":
            out.append(("newline", "\n"))
            at, n = at + 1, 0
            while here() == " ":
                at, n = at + 1, n + 1
            if here() not in ("", "\n"):
                out.append(("indent", str(n)))
        elif text.startswith("note that", at):
            while here() not in ("", "\n"):
                at += 1
        elif c in "\"'":
            at, value = at + 1, ""
            while here() not in ("", c):
                if c == '"' and here() == "\\" and here(1):
                    at += 1
                    value += {"n": "\n", "t": "\t", "r": "\r"}.get(here(), here())
                elif c != '"' or here() != "\\":
                    value += here()
                at += 1
            at += 1
            out.append(("string", value))
        elif c in "0123456789":
            start, dot = at, False
            while (here() and here() in "0123456789") or (here() == "." and not dot and here(1) and here(1) in "0123456789"):
                dot = dot or here() == "."
                at += 1
            out.append(("float" if dot else "integer", text[start:at]))
        elif c.isalpha() or c == "_":
            start = at
            while here() and (here().isalnum() or here() == "_"):
                at += 1
            word = text[start:at]
            out.append(("boolean" if word in ("true", "false") else "keyword" if word in T.KEYWORDS else "identifier", word.removeprefix("user_")))
        else:
            if c == ",":
                out.append(("comma", ","))
            at += 1
    return [*out, ("end of file", "")]


def test_tokens(spark):
    rng = random.Random(3)
    parts = ["note that", "note", " that", "\n", "\n  ", "   ", '"', "'", "\\", "\\n", '\\"', "1", "2.5", ".", "..7", ",", "user_", "type", "true", "é", "_x", "ß2", ";", "\t", "\r", "begin"]
    texts = ["", "\n", "note that x, 1\n\n  y", '"a\\', "'", "1.5.2", "footnote that it", "user_", *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", T.tokens(F.col("a")).alias("t"))
    for r in df.collect():
        assert [tuple(t) for t in r["t"]] == tokens_by_hand(r["a"]), r["a"]
    assert value(spark, T.tokens(F.lit(None).cast("string")), a="x") is None
    long = 'say "' + "a\\n" * 2_000 + '" ' + "word " * 50_000
    assert len(value(spark, T.tokens(F.col("a")), a=long)) == 50_003


def test_token_table(spark):
    df = spark.createDataFrame([(1, "a\n  b, c\n\n d"), (2, None), (3, "")], "id long, t string").withColumns({c: F.lit("x") for c in ("kind", "line", "pos")})
    got = sorted(tuple(r) for r in token_table(df, "id", "t").collect())
    assert [r[1:] for r in got if r[0] == 1] == [
        (0, "identifier", "a", 1, 0), (1, "newline", "\n", 1, 0), (2, "indent", "2", 2, 2), (3, "identifier", "b", 2, 2), (4, "comma", ",", 2, 2), (5, "identifier", "c", 2, 2),
        (6, "newline", "\n", 2, 2), (7, "newline", "\n", 3, 0), (8, "indent", "1", 4, 1), (9, "identifier", "d", 4, 1), (10, "end of file", "", 4, 1),
    ]
    assert [r for r in got if r[0] != 1] == [(3, 0, "end of file", "", 1, 0)]


def test_items_come_back(spark):
    texts = ["", "plain", "'q' \"d\" \\ \\n \t\r\n", "é \u20ac \U0001f600 \x00\x1f\x7f\u2028", "\\u{e9}", "x" * 100_000 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", T.escape_item(F.col("a")).alias("e"))
    for r in df.select("*", T.unescape_item(F.col("e")).alias("b"), T.read_escapes(F.col("e")).alias("r")).collect():
        names = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "\\'", '"': '\\"', "\\": "\\\\"}
        assert r["e"] == "".join(names.get(c) or (c if " " <= c <= "~" else f"\\u{{{ord(c):x}}}") for c in r["a"])
        assert r["b"] == r["a"]
        assert r["r"] == "".join(c if "\t\r\n".find(c) >= 0 or " " <= c <= "~" else f"u{{{ord(c):x}}}" for c in r["a"])


@pytest.mark.parametrize(
    ("source", "out"),
    [
        ("pub fn f(x: i32)\n    -> i32 {", "pub fn f(x: i32) -> i32"), ("pub fn f(x: i32)\n{", "pub fn f(x: i32)"), ("\tpub  fn\tf() -> Vec<u8> {", "pub fn f() -> Vec<u8>"),
        ("pub fn g() {\n}\npub fn f(a: (u8, u8)) -> u8 {", "pub fn f(a: (u8, u8)) -> u8"), ("pub fn g() {\n}\nfn f() {", "pub fn g()"), ("fn f() {", None), ("pub fn f(", None),
    ],
)
def test_signature_heads(spark, source, out):
    assert value(spark, T.code_signature(F.col("a"), F.lit("f")), a=source) == out


def test_strip(spark):
    for text in ("\t\r\n a b \x0b\x0c\n", "\u00a0x\u2003", "\x1cx\x1f", "", " \n ", "x"):
        assert value(spark, T.strip(F.col("a")), a=text) == text.strip()
    assert value(spark, T.wordy_signature(F.col("a"), F.lit("f")), a="\tfunction f\t\n\t takes x\n\n\tbegin") == "function f | takes x"
    assert value(spark, T.with_contract(F.col("a"), F.lit(None).cast("string")), a="\n# Task\n\t") == "# Task"


def test_functions_from_sql(spark):
    """Every function says the same from SQL as as a column, and every table has its array's elements."""
    assert sql.register(spark) == [*sql.FUNCTIONS, *sql.TABLES]
    texts = (
        "type", "Some", " a\t\nb 'q' \\", "```rust\nx\n```", None, "Error: Parse error: x", "fn f (x)", "pub fn f(x: u8)\n -> u8 {", "function é\nbegin", "", "../a/./b",
        "say \"\\n\" note that\n  \\u{e9}\n", "adds 5 to input and returns 7. vec![1, 2, 3]", "it's 1.5,\r\x00\U0001f600",
    )
    phases = (("compile", True, 1.0), ("closure_shift_const", None, None), ("f", False, 0.0))
    rows = [(t, *p, [("user", t), (p[0], "x")]) for t in texts for p in phases]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, s string, p string, f boolean, x double, c {sql._CHAT}")
    df.createOrReplaceTempView("_samples")
    columns = {"string": ["s", "p"], "boolean": ["f", "f", "f"], "double": ["x", "x"], sql._CHAT: ["c", "p"]}

    def own(arguments):
        return columns[next(iter(arguments.values()))][: len(arguments)]

    names = list(sql.FUNCTIONS)
    for some in (names[i::5] for i in range(5)):  # several in one query, as each query costs more than its rows
        called = spark.sql(f"SELECT n, {', '.join(f'{f}({", ".join(own(sql.FUNCTIONS[f][0]))})' for f in some)} FROM _samples").collect()
        columnwise = df.select("n", *[sql.FUNCTIONS[f][1](*map(F.col, own(sql.FUNCTIONS[f][0]))) for f in some]).collect()
        assert sorted(called) == sorted(columnwise), some
    for name, (arguments, function) in sql.TABLES.items():
        given = ["p", "s"] if name == "expected_rows" else own(arguments)
        got = spark.sql(f"SELECT n, r.* FROM _samples, LATERAL {name}({', '.join(given)}) r")
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        expected = df.select("n", F.posexplode(function(*map(F.col, given))).alias("pos", "item")).select("n", "pos", "item.*")
        assert got.columns == expected.columns and sorted(got.collect()) == sorted(expected.collect()) and got.count()


def test_sql_text(spark):
    """What looks like an operator within a string stays as it is."""
    for c in (F.lit("=(") == F.lit("=("), F.concat(F.lit("'and(' \\"), F.lit("or(")).isin("x", "'and(' \\or("), ~(F.lit(3) % 2 - 1 < 0) & (F.lit(2) >= 2)):
        assert spark.range(1).selectExpr(sql.sql_text(c)).first()[0] is True


def test_first_failed_phase(spark):
    df = spark.createDataFrame([(True, True, True), (True, None, True), (False, False, False), (True, True, False)], "t boolean, c boolean, b boolean")
    assert [r[0] for r in df.select(failure_phase(F.col("t"), F.col("c"), F.col("b"))).collect()] == [None, "compile", "transform", "test"]


@pytest.mark.parametrize(
    ("message", "phase", "one", "many"),
    [
        ("", "compile", "none", "none"), (None, "test", "none", "none"),
        ("Parse error: UnexpectedToken", "transform", "wordy_parse_error", "wordy_parse_or_convert"),
        ("Oxidation failed", "transform", "conversion_error", "wordy_parse_or_convert"), ("odd", "transform", "transform_other", "wordy_parse_or_convert"),
        ("Cannot find value", "compile", "name_resolution", "name_resolution"), ("this function takes 1 argument", "compile", "wrong_signature_or_call", "wrong_signature_or_call"),
        ("mismatched types: expected `i32`, found closure", "compile", "type_mismatch", "type_mismatch"), ("expected `i32`, found closure", "compile", "other", "closure_return_shape"),
        ("assertion failed", "test", "behavior_assertion", "other"), ("no function definition found", "test", "missing_function", "other"),
    ],
)
def test_classes(spark, message, phase, one, many):
    assert value(spark, evaluation_class(F.col("m"), F.col("p")), m=message, p=phase) == one
    assert value(spark, report_class(F.col("m"), F.col("p")), m=message, p=phase) == many
