"""Column functions on code, prompts and model output, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the wordy notation that can't be plain names.
RESERVED_WORDS = (
    "type", "reference", "mutable", "raw", "pointer", "optional", "result", "list", "box",
    "if", "condition", "then", "otherwise", "compare", "case", "while", "repeat", "for", "each", "in", "iterator",
    "loop", "forever", "exit", "continue", "return",
    "function", "with", "generic", "implementing", "takes", "parameter", "parameters", "returns", "begin", "end",
    "call", "method", "on", "associated",
    "define", "as", "set", "equal", "to", "constant", "static",
    "structure", "fields", "field", "enumeration", "variants", "variant", "of",
    "context", "self", "note", "that",
)
STANDARD_VARIANTS = ("Some", "None", "Ok", "Err")
COLLISION_PREFIX = "user_"
# The sentences of prompts and their contracts.
CONTRACT_MARKER = "Required interface contract (must match exactly):"
PROHIBITED_SYMBOLS = "[&><*-]|::"


def has_only_words(text: Column) -> Column:
    """Whether a text is free of the symbols that the wordy notation spells out."""
    return ~text.rlike(PROHIBITED_SYMBOLS)


def is_reserved(name: Column) -> Column:
    return F.lower(name).isin(*RESERVED_WORDS)


def is_standard_variant(name: Column) -> Column:
    return name.isin(*STANDARD_VARIANTS)


def sanitize_identifier(name: Column) -> Column:
    """A reserved word gets a prefix, its case kept; standard variants stay."""
    return F.when(is_standard_variant(name), name).when(is_reserved(name), F.concat(F.lit(COLLISION_PREFIX), name)).otherwise(name)


def restore_identifier(name: Column) -> Column:
    """Without the prefix, whoever put it there."""
    return F.regexp_replace(name, f"^{COLLISION_PREFIX}", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends, line ends and tabs included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(text: Column, unicode: bool = True) -> Column:
    """Runs of white space as one space, none at the ends."""
    space = r"(?U)\s+" if unicode else r"\s+"
    return F.trim(F.regexp_replace(text, space, " "))


def single_line(text: Column, limit: int = 220, unicode: bool = True) -> Column:
    """One line of at most limit characters; a longer one ends in three dots within the limit."""
    line = collapse(text, unicode)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def compact(text: Column, limit: int = 300, unicode: bool = True) -> Column:
    """One line; of a longer one the first limit characters, and three dots after them."""
    line = collapse(text, unicode)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def crate_name(name: Column, fallback: str = "task", digit_prefix: str = "task_") -> Column:
    """A name of ASCII letters, digits and underscores that doesn't start with a digit."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(clean == "", F.lit(fallback)).when(clean.rlike("^[0-9]"), F.concat(F.lit(digit_prefix), clean)).otherwise(clean)


def _first_match(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches at all."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def function_name(source: Column) -> Column:
    """The first public function's name, else the first function's; null if none takes plain parameters."""
    plain = r"fn\s+(\w+)\s*\("
    return _first_match(source, r"(?m)^\s*pub\s+" + plain, r"(?m)^\s*" + plain)


# Fixed value: the head of a public function, the return type on its line or the next.
FUNCTION_HEAD = r"(?m)^\s*(pub\s+fn\s+[A-Za-z_][A-Za-z0-9_]*\s*\([^\n]*\)\s*(?:->\s*[^{\n]+)?)\s*\{"


def code_signature(source: Column, name: Column) -> Column:
    """What stands before the body of the public function of that name, else of the first one, on one line."""
    heads = F.transform(F.regexp_extract_all(source, F.lit(FUNCTION_HEAD), 1), lambda h: collapse(h))
    own = F.filter(heads, lambda h: F.regexp_extract(h, r"^pub fn (\w+)", 1) == name)
    return F.try_element_at(F.concat(own, heads), F.lit(1))


def wordy_signature(source: Column, name: Column) -> Column:
    """The lines from `function <name>` (else the first function) up to `begin`, joined by bars."""

    def head(lines: Column) -> Column:
        """The lines from the function's own (none if there is no function)."""
        exact = F.array_position(lines, F.concat(F.lit("function "), name))
        any_at = F.array_position(F.transform(lines, lambda x: x.startswith("function ")), F.lit(True))
        start = F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(any_at, F.lit(0)), F.size(lines) + 1).cast("int")
        return F.slice(lines, start, F.size(lines))

    def before_begin(lines: Column) -> Column:
        stop = F.coalesce(F.nullif(F.array_position(lines, F.lit("begin")), F.lit(0)) - 1, F.size(lines)).cast("int")
        return F.array_join(F.filter(F.slice(lines, F.lit(1), stop), lambda x: x != ""), " | ")

    # Each step is bound to a variable, as the lines would be found anew wherever they are named.
    bound = F.array(F.transform(F.split(source, r"\R"), strip))
    return F.get(F.filter(F.transform(F.transform(bound, head), before_begin), lambda x: x != ""), 0)


def strip_contract(prompt: Column) -> Column:
    """Without its contract paragraphs: each goes from the marker line through the blank lines after it."""
    block = r"(?m)^[^\S\n]*\Q" + CONTRACT_MARKER + r"\E[^\S\n]*(?:\n[^\S\n]*\S[^\n]*)*(?:\n[^\S\n]*(?=\n|\z))*\n?"
    return strip(F.regexp_replace(prompt, block, ""))


def user_prompt(task: Column, language: str, signature: Column) -> Column:
    """Task, contract if there is a signature, and the closing instruction, as paragraphs."""
    contract = F.concat(
        F.lit(f"{CONTRACT_MARKER}\n`"), signature,
        F.lit("`\nDo not change the function name, parameters, or return type. You may add helper functions only if needed."),
    )
    return F.concat_ws("\n\n", strip_contract(task), contract, F.lit(f"Write only valid {language} code for this task. Do not include explanations."))


def with_contract(prompt: Column, signature: Column, repeat: bool = False) -> Column:
    """The prompt and its contract; unless repeat, a prompt that has one stays as it is."""
    clean = strip(prompt)
    added = F.concat(clean, F.lit(f"\n\n{CONTRACT_MARKER}\n`"), signature, F.lit("`\nDo not change the function name, parameters, or return type."))
    has = F.lit(False) if repeat else F.contains(clean, F.lit(CONTRACT_MARKER))
    return F.when(has | signature.isNull(), clean).otherwise(added)


def clean_generation(text: Column) -> Column:
    """Model output without the code fence around it; other text is only trimmed."""
    trimmed = strip(text)
    inner = F.regexp_replace(F.regexp_replace(trimmed, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return F.when(F.startswith(trimmed, F.lit("```")), strip(inner)).otherwise(trimmed)


def expected_value(family: Column, prompt: Column) -> Column:
    """struct<call,value>s that a function of the family must return for its prompt; null for other families."""

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(prompt, pattern, group).try_cast("int")

    def case(call: str, value: Column) -> Column:
        return F.struct(F.lit(call).alias("call"), value.cast("string").alias("value"))

    # The phrases by which the prompts of these families give their numbers.
    shift, fallback, popped = number(r"adds\s+(\d+)\s+to\s+input"), number(r"returns\s+(\d+)\."), number(r"vec!\[(\d+),\s*(\d+),\s*(\d+)\]", 3)
    return (
        F.when((family == "closure_shift_const") & shift.isNotNull(), F.array(case("7", shift + 7)))
        .when((family == "result_unwrap_or_const") & fallback.isNotNull(), F.array(case("Ok(123)", F.lit(123)), case('Err(String::from("x"))', fallback)))
        .when((family == "vec_pop_basic") & popped.isNotNull(), F.array(case("", F.concat(F.lit("Some("), popped, F.lit(")")))))
    )


def uses_verbatim(text: Column) -> Column:
    """Whether a converted text holds an item that was taken over as it is."""
    return F.contains(text, F.lit('verbatim item "'))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def round6(value: Column) -> Column:
    """Six decimals, ties to even."""
    return F.bround(value, 6)


def first_message(conversation: Column, role: str) -> Column:
    """The content of the first message of a role in array<struct<role,content>>, else the empty string."""
    return F.coalesce(F.try_element_at(F.filter(conversation, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def resolve_path(base: Column, path: Column) -> Column:
    """Absolute paths stay; others are below base, without . and .. parts."""
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(up, "/"))


# The words that are keywords in token tables.
KEYWORDS = (
    "function", "with", "generic", "type", "implementing", "takes", "returns", "begin", "end", "define", "mutable", "as", "set", "equal", "to",
    "if", "condition", "then", "otherwise", "compare", "case", "while", "repeat", "for", "each", "in", "iterator", "loop", "forever", "exit", "continue", "return",
    "structure", "fields", "Fields", "field", "enumeration", "variants", "variant", "of", "reference", "raw", "pointer", "optional", "result", "list", "box",
    "call", "method", "on", "associated", "constant", "static", "macro", "bracket", "comma", "context", "some", "none", "ok", "error", "note", "that", "unwrap",
    "or", "and", "plus", "minus", "times", "divided", "by", "modulo", "less", "greater", "than", "not", "tuple", "array", "slice", "containing", "create",
    "index", "at", "range", "from", "inclusive", "taking", "returning", "closure", "move", "parameters", "body", "pipe", "verbatim",
)
#: Pieces that make up a whole text: line ends with the spaces after them, notes up to the line's end, strings,
#: quoted characters, numbers, words, commas, and everything else in between.
PIECE = (
    r"(?s)\n *+|note that[^\n]*+"
    r"|\"(?:[^\"\\]++|\\.)*+(?:\"|\\?\z)|'[^']*+(?:'|\z)"
    r"|[0-9]++(?:\.[0-9]++)?+|[A-Za-z_\p{IsAlphabetic}][A-Za-z0-9_\p{IsAlphabetic}\p{N}]*+|,|[^\n\"',0-9_\p{IsAlphabetic}]++"
)


def read_escapes(body: Column) -> Column:
    """A string's value: n, t and r after a backslash are control characters, any other character is itself."""
    parts = F.regexp_extract_all(body, F.lit(r"(?s)[^\\]++|\\.|\\"), 0)
    controls = F.create_map(*[F.lit(x) for x in ("\\n", "\n", "\\t", "\t", "\\r", "\r")])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(controls, p), F.when(F.startswith(p, F.lit("\\")), F.substring(p, 2, 1)).otherwise(p))), "")


def tokens(text: Column) -> Column:
    """array<struct<kind,text>> of a text's tokens in order, the end included.

    A line end is followed by an indent token, whose text is the number of spaces,
    unless the line is blank.  Notes (`note that` to the line's end) and characters
    of no kind are left out.  Strings are without quotes and escapes, quoted
    characters without quotes; both end with the text if they aren't closed.  Names
    are without the prefix that sets them apart from reserved words.
    """
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)

    none = F.expr("cast(array() as array<struct<kind:string,text:string>>)")

    def token(kind: str | Column, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("text"))

    def read(piece: Column, following: Column) -> Column:
        code = F.ascii(piece)  # of the first character; whether it is a letter is asked only where that isn't plain
        indent = F.array(token("indent", (F.length(piece) - 1).cast("string")))
        line = F.concat(F.array(token("newline", F.lit("\n"))), F.when(following.isNotNull() & (F.ascii(following) != 10), indent).otherwise(none))
        closed = (F.length(piece) > 1) & F.endswith(piece, F.lit("'"))
        inner = F.substr(piece, F.lit(2), F.length(piece) - F.when(closed, 2).otherwise(1))
        string = F.regexp_extract(piece, r'(?s)\A"((?:[^"\\]++|\\.)*+)', 1)
        name = F.when(F.startswith(piece, F.lit(COLLISION_PREFIX)), F.substr(piece, F.lit(len(COLLISION_PREFIX) + 1))).otherwise(piece)
        kind = F.when(piece.isin(*KEYWORDS), "keyword").when(piece.isin("true", "false"), "boolean").otherwise("identifier")
        word = F.when(F.startswith(piece, F.lit("note that")), none).otherwise(F.array(token(kind, name)))
        plain = code.between(97, 122) | code.between(65, 90) | (code == 95)
        return (
            F.when(plain, word).when(code == 32, none).when(code == 10, line).when(code == 44, F.array(token("comma", piece)))
            .when(code.between(48, 57), F.array(token(F.when(F.contains(piece, F.lit(".")), "float").otherwise("integer"), piece)))
            .when(code == 34, F.array(token("string", read_escapes(string)))).when(code == 39, F.array(token("string", inner)))
            .when((code > 127) & piece.rlike(r"\A\p{IsAlphabetic}"), word).otherwise(none)
        )

    end = F.array(token("end of file", F.lit("")))
    # Bound to a variable, as the pieces would be found anew wherever they are named.
    found = F.get(F.transform(F.array(pieces), lambda p: F.flatten(F.zip_with(p, F.slice(p, 2, 1 << 30), read))), 0)
    return F.concat(found, end)


# How the characters of an item that is taken over as it is are written.
_ESCAPED = (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("'", "\\'"), ('"', '\\"'))


def escape_item(text: Column) -> Column:
    """Printable ASCII as it is, quotes and backslashes escaped, and all other characters by name or code point."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[\x20-\x7e\t\r\n]++|."), 0)

    def written(piece: Column) -> Column:
        plain = piece
        for char, code in _ESCAPED:
            plain = F.replace(plain, F.lit(char), F.lit(code))
        return F.when(piece.rlike(r"\A[\x20-\x7e\t\r\n]"), plain).otherwise(F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(piece))), F.lit("}")))

    return F.array_join(F.transform(pieces, written), "")


def unescape_item(text: Column) -> Column:
    """The inverse of escape_item; the notation's own reader (read_escapes) leaves code points as they are written."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\u\{[0-9a-f]+\}|\\.|[^\\]++"), 0)
    chars = F.create_map(*[F.lit(x) for char, code in _ESCAPED for x in (code, char)])

    def code_point(piece: Column) -> Column:
        return F.conv(F.regexp_extract(piece, r"\{([0-9a-f]+)\}", 1), 16, 10).cast("int")

    def from_code(n: Column) -> Column:
        """A character by its UTF-8 bytes."""
        tail = lambda shift: F.shiftright(n, shift).bitwiseAND(63) + 128
        hexes = lambda *parts: F.concat(*[F.lpad(F.hex(x), 2, "0") for x in parts])
        utf8 = (
            F.when(n < 0x80, hexes(n)).when(n < 0x800, hexes(F.shiftright(n, 6) + 192, tail(0)))
            .when(n < 0x10000, hexes(F.shiftright(n, 12) + 224, tail(6), tail(0))).otherwise(hexes(F.shiftright(n, 18) + 240, tail(12), tail(6), tail(0)))
        )
        return F.decode(F.unhex(utf8), "UTF-8")

    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("\\u{")), from_code(code_point(p))).otherwise(F.coalesce(F.try_element_at(chars, p), p))), "")
