"""Column functions on text, tokens and outputs. All of them stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphprep.schema import CLASS_PREFIX, DONE, EDIT_SEPARATOR, NODE, OUTPUT, POINTER


def words(text: Column) -> Column:
    """Split at single spaces; empty words stay. Null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), " ", -1)


def escape(text: Column) -> Column:
    """Backslash, newline, tab and carriage return as two characters each."""
    for raw, seen in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(seen))
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def drop_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def token(text: Column) -> Column:
    """Output tokens are escaped as labels are, so that equal ones can be copied."""
    return F.struct(F.lit("token").alias("kind"), escape(text).alias("token"), F.lit(None).cast("int").alias("pointer"), F.lit(None).cast("string").alias("class")).cast(OUTPUT)


def pointer(at: Column) -> Column:
    return F.struct(F.lit("pointer").alias("kind"), F.lit(None).cast("string").alias("token"), at.cast("int").alias("pointer"), F.lit(None).cast("string").alias("class")).cast(OUTPUT)


def label_class(name: Column) -> Column:
    return F.struct(F.lit("class").alias("kind"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("int").alias("pointer"), name.cast("string").alias("class")).cast(OUTPUT)


def linearise(output: Column, done: bool = True, with_ids: bool = False) -> Column:
    """The output as words: tokens as they are, POINTER or POINTER(id), CLASS_ and the class; DONE at the end."""
    def one(o: Column) -> Column:
        at = F.concat(F.lit(POINTER + "("), o["pointer"].cast("string"), F.lit(")")) if with_ids else F.lit(POINTER)
        return F.when(o["kind"] == "token", o["token"]).when(o["kind"] == "pointer", at).otherwise(F.concat(F.lit(CLASS_PREFIX), o["class"]))

    said = F.transform(output, one)
    return F.concat(said, F.array(F.lit(DONE))) if done else said


def cut_at(tokens: Column, stop: str = DONE) -> Column:
    """What stands before the first `stop`; everything where there is none."""
    at = F.array_position(tokens, stop)
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)


def truncate(tokens: Column, most: int, first: str = "[CLS]", last: str = "[SEP]") -> Column:
    """At most `most` tokens with a delimiter at either end."""
    return F.concat(F.array(F.lit(first)), F.slice(tokens, 1, most - 2), F.array(F.lit(last)))


def pair_lengths(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Lengths after taking from the longer of two sequences until both fit; of equals the second is cut."""
    left = F.least(a, F.greatest(F.lit(most) - b, F.lit(-(-most // 2))))
    return F.when(a + b > most, left).otherwise(a), F.when(a + b > most, F.lit(most) - left).otherwise(b)


def parse_pointer(text: Column) -> Column:
    """k of POINTER(k,...); null if it isn't one."""
    found = F.regexp_extract(text, r"^POINTER\((\d*),.*$", 1)
    return F.when(found != "", found.try_cast("int"))


def parse_error_location(text: Column) -> Column:
    """k of ERROR_LOCATION_k; 1 for BUG_FREE; null for anything else, and for the location 1, which only BUG_FREE may name."""
    found = F.regexp_extract(text, r"^ERROR_LOCATION_(\d+)(?:\s.*$|$)", 1)
    at = F.when(found != "", found.try_cast("int"))
    return F.when(F.startswith(text, F.lit("BUG_FREE")), F.lit(1)).when(at != 1, at)


def parse_edit(script: Column) -> Column:
    """An edit script as output: the operation, pointers to the nodes it names, and the type and value it brings.

    A type may have several parts; they stay joined by the separator. Missing parts and unknown operations are errors.
    """
    parts = F.split(script, r"!#@\$", -1)
    op = F.element_at(parts, 1)
    at = lambda i: pointer(F.element_at(parts, i).cast("int"))
    text = lambda i: token(F.element_at(parts, i))
    kind = lambda first, n: token(F.array_join(F.slice(parts, F.lit(first), n), EDIT_SEPARATOR))
    two_part = F.size(parts) == 6
    return (
        F.when(op == "add_node", F.array(token(op), at(2), at(3), F.when(two_part, kind(4, F.lit(2))).otherwise(text(4)), F.when(two_part, text(6)).otherwise(text(5))))
        .when(op == "del_node", F.array(token(op), at(2)))
        .when(op == "replace_val", F.array(token(op), at(2), text(3)))
        .when(op == "replace_type", F.array(token(op), at(2), kind(3, F.size(parts) - 2)))
        .when(op == "NoOp", F.array(token(op)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown edit operation: "), F.coalesce(op, F.lit("null")))))
    )


def unknown_value(output: Column, labels: Column, in_vocabulary: Column) -> Column:
    """The output of an edit whose new value is neither a node label nor in the output vocabulary, with UNKNOWN in its place."""
    last = F.element_at(output, -1)
    brings = F.element_at(output, 1)["token"].isin("add_node", "replace_val")
    rare = brings & ~F.array_contains(labels, last["token"]) & ~in_vocabulary
    return F.when(rare, F.concat(F.slice(output, F.lit(1), F.size(output) - 1), F.array(token(F.lit("UNKNOWN"))))).otherwise(output)


def remove_prefix(text: Column, prefix: str) -> Column:
    """The text without the prefix, once; as it is where it has none."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def strip_all(text: Column) -> Column:
    """Without white space of any script at both ends, as Unicode defines it."""
    blank = r"[\p{IsWhite_Space}\x1C-\x1F]+"
    return F.regexp_replace(text, f"^{blank}|{blank}$", "")


def integers_of(values: Column) -> Column:
    """The integers of a JSON array that may hold noise; true and false count as 1 and 0, strings of digits don't count."""
    kind = lambda v: F.schema_of_variant(v)
    items = F.from_json(values, "array<variant>")
    number = lambda v: F.when(kind(v) == "BIGINT", F.variant_get(v, "$", "int")).when(kind(v) == "BOOLEAN", F.variant_get(v, "$", "boolean").cast("int"))
    return F.filter(F.transform(items, number), lambda x: x.isNotNull())


def escape_all(text: Column) -> Column:
    """Escape as a string literal would: all characters that don't print as well. escape() covers what occurs in plain text.

    Runs in Python, in batches.
    """

    def literal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repr(t)[1:-1])

    return F.pandas_udf(literal, StringType())(text)


# The words of the Java language by kind.
_JAVA_MODIFIERS = "abstract default final native private protected public static strictfp synchronized transient volatile".split()
_JAVA_BASIC = "boolean byte char double float int long short".split()
_JAVA_KEYWORDS = "assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while".split()
_JAVA_OPERATORS = ">>>= >>= <<= %= ^= |= &= /= *= -= += << -- ++ || && != >= <= == -> :: ... % ^ | & / * - + : ? ~ ! < > =".split()
_JAVA_SEPARATORS = "( ) { } [ ] ; , .".split()
_JAVA_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_JAVA_LITERAL = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\''
_JAVA_NUMBER = r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDlL]?"
_JAVA_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def java_tokens(code: Column) -> Column:
    """Tokens of Java code as structs (type, label), comments left out; an empty array where some of it is no token."""
    signs = "|".join("".join("\\" + c for c in s) for s in _JAVA_OPERATORS + _JAVA_SEPARATORS)
    every = f"{_JAVA_COMMENT}|{_JAVA_LITERAL}|{_JAVA_NUMBER}|{_JAVA_NAME}|@|{signs}"
    found = F.filter(F.regexp_extract_all(code, F.lit(f"({every})"), 1), lambda t: ~F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("/*")))
    first = lambda t: F.substring(t, 1, 1)

    def kind(t: Column) -> Column:
        number = F.when(F.rlike(t, F.lit("^0[xX]")), "HexInteger").when(F.rlike(t, F.lit("^0[bB]")), "BinaryInteger").when(F.rlike(t, F.lit("[.eEfFdD]")), "DecimalFloatingPoint").when(F.rlike(t, F.lit("^0[0-9_]+[lL]?$")), "OctalInteger").otherwise("DecimalInteger")
        word = F.when(t.isin(_JAVA_MODIFIERS), "Modifier").when(t.isin(_JAVA_BASIC), "BasicType").when(t.isin(_JAVA_KEYWORDS), "Keyword").when(t.isin("true", "false"), "Boolean").when(t == "null", "Null").otherwise("Identifier")
        literal = F.when(first(t) == '"', "String").when(first(t) == "'", "Character").when(t == "@", "Annotation").when(t.isin(_JAVA_SEPARATORS), "Separator")
        return literal.when(F.rlike(t, F.lit("^[.]?[0-9]")), number).when(F.rlike(t, F.lit("^[A-Za-z_$]")), word).otherwise("Operator")

    left = F.regexp_replace(F.regexp_replace(code, f"({every})", ""), r"\s+", "")
    tokens = F.transform(found, lambda t: F.struct(kind(t).alias("type"), t.alias("label")))
    return F.when(left == "", tokens).otherwise(F.array().cast("array<struct<type:string,label:string>>"))


def patch_side(patch: Column, after: bool) -> Column:
    """The text before or after a unified diff of one hunk: its unchanged lines and those of that side."""
    lines = F.split(F.regexp_replace(patch, r"^[\s\S]*?(?m)^@@[^\n]*\n", ""), "\n", -1)
    sign = "+" if after else "-"
    own = F.filter(lines, lambda x: F.substring(x, 1, 1).isin(" ", sign))
    return F.array_join(F.transform(own, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def bleu_tokens(text: Column) -> Column:
    """Words for BLEU: letters, digits and signs apart, quotes unified, empties dropped."""
    for pattern, by in ((r"([^A-Za-z0-9_])", " $1 "), (r"([a-z])([A-Z])", "$1 $2"), (r"\s+", " "), ('"', "`"), ("'", "`")):
        text = F.regexp_replace(text, pattern, by)
    return drop_empty(F.split(text, " ", -1))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def node(at: Column, kind: Column, label: Column, candidate: Column | None = None) -> Column:
    return F.struct(at.cast("int").alias("id"), kind.alias("type"), label.alias("label"), (F.lit(None).cast("boolean") if candidate is None else candidate).alias("is_repair_candidate")).cast(NODE)

