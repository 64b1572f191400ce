"""Scalar text functions, all JVM-side column expressions (no UDFs).

Whitespace: Python's ``str.strip`` / ``\\s`` match every Unicode space,
including U+3000 (ideographic space, common in Chinese text) and
U+001C..U+001F. Java's ``(?U)\\s`` misses only U+001C..U+001F and Spark's
``trim`` strips only U+0020, so every function here uses one explicit class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class used everywhere (Java regex syntax).
WS = r"(?U)[\s\x1c-\x1f]"
WS_RUN = r"(?U)[\s\x1c-\x1f]+"
WS_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_space(col) -> Column:
    """Strip, then turn every whitespace run into one space (PX-2)."""
    collapsed = F.regexp_replace(_c(col), WS_RUN, " ")
    return F.regexp_replace(collapsed, r"^ | $", "")


def remove_space(col) -> Column:
    """Remove every whitespace character: the group key of the re-split (PX-3)."""
    return F.regexp_replace(_c(col), WS_RUN, "")


def py_strip(col) -> Column:
    """Strip leading and trailing whitespace exactly like ``str.strip`` (PX-4)."""
    return F.regexp_replace(_c(col), WS_EDGES, "")


def strip_upper(col) -> Column:
    """Strip and upper-case a label (PX-5)."""
    return F.upper(py_strip(col))


def text_prefix(col, n: int = 300) -> Column:
    """At most ``n`` leading characters (PX-6: the prompt sample line)."""
    return F.substring(_c(col), 1, n)


def token_estimate(col) -> Column:
    """``max(1, ceil(len / 4))``: the token count used without a tokenizer (PX-9)."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(_c(col)) / F.lit(4)))


def trim_to_tokens(col, allowed) -> Column:
    """Longest prefix whose estimate stays within ``allowed`` tokens (PX-10).

    For the ``ceil(len/4)`` estimate the binary search has a closed form:
    4 * allowed characters, or '' when nothing is allowed.
    """
    allowed = allowed if isinstance(allowed, Column) else F.lit(allowed)
    c = _c(col)
    return F.when(allowed <= 0, F.lit("")).otherwise(c.substr(F.lit(1), (allowed * 4).cast("int")))


def sanitize_label_id(id_col, name_col) -> Column:
    """Upper-case, keep ``[A-Z0-9_]``; if nothing is left use md5(name)[:8] upper (PX-7)."""
    kept = F.regexp_replace(F.upper(_c(id_col).cast("string")), r"[^A-Z0-9_]", "")
    fallback = F.upper(F.substring(F.md5(F.coalesce(_c(name_col).cast("string"), F.lit(""))), 1, 8))
    return F.when(F.coalesce(F.length(kept), F.lit(0)) > 0, kept).otherwise(fallback)


def json_quote(col) -> Column:
    """A JSON string literal for ``col`` as Python's ``json.dumps(ensure_ascii=False)``
    writes it: backslash, quote and control characters escaped, the rest kept."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    c = F.replace(c, F.lit("\r"), F.lit("\\r"))
    c = F.replace(c, F.lit("\t"), F.lit("\\t"))
    c = F.replace(c, F.lit("\b"), F.lit("\\b"))
    c = F.replace(c, F.lit("\f"), F.lit("\\f"))
    for code in sorted(set(range(0x20)) - set(b"\n\r\t\b\f")):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


# What ends a line for Python's ``str.splitlines`` (Java regex syntax).
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def split_lines(col) -> Column:
    """The lines of ``col`` as ``str.splitlines`` cuts them: no line after a final
    line end, and none in an empty text."""
    c = _c(col)
    lines = F.split(c, LINE_END)
    lines = F.when(c.rlike(f"({LINE_END})\\z"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(lines)


def contains_any(col, words) -> Column:
    """Substring-any predicate (FL-8): ``any(w in text for w in words)``."""
    c = _c(col)
    pred = F.lit(False)
    for w in words:
        pred = pred | F.contains(c, F.lit(w))
    return pred
