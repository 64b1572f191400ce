"""Annotator reply parsing as column expressions (PX-14, PX-15, PX-16).

A reply is free text that should contain one JSON object. Steps, as in the
reference: strip; drop code fences; cut from the first ``{`` to the last
``}``; parse; if that fails, drop trailing commas before ``}``/``]`` and parse
again. Parsing uses ``try_parse_json`` (VARIANT), so a bad reply becomes a
reject row instead of a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, py_strip

# What is cut from a reply before it is parsed (Java regex syntax).
FENCE = r"(?im)^```(?:json)?" + WS + r"*|" + WS + r"*```$"
TRAILING_COMMA = r"," + WS + r"*([}\]])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def json_candidate(reply) -> Column:
    """The substring that will be parsed."""
    t = F.regexp_replace(py_strip(_c(reply)), FENCE, "")
    start = F.instr(t, "{")
    rpos = F.instr(F.reverse(t), "}")
    end = F.when(rpos > 0, F.length(t) - rpos + 1).otherwise(F.lit(0))
    return F.when((start > 0) & (end > start), t.substr(start, end - start + 1)).otherwise(t)


def parse_reply(reply) -> Column:
    """VARIANT of the reply's JSON object, or NULL."""
    cand = json_candidate(reply)
    return F.coalesce(F.try_parse_json(cand), F.try_parse_json(F.regexp_replace(cand, TRAILING_COMMA, "$1")))


def reply_error(reply, parsed: Column) -> Column:
    """NULL when the reply is usable, else a short reason."""
    kind = F.schema_of_variant(parsed)
    return (F.when(F.coalesce(F.length(_c(reply)), F.lit(0)) == 0, F.lit("empty response"))
            .when(parsed.isNull(), F.lit("invalid json"))
            .when(~kind.startswith("OBJECT"), F.lit("not a json object")))


def reply_fields(parsed: Column) -> dict[str, Column]:
    """``label_id`` (upper-cased), ``label_name`` and ``confidence``.

    Confidence: a number (or boolean) as a double, a numeric string parsed, and
    0.5 for anything else (missing, null, words, nested values). Values are not
    clamped to [0, 1], like the reference.
    """
    return {
        "label_id": F.upper(F.coalesce(F.try_variant_get(parsed, "$.label_id", "string"), F.lit(""))),
        "label_name": F.coalesce(F.try_variant_get(parsed, "$.label_name", "string"), F.lit("")),
        "confidence": F.coalesce(F.try_variant_get(parsed, "$.confidence", "double"), F.lit(0.5)),
    }
