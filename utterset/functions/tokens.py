"""Exact token counts of a byte-pair vocabulary (UD-3; PX-9, PX-10, PX-11, WN-5 with it).

The estimate of ``functions.text`` has closed forms for "the longest prefix that fits".
A real vocabulary has none: tokens depend on what follows, and a longer prefix may have
fewer tokens. Here a text is tokenized once. The split pattern cuts it into pieces, the
tokens of a piece depend on that piece alone, and a cut in the text can only change the
piece it falls into and the one before. So the tokens of any prefix are a sum over whole
pieces and those of a few characters, and a search over prefixes costs little more than
one count.

The vocabulary is a file of lines ``base64(token) rank``. It is read once, its size is
checked, and it travels to the tasks as a broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_shipped
from .batches import by_slices

# Fixed value: the split pattern that goes with the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a vocabulary file that may be broadcast.
VOCABULARY_BYTES = 64 << 20
#: Pieces whose counts a worker remembers.
KNOWN_PIECES = 200_000
#: Pieces before a cut that are tokenized anew.
REDONE = 2

_loaded: dict[str, "Tokens"] = {}


class Tokens:
    """Counts with one vocabulary, inside a worker."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # White space as the tokenizer's engine has it: Python's \\s also has U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def piece(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            n = len(self.encode(text))
            if len(text) < 64:
                if len(self.known) >= KNOWN_PIECES:
                    self.known.clear()
                self.known[text] = n
        return n


class Prefixes:
    """Token counts of all prefixes of one text."""

    def __init__(self, tokens: Tokens, text: str):
        self.tokens, self.text = tokens, text
        self.starts, self.before = [0], [0]
        for m in tokens.split.finditer(text):
            self.starts.append(m.end())
            self.before.append(self.before[-1] + tokens.piece(m.group()))
        if self.starts[-1] != len(text) or self.before[-1] != tokens.count(text):
            self.starts, self.before = [0], [0]  # characters that both engines class otherwise: count whole prefixes

    def count(self, end: int, suffix: str = "") -> int:
        """Tokens of the first ``end`` characters followed by ``suffix``."""
        from bisect import bisect_right

        at = max(0, bisect_right(self.starts, end) - 1 - REDONE)
        return self.before[at] + self.tokens.count(self.text[self.starts[at]:end] + suffix)

    def longest(self, allowed: int) -> int:
        """Characters of the longest prefix of at most ``allowed`` tokens that halving the
        range finds (the counts are nearly, not strictly, rising)."""
        if allowed <= 0:
            return 0
        low, high = 0, len(self.text)  # a prefix of ``low`` characters fits
        while low < high:
            middle = (low + high + 1) // 2
            if self.count(middle) <= allowed:
                low = middle
            else:
                high = middle - 1
        return low


def trimmed_prompt(tokens: Tokens, text: str, limit: int, marker: str) -> str:
    """``text``, if over ``limit`` tokens: the part up to ``marker`` with the sample lines
    after it that fit, one after another; if still over, its longest prefix."""
    if tokens.count(text) <= limit:
        return text
    head, found, rest = text.partition(marker)
    if found:
        before, lines = head + found + "\n", rest.splitlines()
        whole = before + "\n".join(lines)
        prefixes, end, fitting = Prefixes(tokens, whole), len(before), len(before)
        for i, line in enumerate(lines):
            end += len(line) + (i > 0)
            if prefixes.count(end) > limit:
                break
            fitting = end
        text = whole[:fitting]
    if tokens.count(text) <= limit:
        return text
    return text[:Prefixes(tokens, text).longest(limit)]


def fitting_lines(tokens: Tokens, head: str, lines: list[str], tail: str, limit: int) -> int:
    """How many of ``lines``, in order, fit between ``head`` and ``tail``."""
    prefixes, end = Prefixes(tokens, head + "\n".join(lines)), len(head)
    for i, line in enumerate(lines):
        end += len(line) + (i > 0)
        if prefixes.count(end, tail) > limit:
            return i
    return len(lines)


@dataclass(frozen=True)
class TokenCounter:
    """A vocabulary that queries count with; the methods give columns."""

    held: Any  # Broadcast[bytes]
    digest: str
    pattern: str

    def tokens(self) -> Tokens:
        """The loaded vocabulary, once a worker."""
        key = self.digest + self.pattern
        if key not in _loaded:
            _loaded[key] = Tokens(self.held.value, self.pattern)
        return _loaded[key]

    def count(self, text: str | Column) -> Column:
        """PX-9 with exact tokens; null for null."""
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = self.tokens()
            for texts in batches:
                yield by_slices(lambda part: pa.array([None if t is None else tokens.count(t) for t in part], pa.int64()), texts, pa.int64())
        return F.arrow_udf(run, "long")(_column(text))

    def trim(self, text: str | Column, allowed: int) -> Column:
        """PX-10 with exact tokens: the longest prefix of at most ``allowed`` tokens."""
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = self.tokens()

            def trimmed(t):
                return t if t is None or 0 < tokens.count(t) <= allowed else t[:Prefixes(tokens, t).longest(allowed)]

            for texts in batches:
                yield by_slices(lambda part: pa.array([trimmed(t) for t in part], pa.string()), texts, pa.string())
        return F.arrow_udf(run, "string")(_column(text))

    def trim_prompt(self, text: str | Column, system_prompt: str, marker: str, max_context_tokens: int = 8192,
                    output_reserve_tokens: int = 1024, overhead: int = 20) -> Column:
        """PX-11 with exact tokens."""
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = self.tokens()
            limit = max_context_tokens - output_reserve_tokens - overhead - tokens.count(system_prompt)
            for texts in batches:
                yield by_slices(lambda part: pa.array([None if t is None else trimmed_prompt(tokens, t, limit, marker) for t in part], pa.string()), texts, pa.string())
        return F.arrow_udf(run, "string")(_column(text))

    def fitting(self, lines: str | Column, head: str, tail: str, system_prompt: str, max_context_tokens: int = 8192,
                output_reserve_tokens: int = 1024, overhead: int = 20) -> Column:
        """WN-5 with exact tokens: how many of an array's lines, in order, fit into a prompt."""
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = self.tokens()
            limit = max_context_tokens - output_reserve_tokens - overhead - tokens.count(system_prompt)
            for arrays in batches:
                yield pd.Series([fitting_lines(tokens, head, list(a), tail, limit) for a in arrays], dtype="int32")
        return F.pandas_udf(run, "int")(_column(lines))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_counter(spark: SparkSession, vocabulary: str, pattern: str = PATTERN) -> TokenCounter:
    """A counter for the vocabulary file at ``vocabulary``: a path on the driver, or one
    with a scheme in any store that Spark reads."""
    ensure_shipped(spark)
    if "://" in vocabulary:
        found = spark.read.format("binaryFile").load(vocabulary)
        if found.agg(F.sum("length")).first()[0] > VOCABULARY_BYTES:
            raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
        data = bytes(found.first()["content"])
    else:
        with open(vocabulary, "rb") as f:
            data = f.read(VOCABULARY_BYTES + 1)
        if len(data) > VOCABULARY_BYTES:
            raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    return TokenCounter(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest(), pattern)
