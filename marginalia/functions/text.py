"""Text expressions: tokens, sentences, regular-expression spans and case or space normalisation.

Everything that needs no offsets is a built-in expression.  Offsets of pieces come from one narrow Arrow pass, which needs no
shuffle; a window over exploded pieces would sort every token of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.batches import ROWS, in_batches

#: Characters that are tokens of their own.
PUNCTUATION = ".,:;!?()[]{}-”“"
_CLASS = "".join("\\" + c if c in "[](){}.?-" else c for c in PUNCTUATION)
#: Runs of white space, single punctuation characters, and everything between: together they cover a text.
COVERING = rf"(?U)[\s\x1c-\x1f]+|[{_CLASS}]|[^\s\x1c-\x1f{_CLASS}]+"
TOKEN = rf"(?U)[{_CLASS}]|[^\s\x1c-\x1f{_CLASS}]+"
_PY_TOKEN = re.compile(rf"[{_CLASS}]|[^\s{_CLASS}]+")
#: A sentence ends behind ! or ? and behind a full stop that isn't followed by a small letter or inside a number, unless a no-break space or one of , . : ; follows.
SENTENCE_END = r"(?<=\.)(?!\p{Ll})(?!(?<=\p{Nd}\.)\p{Nd})(?![\x{a0},.:;])|(?<=[!?])(?![\x{a0},.:;])"


def tokens(text: Column) -> Column:
    """The word and punctuation tokens of a text, as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def sentences(text: Column, keep_tail: bool = False) -> Column:
    """The sentences of a text, stripped, runs of other white space made one space; what follows the last end is left out unless asked for."""
    pieces = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    pieces = F.filter(pieces, (lambda p: p != "") if keep_tail else (lambda p: F.substring(p, -1, 1).isin(".", "!", "?")))
    return F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def token_counts(text: Column) -> Column:
    """(n_tokens, n_chars, n_marks) of a text: its tokens, their characters and how many of them are punctuation, without listing them."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    spaces = F.length(F.regexp_replace(t, r"(?U)[^\s\x1c-\x1f]+", ""))
    return F.struct(count(TOKEN).alias("n_tokens"), (F.length(t) - spaces).cast("long").alias("n_chars"), count(f"[{_CLASS}]").alias("n_marks"))


def normalize_spaces(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stripped_range(text: Column) -> Column:
    """Where the stripped text begins and ends in the text."""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    return F.struct(lead.alias("start"), (lead + F.length(strip(text))).alias("end"))


def same_length(text: Column, changed: Column) -> Column:
    """A case mapping, where it keeps the length, so that character references stay valid; otherwise the text as it was."""
    return F.when(F.length(text) == F.length(changed), changed).otherwise(text)


def spans(df: DataFrame, key: str, text: str, pattern: str, group: int = 0, position: str = "i", value: str = "match") -> DataFrame:
    """(key, position, match, start, end) of every match of a pattern in a text column: character offsets, in one narrow pass.

    A null text has no match.  Matches leave the pass in batches of bounded size, so a worker holds no more for more documents or longer ones.
    """
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([df.schema[key], StructField(position, IntegerType()), StructField(value, StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rule = re.compile(pattern)

        def packed(batch, rows, sizes, places, values, flat):
            bounds = np.array(flat, dtype=np.int32).reshape(-1, 2)
            keys = batch.column(0).take(pa.array(np.repeat(rows, sizes)))
            return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(places)), pa.array(values, pa.string()), pa.array(bounds[:, 0]), pa.array(bounds[:, 1])], schema.names)

        for batch in batches:
            # of a document's matches as many at a time as the batch at hand has room for
            rows, sizes, places, values, flat = held = [], [], [], [], []
            for row, t in enumerate(batch.column(1)):
                matches, at = rule.finditer(t.as_py() or ""), 0
                while some := list(islice(matches, ROWS - len(values))):
                    rows.append(row)
                    sizes.append(len(some))
                    places.append(np.arange(at, at + len(some), dtype=np.int32))
                    values += [m[group] for m in some]
                    flat += [m.span(group) for m in some]
                    at += len(some)
                    if len(values) == ROWS:
                        yield packed(batch, *held)
                        for x in held:
                            x.clear()
            if values:
                yield packed(batch, *held)

    return in_batches(df.select(key, text), found, schema)


def word_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tok_id, token, start, end) of every token."""
    return spans(df, key, text, _PY_TOKEN.pattern, position="tok_id", value="token")


def token_arrays(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): each document's tokens in order with their offsets, as one array, in one narrow pass; documents without tokens are left out."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([df.schema[key], StructField("tokens", _parse_datatype_string("array<struct<tok_id:int,token:string,start:int,end:int>>"))])

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row, t in enumerate(batch.column(1)):
                # pieces of a document's array, so that its matches aren't all held at once
                matches, pieces, at = _PY_TOKEN.finditer(t.as_py() or ""), [], 0
                while some := list(islice(matches, ROWS)):
                    bounds = np.array([m.span() for m in some], dtype=np.int32)
                    places = np.arange(at, at + len(some), dtype=np.int32)
                    pieces.append(pa.StructArray.from_arrays([pa.array(places), pa.array([m[0] for m in some], pa.string()), pa.array(bounds[:, 0]), pa.array(bounds[:, 1])], ["tok_id", "token", "start", "end"]))
                    at += len(some)
                if pieces:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.ListArray.from_arrays(pa.array([0, at], pa.int32()), pa.concat_arrays(pieces))], schema.names)

    return in_batches(df.select(key, text), found, schema)


def _merged(protected: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(p for p in protected if p[0] < p[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def keep_as_words(text: str, protected: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Tokens of a text in which protected ranges stay whole; protected ranges that properly overlap are merged, touching ones aren't."""
    out, at = [], 0
    for a, b in [*_merged(protected), [len(text), len(text)]]:
        out += [(m[0], at + m.start(), at + m.end()) for m in _PY_TOKEN.finditer(text[at:a])]
        if a < b:
            out.append((text[a:b], a, b))
        at = b
    return out


def count_as_words(text: str, protected: list[tuple[int, int]]) -> int:
    """How many tokens ``keep_as_words`` gives, without holding them."""
    n = at = 0
    for a, b in [*_merged(protected), [len(text), len(text)]]:
        n += sum(1 for _ in _PY_TOKEN.finditer(text, at, a)) + (a < b)
        at = b
    return n


def lines_with(text: str, needle: str) -> list[tuple[int, int]]:
    """The ranges of the lines that hold a string, each once; a pattern around it would try every character of every other line."""
    out, at = [], text.find(needle)
    while at >= 0:
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        out.append((start, end))
        at = text.find(needle, end)
    return out
