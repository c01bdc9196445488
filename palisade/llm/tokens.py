"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1_000_000  # of text that one call of the tokenizer gets
PIECE_CHARS = 1_000_000  # longer texts are cut at safe boundaries first
CACHE_UNITS = 1_000_000  # lengths kept by a worker, then it starts anew

# A text may be cut before a space if the next character is no white space, or
# the one before is none: there the pre-tokenizer always ends a piece.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_SAFE = re.compile(r"(?<=\S) | (?=\S)")
# Pieces end only here: the rest of a run of spaces stays with what is before it,
# so a later piece begins with the one space that its first unit has lost.
_CUT = re.compile(r" (?=\S)")


def units(text: str) -> list[str]:
    """Parts between safe boundaries; all but the first lost their leading space."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text before spaces that no white space follows.

    All but the first piece begin with one space. A piece is longer than
    ``limit`` only if it holds no such boundary later on.
    """
    begin = 0
    while len(text) - begin > limit:
        boundary = _CUT.search(text, begin + limit)
        if boundary is None:
            break
        yield text[begin:boundary.start()]
        begin = boundary.start()
    yield text[begin:]


class TokenCounter:
    """Counts tokens; only lengths leave the tokenizer.

    Texts are cut into units whose tokens do not depend on their neighbours,
    and each distinct unit is encoded once per worker.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._inner: dict[str, int] = {}  # tokens of a space and the unit
        self._first: dict[str, int] = {"": 0}  # tokens of a unit that begins a text

    def _learn(self, known: dict[str, int], missing: list[str], before: str) -> None:
        for batch in _by_size(missing, BATCH_BYTES, _n_bytes):
            encoded = self._tokenizer.encode_batch_fast(
                [before + unit for unit in batch], add_special_tokens=False
            )
            known.update(zip(batch, map(len, encoded)))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; give it about ``BATCH_BYTES`` at a time."""
        if len(self._inner) > CACHE_UNITS:
            self._inner.clear()
        if len(self._first) > CACHE_UNITS:
            self._first = {"": 0}
        totals = [0] * len(texts)
        for group in _by_size(
            [(i, j, piece) for i, text in enumerate(texts)
             for j, piece in enumerate(pieces(text))],
            BATCH_BYTES, lambda item: _n_bytes(item[2]),
        ):
            cut = [(i, j == 0, units(piece)) for i, j, piece in group]
            # only the first piece of a text has no space before its first unit
            heads = {parts[0] for _, begins, parts in cut if begins}
            rests = [parts[1:] if begins or not parts[0] else parts for _, begins, parts in cut]
            self._learn(self._first, [u for u in heads if u not in self._first], "")
            inner = set().union(*rests)
            self._learn(self._inner, [u for u in inner if u not in self._inner], " ")
            for (i, begins, parts), rest in zip(cut, rests):
                totals[i] += (self._first[parts[0]] if begins else 0) + sum(
                    map(self._inner.__getitem__, rest)
                )
        return totals


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    """One per worker process, so that later tasks find its lengths."""
    return TokenCounter(path)


def _n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _by_size(items: list, limit: int, size) -> Iterator[list]:
    batch, total = [], 0
    for item in items:
        if batch and total + size(item) > limit:
            yield batch
            batch, total = [], 0
        batch.append(item)
        total += size(item)
    if batch:
        yield batch


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row.

    Whole texts are encoded, without added special tokens; special strings
    inside a text are handled as the tokenizer does by default. A null or empty
    text has no bytes and no tokens. Repeated rows each get their own row;
    other columns are ignored. The tokenizer file is loaded by each worker from
    ``tokenizer_path``, which must exist on every machine.
    """

    @F.pandas_udf("n_bytes long, n_tokens long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer_path)
        for texts in batches:
            given = texts.fillna("").tolist()
            counts: list[int] = []
            for group in _by_size(given, BATCH_BYTES, _n_bytes):
                counts += counter.count(group)
            yield pd.DataFrame({
                "n_bytes": [_n_bytes(text) for text in given], "n_tokens": counts,
            })

    return docs.select("doc_id", lengths("text").alias("_n")).select(
        "doc_id", "_n.n_bytes", "_n.n_tokens",
        (F.col("_n.n_tokens") > limit).alias("over_limit"),
    )
