"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.rows import KEY, by_bytes, join_by_row, join_grouped, keyed, row_key, stored
from palisade.llm.sequences import window_hashes

WINDOW = 2  # lines that a boundary depends on
DIVISOR = 2  # one line in so many ends a chunk
CONTEXT = 8  # lines before and after a chunk by which a repeat may be extended
MIN_LINES = 2  # lines that say something in a chunk; poorer ones are never removed by themselves
_MOVED = 4_000_000  # bytes of text unpacked at once


def chunk_bounds(
    lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR
) -> list[tuple[int, int]]:
    """Line ranges of the chunks.

    A chunk ends after a line if the rolling hash over the hashes of the last
    ``window`` lines is a multiple of ``divisor``, and after the last line. A
    boundary depends on those lines alone, so inserted or removed lines move
    no boundary further on.
    """
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolling = window_hashes(hashes, window)
    ends = np.flatnonzero(rolling % np.uint64(divisor) == 0) + window
    ends = np.union1d(ends, [len(lines)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def split_lines(text: str) -> list[bytes]:
    """Lines end at line feeds; an empty text has none."""
    return text.encode().split(b"\n") if text else []


_SAYS = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def seeds(lines: list[bytes], min_lines: int = MIN_LINES) -> list[tuple[int, int]]:
    """Line ranges of the chunks that are looked up.

    A chunk of one line is joined with the line after it, or before it at the
    end. A range begins and ends with a line that says something (holds a
    letter, digit or character above ASCII), so no blank line that parts two
    paragraphs goes with it, and holds ``min_lines`` such lines at least.
    """
    says = [i for i, line in enumerate(lines) if _SAYS.search(line)]
    places, out = np.array(says), []
    for a, b in chunk_bounds(lines) if lines else ():
        if b - a == 1:
            a, b = (a, b + 1) if b < len(lines) else (max(0, a - 1), b)
        low, high = np.searchsorted(places, [a, b])
        if high - low >= min_lines:
            out.append((says[low], says[high - 1] + 1))
    return sorted(set(out))


def _marks(lines: list[bytes]) -> list[int]:
    """A signed hash of each line; the lowest bit tells whether it says something."""
    return [
        ((xxhash.xxh3_64_intdigest(line) | 1) ^ (0 if _SAYS.search(line) else 1)) - (1 << 63)
        for line in lines
    ]


def _chunks(docs: DataFrame, min_lines: int, with_text: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [KEY, "doc_id", "begin", "end", "digest",
             *(["chunk", "before", "after"] if with_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            row, begins, ends, digests, chunks, before, after = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = split_lines(text)
                marks = _marks(lines) if with_text else []
                for a, b in seeds(lines, min_lines):
                    chunk = b"\n".join(lines[a:b])
                    row.append(i)
                    begins.append(a)
                    ends.append(b)
                    digests.append(xxhash.xxh3_64_intdigest(chunk))
                    if with_text:
                        chunks.append(chunk)
                        before.append(marks[max(0, a - CONTEXT):a][::-1])
                        after.append(marks[b:b + CONTEXT])
            row = pa.array(row, pa.int64())
            more = [pa.array(chunks, pa.binary()), pa.array(before, pa.list_(pa.int64())),
                    pa.array(after, pa.list_(pa.int64()))] if with_text else []
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), batch.column(1).take(row),
                pa.array(begins, pa.int32()), pa.array(ends, pa.int32()),
                pa.array(np.array(digests, np.uint64).view(np.int64)), *more,
            ], names)

    text = ", chunk binary, before array<bigint>, after array<bigint>" if with_text else ""
    return docs.mapInArrow(
        cut, f"{KEY} bigint, doc_id {kind}, begin int, end int, digest bigint{text}"
    )


def _reach(one: Column, other: Column) -> Column:
    """How many lines from the chunk on are equal, up to the last one that says something."""
    same = F.zip_with(one, other, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    equal = F.slice(one, F.lit(1), F.when(differs > 0, differs - 1).otherwise(F.size(one)).cast("int"))
    ends = F.transform(equal, lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 1, i + 1).otherwise(0))
    return F.coalesce(F.array_max(ends), F.lit(0))


def repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``_llm_key``, ``doc_id``, ``ranges``: line ranges of repeats, by row.

    The first place of a chunk, by ``doc_id`` (null first), row and line, is
    no repeat. Digests select the candidates; chunks are equal only if their
    bytes are. An equal chunk is then extended line by line, up to ``CONTEXT``
    lines either way, as long as both places go on alike: so lines of a passage
    that share a chunk with others' lines go too. Each line that goes has an
    equal one at an earlier place. Grouping combines copies before they move,
    and each copy then joins the one first place of its chunk, which adaptive
    execution splits for a chunk with many copies.
    """
    marked = _chunks(docs, min_lines, with_text=False)
    often = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    candidates = stored(join_grouped(
        _chunks(docs, min_lines, with_text=True), often.select("digest"), ["digest"], "left_semi"
    ), "chunks")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", KEY, "begin")
    first = candidates.groupBy("digest", "chunk").agg(
        F.min(F.struct(place.alias("place"), "before", "after")).alias("first")
    )
    copies = join_grouped(candidates, first, ["digest", "chunk"]).filter(
        ~place.eqNullSafe(F.col("first.place"))
    )
    start = F.col("begin") - _reach(F.col("before"), F.col("first.before"))
    end = F.col("end") + _reach(F.col("after"), F.col("first.after"))
    return copies.groupBy(KEY, "doc_id").agg(
        F.collect_set(F.struct(start.alias("start"), end.alias("end"))).alias("ranges")
    )


def _keep(text: str | None, ranges) -> tuple[str | None, int, int]:
    if not text:
        return text, 0, 0
    lines = text.split("\n")
    if ranges is None or not len(ranges):
        return text, len(lines), 0
    gone = np.zeros(len(lines), bool)
    for r in ranges:
        gone[r["start"]:r["end"]] = True
    return "\n".join(x for x, out in zip(lines, gone) if not out), len(lines), int(gone.sum())


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    own = ("n_lines", "n_removed")
    repeats = found.withColumnRenamed("ranges", "_llm_ranges")
    joined = join_by_row(docs.drop(*own).withColumn(KEY, row_key()), repeats)

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_keep(t, r) for t, r in zip(texts, ranges)], columns=["text", *own]
        )

    kept = [F.col("_llm_cut.text").alias("text") if c == "text" else F.col(c)
            for c in docs.columns if c not in own]
    return joined.withColumn("_llm_cut", cut("text", "_llm_ranges")).select(
        *kept, "_llm_cut.n_lines", "_llm_cut.n_removed"
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated multi-line chunks, extended to the lines around them, cut from ``text``.

    Adds ``n_lines``, ``n_removed``. Of every line one copy stays, so no
    passage is lost; documents may become empty but every row stays. Single
    lines, and chunks without ``min_lines`` lines that say something, stay. Null
    texts stay null and have no lines, as has the empty text. Rows equal in
    id and text are one document listed twice: they get equal results and do
    not make each other repeats. An empty table stays empty; columns whose
    names begin with ``_llm_`` are reserved.
    """
    return _without(docs, repeated_chunks(keyed(docs), min_lines))
