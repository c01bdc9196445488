"""Removal of long repeated passages through a compacted De Bruijn graph of words.

The edges of the graph are all sequences of ``span`` consecutive words; an
edge is repeated if it starts at two or more places. A word goes if a repeated
edge covers it.

Edges are too many to shuffle one by one, so each document compacts them
first. The least of the hashed ``core``-word sequences inside an edge is its
core; consecutive edges with the same core occurrence form one nonbranching
path, and two places with an equal edge have an equal core at the same offset.
Joins then settle the paths: cores seen once are dropped; paths whose words
are all equal elsewhere are repeated as a whole; and where different paths
share a core, they are opened again and their edges compared, each distinct
path once. Repeated paths that follow each other in two documents are joined
into long spans, and the words at both source coordinates are compared by
digest before either span is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import KEY, by_bytes, join_by_row, join_grouped, keyed, small_or_not, stored
from palisade.llm.sequences import sliding_minimum, window_hashes, word_bounds, word_hashes

SPAN = 35  # words
CORE = 10  # words of the sequence that a path is known by
_MOVED = 4_000_000  # bytes of text unpacked at once
_PATH = ["core", "path_a", "path_b"]


def _words(text: str) -> np.ndarray:
    data = text.encode()
    return word_hashes(data, *word_bounds(data))


def paths(words: np.ndarray, span: int, core: int) -> tuple[np.ndarray, ...]:
    """First edge, number of edges, core hash and two hashes of the words of each path."""
    edges = len(words) - span + 1
    if edges <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    cores = window_hashes(words, core, lane=2)
    least, at = sliding_minimum(cores, span - core + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, edges))
    length = count + span - 1
    return (
        first, count, least[first].view(np.int64),
        window_hashes(words, length, first, lane=1).view(np.int64),
        window_hashes(words, length, first, lane=2).view(np.int64),
    )


def _document_paths(docs: DataFrame, span: int, core: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [KEY, "doc_id", "first", "edges", *_PATH]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            found = [paths(_words(text), span, core) for text in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [np.concatenate([f[i] for f in found]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                *(pa.array(c, pa.int64()) for c in columns[2:]),
            ], names)

    return docs.mapInArrow(
        find, f"{KEY} bigint, doc_id {kind}, first int, edges int, "
              "core bigint, path_a bigint, path_b bigint",
    )


def _edges_of(wanted: DataFrame, span: int) -> DataFrame:
    """``edge_a``, ``edge_b``, the path's number and the edge's offset in the path."""
    names = ["edge_a", "edge_b", "path", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                a, b = window_hashes(words, span, lane=1), window_hashes(words, span, lane=2)
                count = np.array([x["edges"] for x in asked])
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat([x["first"] for x in asked], count) + offset
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[start].view(np.int64)), pa.array(b[start].view(np.int64)),
                    pa.array(np.repeat(np.array([x["path"] for x in asked], np.int64), count)),
                    pa.array(offset, pa.int32()),
                ], names)

    return wanted.mapInArrow(
        cut, "edge_a bigint, edge_b bigint, path bigint, offset int"
    )


_PLACE = [KEY, "doc_id"]
_RANGE = [*_PLACE, "a", "b"]


def _long_spans(candidates: DataFrame, span: int) -> DataFrame:
    """Word ranges whose paths also stand elsewhere, with the place of the copy.

    ``_llm_key``, ``doc_id``, ``a``, ``b`` and the same of the other place,
    ``other_key``, ``other_id``, ``other_a``. Each repeated path points at the
    least of its places; paths that follow each other in both documents make
    one span.
    """
    place = F.struct(KEY, F.col("doc_id").isNull().alias("unknown"), "doc_id", "first")
    least = candidates.groupBy(*_PATH).agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("other")
    ).filter("n > 1").drop("n")
    away = join_grouped(candidates, least, _PATH).filter(~place.eqNullSafe(F.col("other"))).select(
        *_PLACE, "first", "edges",
        F.col(f"other.{KEY}").alias("other_key"), F.col("other.doc_id").alias("other_id"),
        (F.col("other.first") - F.col("first")).alias("shift"),
    )
    pair = [*_PLACE, "other_key", "other_id", "shift"]
    along = Window.partitionBy(*pair).orderBy("first")
    begins = F.col("first") != F.lag(F.col("first") + F.col("edges")).over(along)
    number = F.sum(F.coalesce(begins.cast("int"), F.lit(0))).over(along)
    return away.withColumn("_span", number).groupBy(*pair, "_span").agg(
        F.min("first").alias("a"),
        F.max(F.col("first") + F.col("edges") + F.lit(span - 1)).alias("b"),
    ).select(*_RANGE, "other_key", "other_id", (F.col("a") + F.col("shift")).alias("other_a"))


def _with_text(docs: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    # a left join, so that all readers of the texts share one shuffle of them
    joined = join_by_row(docs, asked).filter(F.col(columns[-1]).isNotNull())
    return joined.select(*columns)


def _digests(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``digest`` of the words of each range (``_llm_key``, ``doc_id``, ``a``, ``b``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = ranges.distinct().groupBy(*_PLACE).agg(F.collect_list(F.struct("a", "b")).alias("asked"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            row, a, b, digests = [], [], [], []
            for i, (text, wanted) in enumerate(
                zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ):
                words = text.encode().split()
                for x in wanted:
                    row.append(i)
                    a.append(x["a"])
                    b.append(x["b"])
                    digests.append(hashlib.sha256(b" ".join(words[x["a"]:x["b"]])).digest())
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), batch.column(1).take(row),
                pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(digests, pa.binary()),
            ], [*_RANGE, "digest"])

    return _with_text(docs, asked, [*_PLACE, "text", "asked"]).mapInArrow(
        digest, f"{KEY} bigint, doc_id {kind}, a int, b int, digest binary"
    )


def _verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Both places of each span whose words are the same at both."""
    there = spans.select(
        F.col("other_key").alias(KEY), F.col("other_id").alias("doc_id"),
        F.col("other_a").alias("a"),
        (F.col("other_a") + F.col("b") - F.col("a")).alias("b"),
    )
    digests = _digests(docs, spans.select(*_RANGE).unionAll(there))

    def joined(rows: DataFrame, at: list[str], name: str) -> DataFrame:
        side = digests.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(_RANGE)),
                              F.col("digest").alias(name))
        match = F.col(at[1]).eqNullSafe(F.col("_1"))
        for i in (0, 2, 3):
            match = match & (F.col(at[i]) == F.col(f"_{i}"))
        return rows.join(side, match).drop("_0", "_1", "_2", "_3")

    ends = spans.withColumn("other_b", F.col("other_a") + F.col("b") - F.col("a"))
    both = joined(joined(ends, _RANGE, "here"), ["other_key", "other_id", "other_a", "other_b"], "there")
    same = both.filter("here = there")
    places = F.array(
        F.struct(*_RANGE),
        F.struct(F.col("other_key").alias(KEY), F.col("other_id").alias("doc_id"),
                 F.col("other_a").alias("a"), F.col("other_b").alias("b")),
    )
    return same.select(F.inline(places)).distinct()


def repeated_spans(docs: DataFrame, span: int = SPAN, core: int = CORE) -> DataFrame:
    """``_llm_key``, ``doc_id``, ``spans``: word ranges to remove, by row.

    ``docs`` as :func:`palisade.llm.rows.keyed` gives them. Rows without
    repeats are absent.
    """
    found = _document_paths(docs, span, core)
    either = F.xxhash64("path_a", "path_b")  # half the bytes to shuffle
    repeated = found.groupBy("core").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(either) != F.max(either)).alias("varied"),
    ).filter("n > 1").select("core", "varied")
    candidates = stored(join_grouped(found, repeated, ["core"]), "paths")

    whole = _verified(docs, stored(_long_spans(candidates, span), "spans"))

    # a tuple of firsts belongs to one row: any place of a path will do
    distinct = stored(candidates.filter("varied").groupBy(*_PATH).agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in [*_PLACE, "first", "edges"])
    ).withColumn("path", F.monotonically_increasing_id()), "distinct")
    asked = distinct.groupBy(*_PLACE).agg(
        F.collect_list(F.struct("first", "edges", "path")).alias("asked")
    )
    edges = _edges_of(_with_text(docs, asked, ["text", "asked"]), span)
    both = ["edge_a", "edge_b"]
    shared = edges.groupBy(*both).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the path's number is short; its hashes come back once its edges are grouped
    parts = join_grouped(edges, shared.select(*both), both).groupBy("path").agg(
        F.collect_list("offset").alias("offsets")
    )
    # a path that is repeated as a whole needs no parts
    once = distinct.filter("n = 1").select("path", *_PATH)
    parts = parts.join(once, "path").drop("path")
    starts = F.transform("offsets", lambda o: F.col("first") + o)
    partly = join_grouped(candidates, parts, _PATH).select(*_PLACE, F.explode(starts).alias("a")).withColumn(
        "b", F.col("a") + F.lit(span)
    )
    # rows equal in id and text stand at one place and repeat each other
    twice = small_or_not(
        docs.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_PLACE)
    )
    listed = join_by_row(candidates, twice, "left_semi").select(
        *_PLACE, F.col("first").alias("a"),
        (F.col("first") + F.col("edges") + F.lit(span - 1)).alias("b"),
    )
    return whole.unionAll(partly.select(*_RANGE)).unionAll(listed).groupBy(*_PLACE).agg(
        F.collect_list(F.struct("a", "b")).alias("spans")
    )


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted, disjoint ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]


def remove_repeats(docs: DataFrame, span: int = SPAN, core: int = CORE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept``, ``spans`` of every row.

    Words are runs without white space, unchanged. ``kept`` is the words that
    stay, joined by one space; ``spans`` the removed word ranges. All copies of
    a repeated passage go. A null or empty text has no words; texts shorter
    than ``span`` stay whole; repeated rows are repeats of each other; other
    columns are ignored. Long spans are compared by SHA-256 of their words, the
    single edges at their borders by two 64-bit hashes of the same word hashes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    joined = join_by_row(rows, repeated_spans(rows, span, core)).select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            counts, removed, kept, merged = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                counts.append(len(words))
                if not spans:
                    removed.append(0)
                    merged.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                starts, ends = merge_ranges(
                    np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans])
                )
                removed.append(int((ends - starts).sum()))
                merged.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                stay, at = [], 0
                for a, b in zip(starts, ends):
                    stay += words[at:a]
                    at = b
                kept.append(b" ".join(stay + words[at:]).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(
        cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, "
             "spans array<struct<start: bigint, end: bigint>>",
    )
