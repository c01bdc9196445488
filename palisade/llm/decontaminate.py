"""Benchmark decontamination: test phrases searched in an FM-index per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.debruijn import merge_ranges
from palisade.llm.fm_index import FMIndex
from palisade.llm.rows import KEY, by_bytes, join_by_row, keyed, row_key
from palisade.llm.sequences import word_bounds

WINDOW = 10  # words
ITEM_BYTES = 4_000_000  # text of the benchmark that is searched in one pass
SHARD_BYTES = 8_000_000  # text of the documents under one index

# A-Z to a-z; digits, letters and all non-ASCII bytes stay; the rest separates
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A
    else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20
    for c in range(256)
)


def folded(text: str | None) -> bytes:
    """The text's bytes, folded one by one, so that byte positions stay."""
    return (text or "").encode().translate(_FOLD)


@dataclass
class Phrases:
    """Distinct windows of a block of items, over a vocabulary of their words."""

    vocabulary: dict[bytes, int]
    by_length: list[tuple[np.ndarray, list[list[int]]]]  # windows, items of each
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((w.shape[1] for w, _ in self.by_length), default=0)


def phrases(rows: list[tuple], window: int = WINDOW) -> Phrases:
    """From (item_id, text) rows; a null id reads as the empty string."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    items: dict[str, int] = {}
    for item_id, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in folded(text).split()]
        item = items.setdefault("" if item_id is None else str(item_id), len(items))
        if ids:
            for i in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[i:i + window]), set()).add(item)
    lengths: dict[int, list[tuple[int, ...]]] = {}
    for key in windows:
        lengths.setdefault(len(key), []).append(key)
    return Phrases(vocabulary, [
        (np.array(keys, np.int64), [sorted(windows[k]) for k in keys])
        for _, keys in sorted(lengths.items())
    ], list(items))


def search_shard(texts: list[str | None], wanted: Phrases) -> list[tuple[int, list[int], list[tuple[int, int]]]]:
    """Of each text: number of words, items with an occurring window, hit word ranges.

    Words outside the vocabulary cannot be hit, so they only end runs; runs
    too short for any window are left out of the index.
    """
    get, parts, counts = wanted.vocabulary.get, [], []
    for text in texts:
        words = folded(text).split()
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))  # no window spans two documents
    out: list[tuple[int, list[int], list[tuple[int, int]]]] = [(n, [], []) for n in counts]
    symbols = np.concatenate(parts)
    inside = np.concatenate(([False], symbols != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= max(1, wanted.shortest)
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts) or not wanted.by_length:
        return out
    lengths = ends - starts + 1  # with the 0 that follows
    place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    index = FMIndex(symbols[place].astype(np.int64), len(wanted.vocabulary))

    first_word = np.cumsum([0, *counts[:-1]]) + np.arange(len(counts))
    begins, finishes, hit_items = [], [], set()
    for windows, items in wanted.by_length:
        which, low, high = index.search(windows)
        interval, position = index.locate(low, high)
        at = place[position]
        begins.append(at)
        finishes.append(at + windows.shape[1])
        document = np.searchsorted(first_word, at, side="right") - 1
        seen = np.unique(np.stack((document, which[interval])), axis=1)
        hit_items |= {(d, i) for d, w in seen.T.tolist() for i in items[w]}
    begin, finish = np.concatenate(begins), np.concatenate(finishes)
    if len(begin):
        for a, b in zip(*merge_ranges(begin, finish)):
            document = int(np.searchsorted(first_word, a, side="right")) - 1
            shift = int(first_word[document])
            out[document][2].append((int(a) - shift, int(b) - shift))
    for document, item in sorted(hit_items):
        out[document][1].append(item)
    return out


_SPANS = "array<struct<start: bigint, end: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(docs: DataFrame, wanted: Phrases) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        # Spark's batches are joined or cut to shards of about equal bytes
        for batch in by_bytes(batches, "text", SHARD_BYTES):
            found = search_shard(batch.column(2).to_pylist(), wanted)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[wanted.items[i] for i in items] for _, items, _ in found],
                         pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in spans] for _, _, spans in found],
                         _SPAN_TYPE),
            ], [KEY, "doc_id", "n_words", "items", "spans"])

    return docs.mapInArrow(
        search, f"{KEY} bigint, doc_id {kind}, n_words bigint, items array<string>, spans {_SPANS}"
    )


def _item_blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The items in blocks of bounded text, so that one fits any machine."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    # ids and short texts count as well
    blocks = max(1, -(-2 * (size[0] + 64 * size[1]) // limit)) if size[0] + 64 * size[1] > limit else 1
    if blocks == 1:
        return [items]
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.filter(number == i) for i in range(blocks)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``_llm_key``, ``doc_id``, ``n_words``, ``items``, ``spans`` of every row.

    ``spans``: word ranges covered by occurrences, merged. The benchmark is
    the query set; it is searched in blocks of about ``item_bytes`` of text.
    """
    rows = keyed(docs)
    blocks = [
        _search(rows, phrases([tuple(r) for r in block.collect()], window))
        for block in _item_blocks(benchmark, item_bytes)
    ]
    if len(blocks) == 1:
        return blocks[0]
    every = blocks[0]
    for block in blocks[1:]:
        every = every.unionAll(block)
    merged = every.groupBy(KEY, "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        _union_spans(F.flatten(F.collect_set("spans"))).alias("spans"),
    )
    return join_by_row(rows.select(KEY, "doc_id"), merged)


def _union_spans(spans: Column) -> Column:
    @F.pandas_udf(_SPANS)
    def union(given: pd.Series) -> pd.Series:
        out = []
        for ranges in given:
            if len(ranges):
                a, b = merge_ranges(np.array([r["start"] for r in ranges]),
                                    np.array([r["end"] for r in ranges]))
                out.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            else:
                out.append([])
        return pd.Series(out)

    return union(spans)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items``, ``spans`` of every row.

    Words are runs of digits, letters (A-Z as a-z) and non-ASCII characters.
    An item's windows are its sequences of ``window`` words, or its only
    sequence if it is shorter; an item without words has none. A word inside
    an occurrence is hit. ``items`` are the ids, as text, of items with an
    occurring window; rows of one item id are one item. Null texts have no
    words; repeated rows each get a row; other columns are ignored.
    """
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return find_hits(docs, benchmark, window, item_bytes).select(
        "doc_id", "n_words", hit.alias("n_hit"), "items", "spans"
    )


def cut_words(text: str, spans: list) -> str:
    """The text without the bytes from the first to the last word of each range."""
    data = text.encode()
    starts, ends = word_bounds(folded(text))
    kept, at = [], 0
    for span in spans:
        kept.append(data[at:starts[span["start"]]])
        at = ends[span["end"] - 1]
    return b"".join([*kept, data[at:]]).decode()


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; all rows and columns stay.

    Rows without hits are unchanged, null texts included.
    """
    hits = find_hits(docs, benchmark, window).filter(F.size("spans") > 0)
    hits = hits.select(KEY, "doc_id", F.col("spans").alias("_llm_spans")).dropDuplicates([KEY, "doc_id"])
    joined = join_by_row(docs.withColumn(KEY, row_key()), hits)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            t if s is None or not len(s) else cut_words(t, s) for t, s in zip(texts, spans)
        ], dtype=object)

    return joined.withColumn("text", cut("text", "_llm_spans")).select(*docs.columns)
