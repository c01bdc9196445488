"""Ranked lexical search: the best documents of each item by summed term impacts.

Postings of a shard carry integer impacts, and a sparse table over each list
answers where its largest impact within a range of documents lies. Intervals of
documents are taken best first by the sum of those maxima, which bounds every
score inside, and are split at a document of maximum impact. What cannot reach
the worst result kept so far is never scored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from palisade.llm.rows import by_bytes, stored

TOP = 50
ITEM_TERMS = 400_000  # (item, term) pairs that one block of items holds at most, or one item
BATCH_BYTES = 4_000_000  # of text split into terms at a time
SHARD_POSTINGS = 1_000_000  # postings indexed together
AT_ONCE = 64  # intervals taken from the agenda together
FEW_DOCS = 128  # an interval of no more documents is scored outright

_SEPARATE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_JVM_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> list[bytes]:
    """ASCII letters (lower-cased) and digits and all characters above ASCII, in runs."""
    return text.encode().translate(_SEPARATE).split()


# --- the index of a shard -------------------------------------------------------


class SparseTable:
    """Where the largest value of each range lies, for lists laid end to end.

    Level j holds the position of the maximum of 2**j values from each place on;
    a range is covered by two of them. Of equal values the leftmost counts.
    """

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        reach = 1
        while 2 * reach <= longest:
            last = self.levels[-1]
            left, right = last[:len(last) - reach], last[reach:]
            self.levels.append(np.where(values[right] > values[left], right, left))
            reach *= 2

    def argmax(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions of the maxima of non-empty ranges."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), dtype=np.int64)
        for j in np.unique(level):
            at = level == j
            left = self.levels[j][begin[at]]
            right = self.levels[j][end[at] - (1 << int(j))]
            out[at] = np.where(self.values[right] > self.values[left], right, left)
        return out


class Shard:
    """Posting lists of some documents, by term and place, with their impacts."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((docs, terms))
        self.n_docs = n_docs
        self.docs = docs[order]
        self.keys = terms[order] * np.int64(n_docs) + self.docs
        _, sizes = np.unique(terms, return_counts=True)
        self.impacts = impacts[order]
        self.table = SparseTable(self.impacts, int(sizes.max(initial=1)))

    def _ranges(self, terms: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Where the postings of documents begin..end of each term lie, by interval and term."""
        base = terms * np.int64(self.n_docs)
        low = np.searchsorted(self.keys, base[None, :] + begin[:, None])
        high = np.searchsorted(self.keys, base[None, :] + end[:, None])
        return low, high

    def bounds(self, terms: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """For each interval: no score inside is above this, and the document to split at.

        That document holds the largest of the impacts that make up the bound.
        """
        low, high = self._ranges(terms, begin, end)
        row, column = np.nonzero(high > low)
        at = self.table.argmax(low[row, column], high[row, column])
        best = np.zeros(low.shape, dtype=np.int64)
        place = np.zeros(low.shape, dtype=np.int64)
        best[row, column] = self.impacts[at]
        place[row, column] = self.docs[at]
        top = best.argmax(axis=1)
        return best.sum(axis=1), place[np.arange(len(begin)), top]

    def scores(self, terms: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Documents of the intervals with a term, and their exact scores."""
        low, high = self._ranges(terms, begin, end)
        low, size = low.ravel(), (high - low).ravel()
        total = int(size.sum())
        if not total:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty
        first = np.cumsum(size) - size
        at = np.arange(total) + np.repeat(low - first, size)
        docs, inverse = np.unique(self.docs[at], return_inverse=True)
        sums = np.zeros(len(docs), dtype=np.int64)
        np.add.at(sums, inverse, self.impacts[at])
        return docs, sums


class Best:
    """The ``top`` best of what it was shown: by score, then by id, nulls last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.kept: list[tuple] = []  # (score, has an id, -id), the worst in front

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        for score, doc, has in zip(scores.tolist(), ids.tolist(), known.tolist()):
            entry = (score, has, -doc)
            if score <= 0:
                continue
            if len(self.kept) < self.top:
                heapq.heappush(self.kept, entry)
            elif entry > self.kept[0]:
                heapq.heapreplace(self.kept, entry)

    @property
    def floor(self) -> int:
        """Lower scores cannot enter any more; an equal one can, by its id."""
        return self.kept[0][0] if len(self.kept) == self.top else 1


def search(
    shard: Shard, terms: np.ndarray, best: Best, ids: np.ndarray, known: np.ndarray,
    few: int = FEW_DOCS,
) -> int:
    """Show ``best`` all documents of the shard that may enter it; returns how many were scored."""
    if not shard.n_docs or not len(terms):
        return 0
    every = np.array([0]), np.array([shard.n_docs])
    bound, split = shard.bounds(terms, *every)
    agenda = [(-int(bound[0]), 0, shard.n_docs, int(split[0]))]
    scored = 0
    while agenda and -agenda[0][0] >= best.floor:
        taken = []
        while agenda and len(taken) < AT_ONCE and -agenda[0][0] >= best.floor:
            taken.append(heapq.heappop(agenda))
        now, later = [], []
        for _, begin, end, at in taken:
            if end - begin <= few:
                now.append((begin, end))
            else:  # the split document itself, and what lies on both sides
                now.append((at, at + 1))
                later += [(a, b) for a, b in ((begin, at), (at + 1, end)) if b > a]
        docs, sums = shard.scores(terms, *np.array(now).T)
        enough = sums >= best.floor
        best.add(sums[enough], ids[docs[enough]], known[docs[enough]])
        scored += len(docs)
        if later:
            begin, end = np.array(later).T
            bound, split = shard.bounds(terms, begin, end)
            for entry in zip((-bound).tolist(), begin.tolist(), end.tolist(), split.tolist()):
                if -entry[0] >= best.floor:
                    heapq.heappush(agenda, entry)
    return scored


# --- items and documents ----------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term``: the distinct terms of each item; rows of one id are one item."""
    lower = F.translate("text", _UPPER, _LOWER)
    return items.select(
        "item_id", F.explode(F.regexp_extract_all(lower, F.lit(_JVM_TERM), F.lit(0))).alias("term")
    ).distinct()


def _blocks(pairs: DataFrame, limit: int) -> list[DataFrame]:
    """Whole items in blocks of about ``limit`` pairs."""
    n = -(-pairs.count() // limit)
    if n <= 1:
        return [pairs]
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [pairs.filter(block == i) for i in range(n)]


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` and ``tfs`` of each document.

    ``terms`` are places in ``vocabulary``, ascending; others are counted in ``n`` only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast({
        term.encode(): i for i, term in enumerate(vocabulary)
    })
    width = max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found, sizes = [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                found.append(np.fromiter(map(place, words, repeat(-1)), np.int64, len(words)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            term = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            pair, tf = np.unique((row * width + term)[term >= 0], return_counts=True)
            starts = np.searchsorted(pair, np.arange(len(sizes) + 1) * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(starts, pa.array(pair % width, pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(tf, pa.int64())),
            ], ["doc_id", "n", "terms", "tfs"])

    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(count, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class _Wanted:
    """A block of items: their ids, terms and the weights of the vocabulary."""

    items: list
    terms: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    top: int


def _impacts(wanted: _Wanted, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    m = 100 - 50 + (50 * n * wanted.n_docs) // max(1, wanted.n_terms)
    return wanted.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _ranked(counted: DataFrame, wanted: _Wanted, item_type: DataType) -> DataFrame:
    """The best documents of each item in every task."""
    item_kind, item_arrow = item_type.simpleString(), to_arrow_type(item_type)
    kind = counted.schema["doc_id"].dataType.simpleString()
    shared = counted.sparkSession.sparkContext.broadcast(wanted)
    few, enough = FEW_DOCS, SHARD_POSTINGS

    def flush(held: list[pa.RecordBatch], best: list[Best], wanted: _Wanted) -> None:
        ids, known, lengths, rows, terms, impacts, at = [], [], [], [], [], [], 0
        for batch in held:
            doc, lists = batch.column(0), batch.column(2)
            known.append(np.asarray(doc.is_valid()))
            ids.append(np.asarray(doc.fill_null(0)).astype(np.int64))
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            term = np.asarray(lists.flatten()).astype(np.int64)
            tf = np.asarray(batch.column(3).flatten()).astype(np.int64)
            n = np.asarray(batch.column(1)).astype(np.int64)
            impacts.append(_impacts(wanted, term, tf, n[row]))
            lengths.append(n)
            rows.append(row + at)
            terms.append(term)
            at += len(sizes)
        if not at:
            return
        # texts of about one length lie together, which makes the bounds of a range tight
        order = np.argsort(np.concatenate(lengths), kind="stable")
        place = np.empty(at, dtype=np.int64)
        place[order] = np.arange(at)
        shard = Shard(
            np.concatenate(terms), place[np.concatenate(rows)], np.concatenate(impacts), at
        )
        doc_ids, has_id = np.concatenate(ids)[order], np.concatenate(known)[order]
        for item_terms, kept in zip(wanted.terms, best):
            search(shard, item_terms, kept, doc_ids, has_id, few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        best = [Best(wanted.top) for _ in wanted.items]
        held, size, doc_type = [], 0, None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= enough:
                flush(held, best, wanted)
                held, size = [], 0
        flush(held, best, wanted)
        for item, kept in zip(wanted.items, best):
            if kept.kept:
                scores, has, ids = zip(*kept.kept)
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(ids), item_arrow),
                    pa.array([-i if h else None for i, h in zip(ids, has)], doc_type),
                    pa.array(scores, pa.int64()),
                ], ["item_id", "doc_id", "score"])

    return counted.mapInArrow(run, f"item_id {item_kind}, doc_id {kind}, score bigint")


def search_items(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = ITEM_TERMS
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` best documents of each item.

    Every row of ``docs`` (``doc_id`` integer, ``text``) is a document, repeated
    rows too, and is searched by its whole text. A null or text without terms
    counts nowhere. Rows of ``items`` with one ``item_id`` are one item, also
    those with a null id. Equal scores go by ascending ``doc_id``, null ids
    last. Items without results, empty tables and null texts give no rows;
    other columns are ignored.

    The documents are read once for each block of items, a block being whole
    items of about ``block_pairs`` distinct terms together; only a block's
    terms, their document counts and its results' ids ever pass the driver or
    are sent to all tasks. Postings of those terms are written to the shared
    folder. A task holds ``SHARD_POSTINGS`` postings at a time (or those of one
    Arrow batch) and carries its best results on, so later shards begin with a
    high bar.
    """
    item_type = items.schema["item_id"].dataType
    pairs = stored(item_terms(items), "item-terms")
    found = [_search_block(docs, block, top, item_type) for block in _blocks(pairs, block_pairs)]
    best = found[0]
    for block in found[1:]:
        best = best.unionAll(block)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score"
    )


def _search_block(docs: DataFrame, pairs: DataFrame, top: int, item_type: DataType) -> DataFrame:
    block: dict = {}
    for item, term in pairs.collect():
        block.setdefault(item, []).append(term)
    vocabulary = sorted({term for terms in block.values() for term in terms})
    place = {term: i for i, term in enumerate(vocabulary)}
    counted = stored(postings(docs, vocabulary), "postings")
    n_docs, n_terms = counted.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for term, df in frequencies.collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    wanted = _Wanted(
        list(block), [np.array(sorted(place[t] for t in terms), dtype=np.int64) for terms in block.values()],
        weights, int(n_docs), int(n_terms), top,
    )
    return _ranked(counted.filter(F.size("terms") > 0), wanted, item_type)
