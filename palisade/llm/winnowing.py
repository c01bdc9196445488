"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import by_bytes, row_key, stored
from palisade.llm.sequences import mix, sliding_minimum

GRAM = 8  # code points
WINDOW = 16  # grams; a common passage of GRAM + WINDOW - 1 code points is always found
_BASE = 0x9E3779B97F4A7C15
_MOVED = 4_000_000  # bytes of text unpacked at once


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Rolling polynomial hash of every run of ``gram`` code points."""
    value, reach, done = codes.astype(np.uint64), 1, None
    offset = 0
    # binary method: hashes of 1, 2, 4, ... code points are put together
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            factor = np.uint64(pow(_BASE, reach, 1 << 64))
            if done is None:
                done = value
            else:
                n = len(codes) - offset - reach + 1
                done = done[:n] * factor + value[offset:offset + n]
            offset += reach
        if gram >> (bit + 1):
            factor = np.uint64(pow(_BASE, reach, 1 << 64))
            value = value[:-reach] * factor + value[reach:]
            reach *= 2
    return mix(done)


def winnow(
    text: str, gram: int = GRAM, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions (code points), in text order.

    Of each window the smallest hash is kept, the rightmost of equal ones. A
    text shorter than a gram counts as one gram, a text with fewer grams than
    a window as one window; an empty text selects nothing.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, min(gram, len(codes)))
    _, at = sliding_minimum(hashes, min(window, len(hashes)))
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared of all distinct selected hashes; two empty fingerprints are alike."""
    one, two = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(one, two, assume_unique=True))
    total = len(one) + len(two) - shared
    return shared / total if total else 1.0


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A short name for a fingerprint with its positions."""
    packed = hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()
    return hashlib.blake2b(packed, digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``hashes``, ``positions``: the winnowed grams of every row.

    Hashes are signed 64-bit values. A null text counts as empty and has
    empty lists; repeated rows each get a row; other columns are ignored.
    """
    def winnow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found = [winnow(text or "", gram, window) for text in texts]
            yield pa.RecordBatch.from_arrays([
                ids,
                pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int64())),
            ], ["doc_id", "hashes", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        winnow_rows, f"doc_id {kind}, hashes array<bigint>, positions array<bigint>"
    )


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the start of the next text."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


_RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_selected long"
)


def _compare(text: str, own, following: str, other) -> tuple:
    changed = edited(text, following)
    changed_print = own if changed == text else winnow(changed)
    return (
        len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(*own),
        digest(*changed_print), likeness(own[0], changed_print[0]),
        likeness(own[0], other[0]), len(own[0]),
    )


def _seam_rows(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
    names = [column.split()[0] for column in _RESULT.split(", ")]
    return pd.DataFrame(
        [_compare(t, winnow(t), o, winnow(o)) for t, o in zip(texts, others)], columns=names
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text against its edited form and against the next document.

    Next is by ascending ``doc_id`` (null first; equal ids by a hash of the
    text), and the first follows the last; a single document follows itself.
    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``n_selected``.
    Null texts count as empty; other columns are ignored.

    Documents are range-partitioned and sorted once, so nearly every next
    document is the next row of the same task, which holds two texts at a
    time. The first and last document of each partition are kept aside and
    matched by partition number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("_h")
    ).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next", "n_selected", "part", "first", "last"]
    schema = f"doc_id {kind}, {_RESULT}, part int, first string, last string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        id_type = None
        previous = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2,
                     pa.int64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )

        for batch in by_bytes(batches, "text", _MOVED):
            id_type = batch.schema.field(0).type
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = winnow(text)
                if previous is None:
                    rows.append((doc_id, *[None] * 7, part, text, None))
                else:
                    rows.append((
                        previous[0], *_compare(previous[1], previous[2], text, own), part, None, None
                    ))
                previous = (doc_id, text, own)
            yield packed(rows)
        if previous is not None:
            yield packed([(previous[0], *[None] * 7, part, None, previous[1])])

    walked = stored(ordered.mapInArrow(walk, schema), "winnow")
    inside = walked.filter("first IS NULL AND last IS NULL").select(*names[:8])

    # one row for each partition that is not empty
    turn = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = walked.filter("first IS NOT NULL").select("part", F.col("first"))
    after = walked.filter("first IS NOT NULL").select("part").withColumn(
        "next_part", F.coalesce(F.lead("part").over(turn), F.min("part").over(whole))
    )
    tails = walked.filter("last IS NOT NULL").select("part", "doc_id", "last").join(after, "part")
    seams = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part")

    at_seam = F.pandas_udf(_seam_rows, _RESULT)
    stitched = seams.select("doc_id", at_seam("last", "first").alias("_r")).select(
        "doc_id", "_r.*"
    )
    return inside.unionByName(stitched)
