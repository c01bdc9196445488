"""Chat formatting in budgeted windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import by_bytes, small_or_not, stored

# FIXED VALUES: the control strings a text may not contain unescaped
OPEN, CLOSE = "<s>", "</s>"
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

BUDGET = 512  # tokens of a window beside the system turn; its last turn may pass it
HISTORY = 128  # tokens of earlier turns that a window repeats at most
MARKS = 2  # tokens that the template adds to a turn
TRAINED_ROLE = "assistant"
_MOVED = 4_000_000

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """Put one more backslash behind the first character of each control string."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss spans (code points) of (role, text, trained)."""
    parts, spans, at = [], [], 0
    for role, text, trained in turns:
        head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
        at += len(head)
        if trained:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def words_and_marks(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\S+")) + MARKS).cast("long")


def with_prefix_sums(turns: DataFrame) -> DataFrame:
    """``place`` (0, 1, ...) and ``before`` (tokens of earlier turns) by conversation.

    ``turns``: ``conv_id``, ``turn``, ``role``, ``text``, ``tokens``. A range
    partitioning on conversation and turn cuts long conversations; each task
    sums its own pieces, and a piece that continues a conversation then takes
    what the earlier pieces hold: at most one row per partition.
    """
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = [*turns.columns, "part", "own_place", "own_before"]
    at_conv, at_tokens = turns.columns.index("conv_id"), turns.columns.index("tokens")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, started, current, place, before = TaskContext.get().partitionId(), False, None, 0, 0
        for batch in batches:
            places, sums = [], []
            for conv, tokens in zip(
                batch.column(at_conv).to_pylist(), batch.column(at_tokens).to_pylist()
            ):
                if not started or conv != current:
                    started, current, place, before = True, conv, 0, 0
                places.append(place)
                sums.append(before)
                place, before = place + 1, before + tokens
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([part] * len(places), pa.int32()),
                pa.array(places, pa.int64()), pa.array(sums, pa.int64()),
            ], names)

    kinds = ", ".join(f"{n} {k}" for n, k in turns.dtypes)
    summed = stored(
        ordered.mapInArrow(running, f"{kinds}, part int, own_place bigint, own_before bigint"),
        "turns",
    )
    pieces = summed.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = pieces.select(
        F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
        F.sum("n").over(earlier).alias("_n"), F.sum("sum").over(earlier).alias("_sum"),
    ).filter("_n IS NOT NULL")
    joined = summed.join(
        small_or_not(offsets),
        (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left",
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        *turns.columns,
        (F.col("own_place") + F.coalesce("_n", zero)).alias("place"),
        (F.col("own_before") + F.coalesce("_sum", zero)).alias("before"),
    )


_SPANS = "array<struct<start: bigint, end: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
    tokens: Column | None = None,
) -> DataFrame:
    """``conv_id``, ``window``, ``text``, ``loss_spans``, ``n_repeated``, ``n_turns``.

    Turns go by ``turn``, ties by role and text, nulls first; null texts and
    roles count as empty; rows with equal keys are turns of their own; a null
    ``conv_id`` is one conversation; other columns are ignored.

    A turn belongs to the window that its prefix sum of tokens falls into, at
    a stride of budget - history. A window after the first also gets the
    leading system turn and, in full turns, the last turns before it of at
    most ``history`` tokens together. Repeated turns come first, are counted in
    ``n_repeated`` and never trained; ``loss_spans`` are the texts of new
    assistant turns. ``tokens`` measures ``text``, by default words and marks;
    it must be at least 1.
    """
    stride = budget - history
    if not 0 <= 2 * history <= budget:
        raise ValueError("history must be at most half of the budget")
    given = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", words_and_marks(F.col("text")) if tokens is None else tokens)
    placed = with_prefix_sums(given).withColumn(
        "own", F.floor(F.col("before") / F.lit(stride)).cast("long")
    )
    system = placed.filter("place = 0 AND role = 'system'").select(
        F.col("conv_id").alias("_conv"), F.col("text").alias("system")
    )
    # a turn may be history of the next window only: windows lie a stride
    # apart, and history is no longer than that
    near = F.col("before") >= (F.col("own") + 1) * stride - history
    uses = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    used = placed.withColumn("_later", F.explode(uses)).select(
        "conv_id", (F.col("own") + F.col("_later")).alias("window"),
        F.struct("place", "before", "role", "text", (F.col("_later") == 0).alias("new")).alias("t"),
    )
    grouped = used.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list("t")).alias("turns")
    ).filter(F.exists("turns", lambda t: t["new"]))
    with_system = grouped.join(
        system, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("window") > 0), "left"
    ).select("conv_id", "window", "turns", "system")
    kind = dict(conversations.dtypes)["conv_id"]

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, repeated, counts = [], [], [], []
            for turns, system in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                start = min(t["before"] for t in turns if t["new"])
                kept = [t for t in turns if t["new"] or start - t["before"] <= history]
                old = [(t["role"], t["text"], False) for t in kept if not t["new"]]
                if system is not None and not any(t["place"] == 0 for t in kept):
                    old.insert(0, ("system", system, False))
                new = [(t["role"], t["text"], t["role"] == TRAINED_ROLE) for t in kept if t["new"]]
                text, loss = format_turns(old + new)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in loss])
                repeated.append(len(old))
                counts.append(len(old) + len(new))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                pa.array(spans, _SPAN_TYPE), pa.array(repeated, pa.int64()),
                pa.array(counts, pa.int64()),
            ], ["conv_id", "window", "text", "loss_spans", "n_repeated", "n_turns"])

    return with_system.mapInArrow(
        formatted, f"conv_id {kind}, window bigint, text string, loss_spans {_SPANS}, "
                   "n_repeated bigint, n_turns bigint",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows alone.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``. A digest runs over a conversation in order, so its
    windows pass through one task, one window at a time.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, id_type = False, None, None
        state: list = []

        def result(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], columns
            )

        def closed() -> tuple:
            n, turns, chars, loss, size = state
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in by_bytes(batches, "text", _MOVED):
            id_type = batch.schema.field(0).type
            rows = []
            for conv, text, spans, repeated in zip(*(c.to_pylist() for c in batch.columns[:1]),
                                                   *(c.to_pylist() for c in batch.columns[2:5])):
                if not started or conv != current:
                    if started:
                        rows.append(closed())
                    started, current = True, conv
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    body = unescape(text[span["start"]:span["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            if rows:
                yield result(rows)
        if started:
            yield result([closed()])

    ordered = formatted.select(
        "conv_id", "window", "text", "loss_spans", "n_repeated"
    ).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                "loss_sha256 string, formatted_chars bigint",
    )
