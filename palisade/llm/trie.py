"""Prefix trie of conversations: which openings they share, and what that saves.

Turns become 128-bit ids. Conversations, cut into segments of bounded length,
are sorted by their ids into ranges. A task lays its range out as a padded
matrix of ids, sorts it, marks where a column differs from the row above and
carries the marks to the right: each mark then starts a node. Sums over the
rows of a node are taken for one depth after the other. A node that holds the
first or last row of a range may go on in another task; those few are summed
up afterwards.

All figures of a node are sums over its members, so ranges can be added up in
any order. What a member adds depends on the depth from which on it is the
smallest member of its path (``own``): from there on each member owns its
nodes, and turns above it are those it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import join_grouped, stored
from palisade.operators.numbering import with_position

SEGMENT = 64  # turns of a matrix row; longer conversations have several rows
BLOCK_CELLS = 1_000_000  # cells of a matrix
SEGMENT_BLOCK = 1024  # segments whose hashes are summed up in one group
_NEVER = (1 << 63) - 1
_PAD = -(1 << 63)

_NODE = (
    "depth bigint, na bigint, nb bigint, pa bigint, pb bigint, whole boolean, conv_id bigint, "
    "n_convs bigint, n_ends bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
)
_NODE_NAMES = [part.split()[0] for part in _NODE.split(", ")]


# --- turns --------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` (1, 2, ...), ``n`` (turns of it), ``a``, ``b``, ``size``.

    ``a`` and ``b`` are 128 bits of hash of role and text, ``size`` the text's
    UTF-8 bytes. Turns go by ``turn``, nulls first, ties by the hash.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
    )
    placed = with_position(
        stored(turns, "turns"), ["turn", "a", "b"], within=["conv_id"], total="n"
    )
    return placed.select("conv_id", "position", "n", "a", "b", "size")


def shared_openings(turns: DataFrame, openings: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group of ids.

    Of conversation c the first h turns, h = crc32(c) % ``openings``, are
    replaced by the first h of conversation c - c % ``group``: all if it has
    fewer, none if there is no such conversation. Returns the turns with
    ``depth`` and ``length`` in the place of ``position`` and ``n``, and one
    row for each conversation, with or without turns.
    """
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(openings))
    longest = openings - 1
    heads = turns.filter(
        (F.pmod("conv_id", F.lit(group)) == 0) & (F.col("position") <= longest)
    ).groupBy(F.col("conv_id").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("position", "a", "b", "size"))).alias("head")
    )
    given = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", taken).withColumn(
        "first", F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    )
    head = F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h").cast("int"))
    opened = stored(
        given.join(heads, "first", "left").withColumn("head", head)
        .withColumn("m", F.size("head").cast("long"))
        .withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "h", "m", "head", "length"),
        "openings",
    )
    from_head = opened.select("conv_id", "length", F.inline("head")).withColumnRenamed("position", "depth")
    own = join_grouped(
        turns.filter(F.col("position") > taken), opened.select("conv_id", "h", "m", "length"), ["conv_id"]
    ).withColumn("depth", F.col("position") - F.col("h") + F.col("m"))
    names = ["conv_id", "depth", "length", "a", "b", "size"]
    return from_head.select(*names).unionAll(own.select(*names)), opened.select("conv_id", "length")


# --- segments -------------------------------------------------------------------------


def _before(parts: DataFrame, names: list[str], total, add) -> DataFrame:
    """``names`` of each part summed up over the earlier parts ``k`` of its conversation.

    Sums run inside groups of parts and over the groups, so that no task has to
    go through all parts of one conversation.
    """
    grouped = parts.withColumn("g", F.floor(F.col("k") / F.lit(SEGMENT_BLOCK)))
    inside = Window.partitionBy("conv_id", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("conv_id", "g").agg(*(total(n).alias(n) for n in names))
    offsets = sums.select("conv_id", "g", *(total(n).over(over).alias(f"{n}_g") for n in names))
    running = grouped.select("conv_id", "g", "k", *(total(n).over(inside).alias(n) for n in names))
    zero = F.lit(0).cast("long")
    return running.join(offsets, ["conv_id", "g"]).select(
        "conv_id", "k", *(add(F.coalesce(n, zero), F.coalesce(f"{n}_g", zero)).alias(n) for n in names)
    )


def segments(turns: DataFrame) -> DataFrame:
    """Rows of the matrix: up to ``SEGMENT`` turns of a conversation in order.

    ``ids`` are the turns' hashes with their depth. The key of a node is the
    exclusive or of the ids down to it, so a later segment needs to know no
    more of the earlier ones than ``pre_a`` and ``pre_b``.
    """
    salted = turns.select(
        "conv_id", "length", "depth", "size",
        F.xxhash64("a", "b", "depth").alias("a"), F.xxhash64("b", "depth", "a").alias("b"),
        F.floor((F.col("depth") - 1) / F.lit(SEGMENT)).alias("k"),
    )
    rows = stored(
        salted.groupBy("conv_id", "k").agg(
            F.max("length").alias("length"),
            F.sort_array(F.collect_list(F.struct("depth", "a", "b", "size"))).alias("cells"),
            F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"),
        ).select(
            "conv_id", "k", "length", "xa", "xb",
            F.transform("cells", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"))).alias("ids"),
            F.col("cells.size").alias("sizes"),
        ),
        "segments",
    )
    long = rows.filter(F.col("length") > SEGMENT)
    earlier = _before(
        long.select("conv_id", "k", F.col("xa").alias("pre_a"), F.col("xb").alias("pre_b")),
        ["pre_a", "pre_b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y),
    )
    zero = F.lit(0).cast("long")
    short = rows.filter(F.col("length") <= SEGMENT).withColumn("pre_a", zero).withColumn("pre_b", zero)
    return short.unionByName(long.join(earlier, ["conv_id", "k"]))


# --- the matrix -------------------------------------------------------------------------


def _nodes_of(
    batches: list[pa.RecordBatch], complete: bool, segment: int
) -> pa.RecordBatch | None:
    """Nodes of some rows; with ``complete`` they are all rows of a range."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return None
    col = {name: table.column(name).combine_chunks() for name in table.column_names}
    number = {n: col[n].to_numpy() for n in ("k", "pre_a", "pre_b", "conv_id", "length", "own", "rest", "leaf")}
    width = np.asarray(col["ids"].value_lengths()).astype(np.int64)
    n, w = len(width), int(width.max())
    valid = np.arange(w) < width[:, None]
    ids = col["ids"].flatten()

    def matrix(flat: np.ndarray, pad: int) -> np.ndarray:
        out = np.full((n, w), pad, dtype=np.int64)
        out[valid] = flat
        return out

    a = matrix(np.asarray(ids.field("a")), _PAD)
    b = matrix(np.asarray(ids.field("b")), _PAD)
    sizes = matrix(np.asarray(col["sizes"].flatten()), 0)
    columns = [c for j in range(w) for c in (a[:, j], b[:, j])]
    order = np.lexsort([*reversed(columns), number["pre_b"], number["pre_a"], number["k"]])
    a, b, sizes, valid = a[order], b[order], sizes[order], valid[order]
    number = {name: values[order] for name, values in number.items()}
    k, conv, length = number["k"], number["conv_id"], number["length"]

    # a row starts a node at every depth from the first column that differs on
    differs = np.ones((n, w), dtype=bool)
    differs[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (valid[1:] != valid[:-1])
    differs[1:, 0] |= (
        (k[1:] != k[:-1]) | (number["pre_a"][1:] != number["pre_a"][:-1])
        | (number["pre_b"][1:] != number["pre_b"][:-1])
    )
    starts = np.logical_or.accumulate(differs, axis=1) & valid

    first = k * segment  # turns before the row's own
    depth = first[:, None] + np.arange(1, w + 1)
    shared = np.where(depth < number["own"][:, None], sizes, 0)
    saved = np.cumsum(shared[:, ::-1], axis=1)[:, ::-1] + number["rest"][:, None]
    key_a = np.bitwise_xor.accumulate(np.where(valid, a, 0), axis=1) ^ number["pre_a"][:, None]
    key_b = np.bitwise_xor.accumulate(np.where(valid, b, 0), axis=1) ^ number["pre_b"][:, None]
    found: list[list[np.ndarray]] = [[] for _ in _NODE_NAMES]
    for j in range(w):
        rows = np.flatnonzero(valid[:, j])
        at = np.flatnonzero(starts[rows, j])
        top = rows[at]
        last = rows[np.append(at[1:], len(rows)) - 1]

        def summed(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values[rows].astype(np.int64), at)

        d = depth[:, j]
        parent = (key_a[top, j - 1], key_b[top, j - 1]) if j else (number["pre_a"][top], number["pre_b"][top])
        whole = (top > 0) & (last < n - 1) if complete else np.zeros(len(top), dtype=bool)
        for out, values in zip(found, (
            d[top], key_a[top, j], key_b[top, j], *parent, whole,
            np.minimum.reduceat(conv[rows], at), np.diff(np.append(at, len(rows))),
            summed(length == d), summed((length > d) & (number["own"] <= d + 1)),
            summed(number["leaf"]), summed(saved[:, j]),
        )):
            out.append(values)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(values)) for values in found], _NODE_NAMES
    )


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node below the root, with the figures its members add up to."""
    segment, limit = SEGMENT, BLOCK_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, cut = [], 0, False
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = max(1, (limit - cells) // segment)
                held.append(batch.slice(at, room))
                at += held[-1].num_rows
                cells += held[-1].num_rows * segment
                if cells >= limit:
                    cut = True
                    yield _nodes_of(held, False, segment)
                    held, cells = [], 0
        if held:
            nodes = _nodes_of(held, not cut, segment)
            if nodes is not None:
                yield nodes

    order = ["k", "pre_a", "pre_b", "ids", "conv_id"]
    used = rows.select(*order, "sizes", "length", "own", "rest", "leaf")
    found = stored(used.repartitionByRange(*order).mapInArrow(run, _NODE), "nodes")
    key = ["depth", "na", "nb", "pa", "pb"]
    figures = ["n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens"]
    parts = found.filter(~F.col("whole")).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(name).alias(name) for name in figures)
    )
    return found.filter("whole").select(*key, "conv_id", *figures).unionByName(parts)


def _with_owners(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with ``own``, ``rest`` and ``leaf`` of their conversations.

    ``own``: depth from which on the conversation is the smallest member of its
    path. ``rest``: bytes above that depth in later segments. ``leaf``: it owns
    a node without children.
    """
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own"),
        F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"),
    )
    known = join_grouped(rows.drop("own", "rest", "leaf"), owners, ["conv_id"], "left").withColumn(
        "own", F.coalesce("own", F.lit(_NEVER))
    ).withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    own_here = F.least(F.greatest(F.col("own") - 1 - F.col("k") * SEGMENT, F.lit(0)), F.lit(SEGMENT))
    shared = F.aggregate(F.slice("sizes", F.lit(1), own_here.cast("int")), zero, lambda x, y: x + y)
    long = known.filter(F.col("length") > SEGMENT).withColumn("here", shared)
    earlier = _before(long.select("conv_id", "k", F.col("here").alias("above")), ["above"], F.sum,
                      lambda x, y: x + y)
    totals = long.groupBy("conv_id").agg(F.sum("here").alias("all"))
    rest = join_grouped(long.join(earlier, ["conv_id", "k"]), totals, ["conv_id"]).withColumn(
        "rest", F.col("all") - F.col("above") - F.col("here")
    )
    short = known.filter(F.col("length") <= SEGMENT).withColumn("rest", zero)
    return short.unionByName(rest.select(*short.columns))


def _ends(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``depth``, ``na``, ``nb``, ``ends_sha256`` of the nodes at which conversations end.

    A digest runs over the ids in order, so the ids that end at one node pass
    through one task; it keeps none of them.
    """
    last = rows.groupBy("conv_id").agg(F.bit_xor("xa").alias("na"), F.bit_xor("xb").alias("nb"))
    zero = F.lit(0).cast("long")
    ended = members.join(last, "conv_id", "left").select(
        F.col("length").alias("depth"), F.coalesce("na", zero).alias("na"),
        F.coalesce("nb", zero).alias("nb"), "conv_id",
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            values = [*current, state.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        names = ["depth", "na", "nb", "ends_sha256"]
        for batch in batches:
            closed = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    if current is not None:
                        closed.append(row())
                    current, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if closed:
                yield pa.Table.from_batches(closed).combine_chunks().to_batches()[0]
        if current is not None:
            yield row()

    key = ["depth", "na", "nb"]
    ordered = ended.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return ordered.mapInArrow(digest, "depth bigint, na bigint, nb bigint, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns``, from the textless root.

    ``turns`` as :func:`shared_openings` gives them; ``members``: ``conv_id``
    and ``length`` of every conversation, also of those without turns. Returns
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of texts that the
    subtree holds once instead of once per member) and ``ends_sha256`` (of the
    members that end there). Without conversations there are no nodes.

    Two turns are equal if 128 bits of hash are.
    """
    rows = segments(turns)
    never, zero = F.lit(_NEVER), F.lit(0).cast("long")
    plain = rows.withColumn("own", never).withColumn("rest", zero).withColumn("leaf", zero)
    nodes = _nodes(_with_owners(rows, _nodes(plain)))
    below = nodes.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter(
        "n_convs > 0"
    ).join(F.broadcast(below)).select(  # one row each
        zero.alias("depth"), zero.alias("na"), zero.alias("nb"),
        F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    every = nodes.select(*root.columns).unionAll(root)
    parents = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("na").alias("pa"), F.col("nb").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    linked = join_grouped(every, parents, ["depth", "pa", "pb"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return linked.join(_ends(members, rows), ["depth", "na", "nb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; columns as for :func:`trie`.

    ``conversations``: ``conv_id`` (integer), ``turn``, ``role``, ``text``; other
    columns are ignored. Null roles and texts count as empty, rows with equal
    keys are turns of their own, rows without a ``conv_id`` belong to no
    conversation, an empty table has no nodes.
    """
    turns = numbered_turns(conversations)
    return trie(
        turns.withColumnsRenamed({"position": "depth", "n": "length"}),
        turns.groupBy("conv_id").agg(F.max("n").alias("length")),
    )


def opened_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that :func:`shared_openings` makes of the given ones."""
    return trie(*shared_openings(numbered_turns(conversations)))
