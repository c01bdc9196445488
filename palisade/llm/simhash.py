"""SimHash near-duplicates found by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import connected_components
from palisade.llm.rows import (
    KEY, by_bytes, join_by_row, join_grouped, row_key, small_or_not, stored,
)

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
PARTS = 2  # keys of about 32 bits: few unrelated fingerprints share one, at any size
SAMPLE = 2048  # fingerprints the partition and its thresholds are fitted on
BLOCK = 256  # members of a key that are compared with one another in one group
_CHUNK = 100_000  # shingles hashed at once
_MOVED = 4_000_000  # bytes of text unpacked at once


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, total: int) -> int:
    """Bit i is set if it was set in over half of the hashes; signed."""
    packed = np.packbits(counts * 2 > total, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles with their repeats, as a signed 64-bit number.

    A-Z count as a-z. Fewer words than a shingle make one shingle; no words
    give zero.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return _majority(_bit_counts(
            np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)), 1)
    counts, total = np.zeros(64, np.int64), len(found) - words + 1
    for begin in range(0, total, _CHUNK):
        part = found[begin:begin + _CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        counts += _bit_counts(hashes)
    return _majority(counts, total)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) of every row; a null text has no words.

    A column ``_llm_key`` is kept if there is one.
    """
    names = [name for name in (KEY, "doc_id") if name in docs.columns]
    given = docs.select(*names, "text")
    kinds = "".join(f"{name} {given.schema[name].dataType.simpleString()}, " for name in names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            values = [fingerprint(text or "", words, seed) for text in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values, pa.int64())], [*names, "fingerprint"]
            )

    return given.mapInArrow(rows, f"{kinds}fingerprint bigint")


# --- partition of the bits and thresholds -----------------------------------

def group_bits(sample: np.ndarray, parts: int = PARTS) -> list[int]:
    """Masks of ``parts`` equal groups of bits, correlated bits together.

    What one bit of a group says about another is then lost to one key only.
    """
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(np.float64) - bits.mean(axis=0) if len(sample) else np.zeros((1, 64))
    spread = np.sqrt((centred**2).sum(axis=0))
    scale = np.where(spread == 0, 1, spread)
    alike = np.abs(centred.T @ centred / np.outer(scale, scale))
    np.fill_diagonal(alike, 0)
    free, masks = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (1 if i < 64 % parts else 0)
        inside = [max(free, key=lambda b: (alike[b, sorted(free)].max(), -b))]
        while len(inside) < width:
            left = sorted(free - set(inside))
            inside.append(max(left, key=lambda b: (alike[b, inside].sum(), -b)))
        free -= set(inside)
        masks.append(sum(1 << b for b in inside))
    return masks


def flips(mask: int, radius: int) -> list[int]:
    """All changes of at most ``radius`` bits of a part, as masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in picked)
            for size in range(radius + 1) for picked in combinations(bits, size)]


def allocate(
    sample: np.ndarray, masks: Sequence[int], total: int, distance: int = DISTANCE
) -> list[int]:
    """A radius for each part, -1 to leave it out, at the least estimated work.

    Pairs within ``distance`` are complete if the radii sum to
    distance - parts + 1: were each part further apart than its radius, the
    distance would exceed the limit. Work of a part is its probes plus the
    candidates that the sample's pairs predict for ``total`` fingerprints.
    """
    budget = distance - len(masks) + 1
    n = len(sample)
    pairs = max(1, n * (n - 1) // 2)
    scale = total * max(0, total - 1) / 2 / pairs
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, mask in enumerate(masks):
        part = sample & np.uint64(mask)
        near = np.zeros(65, np.int64)
        for row in range(1, n):
            near += np.bincount(np.bitwise_count(part[:row] ^ part[row]), minlength=65)
        within = np.cumsum(near)
        following: dict[int, tuple[float, list[int]]] = {}
        later = len(masks) - i - 1
        for spent, (cost, radii) in best.items():
            for radius in range(-1, distance + 1):
                if spent + radius - later > budget:
                    break  # the parts to come give back at most one each
                work = 0.0 if radius < 0 else total * len(flips(mask, radius)) + within[radius] * scale
                key = spent + radius
                if key not in following or cost + work < following[key][0]:
                    following[key] = (cost + work, [*radii, radius])
        best = following
    return best[budget][1]


# --- probing and verifying ---------------------------------------------------

def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _index(nodes: DataFrame, masks: Sequence[int], radii: Sequence[int]) -> DataFrame:
    used = [(i, mask) for i, (mask, radius) in enumerate(zip(masks, radii)) if radius >= 0]
    parts = F.array(*(
        F.struct(F.lit(i).alias("part"),
                 F.col("probe").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for i, mask in used
    ))
    return nodes.withColumn("_p", F.explode(parts)).select(
        "slot", "_p.part", "_p.key", "node"
    )


def _probes(nodes: DataFrame, masks: Sequence[int], radii: Sequence[int]) -> DataFrame | None:
    """Changed keys; of the two directions of a change one is enough."""
    found = None
    for i, (mask, radius) in enumerate(zip(masks, radii)):
        changes = [c for c in flips(mask, radius) if c] if radius > 0 else []
        if not changes:
            continue
        options = F.array(*(
            F.struct(F.lit(_signed(c)).alias("c"),
                     F.lit(_signed(1 << (c.bit_length() - 1))).alias("top"))
            for c in changes
        ))
        upward = F.filter(options, lambda o: F.col("probe").bitwiseAND(o["top"]) == 0)
        rows = nodes.withColumn("_o", F.explode(upward)).select(
            "slot", F.lit(i).alias("part"),
            F.col("probe").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("_o.c")).alias("key"),
            "node",
        )
        found = rows if found is None else found.unionAll(rows)
    return found


def _star_links(distance: int, wide_distance: int):
    """Compare the members of each group; emit each linked one with its group's least."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            group = table.column("g").to_numpy()
            node = table.column("node").to_numpy()
            probe = table.column("probe").to_numpy().view(np.uint64)
            lists = table.column("wide").combine_chunks()
            wide = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            wide = wide.reshape(len(node), -1) if len(wide) else None
            label = np.arange(len(node))
            pairs = []
            for step in range(1, len(node)):
                at = np.flatnonzero(group[step:] == group[:-step])
                if not len(at):
                    break
                near = np.bitwise_count(probe[at] ^ probe[at + step]) <= distance
                at = at[near]
                if wide is not None and len(at):
                    apart = np.bitwise_count(wide[at] ^ wide[at + step]).sum(axis=1)
                    at = at[apart <= wide_distance]
                if len(at):
                    pairs.append(np.stack((at, at + step)))
            if pairs:
                a, b = np.concatenate(pairs, axis=1)
                while True:  # least position reachable inside the group
                    low = np.minimum(label[a], label[b])
                    before = label.copy()
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                    label = label[label]
                    if np.array_equal(before, label):
                        break
            moved = np.flatnonzero((label != np.arange(len(node))) & (node != node[label]))
            return pa.RecordBatch.from_arrays(
                [pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"]
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            if not len(table):
                continue
            group = table.column("g").to_numpy()
            changes = np.flatnonzero(group[1:] != group[:-1])
            last = int(changes[-1]) + 1 if len(changes) else 0
            kept = table.slice(last)
            if last:
                yield compared(table.slice(0, last))
        if kept is not None and len(kept):
            yield compared(kept)

    return links


def links(
    nodes: DataFrame, distance: int = DISTANCE, wide_distance: int = 0, block: int | None = None
) -> DataFrame:
    """Edges (``u``, ``v``) that connect all nodes with near fingerprints.

    ``nodes``: ``node`` (unique long), ``probes`` (array of 64-bit
    fingerprints, all rows equally many), ``wide`` (array, may be empty).
    Two nodes are linked if some pair of fingerprints in the same place differs
    in at most ``distance`` bits and, where ``wide`` is given, those in at most
    ``wide_distance``. Not every link is returned, but what links connect stays
    connected: within a group of members compared, each is tied to the least
    one it reaches. A key with many members is cut into blocks, every two of
    which meet in a group of their own, so no group is large and none is left
    out.
    """
    flat = nodes.select("node", F.posexplode("probes").alias("slot", "probe"))
    sample_rows = (
        flat.filter("slot = 0").select("probe").distinct()
        .orderBy(F.xxhash64("probe"), "probe").limit(SAMPLE).collect()
    )
    sample = np.array([row[0] for row in sample_rows], np.int64).view(np.uint64)
    masks = group_bits(sample)
    radii = allocate(sample, masks, nodes.count(), distance)

    index = _index(flat, masks, radii)
    place = ["slot", "part", "key"]
    shared = index.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*place)
    probes = _probes(flat, masks, radii)
    if probes is None:
        members, touched = None, shared
    else:
        members = stored(probes.join(index.select(*place).distinct(), place, "left_semi"), "hits")
        touched = shared.unionAll(members.select(*place)).distinct()
    own = index.join(touched, place, "left_semi")
    members = stored(own if members is None else own.unionAll(members), "members")

    most = block or BLOCK
    sizes = members.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    counted = members.join(small_or_not(sizes), place, "left")
    blocks = F.coalesce(F.ceil(F.col("n") / F.lit(most)), F.lit(1)).cast("long")
    placed = counted.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64("node"), F.col("_blocks"))
    ).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    grouped = placed.select(
        F.xxhash64(*place, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("g"),
        "slot", "node",
    )
    full = grouped.join(flat, ["node", "slot"]).join(
        nodes.select("node", "wide"), "node"
    ).select("g", "node", "probe", "wide")
    together = full.repartition("g").sortWithinPartitions("g", "node")
    return together.mapInArrow(_star_links(distance, wide_distance), "u bigint, v bigint")


def classes(
    signed: DataFrame, distance: int = DISTANCE, wide_distance: int = 0, block: int | None = None
) -> DataFrame:
    """``signed`` (``doc_id``, ``probes``, ``wide``, ...) with ``component_id``.

    ``component`` numbers the components within one run. Rows with equal fingerprints are one node, so copies cost one row each.
    ``component_id`` is the smallest ``doc_id`` reachable over links, null only
    if all ids of the component are null.
    """
    same = signed.groupBy("probes", "wide").agg(F.min("doc_id").alias("_least"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = stored(connected_components(links(nodes, distance, wide_distance, block)), "members")
    least = nodes.join(member, "node").groupBy("component").agg(F.min("_least").alias("_found"))
    linked = join_grouped(member, least, ["component"]).select("node", "_found")
    roots = member.withColumnRenamed("component", "_root")
    named = nodes.join(linked, "node", "left").join(roots, "node", "left").select(
        "probes", "wide", F.coalesce("_found", "_least").alias("component_id"),
        F.coalesce("_root", "node").alias("component"),
    )
    return signed.join(named, ["probes", "wide"])


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    Fingerprints of three-word shingles link at ``distance`` or fewer differing
    bits; texts without words have fingerprint zero and link like any other.
    Repeated rows each get a row, null texts count as empty, null ids never
    name a component unless it has no other. Other columns are ignored.
    """
    hexed = F.lpad(F.lower(F.hex(F.col("probes")[0])), 16, "0")
    return classes(_signed_rows(docs), distance).select(
        "doc_id", hexed.alias("fingerprint"), "component_id"
    )


def _signed_rows(docs: DataFrame) -> DataFrame:
    prints = stored(fingerprints(docs), "fingerprints")
    return prints.select(
        *(name for name in prints.columns if name != "fingerprint"),
        F.array("fingerprint").alias("probes"), F.array().cast("array<bigint>").alias("wide"),
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` without near-duplicates: of each group one row stays, all columns.

    Groups are those of :func:`near_duplicates`: what links of at most
    ``distance`` differing bits connect. The row with the smallest ``doc_id``
    stays (ties: by a hash of the text; a null id only if the group has no
    other). Texts without words are one group; null texts count as empty.
    Repeated rows are one document.
    """
    own = docs.withColumn(KEY, row_key())
    found = classes(_signed_rows(own), distance)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        "component"
    ).agg(F.min(KEY).alias(KEY), F.first("doc_id").alias("doc_id")).select(KEY, "doc_id")
    return join_by_row(own, stays, "inner").dropDuplicates([KEY, "doc_id"]).select(*docs.columns)
