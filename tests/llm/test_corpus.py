"""Operators that compare documents with one another."""

import zlib
import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from palisade.llm import (
    components, debruijn, fm_index, lines, mixing, sequences, simhash, toxicity, winnowing,
)
from tests.llm import cases as data


# --- hashes and the index

def test_sequence_hashes_and_minima():
    text = "a bb  a\nbb c a bb".encode()
    starts, ends = sequences.word_bounds(text)
    words = sequences.word_hashes(text, starts, ends)
    assert words[0] == words[2] == words[5] and words[1] == words[3] == words[6] != words[4]
    pairs = sequences.window_hashes(words, 2)
    assert pairs[0] == pairs[2] == pairs[5] and len(set(pairs.tolist())) == 4
    values = np.array([3, 1, 1, 5, 2, 2, 2, 9])
    for width in range(1, 9):
        least, at = sequences.sliding_minimum(values, width)
        for i in range(len(values) - width + 1):
            part = values[i:i + width]
            assert least[i] == part.min()
            assert at[i] == i + max(k for k in range(width) if part[k] == part.min())


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(4)
    for _ in range(60):
        runs = [np.append(rng.integers(1, 4, rng.integers(1, 15)), 0) for _ in range(rng.integers(1, 8))]
        symbols = np.concatenate(runs)
        index = fm_index.FMIndex(symbols, 3, rate=4)
        for length in (1, 2, 3, 5):
            patterns = rng.integers(1, 4, (20, length))
            which, low, high = index.search(patterns)
            interval, position = index.locate(low, high)
            got = sorted(zip(which[interval].tolist(), position.tolist()))
            assert got == sorted(
                (k, i) for k in range(20) for i in range(len(symbols))
                if np.array_equal(symbols[i:i + length], patterns[k]))


# --- line dedup

def test_line_chunks_resist_shifts():
    text = [b"line %d" % i for i in range(300)]
    bounds = {tuple(text[a:b]) for a, b in lines.chunk_bounds(text)}
    moved = [b"new", *text[:100], b"inserted", *text[100:]]
    again = {tuple(moved[a:b]) for a, b in lines.chunk_bounds(moved)}
    assert len(bounds - again) <= 3


def test_line_dedup_is_brute_force(spark):
    rows = data.rows(2, 40)
    found = lines.dedup_lines(spark.createDataFrame(rows, data.SCHEMA).withColumnRenamed("score", "n_lines"))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "n_lines", "n_removed"]
    first = {}
    for doc_id, text in dict.fromkeys((r[0], r[1]) for r in rows):
        own = lines.split_lines(text or "")
        for a, b in lines.seeds(own):
            place = ((doc_id is not None, doc_id or 0, a), own)
            first[tuple(own[a:b])] = min(first.get(tuple(own[a:b]), place), place)

    def says(line):
        return any(c.isalnum() or ord(c) > 127 for c in line.decode())

    def reach(mine, theirs):
        n = last = 0
        while n < min(len(mine), len(theirs), 8) and mine[n] == theirs[n]:
            n += 1
            last = n if says(mine[n - 1]) else last
        return last

    want = Counter()
    for row in rows:
        own, gone = lines.split_lines(row[1] or ""), set()
        for a, b in lines.seeds(own):
            place, theirs = first[tuple(own[a:b])]
            if place != (row[0] is not None, row[0] or 0, a):
                at = place[2]
                gone |= set(range(a - reach(own[:a][::-1], theirs[:at][::-1]),
                                  b + reach(own[b:], theirs[at + b - a:])))
        kept = [x.decode() for i, x in enumerate(own) if i not in gone]
        text = "\n".join(kept) if row[1] else row[1]
        want[row[0], text, len(own), len(gone)] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect())
    assert got == want and any(k[3] for k in got)
    assert lines.dedup_lines(data.empty(spark)).collect() == []


# --- mixing

def filled(sizes, weights):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free)
                  for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, "d": 3, None: 700}, {"a": 5}, {"a": 0, "b": 9},
    {chr(97 + i): (i * 37) % 11 * 100 for i in range(20)},
])
def test_targets_are_shared_by_weight(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame, (5, 2, 1)).collect()}
    want = filled(sizes, (5, 2, 1))
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_repeats_by_rate(spark):
    frame = data.frame(spark)
    counted = mixing.with_copies(frame).collect()
    assert len(counted) == len(data.rows())
    for r in counted:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.copies <= 3
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + 1
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r.copies for r in counted)
    assert Counter(map(str, mixed.collect())) == Counter(map(str, mixing.mix(frame).collect()))
    assert mixing.mix(data.empty(spark)).collect() == []


def test_sources_come_near_their_targets(spark):
    frame = spark.range(20_000).selectExpr(
        "id AS doc_id", "concat('s', id % 5) AS source", "repeat('w ', cast(1 + id % 50 AS int)) AS text")
    sums = mixing.with_copies(frame).groupBy("source").agg({"target": "max", "size": "sum"})
    taken = mixing.with_copies(frame).selectExpr("source", "target", "size * copies AS t").groupBy(
        "source", "target").sum("t").collect()
    assert sums.count() == 5
    assert all(abs(r[2] - r[1]) < 0.05 * r[1] for r in taken)


# --- simhash

def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values, distance):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprints_link_as_by_brute_force(spark):
    rows = data.rows(5, 40)
    for i, text in enumerate(list(r[1] for r in rows[8:16])):
        rows.append((100 + i, (text or "") + " more", None, None, None, None, None))
    found = simhash.near_duplicates(spark.createDataFrame(rows, data.SCHEMA)).collect()
    values = [plain_fingerprint(r[1] or "") for r in rows]
    roots = plain_classes(values, 3)
    least = {}
    for row, root in zip(rows, roots):
        if row[0] is not None:
            least[root] = min(least.get(root, row[0]), row[0])
    want = Counter((r[0], f"{v:016x}", least.get(root)) for r, v, root in zip(rows, values, roots))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert simhash.near_duplicates(data.empty(spark)).collect() == []


@pytest.mark.parametrize("distance, block", [(3, 256), (3, 3), (1, 256), (4, 4)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, distance, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 1 << 63, 6)
    values = {0, *centres.tolist()}
    for centre in centres.tolist():
        for _ in range(40):
            value = centre
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                value ^= 1 << int(bit)
            values.add(value)
    values = sorted(values)
    nodes = spark.createDataFrame(
        [(i, [v - (1 << 64) if v >> 63 else v], []) for i, v in enumerate(values)],
        "node long, probes array<long>, wide array<long>")
    member = components.connected_components(simhash.links(nodes, distance)).collect()
    got = {r.node: r.component for r in member}
    want = plain_classes(values, distance)
    assert [got.get(i, i) for i in range(len(values))] == want


def test_radii_leave_no_pair_out():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for parts in (1, 2, 3, 4):
        masks = simhash.group_bits(sample, parts)
        assert sum(masks) == (1 << 64) - 1
        for distance in (2, 3, 5):
            radii = simhash.allocate(sample, masks, 10**6, distance)
            assert sum(radii) == distance - parts + 1 and min(radii) >= -1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_of_each_group_stays(spark):
    import random

    rng = random.Random(9)
    texts = [data.sentence(rng, 6000, 5000) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    for i, text in enumerate(texts[:6]):
        words = text.split()
        words[200] = "changed"
        rows += [(100 + i, " ".join(words), "x"), (200 + i, text, "x")]
    rows += [(0, texts[0], "x"), (None, texts[1], None), (300, "", "x"), (301, None, "x")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 300]
    assert kept.columns == ["doc_id", "text", "component"]


# --- winnowing

def test_winnowing_selects_the_rightmost_minima():
    import random

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aab") for _ in range(rng.randrange(0, 60)))
        hashes, places = winnowing.winnow(text, 4, 5)
        if len(text) >= 8:
            grams = winnowing.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), 4)
            want = set()
            for i in range(len(grams) - 4):
                part = grams[i:i + 5]
                want.add(i + max(k for k in range(5) if part[k] == part.min()))
            assert places.tolist() == sorted(want) and (grams[places] == hashes).all()
        else:
            assert len(places) == (1 if text else 0) or len(text) >= 4


def test_common_passages_share_a_hash():
    passage = "the quick brown fox jumps over"
    a, b = winnowing.winnow("aaaa " + passage + " bbb")[0], winnowing.winnow("x" + passage)[0]
    assert set(a.tolist()) & set(b.tolist())


def test_each_text_against_the_next(spark):
    rows = data.rows(4, 20)
    found = winnowing.compare_with_next(spark.createDataFrame(rows, data.SCHEMA))
    ids = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    first_null = [r for r in rows if r[0] is None]
    ordered = [r[1] or "" for r in first_null + ids]
    names = [r[0] for r in first_null + ids]
    want = Counter()
    for i, text in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)]
        changed = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        own, other = winnowing.winnow(text), winnowing.winnow(following)
        want[names[i], len(text), hashlib.sha256(changed.encode()).hexdigest(), winnowing.digest(*own),
             round(winnowing.likeness(own[0], winnowing.winnow(changed)[0]), 9),
             round(winnowing.likeness(own[0], other[0]), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9),
                    round(r.near_next, 9)) for r in found.collect()) == want
    one = spark.createDataFrame([(1, "abcdefgh" * 9)], "doc_id long, text string")
    assert winnowing.compare_with_next(one).first().near_next == 1.0
    assert winnowing.compare_with_next(data.empty(spark)).collect() == []
    prints = {r.doc_id: r for r in winnowing.fingerprints(data.frame(spark)).collect()}
    assert prints[1].hashes == [] == prints[0].hashes


# --- substring dedup

def test_repeated_windows_go_as_by_brute_force(spark):
    rows = data.rows(6, 40)
    for span, core in ((35, 10), (12, 3)):
        counts = Counter()
        for r in rows:
            words = (r[1] or "").encode().split()
            counts.update(tuple(words[i:i + span]) for i in range(len(words) - span + 1))
        want = Counter()
        for r in rows:
            words = (r[1] or "").encode().split()
            gone = [False] * len(words)
            for i in range(len(words) - span + 1):
                if counts[tuple(words[i:i + span])] > 1:
                    gone[i:i + span] = [True] * span
            want[r[0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()] += 1
        found = debruijn.remove_repeats(spark.createDataFrame(rows, data.SCHEMA), span, core).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == want
        assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_removed for r in found)
    assert debruijn.remove_repeats(data.empty(spark)).collect() == []


# --- toxicity

def test_toxic_words_are_learnt_and_held_out_rows_are_not(spark):
    import random
    import zlib

    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = data.sentence(rng, 60, 300).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(["nastyword", "horribleone"])
        docs.append((i, " ".join(words), "clash"))
        out = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, 0, (0 if bad else 1) if out else int(bad)))  # held-out labels lie
    docs += [(None, "w1", "x"), (901, None, "x"), (902, "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(901, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(frame, marks).collect()}
    for i in range(900):
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    wrong = sum(found[i].predicted != (i % 5 == 0) for i in range(900))
    assert wrong <= 9
    assert found[901].score == found[902].score and 0 <= found[901].score <= 1
    assert not found[None].held_out
    none = toxicity.toxicity(frame, marks.limit(0)).filter("score > 0.01")
    assert none.count() == 0
    assert toxicity.toxicity(frame.limit(0), marks).collect() == []


def test_training_rows_are_bounded_whatever_the_ids(spark):
    frame = spark.createDataFrame(
        [(i % 10, f"text {i}") for i in range(500)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic long")
    free = toxicity._training_rows(frame, labels, 20)
    assert free.count() == len({i for i in range(10) if zlib.crc32(str(i).encode()) % 3 != 1})
    assert sorted(free.collect(), key=str) == sorted(
        toxicity._training_rows(frame.repartition(7), labels, 20).collect(), key=str)
