"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from palisade.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, own string"


def ordered(rows):
    """Turns of each conversation; ties must be equal here."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


def opened(conversations):
    out = {}
    for conv, turns in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = conversations.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for conv, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        parent = min(members[path[:-1]]) if path else None
        ends = [c for c in convs if len(conversations[c]) == len(path)]
        out.add((
            min(convs), len(path), parent, len(convs), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def found(nodes):
    rows = [tuple(r) for r in nodes.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def case(seed=0, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(200), convs):
        path = [rng.choice(["x", "y", "é"]) for _ in range(rng.randrange(1, longest))]
        if rng.random() < 0.3:
            path = ["x", "y", "x"]
        for turn, text in enumerate(path):
            rows.append((conv, turn if turn else rng.choice([None, 0]), "user" if turn % 2 else None, text))
    rows += [(500, 1, "u", ""), (500, 1, "u", ""), (500, 2, None, None), (None, 1, "u", "lost"),
             (501, 5, "", ""), (7, 3, "u", "z" * 100_000), (-3, 0, "u", "x"), (-5, 0, "u", "y")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("segment, cells", [(64, 1_000_000), (2, 6), (3, 1_000_000)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, cells):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "BLOCK_CELLS", cells)
    monkeypatch.setattr(trie, "SEGMENT_BLOCK", 2)
    rows = case(seed=segment)
    assert found(trie.opened_trie(frame(spark, rows))) == brute(opened(ordered(rows)))


def test_conversations_as_they_are(spark):
    rows = case(seed=9)
    assert found(trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_long_copies_meet_over_segments(spark):
    long = [("u", f"t{i % 7}") for i in range(300)]
    rows = [(conv, i, *turn) for conv, n in [(1, 300), (2, 300), (3, 130), (4, 65), (6, 64)]
            for i, turn in enumerate(long[:n])]
    rows += [(5, i, *turn) for i, turn in enumerate([*long[:200], ("u", "other"), ("u", "end")])]
    assert found(trie.conversation_trie(frame(spark, rows))) == brute(ordered(rows))


def test_many_copies_and_turnless_conversations(spark):
    # of 11 nothing is left: 10 does not exist, and its one turn is replaced
    rows = [(c, t, "u", "same") for c in range(1000, 1400) for t in range(4)] + [(11, 0, "u", "a")]
    assert zlib.crc32(b"11") % 9 >= 1
    want = brute(opened(ordered(rows)))
    assert found(trie.opened_trie(frame(spark, rows))) == want
    assert any(depth == 0 and ends != hashlib.sha256(b"").hexdigest() for _, depth, *_, ends in want)


def test_nothing_and_one(spark):
    assert trie.opened_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x", "", "")], SCHEMA)).collect() == []
    rows = [(11, 0, "u", "a")]
    assert found(trie.opened_trie(frame(spark, rows))) == brute(opened(ordered(rows)))
