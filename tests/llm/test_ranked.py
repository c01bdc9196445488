"""Ranked search against scoring every document of every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import ranked
from tests.llm import cases as data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [("a", "w1 w2 W3, w4-w5"), ("a", "w6"), ("b", "日本語 é X"), ("c", None), ("d", "..."), ("e", "absent"),
         (None, "w7 w8 w7"), ("f", " ".join(f"w{i}" for i in range(400))), ("b", "日本語 é X")]
ITEM_SCHEMA = "item_id string, text string, rank string, score string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=50):
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = set()
    for item, words in wanted.items():
        weight = {
            w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in c for _, c in counted) + 1)))
            for w in words
        }
        scores = []
        for (doc, c), n in zip(counted, sizes):
            score = sum(
                weight[w] * ((1_000_000_000 * c[w])
                             // (1000 * c[w] + 20 * (50 + (50 * n * n_docs) // n_terms)))
                for w in words if c[w]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        out |= {(item, i + 1, doc, -score) for i, (score, _, _, doc) in enumerate(scores[:top])}
    return out


def found(frame):
    rows = [tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def items_frame(spark):
    return spark.createDataFrame([(*i, "clash", "clash") for i in ITEMS], ITEM_SCHEMA)


@pytest.mark.parametrize("top, shard, few", [(3, 1, 1), (50, 300, 2), (1, 300, 2), (50, 1_000_000, 64)])
def test_equals_scoring_everything(spark, monkeypatch, top, shard, few):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked, "FEW_DOCS", few)
    docs = data.frame(spark, n=120).repartition(3)
    got = found(ranked.search_items(docs, items_frame(spark), top=top))
    assert got == expected([r[:2] for r in data.rows(n=120)], ITEMS, top)


def test_items_in_blocks(spark):
    docs = data.frame(spark)
    got = found(ranked.search_items(docs, items_frame(spark), block_pairs=150))
    assert got == expected([r[:2] for r in data.rows()], ITEMS)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], ITEM_SCHEMA)
    assert ranked.search_items(data.empty(spark), items_frame(spark)).collect() == []
    assert ranked.search_items(data.frame(spark), nothing).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "- .")], "doc_id long, text string")
    assert ranked.search_items(blank, items_frame(spark)).collect() == []


def test_ties_go_by_id(spark):
    docs = [(i, "w1 w2") for i in range(200, 0, -1)] + [(None, "w1 w2"), (7, "w1 w2"), (999, "zz " * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = found(ranked.search_items(frame, items_frame(spark)).filter("item_id = 'a'"))
    assert got == {r for r in expected(docs, ITEMS) if r[0] == "a"}
    assert {r[2] for r in got} == set(range(1, 50))  # 7 twice


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=70), st.data())
def test_largest_of_a_range(values, draw):
    table = ranked.SparseTable(np.array(values), len(values))
    a = draw.draw(st.integers(0, len(values) - 1))
    b = draw.draw(st.integers(a + 1, len(values)))
    (at,) = table.argmax(np.array([a]), np.array([b]))
    assert a <= at < b and values[at] == max(values[a:b])


def test_most_documents_are_never_scored():
    rng = np.random.default_rng(3)
    n = 20_000
    lists = [np.sort(rng.choice(n, 2_000, replace=False)) for _ in range(8)]
    terms_, docs = np.repeat(np.arange(8), 2_000), np.concatenate(lists)
    impacts = (1_000 * rng.pareto(1, len(docs))).astype(np.int64) + 1
    shard = ranked.Shard(terms_, docs, impacts, n)
    best = ranked.Best(5)
    scored = ranked.search(shard, np.arange(8), best, np.arange(n), np.ones(n, dtype=bool))
    sums = np.zeros(n, dtype=np.int64)
    np.add.at(sums, shard.docs, shard.impacts)
    want = sorted(zip((-sums).tolist(), range(n)))[:5]
    assert sorted((-s, -d) for s, _, d in best.kept) == want
    assert scored < np.count_nonzero(sums) / 2


def test_a_long_text_is_ranked_whole(spark):
    docs = [(1, "zz " * 300_000 + "w1"), (2, "w1 zz"), (3, "qq")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(ranked.search_items(frame, items_frame(spark)))
    assert got == expected(docs, ITEMS)
