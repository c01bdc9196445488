"""Repeated passages of lines inside otherwise different documents."""

import random

from palisade.llm import lines


def test_planted_passages_go_and_nothing_else(spark):
    rng = random.Random(31)
    rows, parts = [], {}
    for n in range(2, 21):
        for group in range(8):
            passage = [f"passage {n} {group} line {i}" for i in range(n)]
            for copy in range(4):
                def own(k):
                    return [f"own {n} {group} {copy} {rng.random()}" for _ in range(k)]
                before, after = own(rng.randrange(0, 6)), own(rng.randrange(0, 6))
                doc_id = 1000 * n + 10 * group + copy
                rows.append((doc_id, "\n".join(before + passage + after)))
                parts[doc_id] = (n, copy, before, passage, after)
    found = {r.doc_id: r for r in lines.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {}
    for doc_id, (n, copy, before, passage, after) in parts.items():
        kept = found[doc_id].text.split("\n") if found[doc_id].text else []
        assert [x for x in kept if x.startswith("own")] == before + after
        if copy == 0:
            assert kept == before + passage + after
        else:
            recall.setdefault(n, []).append(found[doc_id].n_removed / n)
    mean = {n: sum(r) / len(r) for n, r in recall.items()}
    assert all(mean[n] >= 0.9 for n in range(8, 21)), mean
    assert sum(mean.values()) / len(mean) > 0.8, mean


def test_blank_and_poor_lines_stay(spark):
    texts = ["alpha\n\n\nbeta", "gamma\n\n\ndelta", "x = {\n  }\n}\nv", "y = {\n  }\n}\nw", "one", "one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(frame).orderBy("doc_id").collect()] == texts


def test_paragraphs_are_not_run_together(spark):
    passage = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(i, f"before {i}\n\n{passage}\n\nafter {i}") for i in range(3)]
    kept = [r.text for r in lines.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert kept == [rows[0][1], "before 1\n\n\nafter 1", "before 2\n\n\nafter 2"]


def test_clashing_names_nulls_and_repeated_rows(spark):
    passage = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(1, passage, "a", 5), (2, passage + "\nown", "a", 5), (2, passage + "\nown", "a", 5),
            (None, None, None, None), (3, "", "b", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _cut string, digest int")
    found = lines.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "_cut", "digest", "n_lines", "n_removed"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(1, passage, "a", 5, 12, 0), (2, "own", "a", 5, 13, 12), (2, "own", "a", 5, 13, 12),
                          (None, None, None, None, 0, 0), (3, "", "b", 6, 0, 0)], key=str)
    assert lines.dedup_lines(frame.limit(0)).collect() == []
