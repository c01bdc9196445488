"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
from palisade.llm import debruijn, mixing
from tests.llm import cases as data

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark, folder):
    rng = random.Random(12)
    leak = " ".join(f"bench{i}" for i in range(20))
    docs, labels = [], []
    for i in range(400):
        words = data.sentence(rng, 120, 3000).split()
        if i % 6 == 0:
            words[5] = words[60] = "nastyword"
        text = " ".join(words)
        if i % 10 == 1:
            text = f"{text} {leak} end"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    copies = [docs[1], docs[2], docs[3]]
    docs += [(1000 + i, d[1].replace(" ", "  ", 1), "en", "s1", d[4]) for i, d in enumerate(copies)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_catch_what_was_planted_and_keep_the_rest(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup",
                            "benchmark_decontamination", "source_mixing"]
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS
    assert not any(i % 6 == 0 for i in kept if i < 1000)
    assert sum(1 for i in range(400) if i % 6) == len([i for i in kept if i < 1000])
    deduped = stages["line_dedup"](spark, clean, str(tmp_path))
    assert deduped.columns == COLUMNS and deduped.count() == clean.count()
    single = stages["simhash_near_dedup"](spark, deduped, str(tmp_path)).cache()
    assert {r.doc_id for r in single.collect()} == {i for i in kept if i < 1000}
    free = stages["benchmark_decontamination"](spark, single, str(tmp_path))
    assert free.columns == COLUMNS and free.count() == single.count()
    assert free.filter("text LIKE '%bench%'").count() == 0
    assert free.filter("n_chars != length(text)").count() == 0
    mixed = stages["source_mixing"](spark, free, str(tmp_path))
    assert mixed.count() == sum(r.copies for r in mixing.with_copies(free).collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))


def test_merging_ranges():
    import numpy as np

    a, b = debruijn.merge_ranges(np.array([5, 1, 2, 9]), np.array([7, 3, 4, 12]))
    assert list(zip(a.tolist(), b.tolist())) == [(1, 4), (5, 7), (9, 12)]
