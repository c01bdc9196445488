"""Small documents with the awkward cases: nulls, empties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def sentence(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    lines = [sentence(rng, 5) for _ in range(8)]
    texts = [None, "", "  \n\t ", "one", "x" * 30_000, "é" * 50 + " " + "日本語 " * 20]
    for i in range(n):
        text = sentence(rng, rng.randrange(1, 90))
        if i % 5 == 0:
            text = f"{text} {shared} {sentence(rng, 7)}"
        if i % 4 == 0:
            text += "\n" + "\n".join(lines) + "\n" + sentence(rng, 4)
        if i % 7 == 0:
            text = texts[-1]
        texts.append(text)
    texts.append("\n".join(sentence(rng, 6) for _ in range(3000)))  # a long one
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "clash", "clash")
           for i, t in enumerate(texts)]
    out.append((None, texts[8], None, None, None, None, None))
    out.append(out[9])  # a repeated row
    return out


def frame(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
