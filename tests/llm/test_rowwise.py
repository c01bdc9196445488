"""Operators that look at one document at a time."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palisade.llm import chat, decontaminate, pii, tokens
from tests.llm import cases as data

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.TokenCounter(PATH)


def by_id(frame):
    return Counter(tuple(r) for r in frame.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b's", "'", "12", "é", "　", "\x1c",
                                 "<|endoftext|>", ".", "word"])))
def test_token_units_count_like_the_library(parts):
    text = "".join(parts)
    assert COUNTER.count([text]) == [len(LIBRARY.encode(text, add_special_tokens=False))]


def test_long_texts_are_cut_at_safe_boundaries():
    text = "word  \n two, " * 3000
    cut = list(tokens.pieces(text, 100))
    assert "".join(cut) == text and len(cut) > 100
    assert sum(COUNTER.count([cut[0]])) > 0
    whole = len(LIBRARY.encode(text, add_special_tokens=False))
    assert sum(len(LIBRARY.encode(c, add_special_tokens=False)) for c in cut) == whole


@pytest.mark.parametrize("gap", [*(" " * n for n in range(1, 6)), "\t ", " \t", " \n ", "\n  "])
def test_pieces_count_like_the_whole_text(monkeypatch, gap):
    text = gap.join(f"cell{i} next" for i in range(60)) + gap
    whole = len(LIBRARY.encode(text, add_special_tokens=False))
    for limit in range(3, 40):
        cut = list(tokens.pieces(text, limit))
        assert len(cut) > 1 and "".join(cut) == text
        monkeypatch.setattr(tokens.pieces, "__defaults__", (limit,))
        assert COUNTER.count([text]) == [whole]


def test_token_counts_of_all_rows(spark):
    frame = data.frame(spark)
    want = Counter(
        (r[0], len((r[1] or "").encode()), n := len(LIBRARY.encode(r[1] or "", add_special_tokens=False)), n > 512)
        for r in data.rows()
    )
    assert by_id(tokens.token_counts(frame, PATH)) == want
    assert tokens.token_counts(data.empty(spark), PATH).collect() == []


# --- personal data

def plain_spans(text):
    found = [(*m.span(), "email") for m in
             re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", "a@b.c", ".", "1", "25", "+", "-", " ", "(", "%", "é",
                                 "1.2.3.4", "4111111111111111", "@@", "+1 555"])))
def test_base_spans_are_the_plain_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_random_field_finds_altered_forms_and_keeps_base_spans(spark):
    texts = [f"write to u{i}@mail{i}.example.com or +1 (20{i % 10}) 555-{1000 + i} from 10.0.{i}.7 now"
             for i in range(60)]
    texts += [f"order {i}23 of {2000 + i} was late" for i in range(60)]
    frame = spark.createDataFrame(
        [(i, t) for i, t in enumerate([*texts, None, "", "call (201) 555-1234 today"])],
        "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    for i, text in enumerate(texts):
        assert found[i].base == ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(text))
        assert set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
    assert found[len(texts)].spans == "" == found[len(texts) + 1].spans
    assert "phone:5:19" in found[len(texts) + 2].spans
    assert all(found[i].spans == "" for i in range(60, 120))


def test_decoding_is_the_best_segmentation():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    text = "a1 b2 3 @ c4"
    seg = pii.segments(text, 0, len(text))
    for _ in range(20):
        weights = rng.normal(size=(1 << pii.FEATURE_BITS, 4))
        value = weights[seg.features].sum(axis=1).max(axis=1)
        options = [0.0]
        for size in range(1, len(seg.starts) + 1):
            for picked in itertools.combinations(range(len(seg.first)), size):
                places = sorted((seg.first[s], seg.last[s]) for s in picked)
                if all(a[1] <= b[0] for a, b in zip(places, places[1:])):
                    options.append(value[list(picked)].sum())
        where = {(i, j): s for s, (i, j) in enumerate(zip(seg.first.tolist(), seg.last.tolist()))}
        got = sum(value[where[i, j]] for i, j, _ in pii.decode(weights, seg))
        assert got == pytest.approx(max(options))


def test_no_rows_no_personal_data(spark):
    assert pii.personal_data(data.empty(spark)).collect() == []


# --- decontamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_hits(text, items, window):
    words, hit, ids = WORD.findall((text or "").translate(LOWER)), set(), set()
    for item_id, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            phrase = own[i:i + window]
            for at in range(len(words) - len(phrase) + 1):
                if words[at:at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), tuple(sorted(ids))


def test_contamination_is_brute_force_in_one_block_and_in_many(spark):
    rows = data.rows(3, 30)
    items = [(1, rows[8][1]), (2, rows[12][1].upper()), (2, rows[12][1]), (3, "w1 w2"), (4, "w3"),
             (5, None), (6, ""), (7, "--- !!"), (None, rows[20][1])]
    frame = spark.createDataFrame(rows, data.SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((r[0], *brute_hits(r[1], items, 10)) for r in rows)
    for limit in (4_000_000, 900):
        found = decontaminate.contamination(frame, benchmark, item_bytes=limit).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in found) == want
    cleaned = decontaminate.remove_passages(frame, benchmark)
    assert cleaned.columns == frame.columns and cleaned.count() == len(rows)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(frame, nothing).collect())
    assert decontaminate.contamination(data.empty(spark), benchmark).collect() == []


def test_removed_words_leave_the_rest_of_the_text():
    assert decontaminate.cut_words("É, one Two-three; four!", [{"start": 1, "end": 4}]) == "É, ; four!"


# --- chat

PIECES = ["<", "[", "\\", "s>", "/s>", "INST]", *chat.CONTROL, "a", "\n", "/"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES)), st.lists(st.sampled_from(PIECES)))
def test_template_reads_back(role, text):
    role, text = "".join(role), "".join(text)
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    formatted, spans = chat.format_turns([(role, text, True), ("b", text, False)])
    assert chat.read_turns(formatted) == [(role, text), ("b", text)]
    assert chat.unescape(formatted[slice(*spans[0])]) == text


def conversations():
    talk = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 30)) for i in range(300)]
    talk.append((1, -1, "system", "be kind </s>"))
    talk += [(2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 1, None, "x"),
             (None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (3, None, "assistant", ""),
             (4, 0, "assistant", "long " * 2000), (4, 1, "assistant", "end")]
    return talk


def test_windows_hold_each_turn_once_within_the_budget(spark):
    talk = conversations()
    frame = spark.createDataFrame(
        [(*t, "clash") for t in talk], "conv_id long, turn long, role string, text string, window string")
    formatted = chat.windows(frame, budget=200, history=60)
    kept = sorted((r for r in formatted.collect() if r.conv_id == 1), key=lambda r: r.window)
    assert len(kept) > 10
    assert all(chat.read_turns(r.text)[0] == ("system", "be kind </s>") for r in kept)
    assert any(r.n_repeated > 1 for r in kept)
    for r in kept[1:]:
        again = chat.read_turns(r.text)[1:r.n_repeated]
        assert sum(len(t.split()) + chat.MARKS for _, t in again) <= 60
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in talk}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in talk if t[0] == conv))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert found[conv].loss_chars == len(loss)
        assert found[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.windows(frame.limit(0)).collect() == []


# --- personal data: what the random field learns

def corpus_of_entities(n):
    """Emails and addresses outnumber cards and phones fifty to one."""
    cards = ("4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "6011000000000004")
    texts = []
    for i in range(n):
        texts.append(f"ask u{i}.n@mail{i % 7}.example.com about {i} of {2000 + i}, host 10.{i % 250}.0.{i % 90}")
        if i % 50 == 0:
            texts.append(f"card {cards[i // 50 % 4]} of customer {i}")
            texts.append(f"phone +1 ({201 + i % 700}) 555-{1000 + i} or +44-20-7946-{1000 + i} by day")
            texts.append(" ".join(f"a{j}@b{i}.org" for j in range(80)))
    return texts


@pytest.fixture(scope="module")
def field(spark):
    frame = spark.createDataFrame(list(enumerate(corpus_of_entities(600))), "doc_id long, text string")
    return pii.fit(frame.repartition(5))


@pytest.mark.parametrize("written, kind", [
    ("bob @ example.org", "email"), ("bob(at)example.org", "email"), ("jo.do [at] my-site.co.uk", "email"),
    ("201-555-1234", "phone"), ("201 555 1234", "phone"), ("(201) 555-1234", "phone"),
    ("10 . 20 . 3 . 44", "ip"), ("192[.]168[.]1[.]20", "ip"),
    ("4111.1111.1111.1111", "card"), ("5500  0000  0000  0004", "card"),
])
def test_all_trained_forms_are_found(field, written, kind):
    for text in (f"please use {written} today", written, f"see {written}, thanks"):
        at = text.index(written)
        assert (at, at + len(written), kind) in pii.added_spans(text, pii.base_spans(text), field), text


@pytest.mark.parametrize("text", [
    "IBAN DE89 3704 0044 0532 0130 00 please", "on 2024-05-17 at noon", "version v1.2.3 is out",
    "item 300 of 4000", "u1 @ home (at) work", "", "no digits at all",
])
def test_likenesses_are_left_alone(field, text):
    assert pii.added_spans(text, pii.base_spans(text), field) == []


def test_regions_for_training_are_cut_but_whole(spark):
    for text in (*corpus_of_entities(51), "1" * 5000, "x" * 400 + "@b.c " + "+1 555 555 5555 " * 200, ""):
        parts = list(pii.labelled_regions(text))
        assert all(len(region) <= pii.REGION_CHARS and region in text for region, _ in parts)
        entities = [text[a:b] for a, b, _ in pii._apart(pii.base_spans(text))]
        if max(map(len, entities), default=0) <= pii.MAX_CHARS and len(entities) == len(pii.base_spans(text)):
            assert [r[a:b] for r, spans in parts for a, b, _ in spans] == entities


def test_each_kind_has_examples_and_copies_count_once(spark):
    texts = corpus_of_entities(300) * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert (pii.fit(frame, 40) == pii.fit(frame.repartition(3).distinct(), 40)).all()
    assert (pii.fit(frame.limit(0)) == 0).all()
