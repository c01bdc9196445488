"""Personal data: fixed patterns, and a semi-Markov random field for what they miss."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import by_bytes

KINDS = ("email", "ip", "card", "phone")

# FIXED VALUES: the base patterns. Where a match may begin is narrowed to the
# places where the plain pattern would begin one, so that scanning is linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS = 14  # of an entity
MAX_CHARS = 80  # of an entity
FEATURE_BITS = 12
TRAIN_REGIONS = 400  # regions the model is fitted on, those of least hash: an eighth of each kind
REGION_CHARS = 4 * MAX_CHARS  # longer regions are cut for training
EPOCHS = 8
RATE = 0.3
_MOVED = 4_000_000

Span = tuple[int, int, str]

_NO_DIGITS = re.compile(r"[^0-9]+")
_GROUP = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[A-Za-z]+")
_SIGNS = re.compile(r"[^A-Za-z0-9]")
_BLANK = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NO_DIGITS.sub("", text)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        match = _DOMAIN.match(text, at)
        # the local part is the run of its characters that ends here
        local = len(text[max(end, text.rfind("@", end, at) + 1):at])
        start = at - local + len(text[at - local:at].rstrip(_LOCAL))
        if match and start < at:
            found.append((start, match.end(), "email"))
            end = match.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match[0].split(".")):
            found.append((*match.span(), "ip"))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _digits(match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*match.span(), "card"))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match[0])) <= 15:
                found.append((*match.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidate regions and segments ------------------------------------------

_AT = r"(?<=[(\[])(?i:at)(?=[)\]])"
_TRIGGER = re.compile(rf"[0-9@]+|{_AT}")
_TRIGGERS = re.compile(rf"[0-9@]|{_AT}")
_WRITTEN_AT = re.compile(_AT)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[](?i:at)[)\]]) ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def regions(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Ranges outside ``taken`` in which an entity could lie.

    Every entity holds a digit, an at sign or "at" in brackets and is at most
    ``MAX_CHARS`` long, so the text further away from these cannot matter;
    ranges that touch are one.
    """
    out: list[tuple[int, int]] = []
    walls = [(0, 0), *[(a, b) for a, b, _ in taken], (len(text), len(text))]
    free, reach = [], 0
    for a, b in walls:
        if a > reach:
            free.append((reach, a))
        reach = max(reach, b)
    for low, high in free:
        for match in _TRIGGER.finditer(text, low, high):
            a = max(low, match.start() - MAX_CHARS)
            b = min(high, match.end() + MAX_CHARS)
            # a word cut by the border belongs to no entity
            while low < a < match.start() and not text[a - 1].isspace():
                a += 1
            if out and out[-1][1] >= a and out[-1][0] >= low:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


def _bucket(value: int) -> int:
    return value if value < 5 else 5 + int(np.log2(value / 5) * 2)


@lru_cache(maxsize=100_000)
def _features(span: str, left: str, right: str) -> tuple[int, ...]:
    """Hashed features of a whole candidate and the characters beside it."""
    worded = _LETTERS.sub("a", span)
    shape, sized = _GROUP.sub("9", worded), _DIGIT.sub("9", worded)
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    begins = not left or not (left.isalnum() or left in "._%+-@")
    ends = "." if right == "." else not right or not (right.isalnum() or right in "-_@")
    between = "".join(sorted(set(_SIGNS.findall(span))))
    signs = span.count("@") + len(_WRITTEN_AT.findall(span))
    # how many digits an address holds says nothing
    count, parts = (f"@{signs}",) * 2 if signs else (_bucket(len(digits)), len(groups))
    named = (
        "bias", f"shape {shape}", f"sized {sized}", f"digits {count}",
        f"groups {parts}", f"at {signs}",
        f"dots {span.count('.')}", f"between {between}",
        f"mail {bool(_MAIL.fullmatch(span))} {begins} {ends}",
        f"ends {_kind(span[0])}{_kind(span[-1])}", f"left {_kind(left)}", f"right {_kind(right)}",
        f"octets {octets}", f"luhn {12 <= len(digits) <= 19 and luhn(digits)}",
        f"spaces {min(3, len(_BLANK.findall(span)))}",
        f"letters {_bucket(sum(map(str.isalpha, span)))}",
    )
    return tuple(zlib.crc32(n.encode()) >> (32 - FEATURE_BITS) for n in named)


N_FEATURES = 16


def _kind(c: str) -> str:
    if not c:
        return "edge"
    if "0" <= c <= "9":
        return "9"
    return "a" if c.isalpha() else "space" if c.isspace() else c


@dataclass
class Segments:
    """Tokens of a region and its candidates: token range and features of each."""

    starts: list[int]
    ends: list[int]
    first: np.ndarray
    last: np.ndarray
    features: np.ndarray


def segments(text: str, low: int, high: int) -> Segments:
    tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    at = np.array([m.start() for m in _TRIGGERS.finditer(text, low, high)], np.int64)
    trigger = np.searchsorted(at, ends) > np.searchsorted(at, starts)
    seen = np.concatenate(([0], np.cumsum(trigger)))
    first, last, found = [], [], []
    for i, a in enumerate(starts):
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            b = ends[j]
            if b - a > MAX_CHARS:
                break
            if seen[j + 1] > seen[i]:
                first.append(i)
                last.append(j + 1)
                found.append(_features(text[a:b], text[a - 1:a], text[b:b + 1]))
    return Segments(
        starts, ends, np.array(first, np.int64), np.array(last, np.int64),
        np.array(found, np.int64).reshape(-1, N_FEATURES),
    )


# --- the random field ----------------------------------------------------------

def _by_last(seg: Segments) -> list[np.ndarray]:
    order = np.argsort(seg.last, kind="stable")
    cuts = np.searchsorted(seg.last[order], np.arange(len(seg.starts) + 2))
    return [order[cuts[i]:cuts[i + 1]] for i in range(len(seg.starts) + 1)]


def decode(weights: np.ndarray, seg: Segments) -> list[tuple[int, int, int]]:
    """Best segmentation: (first token, end token, kind); other tokens score 0."""
    if not len(seg.first):
        return []
    scores = weights[seg.features].sum(axis=1)
    kind, value = scores.argmax(axis=1), scores.max(axis=1)
    best, back = np.zeros(len(seg.starts) + 1), [-1] * (len(seg.starts) + 1)
    for end, ending in enumerate(_by_last(seg)):
        if end:
            best[end] = best[end - 1]
        if len(ending):
            total = best[seg.first[ending]] + value[ending]
            top = int(total.argmax())
            if total[top] > best[end]:
                best[end], back[end] = total[top], int(ending[top])
    out, at = [], len(seg.starts)
    while at > 0:
        if back[at] < 0:
            at -= 1
        else:
            s = back[at]
            out.append((int(seg.first[s]), int(seg.last[s]), int(kind[s])))
            at = int(seg.first[s])
    return out[::-1]


@dataclass
class Example:
    """A text prepared for the fit.

    Its features are numbered anew (``known`` holds their numbers in the model),
    and its candidates stand in a band: row is the first token, column the
    length less one.
    """

    known: np.ndarray
    features: np.ndarray
    tokens: int
    first: np.ndarray
    last: np.ndarray
    gold: list[tuple[int, int]]


def _prepared(text: str, spans: list[Span]) -> Example | None:
    seg = segments(text, 0, len(text))
    if not len(seg.first):
        return None
    where = {(seg.starts[i], seg.ends[j - 1]): s
             for s, (i, j) in enumerate(zip(seg.first.tolist(), seg.last.tolist()))}
    gold = [(where[a, b], KINDS.index(k)) for a, b, k in spans if (a, b) in where]
    known, features = np.unique(seg.features, return_inverse=True)
    return Example(known, features.reshape(seg.features.shape), len(seg.starts),
                   seg.first, seg.last, gold)


def _totals(weight: np.ndarray) -> np.ndarray:
    """Logarithms of the summed weights of all segmentations that end at each token.

    ``weight[j, w]`` is that of the candidates of w + 1 tokens ending at j + 1.
    The sums only grow, so the last few are kept relative to the latest one.
    """
    out = np.zeros(len(weight) + 1)
    recent = np.zeros(weight.shape[1])
    recent[0] = 1
    for j, row in enumerate(weight):
        grown = 1 + recent @ row
        out[j + 1] = out[j] + np.log(grown)
        recent[1:] = recent[:-1] / grown
        recent[0] = 1
    return out


def _gradient(scores: np.ndarray, example: Example) -> np.ndarray:
    """Expected minus true candidates of each kind; forward-backward over segments."""
    n, first, last = example.tokens, example.first, example.last
    length = last - first - 1
    weight = np.exp(scores)
    total = weight.sum(axis=1)
    band = np.zeros((n, MAX_TOKENS))
    band[last - 1, length] = total
    forward = _totals(band)
    band[:] = 0
    band[n - 1 - first, length] = total  # the same, read from the end
    backward = _totals(band)[::-1]
    chance = weight * np.exp(forward[first] + backward[last] - forward[n])[:, None]
    for s, kind in example.gold:
        chance[s, kind] -= 1
    return chance


def train(examples: list[tuple[str, list[Span]]]) -> np.ndarray:
    """Weights (feature, kind) from texts with their entities; adaptive gradient steps."""
    prepared = [e for e in (_prepared(text, spans) for text, spans in examples) if e is not None]
    weights = np.zeros((1 << FEATURE_BITS, len(KINDS)))
    size = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS):
        for example in prepared:
            held = weights[example.known]
            chance = _gradient(held[example.features].sum(axis=1), example)
            spread = np.repeat(chance, example.features.shape[1], axis=0)
            slope = np.stack([
                np.bincount(example.features.ravel(), spread[:, k], len(held))
                for k in range(len(KINDS))
            ], axis=1)
            size[example.known] += slope**2
            weights[example.known] = held - RATE * slope / np.sqrt(size[example.known])
    return weights


def _forms(span: str, kind: str) -> list[str]:
    """Other ways to write an entity, which the fixed patterns miss."""
    digits = _digits(span)
    if kind == "email":
        return [span.replace("@", at) for at in (" @ ", "(at)", " [at] ")]
    if kind == "ip":
        return [span.replace(".", dot) for dot in (" . ", "[.]")]
    if kind == "card":
        groups = re.findall(r"[0-9]{1,4}", digits)
        return [".".join(groups), "  ".join(groups)]
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"{area}-{first}-{last}", f"{area} {first} {last}", f"({area}) {first}-{last}",
            re.sub(r"^\+[0-9]+[\x20-]?", "", span)]


def _likenesses(span: str, kind: str) -> list[str]:
    """Texts that look like an entity of this kind and are none."""
    digits = _digits(span)
    if kind == "email":
        return [span.split("@")[0] + " @ home", "(at) " + span.split("@")[0]]
    if kind == "ip":
        parts = span.split(".")
        return [".".join([*parts[:3], "999"]), "v" + ".".join(parts[:3])]
    if kind == "card":
        account = " ".join(re.findall(r"[0-9]{1,4}", (digits * 2)[:18]))
        return [f"DE{digits[:2]} {account}", span[:-1] + str((int(span[-1]) + 1) % 10)]
    return [f"20{digits[:2]}-0{digits[2]}-1{digits[3]}", f"{digits[:3]}-{digits[3:6]}"]


_REACH = MAX_CHARS // 2  # characters of an example's text kept on each side of an altered entity


def _near(text: str, spans: list[Span], span: Span) -> tuple[str, list[Span], Span]:
    """An entity with whole words and whole entities around it."""
    low, high = max(0, span[0] - _REACH), min(len(text), span[1] + _REACH)
    while 0 < low < span[0] and not text[low - 1].isspace():
        low += 1
    while span[1] < high < len(text) and not text[high].isspace():
        high -= 1
    for a, b, _ in spans:
        if a < low < b:
            low = b
        if a < high < b:
            high = a
    inside = [(a - low, b - low, k) for a, b, k in spans if low <= a and b <= high]
    return text[low:high], inside, (span[0] - low, span[1] - low, span[2])


_SURROUNDINGS = (("", ""), ("see ", ", thanks"), ("(", ")"), ("it is ", "."), ("to: ", " now"), ("the ", "; "))


def _replaced(
    text: str, spans: list[Span], span: Span, changed: str, entity: bool
) -> tuple[str, list[Span]]:
    """The example with ``changed`` in place of one entity."""
    start, end, kind = span
    moved = len(changed) - (end - start)
    others = [(a + moved, b + moved, k) if a >= end else (a, b, k)
              for a, b, k in spans if (a, b, k) != span]
    own = [(start, start + len(changed), kind)] if entity else []
    return text[:start] + changed + text[end:], sorted(others + own)


def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The example and, for each entity, another form and a mere likeness, in place and elsewhere.

    Which of them is taken goes by the text and the entity's number, so that
    many examples hold all of them.
    """
    out, turn = [(text, spans)], zlib.crc32(text.encode())
    for i, span in enumerate(spans, turn):
        written = text[span[0]:span[1]]
        forms, others = _forms(written, span[2]), _likenesses(written, span[2])
        near = _near(text, spans, span)
        out.append(_replaced(*near, forms[i % len(forms)], True))
        out.append(_replaced(*near, others[i % len(others)], False))
        # the same in other surroundings
        before, after = _SURROUNDINGS[(i + turn) % len(_SURROUNDINGS)]
        form, other = forms[i % len(forms)], others[i % len(others)]
        begin = len(before)
        out.append((before + form + after, [(begin, begin + len(form), span[2])]))
        out.append((before + other + after, []))
    return out


def _apart(spans: list[Span]) -> list[Span]:
    """Spans that do not overlap: the longest, then what lies beside them."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(span[1] <= a or b <= span[0] for a, b, _ in kept):
            kept.append(span)
    return sorted(kept)


def labelled_regions(text: str, limit: int = REGION_CHARS) -> Iterator[tuple[str, list[Span]]]:
    """Every region, base entities included, with what the base patterns say.

    Regions over ``limit`` characters are cut in front of a word or entity.
    What a chain of overlapping matches fills beyond that is left out: it is
    longer than an entity may be.
    """
    spans = base_spans(text)
    blocks: list[list[int]] = []  # overlapping spans taken together
    for a, b, _ in spans:
        if blocks and a < blocks[-1][1]:
            blocks[-1][1] = max(b, blocks[-1][1])
        else:
            blocks.append([a, b])
    starts, firsts = [a for a, _ in blocks], [a for a, _, _ in spans]
    for low, high in regions(text, []):
        while low < high:
            end = high
            if high - low > limit:
                end = low + limit
                end = max(text.rfind(" ", low + 1, end) + 1, 0) or end
                i = bisect_right(starts, end) - 1
                if i >= 0 and blocks[i][0] < end < blocks[i][1]:
                    end = blocks[i][0] if blocks[i][0] > low else min(blocks[i][1], high)
            if end - low <= limit:
                inside = spans[bisect_right(firsts, low - 1):bisect_right(firsts, end)]
                yield text[low:end], _apart([
                    (a - low, b - low, k) for a, b, k in inside if b <= end
                ])
            low = end


def _least(limits: dict[str, int]):
    """Per task: of each kind, and of regions without any (""), those of least hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[tuple[int, str], str]] = {kind: {} for kind in limits}
        for batch in by_bytes(batches, "text", _MOVED):
            for text in batch.column(0).to_pylist():
                for region, spans in labelled_regions(text or ""):
                    key = (xxhash.xxh64_intdigest(region.encode()) >> 1, region)
                    label = ";".join(f"{a}:{b}:{k}" for a, b, k in spans)
                    for kind in {k for _, _, k in spans} or {""}:
                        found = least[kind]
                        found[key] = label
                        if len(found) >= 8 * limits[kind] + 8:
                            least[kind] = dict(sorted(found.items())[:limits[kind]])
        rows = [(kind, key[0], key[1], label) for kind, found in least.items()
                for key, label in sorted(found.items())[:limits[kind]]]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))],
            ["kind", "place", "region", "label"],
        )

    return run


def fit(docs: DataFrame, limit: int = TRAIN_REGIONS) -> np.ndarray:
    """Fit on at most ``limit`` regions of the texts: an eighth for each kind, half without any.

    One pass over the texts, of which each task hands on its regions of least
    hash. The base patterns give the labels; altered forms and mere likenesses
    teach the whole-span features what else such data look like.
    """
    limits = {**{kind: max(1, limit // 8) for kind in KINDS}, "": max(1, limit // 2)}
    found = docs.select("text").mapInArrow(
        _least(limits), "kind string, place bigint, region string, label string"
    )
    rank = F.dense_rank().over(Window.partitionBy("kind").orderBy("place", "region"))
    allowed = F.when(F.col("kind") == "", limits[""]).otherwise(limits[KINDS[0]])
    taken = (
        found.withColumn("_rank", rank)
        .filter((F.col("_rank") <= limits[""]) & (F.col("_rank") <= allowed))
        .groupBy("place", "region").agg(F.min("label").alias("label")).collect()
    )
    examples = []
    for _, region, label in sorted(taken):
        spans = [(int(a), int(b), k) for a, b, k in
                 (part.split(":") for part in label.split(";") if part)]
        examples += variants(region, spans)
    return train(examples)


# --- the operator ---------------------------------------------------------------

def added_spans(text: str, taken: list[Span], weights: np.ndarray) -> list[Span]:
    """Entities that the random field finds outside ``taken``."""
    found = []
    for low, high in regions(text, taken):
        seg = segments(text, low, high)
        for i, j, kind in decode(weights, seg):
            found.append((seg.starts[i], seg.ends[j - 1], KINDS[kind]))
    return found


def _listed(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row, and counts by kind.

    ``base`` and ``spans`` are texts kind:start:end (code points, end
    exclusive), by start, then kind, joined by commas: what the fixed patterns
    find, and that together with what the random field adds outside it.
    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` count the base spans.
    Null texts count as empty and have none; repeated rows each get a row;
    other columns are ignored. Without regions to learn from nothing is added.
    """
    model = fit(docs) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(f"{counts}, base string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, base, shared.value)
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in KINDS), _listed(base), _listed(base + more)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.select("doc_id", find("text").alias("_f")).select("doc_id", "_f.*")
