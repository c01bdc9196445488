"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.rows import by_bytes

SPACE = "▁"
BATCH_BYTES = 2_000_000  # of text encoded, decoded and checked at a time
CACHED_UNITS = 700_000  # units, and parts of units, of a generation whose ids a worker keeps
CACHED_CHARS = 64  # longer units are encoded each time

# A unit: a run of spaces and what follows up to the next space.
_UNIT = re.compile(" +[^ ]*")


def _every_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("palisade.every_byte", _every_byte)


class _Remembered(dict):
    """Results by key, computed when first asked for; rarely used ones are forgotten.

    It holds two generations. Keys asked for again move on to the younger one.
    """

    def __init__(self, compute: Callable[[str], bytes]) -> None:
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    """Encodes and decodes like the library, by an agenda of symbol pairs.

    The vocabulary must be of the merge type with byte fallback, its
    normaliser must only mark spaces and put one before the text; other models
    are refused. A symbol can only grow over two neighbouring characters if
    some piece holds both side by side. Where none does, the text is cut and
    the parts are encoded apart, each distinct one once per worker: first at
    spaces, then at all such places.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.normalize(" Ａ\t  b ") != "▁▁Ａ\t▁▁b▁":
            raise ValueError("only models that mark spaces and add one in front are supported")
        ids = range(library.get_piece_size())
        names = [library.id_to_piece(i) for i in ids]
        plain = [
            i for i in ids
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)
                    or library.is_unused(i))
        ]
        byte_ids = [i for i in ids if library.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        self._byte = {int(names[i][3:5], 16): _packed([i]) for i in byte_ids}
        # symbols are compared with spaces unmarked, as texts hold them
        self._id = {names[i].replace(SPACE, " "): _packed([i]) for i in plain}
        levels = {score: i for i, score in enumerate(
            sorted({library.get_score(i) for i in plain}, reverse=True)
        )}
        self._rank = {names[i].replace(SPACE, " "): levels[library.get_score(i)] for i in plain}
        self._surface = [
            b"" if library.is_control(i)
            else " ⁇ ".encode() if library.is_unknown(i)
            else bytes([int(names[i][3:5], 16)]) if library.is_byte(i)
            else names[i].replace(SPACE, " ").encode()
            for i in ids
        ]
        self._starts_with_space = [
            names[i].startswith(SPACE) and not library.is_byte(i) for i in ids
        ]
        self._joined = {piece[i:i + 2] for piece in self._id for i in range(len(piece) - 1)}
        self._separable = not any(pair[1] == " " and pair != "  " for pair in self._joined)
        self._parts = _Remembered(self.part_ids)
        self._units = _Remembered(self.unit_ids)
        self._begin, self._end = _packed([library.bos_id()]), _packed([library.eos_id()])

    def merged(self, unit: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece.

        The agenda holds the pairs that are pieces, best score first, then
        leftmost: rank of the score, places of both symbols, length. A pair is
        stale if one of its symbols has changed since.
        """
        symbols, rank_of, agenda = list(unit), self._rank.get, []
        for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])):
            rank = rank_of(pair)
            if rank is not None:
                agenda.append((rank, i, i + 1, 2))
        if not agenda:
            return symbols
        push, pop, n = heapq.heappush, heapq.heappop, len(symbols)
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, left, right, size = pop(agenda)
            pair = symbols[left] + symbols[right]
            if len(pair) != size or not symbols[left] or not symbols[right]:
                continue
            symbols[left], symbols[right] = pair, ""
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                longer = pair + symbols[follower]
                rank = rank_of(longer)
                if rank is not None:
                    push(agenda, (rank, left, follower, len(longer)))
            leader = before[left]
            if leader >= 0:
                longer = symbols[leader] + pair
                rank = rank_of(longer)
                if rank is not None:
                    push(agenda, (rank, leader, left, len(longer)))
        return [symbol for symbol in symbols if symbol]

    def parts(self, unit: str) -> list[str]:
        """The unit, cut between characters that no piece holds side by side."""
        joined, begin, out = self._joined, 0, []
        if joined.issuperset(map(str.__add__, unit, unit[1:])):
            return [unit]
        for i, pair in enumerate(map(str.__add__, unit, unit[1:]), 1):
            if pair not in joined:
                out.append(unit[begin:i])
                begin = i
        out.append(unit[begin:])
        return out

    def unit_ids(self, unit: str) -> bytes:
        """Packed ids of one unit."""
        return b"".join(map(self._parts.__getitem__, self.parts(unit)))

    def part_ids(self, part: str) -> bytes:
        """Packed ids of one part; symbols outside the vocabulary become bytes."""
        ids = []
        for symbol in self.merged(part):
            known = self._id.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids += [self._byte[b] for b in symbol.encode()]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return self._begin + self._end
        marked = " " + text.replace(SPACE, " ")
        units = _UNIT.findall(marked) if self._separable else [marked]
        return b"".join([self._begin, *map(self._units.__getitem__, units), self._end])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; a byte that is no part of a character gives U+FFFD."""
        return self.text_of(_unpacked(packed))

    def text_of(self, ids: list[int]) -> str:
        surface = self._surface
        data = b"".join(map(surface.__getitem__, ids))
        first = next((i for i in ids if surface[i]), None)
        if first is not None and self._starts_with_space[first]:
            data = data[1:]  # the space put before the text
        return data.decode("utf-8", "palisade.every_byte")

    def agrees(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
        """Whether the library gives the same ids and the same text back."""
        given = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        back = self.library.decode(given, num_threads=1)
        return [
            theirs == ours and text == own
            for theirs, ours, text, own in zip(given, ids, back, decoded)
        ]


def _packed(ids: Iterable[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _unpacked(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per worker process, so that later tasks find its units."""
    return PieceCodec(path)


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, ``decoded``, ``agrees`` of every row.

    ``ids`` are those of the whole text with begin and end, packed as
    little-endian unsigned 32-bit integers; ``decoded`` is the text they stand
    for. With ``check`` each Arrow batch is also given to the library, and
    ``agrees`` tells whether both results are equal (null without).

    A null text counts as empty and has begin and end only. Repeated rows each
    get their own row, null ids stay, other columns are ignored, an empty
    table gives no rows. No text is cut, so a worker holds one text and its
    ids; shorter ones are taken together up to ``BATCH_BYTES``. The model is
    loaded by each worker from ``model_path``, which must exist on every machine.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            packed = [own.encode(text) for text in texts]
            ids = [_unpacked(each) for each in packed]
            decoded = [own.text_of(each) for each in ids]
            same = own.agrees(texts, ids, decoded) if check else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(each) for each in ids], pa.int64()),
                pa.array(packed, pa.binary()), pa.array(decoded, pa.string()),
                pa.array(same, pa.bool_()),
            ], ["doc_id", "n_tokens", "ids", "decoded", "agrees"])

    return given.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string, agrees boolean"
    )


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``text`` of rows with packed ``ids``; null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in by_bytes(batches, "ids", BATCH_BYTES):
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
