"""Operator 2: token counts of a sentence-piece BPE model with a whole-token shortcut.

Merging never crosses a place where no vocabulary string has the two neighbouring characters side
by side. Two kinds of such places are proved from the vocabulary when the model is loaded: before a
space that follows another character, and around a character that no longer string contains. A text
is cut there into pre-tokens. Offline, every vocabulary string is encoded alone; those that give
exactly one token form the shortcut table, and a pre-token found in it counts one. Only the rest is
merged, by score and position, and remembered per worker up to a fixed number of words.

Null texts count as empty, an empty text has no token. Very long pre-tokens are merged with a heap,
so the cost stays n log n. Ties between equal scores go to the leftmost pair. Rows are independent:
repeated rows give repeated results, an empty table an empty one, and further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import Memo, per_row, text_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at:at + size]
        at += size


class PieceCounter:
    """Counts tokens; made from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.scores: dict[str, float] = {}
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind not in (UNKNOWN, CONTROL, BYTE):
                    raise ValueError(f"pieces of kind {kind} are not supported")
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a BPE model with byte fallback is needed")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave texts as they are and escape spaces are supported")
        self.prefix = " " if normalizer.get(3, 1) else ""
        longer = [s for s in self.scores if len(s) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", s) for s in longer):
            raise ValueError("a vocabulary string has a space after another character")
        joined = set("".join(longer))
        #: Characters that occur in no longer string merge with nothing.
        self.cut = re.compile("([^" + "".join(map(re.escape, sorted(joined | {" "}))) + "])")
        self.alone = {s.replace(SPACE, " "): 1 for s in self.scores if self._merge(s) == 1}
        self.memo = Memo(self._pre_token)

    def _pre_token(self, word: str) -> int:
        if word in self.alone:
            return 1
        parts = self.cut.split(word)
        return sum(self.alone.get(p) or self._merge(p.replace(" ", SPACE)) for p in parts if p)

    def _merge(self, word: str) -> int:
        """Tokens of one pre-token: merge the best pair, leftmost first, until none is left."""
        scores = self.scores
        if len(word) > 32:
            symbols = self._merge_long(word)
        else:
            symbols = list(word)
            offers = [scores.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
            while offers and (best := max(offers)) > NEVER:
                i = offers.index(best)
                symbols[i] += symbols.pop(i + 1)
                offers.pop(i)
                if i:
                    offers[i - 1] = scores.get(symbols[i - 1] + symbols[i], NEVER)
                if i < len(offers):
                    offers[i] = scores.get(symbols[i] + symbols[i + 1], NEVER)
        return sum(1 if s in scores else len(s.encode()) for s in symbols)

    def _merge_long(self, word: str) -> list[str]:
        symbols: list[str | None] = list(word)
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(word):
                both = symbols[left] + symbols[after[left]]
                if both in self.scores:
                    heapq.heappush(waiting, (-self.scores[both], left, both))

        for i in range(len(word) - 1):
            offer(i)
        while waiting:
            _, left, both = heapq.heappop(waiting)
            right = after[left]
            if symbols[left] is None or right >= len(word) or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < len(word):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [s for s in symbols if s is not None]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(SPACE, " ")
        if "  " not in text and text[-1] != " ":
            head, *words = text.split(" ")
            found = [" " + w for w in words] if not head else [head, *(" " + w for w in words)]
        else:
            found = re.findall(r" *[^ ]+| +\Z", text)
        return sum(map(self.memo.__getitem__, found))


_LOADED: dict[str, PieceCounter] = {}


def counter_of(path: str) -> PieceCounter:
    """The counter of a model file, made once per worker."""
    if path not in _LOADED:
        with open(path, "rb") as file:
            _LOADED[path] = PieceCounter(file.read())
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``model_path`` must exist on every worker. The work is one narrow map: no shuffle.
    """
    schema = pa.schema([(id_column, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def work(text: str) -> tuple[int]:
        return (counter_of(model_path).count(text),)

    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias(id_column),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    counted = rows.mapInArrow(per_row(
        work, [id_column, "n_bytes"], schema, at_end=lambda: counter_of(model_path).memo.forget()),
                              f"`{id_column}` long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
