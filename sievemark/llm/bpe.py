"""Operator 3: byte-level BPE as a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that merging produces. It is compiled by one
gadget per merge, in merge order. Before the first merge there is one state with a loop for every
byte. The gadget of merge k, (u, v) -> t, changes every state that has an arc u and, behind it, an
arc v: it gets an arc t, and the state behind u is replaced by a copy that has no arc v any more; t
leads where v led at that moment. Since all arcs with the same label lead to the same state, a state
is kept as a log: ``cuts[u]`` holds the arcs that the copies of u's state lost, with the merge
number, and ``fork[t] = (v, k)`` says that t's state began as v's state as of merge k. An arc t
exists in a state unless one of t's left parts was cut there while that part was still on its own.

Looked-up transitions are kept in a table, so encoding a pre-split word is a walk over that table:
the longest label that matches next and has an arc, with a step back where the walk ends early. A
position from which the walk failed is never tried again, because at most one path reaches each
position; a word costs time linear in its length. Decoding emits the label of each arc.

Special strings in a text become their single id, as in the library. Null texts count as empty; an
empty text has no id and decodes to the empty text. Repeated rows give repeated results, an empty
table an empty one, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import Memo, per_row, text_of

#: Fixed value: the pre-split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and accented Latin letters only, where plain classes say the same faster.
LATIN = re.compile("[\\x00-\\x7F\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\xFF]*")
LATIN_SPLIT = re.compile(
    " ?[A-Za-z\\xC0-\\xFF]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^A-Za-z\\xC0-\\xFF0-9 \\t-\\r]+"
    "|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+")
START = -1


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        self.labels = {i: token for token, i in vocabulary.items()}
        self.cuts: dict[int, dict[int, int]] = {}
        self.fork: dict[int, tuple[int, int]] = {}
        self.left: dict[int, tuple[int, int]] = {}
        for k, (first, second) in enumerate(merges):
            self._gadget(k, vocabulary[first], vocabulary[second], vocabulary[first + second])
        #: Looked-up transitions: state and label packed in one number; whether there is an arc.
        self.table: dict[int, bool] = {}
        #: The longest label by its first three bytes.
        self.reach: dict[bytes, int] = {}
        for token in vocabulary:
            for n in range(1, min(3, len(token)) + 1):
                self.reach[token[:n]] = max(self.reach.get(token[:n], 1), len(token))

    def _gadget(self, k: int, u: int, v: int, t: int) -> None:
        if not self._arc(u, v, k):
            return  # no state has an arc v behind u any more: this merge can never apply
        self.cuts.setdefault(u, {})[v] = k
        self.fork[t], self.left[t] = (v, k), (u, k)

    def _arc(self, u: int, label: int, now: int) -> bool:
        """Whether the state behind u has the arc before merge ``now``."""
        parts = []  # left parts of the label, and the merge that ends each part's own life
        part, until = label, now
        while True:
            parts.append((part, until))
            if part not in self.left:
                break
            part, until = self.left[part]
        state, until = u, now
        while True:
            cut = self.cuts.get(state)
            if cut:
                for part, alive in parts:
                    k = cut.get(part)
                    # k == alive: of three equal tokens the first two merge, so the cut comes first.
                    if k is not None and k < until and k <= alive:
                        return False
            if state not in self.fork:
                return True
            state, until = self.fork[state]

    def _step(self, key: int) -> bool:
        """Fill in one entry of the table."""
        if len(self.table) > 300_000:
            self.table.clear()
        found = self.table[key] = self._arc(key >> 20, key & 0xFFFFF, sys.maxsize)
        return found

    def encode(self, word: bytes) -> list[int]:
        ids = self.ids.get
        whole = ids(word)
        if whole is not None:
            return [whole]
        arc, reach, end = self.table.get, self.reach.get, len(word)
        path: list[int] = []
        state, here, failed = START, 0, set()
        size = reach(word[:3]) or reach(word[:2]) or 1
        while True:
            if size > end - here:
                size = end - here
            while size:
                label = ids(word[here:here + size])
                if label is not None and (not failed or here + size not in failed):
                    if state == START:
                        break
                    key = state << 20 | label
                    found = arc(key)
                    if found or (found is None and self._step(key)):
                        break
                size -= 1
            if size:
                path.append(label)
                here += size
                if here == end:
                    return path
                state = label
                three = word[here:here + 3]
                size = reach(three) or reach(three[:2]) or 1
            else:
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                failed.add(here)
                size = len(self.labels[path.pop()])
                here -= size
                size -= 1
                state = path[-1] if path else START


def checked(spec: dict) -> dict[str, int]:
    """The special strings of a tokenizer file, after a check that the file is of the supported kind."""
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("a byte-level BPE file without normalizer is needed")
    if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
        raise ValueError("only the plain pre-split is supported")
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


class Splitter:
    """Cuts a text into special strings and pre-split words."""

    def __init__(self, special: dict[str, int]):
        self.special = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.split = regex.compile(SPLIT)

    def __call__(self, text: str) -> list[str]:
        split = LATIN_SPLIT if LATIN.fullmatch(text) else self.split
        if not any(s in text for s in self.special):
            return split.findall(text)
        return [word for part in self.cut.split(text)
                for word in ([part] if part in self.special else split.findall(part))]


class ByteTokenizer:
    """Encodes and decodes whole texts; made from the parsed JSON of a tokenizer file."""

    def __init__(self, spec: dict):
        model, letter, self.special = spec["model"], byte_letters(), checked(spec)
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocabulary = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.automaton = MergeAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.labels = self.automaton.labels | {i: s.encode() for s, i in self.special.items()}
        self.split = Splitter(self.special)
        self.memo = Memo(self._word)

    def _word(self, word: str) -> bytes:
        special = self.special.get(word)
        return array("I", self.automaton.encode(word.encode()) if special is None else [special]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer_of(path: str) -> ByteTokenizer:
    """The tokenizer of a file, compiled once per worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as file:
            _LOADED[path] = ByteTokenizer(json.load(file))
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens`` and ``ids`` (little-endian 32-bit integers)."""
    schema = pa.schema([(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(text: str) -> tuple[int, bytes]:
        ids = tokenizer_of(path).encode(text)
        return len(ids) // 4, ids

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), text_of(text_column).alias("_text"))
    return rows.mapInArrow(per_row(work, [id_column], schema, at_end=lambda: tokenizer_of(path).memo.forget()),
                           f"`{id_column}` long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded`` (see ``encode_texts``): its id and the decoded ``text``."""
    schema = pa.schema([(id_column, pa.int64()), ("text", pa.string())])

    def work(ids: bytes) -> tuple[str]:
        return (tokenizer_of(path).decode(ids),)

    rows = encoded.select(F.col(id_column).cast("long").alias(id_column), "ids")
    return rows.mapInArrow(per_row(work, [id_column], schema), f"`{id_column}` long, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts; digests of both sides leave the worker.

    Returns the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``. One narrow map: no shuffle.
    """
    schema = pa.schema([(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def work(text: str) -> tuple[int, str, str]:
        tokenizer = tokenizer_of(path)
        ids = tokenizer.encode(text)
        back = tokenizer.decode(ids).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), text_of(text_column).alias("_text"))
    return rows.mapInArrow(per_row(work, [id_column], schema, at_end=lambda: tokenizer_of(path).memo.forget()),
                           f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
