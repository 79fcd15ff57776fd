"""Operators 2, 3 and 7 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievemark.llm import bpe, id_blocks, token_counts
from sievemark.session import scratch_folder
from tests.llm.helpers import ODD, documents

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "ß", "<|endoftext|>", "<s>", "\x00", "日本", "🙂", "\u0301", "\x1c",
             "\x85", "'s", "'ll", "12", "!!", "...", "the", "ing", "e" * 40, "ab" * 30, "\r\n", "\u200b", "²", "×", "_"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    made += [f"a{chr(i)} {chr(i)}b" for i in range(1, 0x3000, 3)]
    return made + ["x" * 3000, " " * 500, "ab c" * 2000, "\n" * 50 + "a", ""]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def ids_of(library, some):
    return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]


def test_piece_counts_agree():
    counter, some = token_counts.counter_of(PIECES), texts()
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [counter.count(t) for t in some] == [len(x) for x in reference.encode(some, num_threads=1)]


def test_shortcut_strings_are_single_tokens():
    counter = token_counts.counter_of(PIECES)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alone = [w for w in counter.alone if w[0] == " " and w.strip()][::50]
    assert alone and all(len(x) == 1 for x in reference.encode([w[1:] for w in alone]))


def test_automaton_agrees_and_decodes(library):
    tokenizer, some = bpe.tokenizer_of(BYTES), texts()
    ids = [tokenizer.encode(t) for t in some]
    assert ids == ids_of(library, some)
    assert [tokenizer.decode(i) for i in ids] == some


def test_both_pre_splits_agree():
    for text in texts():
        if bpe.LATIN.fullmatch(text):
            assert bpe.LATIN_SPLIT.findall(text) == bpe.regex.compile(bpe.SPLIT).findall(text)


def test_equal_tokens_merge_from_the_left():
    automaton = bpe.MergeAutomaton({b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}, [(b"a", b"a"), (b"aa", b"b")])
    assert [automaton.encode(b"a" * n) for n in range(1, 6)] == [[0], [2], [2, 0], [2, 2], [2, 2, 0]]
    assert automaton.encode(b"aaab") == [2, 0, 1] and automaton.encode(b"aab") == [3]


def test_counts_of_odd_rows(spark):
    got = token_counts.count_tokens(documents(spark, ODD, clashes=True), PIECES, limit=10).collect()
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = [(i, len((t or "").encode()), n := len(reference.encode(t or "")), n > 10) for i, t in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_round_trip_of_odd_rows(spark, library):
    docs = documents(spark, ODD, clashes=True)
    got = bpe.round_trip(docs, BYTES).collect()
    ids = ids_of(library, [t or "" for _, t in ODD])
    expected = [(i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                for (i, t), x in zip(ODD, ids, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    decoded = bpe.decode_ids(bpe.encode_texts(docs, BYTES), BYTES).collect()
    assert sorted(map(tuple, decoded), key=str) == sorted([(i, t or "") for i, t in ODD], key=str)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert bpe.round_trip(none, BYTES).count() == 0
    folder = scratch_folder(spark, "none")
    id_blocks.write_ids(none, BYTES, folder)
    assert id_blocks.read_ids(spark, folder).count() == 0


def test_file_encoder_agrees(library):
    some = texts() + [f"a{chr(i)} {chr(i)}b" for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    encode = id_blocks.encoder_of(BYTES).encode
    assert [encode(t) for t in some] == ids_of(library, some)


@pytest.mark.parametrize("run", [" ", " \t\u3000"])
def test_file_encoder_takes_very_long_whitespace(library, run):
    run *= 2_000_000 // len(run)
    short = run[:150_000]
    some = [run + "a", short, "a b" + short + "\n!", "x" + short + "<|endoftext|>" + short + "<|endo", short + " é" + short]
    encode = id_blocks.encoder_of(BYTES).encode
    assert [encode(t) for t in some] == ids_of(library, some)


@pytest.mark.parametrize("ids", [
    [0], [7] * 5000, list(range(5000)), [0, 2**32 - 1] * 3, [3] * 99 + [50_000], [1] * 300 + [2**20] * 2 + [5] * 4000])
def test_blocks_keep_all_ids(ids):
    ids = np.array(ids, np.uint32)
    payload = id_blocks.pack(ids, 64)
    assert (id_blocks.unpack(payload) == ids).all()
    for first, last in ((0, 1), (len(ids) // 2, len(ids)), (60, 70), (5, 5)):
        assert (id_blocks.unpack(payload, first, last) == ids[first:last]).all()


def test_outliers_go_to_the_exception_list():
    narrow, outlier = np.full(1000, 3, np.uint32), np.full(1000, 3, np.uint32)
    outlier[500] = 2**30
    assert len(id_blocks.pack_block(outlier)) - len(id_blocks.pack_block(narrow)) == 8


def test_files_hold_all_documents_in_order(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:300])] + [(1000, None), (2000, "x " * 20_000)]
    random.Random(2).shuffle(rows)
    folder = scratch_folder(spark, "ids")
    id_blocks.write_ids(documents(spark, rows, clashes=True), BYTES, folder, files=5)
    got = id_blocks.read_ids(spark, folder).orderBy("start").collect()
    rows.sort()
    ids = [x + b"\0\0\0\0" for x in ids_of(library, [t or "" for _, t in rows])]
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)])[:-1].tolist()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == [
        (i, s, len(x) // 4, zlib.crc32(x), x) for (i, _), s, x in zip(rows, starts, ids, strict=True)]


def test_files_of_odd_rows(spark):
    folder = scratch_folder(spark, "ids")
    id_blocks.write_ids(documents(spark, ODD), BYTES, folder, files=2)
    got = id_blocks.read_ids(spark, folder)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in ODD)
