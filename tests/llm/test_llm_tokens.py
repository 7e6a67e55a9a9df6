"""Encoding, counting and packing against the libraries whose vocabularies they read."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from shelfline.llm import bpe, packing, tokencount

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BITS = ["a", "the", "ing", " ", "  ", "'", "s", "'ll", "\n", "\t", "1", "23", "!", "...", ",", "é", "中", "𝄞", "<|endoftext|>",
        "<|end", "<s>", "▁", "\xa0", "　", "xxxxxxx", "A", "\r", "\x1c", "\x85", "\x00", "ﬁ", "́", "İ", "가"]


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def strings(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(count)]


def test_tree_of_small_leaves_is_the_library():
    own, other = bpe.TreeCodec(BYTES), library(BYTES)
    for n, x in enumerate(strings(1500, 1)):
        ids = other.encode(x, add_special_tokens=False).ids
        assert own.encode(x, 1 + n % 17) == ids
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("x", ["abc" * 3000, "中文" * 2000, "!?" * 2500, " " * 5000, "a" * 7000, "1" * 4999])
def test_long_unsplit_text(x):
    assert bpe.TreeCodec(BYTES).encode(x, 300) == library(BYTES).encode(x, add_special_tokens=False).ids


def test_encode_rows(tricky, nothing, pairs):
    other = library(BYTES)
    expected = Counter((k, tuple(other.encode(x, add_special_tokens=False).ids)) for k, x in pairs)
    coded = bpe.encode(tricky, BYTES, leaf_chars=1000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == expected
    back = bpe.decode(coded, BYTES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(pairs)
    digest = Counter((r.doc_id, r.ids_sha256) for r in bpe.round_trip_digest(tricky, BYTES).collect())
    assert digest == Counter((k, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for k, ids in expected.elements())
    assert bpe.round_trip_digest(nothing, BYTES).count() == 0


def test_counts_are_the_library():
    import sentencepiece

    own, other = tokencount.Counter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for x in strings(3000, 2):
        assert own.tokens(x) == len(other.encode(x)), x


def test_count_rows(tricky, nothing, pairs):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = tokencount.token_counts(tricky, PIECES, limit=100)
    expected = [(k, len(x.encode()), n := len(other.encode(x)), n > 100) for k, x in pairs]
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert tokencount.token_counts(nothing, PIECES).count() == 0


def test_word_ids_are_the_library():
    own, other = packing.WordIds(WORDS), library(WORDS)
    some = strings(3000, 3)
    for x, ids in zip(some, own.ids(some)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing_is_the_plain_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 31])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
    histogram = Counter(lengths)
    moves = packing.best_fit_decreasing(dict(histogram), capacity)
    used: dict[int, list] = {}
    for n, (length, rank, window, offset) in enumerate(moves):
        after = moves[n + 1][1] if n + 1 < len(moves) and moves[n + 1][0] == length else histogram[length]
        for k in range(after - rank):
            used.setdefault(window + k, []).append((offset, length))
    for held in used.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
    left: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, n) for n, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(capacity - length)
    assert sorted(capacity - sum(x for _, x in held) for held in used.values()) == sorted(left)


def test_pack_rows(tricky, nothing, pairs):
    other = library(WORDS)
    rows = packing.pack_documents(tricky, WORDS, capacity=64).collect()
    ids = {}
    expected = Counter()
    for k, x in pairs:
        full = np.array([*other.encode(x, add_special_tokens=False).ids, packing.END_ID], "<u4")
        for start in range(0, len(full), 64):
            piece = full[start:start + 64]
            expected[k, start, len(piece), zlib.crc32(piece.tobytes()), len(full)] += 1
        ids[k] = full
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        assert [o for o, _ in sorted(held)] == [sum(x for _, x in sorted(held)[:n]) for n in range(len(held))]
        assert sum(x for _, x in held) <= 64
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_signs_behind_letters_are_not_learned_with_them():
    """Words that differ in the signs behind them share what is learned of their letters, with the ids of the library."""
    words = ["Les&&&", "ESEDEA!!", "paçeux$$$", "querara,&&&", "Σας;", "İ,", "ŉ!", "ab'", "ab's", "ab',", "a≠", "x1..", "ⅷ.", "ⓐ!!", "ª,", "--", "é́)", "ab<|endoftext|>", "<|endoftext|>ab;;", "ab<|endoftext|"]
    source = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for word in words:
        wanted = source.tokenizer.encode(word, add_special_tokens=False).ids
        assert source.ids([word]) == [np.array(wanted, "<u4").tobytes()]
    assert "les" in source and "esedea" in source and packing.WordIds.base("querara,&&&") == "querara"
