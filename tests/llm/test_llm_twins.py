"""Fingerprints and quality rules against plain twins, written from their description."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from llm_samples import prose

from shelfline.llm import ctph, quality

M = (1 << 64) - 1


def mixed(x: int) -> int:
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & M
    return (x ^ (x >> 29)) * 0x94D049BB133111EB & M


def plain_fingerprint(text: str) -> str:
    """A byte at a time: the rolling hash of the last seven bytes ends chunks, each chunk's own hash is a character."""
    data = text.encode()
    if not data:
        return "3::"
    value = lambda b: mixed((b + 1) * ctph.ODD & M)
    rolling = []
    for n in range(len(data)):
        total = value(data[n])
        for back in range(1, 7):
            if n - back >= 0:
                total += value(data[n - back]) * (2 * back * 0x85EBCA77 + 1)
        rolling.append(mixed(total & M) >> 32)

    def signature(block: int) -> str:
        out, chunk, power, held = "", 0, 1, 0
        for n, b in enumerate(data):
            chunk, power, held = (chunk + value(b) * power) & M, power * ctph.ODD & M, held + 1
            ends = rolling[n] % block == block - 1 and len(out) < 63
            if ends or n == len(data) - 1:
                out += ctph.ALPHABET[mixed(chunk) >> 58]
                chunk, power, held = 0, 1, 0
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(r % block == block - 1 for r in rolling) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


@pytest.mark.parametrize("seed", range(6))
def test_fingerprint_is_the_plain_one(seed):
    rng = random.Random(seed)
    texts = ["", "a", "abc", "é中𝄞", "x" * 500, "ab" * 700, "\n" * 100]
    texts += [prose(seed * 50 + n, rng.choice([1, 5, 30, 200, 600])) for n in range(12)]
    texts += ["".join(chr(rng.choice([65, 97, 233, 0x4E2D, 10])) for _ in range(rng.randint(1, 300))) for _ in range(12)]
    for x in texts:
        assert ctph.fingerprint(x) == plain_fingerprint(x)


def plain_rules(text: str) -> tuple[int, bool]:
    """The failed rules as bits, and whether the document is kept."""
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    double = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k:k + 3]) for k in range(n - 2)]
    often = Counter(windows)
    repeated = len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)})
    failed = [
        n < 50, repeated * 100 > 50 * n, 10 * sum(x in "#*$%&|<>" for x in text) > n, double >= 3 and 100 * double > 50 * len(lines),
        100 * sum("A" <= x <= "Z" for x in text) > 40 * chars, 2 * text.count("!") > n, chars < 2 * n, chars > 40 * n,
        100 * sum("0" <= x <= "9" for x in text) > 50 * chars]
    return sum(1 << bit for bit, x in enumerate(failed) if x), not any(failed)


def test_rules_are_the_plain_ones(spark):
    rng, texts = random.Random(3), ["", " \n ", "!" * 200]
    extras = ["#", "##*$", "HELLO WORLD", "!", "!!!", "a", "b c", "x" * 300, "12345", "9", "\nline again\n", "the end", "é", " "]
    for n in range(400):
        words = prose(n, rng.choice([20, 60, 120])).split()
        rate = rng.choice([0, 0.1, 0.5, 0.9])
        few = rng.sample(extras, 2)
        texts.append(" ".join(rng.choice(few) if rng.random() < rate else w for w in words) + ("\nsame line" * rng.choice([0, 1, 4, 9])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = {r.doc_id: (r.failures, r.kept) for r in quality.verdicts(docs).collect()}
    assert [rows[n] for n in range(len(texts))] == [plain_rules(x) for x in texts]
    seen = {bit for failures, _ in rows.values() for bit in range(9) if failures >> bit & 1}
    assert seen == set(range(9)) and any(kept for _, kept in rows.values())
