"""Alignment of two tokenisations against one that compares all offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfline.llm import align, bpe

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
BITS = [" \n", "\n ", " \xa0", "\u2003", "\x85", "\x1f", "a", "the", "ing", " ", "  ", "'", "s", "'ll", "\n", "\t", "1", "23", "!", "...", ",", "é", "中", "𝄞", "<|endoftext|>", "<s>", "</s>",
        "<0x41>", "<unk>", "\xa0", "　", "xxxxxxx", "A", "\r", "\x00", "ﬁ", "́", "가", " the", " of", " and the"]


def strings(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(count)]


def plain(texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the groups of each text, all by comparing offsets."""
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    back = bpe.byte_characters()
    rows = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        sides = []
        for ids, spell in ((a, lambda n: bytes(back[c] for c in tokenizer.id_to_token(n))),
                           (b, lambda n: bytes([n - pieces.piece_to_id("<0x00>")]) if pieces.is_byte(n)
                            else pieces.id_to_piece(n).replace("▁", " ").encode())):
            end, ends = 0, []
            for n in ids:
                end += len(spell(n))
                ends.append((end, n))
            sides.append((b"".join(map(spell, ids)) == whole, ends))
        rows.append(([], []) if not all(same for same, _ in sides) else (sides[0][1], sides[1][1]))
    count: Counter = Counter()
    linked = []
    for a, b in rows:
        at = dict(b)
        linked.append([(n, at[end]) for end, n in a if end in at])
        count.update(linked[-1])
    best: dict = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (a, b), pairs in zip(rows, linked):
        shared = sorted({e for e, _ in a} & {e for e, _ in b})
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(n) for e, n in side if start < e <= end) for side in (a, b)))
            start = end
        whole = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(whole.encode()).hexdigest() if a else "", whole))
    return out


def found_by(held: align.Aligner, texts: list[str]) -> list[tuple]:
    x = held.align(texts)
    return [(*own, groups) for *own, groups in zip(*(x.of_texts(n).tolist() for n in range(3)), x.groups())]


def test_random_strings_without_spark():
    texts, held = strings(3000, 1), align.Aligner(A, B)
    expected = plain(texts)
    wanted = [(r[0], r[1], r[3], r[7]) for r in expected]
    assert found_by(held, texts) == wanted
    assert [found_by(held, [x])[0] for x in texts[:200]] == wanted[:200]
    assert found_by(held, ["", "", "a"])[:2] == [(0, 0, 0, "")] * 2 and found_by(held, [""]) == [(0, 0, 0, "")]
    assert sum(r[0] > 0 for r in expected) > 1000


def test_windows_that_only_share_a_hash():
    """All windows meet: they are still told apart by their ids."""
    texts, held = strings(200, 5) + ["xyz" * 400 + " the end", "the cat and the dog " * 50, "中文" * 300], align.Aligner(A, B)
    held.mix = np.zeros_like(held.mix)
    assert [r[3] for r in found_by(held, texts)] == [r[7] for r in plain(texts)]


@pytest.mark.parametrize("hot_pairs", [0, 20, 1 << 20])
def test_counts_over_all_rows(spark, hot_pairs):
    texts = strings(400, 2) + ["the cat and the dog " * 30] * 40 + [None, "", " ", "▁x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = {r.doc_id: tuple(r)[1:] for r in align.alignment_digest(docs, A, B, hot_pairs=hot_pairs).collect()}
    assert [rows[n] for n in range(len(texts))] == [r[:7] for r in plain(texts)]


def test_rows(tricky, nothing, pairs):
    found = align.alignment_digest(tricky, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter((k, *r[:7]) for (k, _), r in zip(pairs, plain([x for _, x in pairs])))
    assert Counter((r.doc_id, len(r.a), len(r.b), r.groups) for r in align.groups(tricky, A, B).collect()) == Counter(
        (k, r[0], r[1], r[7]) for (k, _), r in zip(pairs, plain([x for _, x in pairs])))
    assert align.alignment_digest(nothing, A, B).count() == 0
