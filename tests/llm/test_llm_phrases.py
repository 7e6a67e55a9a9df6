"""Collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows: list[tuple], least: int, top: int = 2000, depth: int = 5, percent: int = 100) -> list[tuple]:
    """rows: (text, lang). Every phrase is counted, every longer candidate searched."""
    counts: dict[str, Counter] = {}
    total: Counter = Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            f.update(tuple(words[n:n + k]) for n in range(len(words)) for k in range(1, depth + 1) if n + k <= len(words))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around: dict = {}
        for p, a in known.items():
            for n in range(len(p)):
                for k in range(2, len(p)):
                    if n + k <= len(p):
                        around[p[n:n + k]] = max(around.get(p[n:n + k], 0), a)
        scored = []
        for p, a in known.items():
            if 100 * around.get(p, 0) < percent * a:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for n, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, n, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def some_rows(seed: int, number: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "and", "É", "x", "cat", "dog", "sat", "Mat", "\x1c", "中文", "on", "a", "rare%d"]
    passage = "in the beginning was the word and the word was long"
    rows = []
    for n in range(number):
        text = ""
        for _ in range(rng.randint(0, 60)):
            w = rng.choices(words, [9, 7, 6, 2, 2, 3, 3, 2, 2, 1, 1, 2, 3, 2])[0]
            text += (w % rng.randint(0, 99) if "%" in w else w) + rng.choice([" "] * 12 + ["  ", "\t", ", ", ".", "\n", "! ", "\r\n", ";"])
        if rng.random() < 0.4:
            text += passage
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" . ,", "fr"), ("Alone", "fr")]


@pytest.mark.parametrize("budgets", [dict(part_words=200, group_suffixes=30, broadcast_words=0), dict(part_words=3000, group_suffixes=400), {}])
def test_collocations(spark, budgets):
    rows = some_rows(1, 400)
    docs = spark.createDataFrame([(t, g, "?", 7) for t, g in rows], "text string, lang string, ids string, rank int").repartition(4)
    found = phrases.collocations(docs, least=12, top=40, **budgets)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == plain(rows, 12, 40)


def test_heavy_prefixes_of_every_length(spark):
    """Copies of one passage, and one pair of words that all rows hold: prefixes up to four words exceed the budget."""
    rows = [("one two three four five six", "en")] * 300 + [(f"one two three four w{n % 9} one two x{n % 5}", "en") for n in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    found = phrases.collocations(docs, least=20, part_words=100, group_suffixes=60)
    assert sorted(map(tuple, found.collect())) == plain(rows, 20)


def test_absorbed_share(spark):
    rows = some_rows(2, 200)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = phrases.collocations(docs, least=8, percent=80)
    assert sorted(map(tuple, found.collect())) == plain(rows, 8, percent=80)


def test_exact_scores(spark):
    big = 10 ** 16 - 1
    rows = [(big, big, big, big), (100, 10 ** 15, 10 ** 9 + 7, 10 ** 9 + 9), (7, 3, 2, 1)]
    found = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint").select("*", phrases.exact_score().alias("x"))
    assert all(r.x == 1000 * r.a * r.n // (r.l * r.r) for r in found.collect())


def test_no_phrases(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    one = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(one).count() == 0


def test_ties(spark):
    rows = [(f"{w} z{w}, ", "en") for w in ("b", "a", "c")] * 5 + [("x y", "en")] * 6
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [tuple(r) for r in phrases.collocations(docs, least=5, top=2).orderBy("rank").collect()]
    assert got == plain(rows, 5, 2) and got[0][2] == "a za"


@pytest.mark.parametrize("seed", range(5))
def test_suffixes(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(-1, 3, 200).astype("<i4")
    expected = Counter()
    for n in range(200):
        run = []
        while len(run) < 4 and n + len(run) < 200 and tokens[n + len(run)] >= 0:
            run.append(int(tokens[n + len(run)]))
        if len(run) > 1:
            expected[tuple(run + [-1] * (4 - len(run)))] += 1
    rows = phrases.suffixes(tokens, 4)
    assert Counter(map(tuple, rows.tolist())) == expected
    merged, times = phrases.leaves(rows, np.ones(len(rows), np.int64))
    assert dict(zip(map(tuple, merged.tolist()), times.tolist())) == expected
    assert merged.tolist() == sorted(merged.tolist())
