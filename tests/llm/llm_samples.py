"""Documents that small tests share."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHING = ["key", "bits", "part", "row", "ids", "length", "offset", "label", "n_tokens", "tie", "_row", "spans", "base"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "ing", "er", "on", "an", "re", "he", "in", "th", "nd", "st", "or"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def texts() -> list[tuple]:
    shared = prose(1, 40)
    long = " ".join(prose(n, 400) for n in range(20, 40))
    rows = [
        (1, prose(2, 120) + " " + shared, "en"), (2, prose(3, 60) + " " + shared + " " + prose(4, 30), "en"),
        (3, prose(2, 120) + " " + shared, "de"), (4, None, None), (5, "", "en"), (6, " \n\t ", "en"), (7, "12 34", "de"),
        (8, "é中𝄞 naïve café " + prose(5, 30), "fr"), (9, long, "en"), (10, "x" * 3000, "en"), (10, "x" * 3000, "en"),
        (11, shared, "en"), (12, "<|endoftext|> a <s> b </s> ▁ c", "en"), (None, shared + " tail", "en"),
        (None, None, None), (13, long + " end", "en"), (14, (prose(6, 8) + "\n") * 9, "en"), (15, "a\r\nb\n\nc d\n\nc d", "en"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
