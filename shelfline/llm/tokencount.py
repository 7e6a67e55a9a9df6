"""Token counts by byte-pair merging on a heap and a linked list, without making any identifiers.

A text is normalised as the vocabulary has it (spaces become U+2581, one is put in front) and cut where no piece of
the vocabulary continues: before a space that follows another character, around line breaks, and between any two
characters that stand side by side in no piece. No merge can cross such a cut, so the parts are counted on their own and
remembered. Within a part, the pair of lowest rank is popped from a heap, the leftmost first, and merged in a linked
list of symbols; the count is the initial symbols less the merges. A character outside the vocabulary is as many
symbols as it has bytes.

Null and empty texts have 0 tokens. Repeated rows are counted each for itself.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import map_slices, whole_text

#: More than so many tokens are over the limit.
LIMIT_TOKENS = 4096
#: Parts that a worker remembers; it forgets all of them beyond this.
REMEMBERED = 400_000
#: Fixed value: the sign that stands for a space in pieces.
SPACE = "▁"


class Merger:
    """The pieces of a vocabulary with their ranks; the lowest is merged first."""

    def __init__(self, ranks: dict[str, float]) -> None:
        self.ranks = ranks
        self.together = {word[n:n + 2] for word in ranks for n in range(len(word) - 1)}
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of an already normalised text."""
        total, start = 0, 0
        for n in range(1, len(text) + 1):
            if n == len(text) or text[n - 1:n + 1] not in self.together:
                part = text[start:n]
                if (count := self.known.get(part)) is None:
                    self.known[part] = count = self.count_part(part)
                total += count
                start = n
        return total

    def count_part(self, text: str) -> int:
        ranks = self.ranks
        symbols: list[str] = list(text)
        count = sum(1 if x in ranks else len(x.encode("utf-8")) for x in symbols)
        if len(symbols) < 2:
            return count
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap = [(ranks[pair], n, pair) for n in range(len(symbols) - 1) if (pair := symbols[n] + symbols[n + 1]) in ranks]
        heapify(heap)
        while heap:
            _, n, pair = heappop(heap)
            right = after[n]
            if right < 0 or not symbols[n] or symbols[n] + symbols[right] != pair:
                continue  # one of its symbols has been merged since
            symbols[n], symbols[right] = pair, ""
            after[n] = after[right]
            if after[n] >= 0:
                before[after[n]] = n
            count -= 1
            for left in (before[n], n):
                if left >= 0 and after[left] >= 0 and (new := symbols[left] + symbols[after[left]]) in ranks:
                    heappush(heap, (ranks[new], left, new))
        return count


class Counter(dict):
    """Tokens by chunk: a chunk that starts with a line break stands as it is, any other follows a space."""

    #: A run of spaces or a line break, with the word after it.
    CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")

    def __init__(self, model: str) -> None:
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        own = range(vocabulary.get_piece_size())
        ranks = {vocabulary.id_to_piece(n): -vocabulary.get_score(n) for n in own
                 if not (vocabulary.is_control(n) or vocabulary.is_unknown(n) or vocabulary.is_byte(n)
                         or vocabulary.is_unused(n))}
        if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in ranks):
            raise ValueError("pieces of this vocabulary continue after a space or a line break")
        self.merger = Merger(ranks)

    def __missing__(self, chunk: str) -> int:
        whole = chunk if chunk[:1] == "\n" else SPACE + chunk.replace(" ", SPACE)
        self[chunk] = count = self.merger.count(whole)
        return count

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or " \n" in text or text[-1] == " " or text[0] in " \n":
            chunks = [x[1:] if x[0] == " " else x for x in self.CHUNK.findall(" " + text)]
        else:
            chunks = text.replace("\n", " \n").split(" ")
        count = sum(map(self.__getitem__, chunks))
        if len(self) > REMEMBERED:
            self.clear()
            self.merger.known.clear()
        return count


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id",
                 limit: int = LIMIT_TOKENS) -> DataFrame:
    """Columns key, n_bytes, n_tokens and over_limit (n_tokens > limit), one row per row of docs."""
    kind = dict(docs.dtypes)[key]

    def work(part: pa.RecordBatch) -> dict:
        tokens = counter(model).tokens
        return {"key": part.column("key"), "n_bytes": part.column("n_bytes"),
                "n_tokens": [tokens(x) for x in part.column("text").to_pylist()]}

    rows = docs.select(F.col(key).alias("key"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
                       whole_text(text).alias("text"))
    return map_slices(rows, work, f"key {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
