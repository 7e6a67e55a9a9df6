"""Packing token sequences into fixed windows by best-fit decreasing.

Documents become token ids; overlong ones are first cut into full windows, so a piece is at most a window long. Pieces
are placed from the longest to the shortest, each into the open window with the least remaining capacity that still
holds it; a segment tree indexed by remaining capacity finds that window.

Pieces of one length are alike, so the placing needs only how many there are of each length. That histogram has
at most `capacity` rows whatever the size of the corpus, and windows with the same remaining capacity are kept as
intervals of window numbers. Placing yields moves: so many pieces of a length, in the order of their
rank within that length, go to consecutive windows at one offset. Each piece then finds its move by
binary search. The result is the best-fit-decreasing packing of all pieces together, not one for each partition.

Ranks within a length are counted in blocks dealt by hash, so a length that a third of all pieces share is spread.
Null and empty texts are pieces that hold only the end token. Repeated rows are pieces of their own. Ties are
broken arbitrarily among pieces that are alike in length.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import chunks, cut_lineage, map_slices, whole_text

CAPACITY = 4096
#: The id that ends each document.
END_ID = 2
#: Words that a worker remembers; it forgets all of them beyond this.
REMEMBERED = 600_000
#: Signs that the vocabulary splits from letters before them, as one run. An apostrophe may take letters with it, and ">" ends
#: the special strings.
SIGNS = "!\"#$%&()*+,-./:;<=?@[\\]^_`{|}~"
#: Pieces that a block of one length holds on average at most, and the least number of blocks.
BLOCK_ROWS, LEAST_BLOCKS = 1_000_000, 64


class WordIds(dict):
    """The ids of a word as little-endian 32-bit numbers. This vocabulary drops white space, so words that a space or
    a line break separates are independent of each other."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[n for word, n in known.items() if word.endswith("</w>")]] = True

    def __missing__(self, word: str) -> bytes:
        if base := self.base(word):
            ids = self[base] + self[word[len(base):]] if len(base) < len(word) else self[base]
        else:
            ids = self.encoded(word).tobytes()
        self[word] = ids
        return ids

    def encoded(self, text: str) -> np.ndarray:
        """The ids alone: the fast way leaves out where in the text each token stands, which nothing reads."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def base(word: str) -> str | None:
        """The same letters without the signs behind them, which are split off anyway, or in lower case, as the
        vocabulary is."""
        letters = word.rstrip(SIGNS)
        if letters and len(letters) < len(word) and (last := letters[-1]).isalpha() and (last.isascii() or last.islower()):
            return letters
        if word.isascii() and word.isalpha() and not word.islower():
            return word.lower()
        return None

    def learn(self, words: set[str]) -> None:
        """Encode new words that consist of letters in one go; each ends with the only token that ends a word."""
        fresh = set()
        for word in words:
            while base := self.base(word):
                word = base
            if word.isalpha() and word not in self:
                fresh.add(word)
        for some in chunks(fresh, 2000):
            ids = self.encoded(" ".join(some))
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(some):  # else some letter is not one in lower case: these are encoded one by one
                data, ends = ids.tobytes(), (4 * cuts).tolist()
                self.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends))))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        split = [x.replace("\n", " ").split(" ") for x in texts]
        self.learn(set(filterfalse(self.__contains__, set().union(*split))))
        return [b"".join(map(self.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def windows(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
            capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: key, start, length, doc_tokens and ids (little-endian unsigned 32-bit)."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def work(part: pa.RecordBatch) -> dict:
        source = word_ids(vocabulary)
        out: dict[str, list] = {"key": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
        for k, ids in zip(part.column("key").to_pylist(), source.ids(part.column("text").to_pylist()), strict=True):
            ids += end
            for start in range(0, len(ids), 4 * capacity):
                piece = ids[start:start + 4 * capacity]
                for name, value in zip(out, (k, start // 4, len(piece) // 4, len(ids) // 4, piece), strict=True):
                    out[name].append(value)
        return out

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_slices(rows, work, f"key {kind}, start bigint, length bigint, doc_tokens bigint, ids binary",
                      rows=128).withColumnRenamed("key", key)


class CapacityTree:
    """A segment tree over remaining capacities that finds the least one in use that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def put(self, remaining: int, used: bool) -> None:
        n = remaining + self.size
        self.used[n] = used
        while n > 1:
            n //= 2
            self.used[n] = self.used[2 * n] or self.used[2 * n + 1]

    def tightest(self, length: int) -> int | None:
        n = length + self.size
        if self.used[n]:
            return length
        while n > 1:  # up to the first ancestor with something to the right, then down to its leftmost leaf
            if n % 2 == 0 and self.used[n + 1]:
                n += 1
                while n < self.size:
                    n = 2 * n if self.used[2 * n] else 2 * n + 1
                return n - self.size
            n //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Moves (length, first rank, first window, offset) by length and rank; each holds up to the next one's rank."""
    tree = CapacityTree(capacity)
    open_windows: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: first window, number
    moves: list[tuple[int, int, int, int]] = []
    opened = 0

    def give(remaining: int, first: int, number: int) -> None:
        if remaining:
            open_windows.setdefault(remaining, []).append((first, number))
            tree.put(remaining, True)

    def fill(length: int, rank: int, remaining: int, first: int, number: int, each: int) -> int:
        """Put `each` pieces into every one of these windows; the next rank."""
        for n in range(each):
            moves.append((length, rank, first, capacity - remaining + n * length))
            rank += number
        give(remaining - each * length, first, number)
        return rank

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                each = min(remaining // length, left)
                number = left // each
                intervals = [(opened, number)]
                opened += number
            else:
                each = min(remaining // length, left)
                number = left // each
                held, intervals = open_windows[remaining], []
                while held and number:
                    first, there = held.pop()
                    taken = min(there, number)
                    intervals.append((first, taken))
                    number -= taken
                    if there > taken:
                        held.append((first + taken, there - taken))
                if not held:
                    del open_windows[remaining]
                    tree.put(remaining, False)
            for first, number in intervals:
                rank = fill(length, rank, remaining, first, number, each)
                left -= each * number
    return sorted(moves)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces with sequence_id and offset; length must be 1 to capacity. pieces is read twice, so it should be stored."""
    counts = pieces.groupBy("length").count().collect()  # a row per length, so at most capacity rows
    histogram = {int(row["length"]): row["count"] for row in counts}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("pieces must be 1 to capacity long")
    moves = np.array(best_fit_decreasing(histogram, capacity), np.int64).reshape(-1, 4)
    lengths = sorted(histogram)
    first_move = np.searchsorted(moves[:, 0], lengths)
    blocks = LEAST_BLOCKS + sum(histogram.values()) // BLOCK_ROWS
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_block").count().select(
        "length", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_block").orderBy(*order)
    ranked = dealt.withColumn("_within", F.row_number().over(within)).join(offsets, ["length", "_block"]).withColumn(
        "_rank", F.col("_before") + F.col("_within") - 1).select(*pieces.columns, "_rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"

    def work(part: pa.RecordBatch) -> dict:
        length, rank = (part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            at, k = length == n, bisect_left(lengths, n)
            own = moves[first_move[k]:first_move[k + 1] if k + 1 < len(lengths) else len(moves)]
            move = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
            sequence[at], offset[at] = move[:, 2] + rank[at] - move[:, 1], move[:, 3]
        kept = {n: part.column(n) for n in part.schema.names if n != "_rank"}
        return kept | {"sequence_id": sequence, "offset": offset}

    return map_slices(ranked, work, schema, rows=10_000)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes, with the checksum of its ids."""
    pieces = windows(docs, vocabulary, capacity=capacity).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(cut_lineage(pieces), capacity)
