"""Phrases whose words stand together more often than their parts would by chance, by vertical partitioning.

The words of each language become numbers part by part; a part is a bounded run of documents of one language with a dictionary of
its own. A phrase is no more frequent than its words, so a word below the least count ends a run as the end of a piece does. Every
place in a run starts a suffix, truncated at the greatest depth (the words of the longest phrase).

Suffixes are divided by word prefixes: the prefixes of one word are grouped until a group's suffixes fill the memory budget.
A word with more suffixes than that is extended to prefixes of two words, one of these that is still too frequent to three, and
so on; the suffixes below such a prefix are dealt over groups of its own by their next word. Each group builds its subtree alone:
its suffixes sorted, a node for each different prefix, with the sum of the leaf totals below it as the frequency of its phrase.
Parts add up equal suffixes before they are shuffled, so copies of a text cost one leaf for each part.

The score of a phrase at a cut is floor(1000 * a * n / (l * r)), a its frequency, l and r those of the parts and n the words of the
language, in exact decimals (up to 38 digits). Its lowest cut counts. Phrases within a longer one that is as frequent are left out.

A null text is empty, a null language is `und`; repeated rows count each for itself. Of equal scores the more frequent phrase comes
first, then the phrase that is less in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import stored, whole_text

#: Words of the longest phrase, the least frequency, and how many phrases of a language are reported.
DEPTH, LEAST, TOP = 5, 100, 2000
#: A phrase is left out if a longer one around it has this share of its frequency, in percent.
ABSORBED_PERCENT = 100
#: Words in a part; suffixes of a group of prefixes (a group may exceed it by one prefix that is not larger).
PART_WORDS, GROUP_SUFFIXES = 1 << 19, 1 << 19
#: Frequent words that are broadcast at most; more of them meet the parts in a join.
BROADCAST_WORDS = 1 << 18
#: What ends a piece; letters of which only A to Z are made small.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = -1
TO_BREAKS = bytes.maketrans(PIECE_ENDS, b"." * len(PIECE_ENDS))


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text, with b"." after each piece."""
    return (text.encode().lower().translate(TO_BREAKS).replace(b".", b" . ") + b" .").split()


class Numbers(dict):
    """Numbers of words in the order of their first occurrence."""

    def __init__(self) -> None:
        super().__init__({b".": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class Part:
    """Documents of one language as numbers."""

    def __init__(self) -> None:
        self.numbers, self.tokens, self.size = Numbers(), [], 0

    def add(self, text: str) -> None:
        words = words_and_breaks(text)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, lang: str) -> dict:
        tokens = np.concatenate(self.tokens)
        words = [w.decode() for w in list(self.numbers)[1:]]
        counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
        return {"lang": lang, "n": int(counts.sum()), "words": words, "counts": counts, "tokens": packed(tokens)}


def packed(numbers: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    from zstandard import ZstdDecompressor

    return np.frombuffer(ZstdDecompressor().decompress(data), kind)


def rows_to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


PARTS = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())),
                   ("counts", pa.list_(pa.int64())), ("tokens", pa.binary())])


def parts(docs: DataFrame, text: str, lang: str, part_words: int) -> DataFrame:
    """Columns part, lang, n (its words), words and counts (its dictionary), and tokens (numbers, packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                for name, x in zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True):
                    part = held.setdefault(name, Part())
                    part.add(x)
                    if part.size >= part_words:
                        yield rows_to_batch([held.pop(name).row(name)], PARTS)
                    elif sum(p.size for p in held.values()) >= 4 * part_words:
                        for other in list(held):
                            yield rows_to_batch([held.pop(other).row(other)], PARTS)
        for name in list(held):
            yield rows_to_batch([held.pop(name).row(name)], PARTS)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    schema = "lang string, n bigint, words array<string>, counts array<bigint>, tokens binary"
    return rows.mapInArrow(run, schema).withColumn("part", F.monotonically_increasing_id())


def frequent_words(held: DataFrame, least: int) -> DataFrame:
    """Columns id (from 0 without gaps), lang, word, f and place (the id's partition), for words of at least this frequency."""
    each = held.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("count"))))
    counted = each.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    found = stored(counted.withColumn("at", F.monotonically_increasing_id()), "words")
    place = F.shiftright("at", 33)
    sizes = sorted(found.groupBy(place.alias("place")).count().collect())  # a row for each partition
    first, offsets = 0, []
    for row in sizes:
        offsets.append((row.place, first))
        first += row["count"]
    starts = held.sparkSession.createDataFrame(offsets, "place bigint, first bigint")
    return found.withColumn("place", place).join(F.broadcast(starts), "place").select(
        (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "lang", "word", "f", "place")


def grouped_prefixes(words: DataFrame, budget: int) -> DataFrame:
    """words with group: prefixes of one word grouped by budget, null for those that need longer prefixes."""
    light = F.when(F.col("f") <= budget, F.col("f")).otherwise(0)
    before = F.sum(light).over(Window.partitionBy("place").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(before, F.lit(0)) / budget).cast("long")
    return words.withColumn("group", F.when(F.col("f") <= budget, F.shiftleft("place", 32) + number))


CODED = pa.schema([("lang", pa.string()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("groups", pa.list_(pa.int64()))])


def coded(held: DataFrame, words: DataFrame, kind: str, broadcast_words: int) -> DataFrame:
    """The parts with ids in place of their own numbers, rare words as breaks, and the groups of the ids they have."""
    each = held.select("part", "lang", F.posexplode("words").alias("pos", "word"))
    few = words.count() <= broadcast_words
    found = each.join(F.broadcast(words) if few else words, ["lang", "word"]).select("part", "pos", "id", "group")
    looked_up = found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "group"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                size = batch.column("size")[n].as_py()
                found = batch.column("found").slice(n, 1).flatten()
                ids = found.field("id").to_numpy()
                by_number = np.full(size + 1, BREAK, np.int64)  # the last is for breaks
                by_number[found.field("pos").to_numpy()] = ids
                tokens = by_number[unpacked(batch.column("tokens")[n].as_py(), "<i4")].astype(kind)
                order = np.argsort(ids)
                groups = found.field("group").fill_null(-1).to_numpy()
                yield rows_to_batch([{"lang": batch.column("lang")[n].as_py(), "tokens": packed(tokens),
                                      "ids": ids[order], "groups": groups[order]}], CODED)

    rows = held.select("part", "lang", "tokens", F.size("words").alias("size")).join(looked_up, "part")
    return rows.mapInArrow(run, "lang string, tokens binary, ids array<bigint>, groups array<bigint>")


@dataclass
class Heavy:
    """Prefixes with more suffixes than the budget, by their length; each has groups of its own, with negative numbers."""
    words: int
    codes: list[np.ndarray] = field(default_factory=list)  # rank of the prefix without its last word, times words, plus that
    firsts: list[np.ndarray] = field(default_factory=list)  # the first group of each
    sizes: list[np.ndarray] = field(default_factory=list)  # how many groups each has
    next_group: int = 1

    def add(self, found: list[tuple[int, int]], budget: int) -> None:
        """The prefixes of the next length as (code, frequency)."""
        found = sorted(found)
        sizes = np.array([-(-2 * f // budget) for _, f in found], np.int64)
        self.codes.append(np.array([c for c, _ in found], np.int64))
        self.firsts.append(self.next_group + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.next_group += int(sizes.sum())

    def ranks(self, suffixes: np.ndarray, depth: int) -> np.ndarray:
        """The rank of each suffix's prefix of this length among the heavy ones, else -1."""
        rank = np.zeros(len(suffixes), np.int64)
        for n in range(depth):
            known, code = self.codes[n], np.where(rank >= 0, rank * self.words + suffixes[:, n], -1)
            at = np.searchsorted(known, code)
            same = (rank >= 0) & (suffixes[:, n] >= 0) & (known[np.minimum(at, len(known) - 1)] == code) if len(known) else False
            rank = np.where(same, at, -1)
        return rank

    def route(self, suffixes: np.ndarray) -> np.ndarray:
        """The group of suffixes whose first word is heavy."""
        group = np.zeros(len(suffixes), np.int64)
        for n in range(len(self.codes)):  # the longest heavy prefix decides
            rank = self.ranks(suffixes, n + 1)
            held = rank >= 0
            spread = np.maximum(suffixes[held, n + 1], 0) % self.sizes[n][rank[held]]
            group[held] = -(self.firsts[n][rank[held]] + spread)
        return group

    def split_depth(self, group: int) -> int:
        """The length of the prefix that this group shares with others; 0 for a group of whole prefixes."""
        return sum(1 for x in self.firsts if len(x) and x[0] <= -group) if group < 0 else 0


def suffixes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of two words and more, a row each; beyond the end of a run stands BREAK."""
    runs = np.concatenate((tokens, np.full(depth, BREAK, tokens.dtype)))
    starts = np.flatnonzero((runs[:-1] >= 0) & (runs[1:] >= 0))
    rows = runs[starts[:, None] + np.arange(depth)]
    for n in range(2, depth):
        rows[rows[:, n - 1] < 0, n] = BREAK
    return rows


def leaves(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, with the sum of their times."""
    if not len(rows):
        return rows, times
    order = np.lexsort(rows.T[::-1])
    rows, times = rows[order], times[order]
    first = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(times, np.flatnonzero(first))


def heavy_prefixes(texts: DataFrame, words: DataFrame, number: int, kind: str, budget: int, depth: int) -> Heavy:
    """All prefixes shorter than depth with more suffixes than the budget; there are at most as many as the budget goes into
    the words of the corpus, for each length."""
    heavy = Heavy(number)
    heavy.add([(r.id, r.f) for r in words.filter(F.col("f") > budget).select("id", "f").collect()], budget)
    singles = heavy.codes[0]
    while len(heavy.codes[-1]) and len(heavy.codes) < depth - 1:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            length = len(heavy.codes)
            for batch in batches:
                for data in batch.column("tokens"):
                    rows = suffixes(unpacked(data.as_py(), kind), depth)
                    rows = rows[np.isin(rows[:, 0], singles) & np.isin(rows[:, length], singles)]
                    rank = heavy.ranks(rows, length)
                    codes, n = np.unique(rank[rank >= 0] * heavy.words + rows[rank >= 0, length], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

        found = texts.select("tokens").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("f"))
        heavy.add([(r.code, r.f) for r in found.filter(F.col("f") > budget).collect()], budget)
    return heavy


DEALT = pa.schema([("lang", pa.string()), ("group", pa.int64()), ("suffixes", pa.binary()), ("times", pa.binary())])


def dealt(texts: DataFrame, heavy: Heavy, kind: str, depth: int) -> DataFrame:
    """Columns lang, group, suffixes and times (packed): a row for each group that a part has suffixes of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                rows = suffixes(unpacked(batch.column("tokens")[n].as_py(), kind), depth)
                rows, times = leaves(rows, np.ones(len(rows), np.int64))
                ids, groups = (batch.column(c)[n].values.to_numpy() for c in ("ids", "groups"))
                group = groups[np.searchsorted(ids, rows[:, 0])] if len(rows) else np.empty(0, np.int64)
                more = group < 0
                group[more] = heavy.route(rows[more])
                order = np.argsort(group, kind="stable")
                lang, out = batch.column("lang")[n].as_py(), []
                for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                    out.append({"lang": lang, "group": int(group[some[0]]), "suffixes": packed(rows[some].T),
                                "times": packed(times[some])})
                    if len(out) == 256:
                        yield rows_to_batch(out, DEALT)
                        out = []
                yield rows_to_batch(out, DEALT)

    return texts.mapInArrow(run, "lang string, group bigint, suffixes binary, times binary")


NODES = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("a", pa.int64())])


def subtree(rows: np.ndarray, times: np.ndarray, least: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of each depth from 2 on as (their words, their frequencies): those of at least this frequency, and all of a
    prefix that has suffixes in other groups too."""
    rows, times = leaves(rows, times)
    changed = np.zeros(len(rows), bool)
    changed[:1] = True
    for depth in range(1, rows.shape[1] + 1):
        changed[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
        starts = np.flatnonzero(changed)
        if depth > 1 and len(starts):
            totals = np.add.reduceat(times, starts)
            chosen = (rows[starts, depth - 1] >= 0) & ((totals >= least) | (depth <= split))
            yield rows[starts[chosen], :depth], totals[chosen]


def phrases(texts: DataFrame, heavy: Heavy, kind: str, least: int, depth: int) -> DataFrame:
    """Columns lang, ids and a of all phrases of two words and more with at least this frequency."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, times = [], []
        for batch in batches:
            for data, n in zip(batch.column("suffixes"), batch.column("times"), strict=True):
                rows.append(unpacked(data.as_py(), kind).reshape(depth, -1).T)
                times.append(unpacked(n.as_py(), "<i8"))
        lang, group = key[0].as_py(), key[1].as_py()
        for words, totals in subtree(np.concatenate(rows), np.concatenate(times), least, heavy.split_depth(group)):
            ids = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()),
                                           pa.array(words.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), ids, pa.array(totals)], schema=NODES)

    nodes = dealt(texts, heavy, kind, depth).groupBy("lang", "group").applyInArrow(run, "lang string, ids array<bigint>, a bigint")
    return nodes.groupBy("lang", "ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def exact_score() -> Column:
    """floor(1000 * a * n / (l * r))."""
    wide = lambda name: F.col(name).cast("decimal(17,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)")
    return F.call_function("div", product, (wide("l") * wide("r")).cast("decimal(38,0)"))


def scored(found: DataFrame, words: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """The phrases that no longer one absorbs, with n and the score, l and r of their lowest cut."""
    size = F.size("ids")
    inner = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    longer = found.filter(size > 2).select("lang", F.explode(inner).alias("ids"), "a").groupBy("lang", "ids").agg(
        F.max("a").alias("longer"))
    alone = found.join(longer, ["lang", "ids"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    every = found.select("ids", F.col("a").alias("f")).union(words.select(F.array("id"), "f"))
    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    parted = cuts.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(
        every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right").join(totals, "lang")
    lowest = parted.withColumn("score", exact_score()).groupBy("lang", "ids", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, depth: int = DEPTH,
                 percent: int = ABSORBED_PERCENT, part_words: int = PART_WORDS, group_suffixes: int = GROUP_SUFFIXES,
                 broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n and score: the best phrases of each language."""
    held = stored(parts(docs, text, lang, part_words), "parts")
    words = stored(grouped_prefixes(frequent_words(held, least), group_suffixes), "vocabulary")
    number = words.count()
    kind = "<i4" if number < 1 << 31 else "<i8"
    texts = stored(coded(held, words, kind, broadcast_words), "coded")
    heavy = heavy_prefixes(texts, words, number, kind, group_suffixes, depth)
    found = stored(phrases(texts, heavy, kind, least, depth), "phrases")
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored(found, words, totals, percent).withColumn("rank", F.rank().over(by_score)).filter(F.col("rank") <= top)
    named = best.select("*", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "word"), "id")
    spelt = named.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(
        F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words")).withColumn(
        "phrase", F.array_join("words.word", " "))
    ranked = spelt.withColumn("rank", F.row_number().over(by_score.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
