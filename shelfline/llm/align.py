"""Alignment of two tokenisations of the same text.

Each text is tokenised as a whole by a byte-level vocabulary (A) and by a vocabulary of pieces (B), which puts a space in front of
every text; A encodes a space and the text. Offsets at which both have a token that begins with a space are anchors: the
tokens before them end together there, which the offsets verify. Anchors split the tokens of a text into windows, and the
alignment of a window depends on nothing but its ids. So windows are told apart by their id tuples, over all texts that a task
looks at together, and each different one is aligned once, all of them in one pass over arrays. (The same holds for tokens: no token
goes on from a word into a single space, so the texts' equal words are tokenised once.) Within a window, offsets where tokens of
both end cut them into groups; the two tokens that end there are linked. As no token is empty, a group has one link.

The number of links that hold an id pair is counted over all texts. Frequent pairs, at most `HOT_PAIRS` of them, are broadcast to
where the links are; the others meet their links in a join on the pair, in which no pair has more rows than the
rarest of the broadcast ones.

A text that is null or empty, or whose tokens' bytes do not give a space and the text again, has no tokens, groups or links.
Repeated rows are aligned and counted each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.bpe import codec, leaves
from shelfline.llm.common import map_slices, stored, whole_text

#: Characters of texts that are aligned together (or one text).
TOGETHER_CHARS = 1 << 21
#: Pairs that are broadcast at most.
HOT_PAIRS = 1 << 20
#: Fixed value: the sign that stands for a space in pieces.
SPACE = "▁"
#: Words that may begin or end with white space.
EDGE = re.compile(rb"^(?:[\x00-\x20]|\xC2[\x85\xA0]|[\xE1-\xE3][\x9A\x80\x81\x96])|(?:[\x00-\x20\x7F]|\xC2[\x85\xA0]|[\xE1-\xE3][\x9A\x80\x81\x96].)$", re.DOTALL)


@dataclass
class Aligned:
    """Texts as the numbers of their words (own, with where each text's end), and for each different word its ids of both
    vocabularies, its groups as written and its links as pair codes; counts tells how many of each a word has."""
    own: np.ndarray
    stops: np.ndarray
    ids: tuple[np.ndarray, np.ndarray]
    written: list[str]
    links: np.ndarray
    counts: tuple[np.ndarray, np.ndarray, np.ndarray]

    def of_texts(self, side: int) -> np.ndarray:
        """How many tokens of A (0) or B (1), or links (2), each text has."""
        total = np.concatenate(([0], np.cumsum(self.counts[side][self.own])))[self.stops]
        return np.diff(total, prepend=0)

    def values(self, side: int) -> np.ndarray:
        """These tokens or links themselves, of all texts one after another."""
        counts = self.counts[side]
        held = self.links if side == 2 else self.ids[side]
        return held[ranges((np.cumsum(counts) - counts)[self.own], counts[self.own])]

    def groups(self) -> list[str]:
        words, start, out = list(map(self.written.__getitem__, self.own.tolist())), 0, []
        for stop in self.stops.tolist():
            out.append(";".join(words[start:stop]))
            start = stop
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.codec = codec(a_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.factor = self.pieces.get_piece_size()
        self.a_bytes = self.codec.table
        self.b_bytes = [self.piece_bytes(n) for n in range(self.factor)]
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes):
            raise ValueError("pieces of this vocabulary continue after a space")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        ids = range(len(self.a_bytes)), range(self.factor)
        #: Ids as they are written within a group and at its end, first those of A, then those of B.
        self.written = [f"{n}{sign}" for own, signs in zip(ids, (",|", ",;")) for sign in signs for n in own]
        self.mix = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 2 * max(len(x) for x in ids), np.int64).view(np.uint64)

    def piece_bytes(self, n: int) -> bytes:
        piece = self.pieces.id_to_piece(n)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(n) else piece.replace(SPACE, " ").encode()

    def align(self, texts: list[str]) -> Aligned:
        """The words of all texts, and the alignment of each different one. Where a word begins, after a single space, both
        vocabularies begin a token, so words are windows or hold several."""
        words, own, stops = split(texts)
        (a, b), (a_sizes, b_sizes), right = self.encoded(words, at_ends(own, stops, len(words)))
        own, stops = whole_texts(own, stops, right)
        a, b = a[np.repeat(right, a_sizes)], b[np.repeat(right, b_sizes)]
        a_sizes, b_sizes = np.where(right, a_sizes, 0), np.where(right, b_sizes, 0)
        # Words one after another end together in both, so that offsets of all of them can be compared.
        a_stops, b_stops = np.cumsum(a_sizes), np.cumsum(b_sizes)
        a_cuts, b_cuts = self.anchors(a, b, a_stops, b_stops)
        a_lengths, b_lengths = (np.diff(np.append(cuts, len(x))) for cuts, x in ((a_cuts, a), (b_cuts, b)))
        first, like = self.different(a, b, a_cuts, b_cuts, a_lengths, b_lengths)
        texts_of, links, link_sizes = self.windows(
            a[ranges(a_cuts[first], a_lengths[first])], b[ranges(b_cuts[first], b_lengths[first])], a_lengths[first], b_lengths[first])
        every = links[ranges((np.cumsum(link_sizes) - link_sizes)[like], link_sizes[like])]
        window_stops = np.searchsorted(a_cuts, a_stops)  # the windows of a word begin within it
        spelt, number = list(map(texts_of.__getitem__, like.tolist())), np.diff(window_stops, prepend=0)
        if (number == 1).all():
            written = spelt
        else:
            written = [spelt[stop - 1] if n == 1 else ";".join(spelt[stop - n:stop])
                       for stop, n in zip(window_stops.tolist(), number.tolist())]
        link_counts = np.diff(np.concatenate(([0], np.cumsum(link_sizes[like])))[window_stops], prepend=0)
        return Aligned(own, stops, (a, b), written, every, (a_sizes, b_sizes, link_counts))

    def encoded(self, new: list[bytes], outer: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """The ids of words that a space stands before, how many each has, and whether they give the word again. Those that
        stand at the ends of texts (outer) may begin or end with white space and are encoded each alone then."""
        b_lists = self.pieces.encode([w.decode() for w in new], num_threads=1) if new else []
        sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
        edges = np.ones(len(new), bool)
        edges[outer] = [EDGE.search(new[n]) is None for n in outer.tolist()]
        inner = list(compress(new, edges.tolist()))
        cut = leaves((b" " + b" ".join(inner)).decode()) if inner else []
        joined = np.array(self.codec.concatenate([self.codec.leaf(x) for x in cut], cut), np.int64)
        others = [self.codec.leaf(" " + new[n].decode()) for n in np.flatnonzero(~edges).tolist()]
        counts = np.empty(len(new), np.int64)
        counts[edges] = np.diff(np.searchsorted(np.cumsum(self.a_lengths[joined]), np.cumsum(sizes[edges]), "right"), prepend=0)
        counts[~edges] = [len(x) for x in others]
        starts = np.cumsum(counts) - counts
        a = np.empty(int(counts.sum()), np.int64)
        a[np.repeat(edges, counts)] = joined
        a[ranges(starts[~edges], counts[~edges])] = np.fromiter(chain.from_iterable(others), np.int64)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64)
        b_counts = np.fromiter(map(len, b_lists), np.int64, len(new))
        data = b"".join([b" " + w for w in new])
        right = np.ones(len(new), bool)
        for ids, held, table, lengths in ((a, counts, self.a_bytes, self.a_lengths), (b, b_counts, self.b_bytes, self.b_lengths)):
            ends = np.concatenate(([0], np.cumsum(lengths[ids])))[np.cumsum(held)]
            if (ends == np.cumsum(sizes)).all() and b"".join(map(table.__getitem__, ids.tolist())) == data:
                continue
            begin = 0
            for n, (w, size) in enumerate(zip(new, held.tolist())):
                right[n] &= b"".join([table[i] for i in ids[begin:begin + size].tolist()]) == b" " + w
                begin += size
        return (a, b), (counts, b_counts), right

    def anchors(self, a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, in both: at shared starts of tokens that begin with a space, and where a text begins."""
        if not len(a):
            return (np.empty(0, np.int64),) * 2
        cuts = []
        marks = [np.zeros(len(x), bool) for x in (a, b)]
        for x, own, marked, stops in zip((a, b), marks, (self.a_marked, self.b_marked), (a_stops, b_stops)):
            own[:] = marked[x]
            begins = np.concatenate(([0], stops[:-1]))
            own[begins[begins < len(x)]] = True
        a_starts, b_starts = (np.cumsum(n) - n for n in (self.a_lengths[a], self.b_lengths[b]))
        there = np.zeros((2, int(max(a_starts[-1], b_starts[-1])) + 1), bool)
        there[0, a_starts[marks[0]]] = there[1, b_starts[marks[1]]] = True
        both = there[0] & there[1]
        for starts, own in ((a_starts, marks[0]), (b_starts, marks[1])):
            cuts.append(np.flatnonzero(own & both[starts]))
        return cuts[0], cuts[1]

    def different(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, a_sizes: np.ndarray,
                  b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each different window by its id tuples, and for every window which of these it is like.

        Windows meet by a hash of their ids and are then compared id by id with the first one of the hash.
        """
        if not len(a_cuts):
            return (np.empty(0, np.int64),) * 2
        name = (a_sizes * 1_000_003 + b_sizes).astype(np.uint64)
        for ids, starts, sizes, shift in ((a, a_cuts, a_sizes, 0), (b, b_cuts, b_sizes, len(self.mix) // 2)):
            place = (np.arange(len(ids)) - np.repeat(starts, sizes)).astype(np.uint64)
            x = self.mix[ids + shift] * (2 * place + np.uint64(1))
            name = name * np.uint64(0x9E3779B97F4A7C15) + np.add.reduceat((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), starts)
        _, first, own = np.unique(name, return_index=True, return_inverse=True)
        like = np.ones(len(a_cuts), bool)
        for ids, starts, sizes in ((a, a_cuts, a_sizes), (b, b_cuts, b_sizes)):
            like &= sizes == sizes[first[own]]
            at = np.flatnonzero(like)
            same = ids[ranges(starts[at], sizes[at])] == ids[ranges(starts[first[own[at]]], sizes[at])]
            like[at] &= np.logical_and.reduceat(same, np.cumsum(sizes[at]) - sizes[at])
        others = np.flatnonzero(~like)  # of the same hash only: each stands for itself
        own[others] = len(first) + np.arange(len(others))
        return np.concatenate((first, others)), own

    def windows(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The groups of windows as written, their links, and how many each has. In a window both tuples have the same bytes, so
        the windows one after another end together too."""
        if not len(a):
            return [], np.empty(0, np.int64), np.empty(0, np.int64)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        there = np.zeros((2, int(a_ends[-1]) + 1), bool)
        there[0, a_ends] = there[1, b_ends] = True
        a_last, b_last = there[1, a_ends], there[0, b_ends]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_counts, b_counts = np.bincount(a_group), np.bincount(b_group)
        place = np.empty(len(a) + len(b), np.int64)  # of a group the tokens of A, then those of B
        place[np.arange(len(a)) + (np.cumsum(b_counts) - b_counts)[a_group]] = a + len(self.a_bytes) * a_last
        place[np.arange(len(b)) + np.cumsum(a_counts)[b_group]] = b + 2 * len(self.a_bytes) + self.factor * b_last
        written = list(map(self.written.__getitem__, place.tolist()))
        stops = np.cumsum(a_sizes + b_sizes).tolist()
        texts = ["".join(written[start:stop])[:-1] for start, stop in zip([0, *stops], stops)]
        groups = np.cumsum(a_last)[np.cumsum(a_sizes) - 1]
        return texts, a[a_last] * self.factor + b[b_last], np.diff(groups, prepend=0)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, the words of each text by their numbers, and where each text's end.

    Words end at single spaces that have no white space, nor the sign of pieces for it, beside them: no token goes on there.
    """
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    begins = ends - np.diff(ends, prepend=0)
    at = np.flatnonzero(data == 32)
    wide = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)))
    before, after = [wide[at + 2 - n] for n in range(3)], [wide[at + 4 + n] for n in range(2)]
    blank = lambda x: (x <= 32) & ((x == 32) | (x >= 9) & (x <= 13) | (x >= 28)) | (x == 127)
    lead = lambda x: (x >= 0xE1) & (x <= 0xE3)
    inside = lambda x: (x == 0x9A) | (x == 0x80) | (x == 0x81) | (x == 0x96)
    pair = lambda x, y: (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    beside = (blank(before[0]) | blank(after[0]) | pair(before[1], before[0]) | pair(after[0], after[1])
              | lead(before[2]) & inside(before[1]) | lead(after[0]) & inside(after[1]))
    edge = np.zeros(len(data) + 2, bool)
    edge[begins + 1] = edge[ends] = True  # a space at the end of a text
    cuts = at[~beside & ~edge[at + 1]]
    some = begins < ends
    starts = np.sort(np.concatenate((begins[some], cuts + 1)))
    stops = np.sort(np.concatenate((ends[some], cuts)))
    whole = data.tobytes()
    every = [whole[i:j] for i, j in zip(starts.tolist(), stops.tolist())]
    number = dict.fromkeys(every)
    number = dict(zip(number, range(len(number))))
    own = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    return list(number), own, np.searchsorted(starts, ends)


def at_ends(own: np.ndarray, stops: np.ndarray, number: int) -> np.ndarray:
    """The words, of so many, that stand first or last in a text."""
    begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    some = begins < stops
    found = np.zeros(number, bool)
    found[own[begins[some]]] = found[own[stops[some] - 1]] = True
    return np.flatnonzero(found)


def whole_texts(own: np.ndarray, stops: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts all of whose words are right, and where each text's end; the other texts have none."""
    if right.all():
        return own, stops
    wrong = np.concatenate(([0], np.cumsum(~right[own])))[stops]
    kept = np.diff(wrong, prepend=0) == 0
    sizes = np.diff(stops, prepend=0)
    return own[np.repeat(kept, sizes)], np.cumsum(np.where(kept, sizes, 0))


def together(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Texts in their order, so many characters at a time (or one text)."""
    held: list[str] = []
    size = 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, a and b (the ids of both vocabularies) and groups (`a1,a2|b1;a3|b2,b3`), one row per row of docs."""
    kind = dict(docs.dtypes)[key]

    def work(part: pa.RecordBatch) -> dict:
        out: dict = {"key": part.column("key"), "a": [], "b": [], "groups": []}
        for some in together(part.column("text").to_pylist(), TOGETHER_CHARS):
            x = aligner(a_path, b_path).align(some)
            for side, name in enumerate("ab"):
                out[name] += np.split(x.values(side), np.cumsum(x.of_texts(side))[:-1])
            out["groups"] += x.groups()
        return out

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    found = map_slices(rows, work, f"key {kind}, a array<int>, b array<int>, groups string", rows=1024)
    return found.withColumnRenamed("key", key)


def links(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, n_a, n_b, n_groups, n_links, groups_sha256, pairs (the different id pairs, as a times the size of B's
    vocabulary plus b) and times (the links that hold each), one row per row of docs."""
    kind = dict(docs.dtypes)[key]

    def work(part: pa.RecordBatch) -> dict:
        counted: dict = {name: [] for name in ("n_a", "n_b", "n_links", "groups_sha256", "pairs", "times")}
        for some in together(part.column("text").to_pylist(), TOGETHER_CHARS):
            x = aligner(a_path, b_path).align(some)
            number = x.of_texts(2)
            known, code = np.unique(x.values(2), return_inverse=True)
            named = np.sort(np.repeat(np.arange(len(some)), number) * len(known) + code)  # text by text, pair by pair
            fresh = np.flatnonzero(np.diff(named, prepend=-1))
            row, code = np.divmod(named[fresh], max(1, len(known)))
            cuts = np.searchsorted(row, np.arange(1, len(some)))
            counted["pairs"] += np.split(known[code], cuts)
            counted["times"] += np.split(np.diff(np.append(fresh, len(named))), cuts)
            counted["n_a"] += x.of_texts(0).tolist()
            counted["n_b"] += x.of_texts(1).tolist()
            counted["n_links"] += number.tolist()
            counted["groups_sha256"] += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups()]
        return counted | {"key": part.column("key"), "n_groups": counted["n_links"]}

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = (f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "pairs array<bigint>, times array<int>")
    return map_slices(rows, work, schema, rows=1024).withColumnRenamed("key", key)


def pair_counts(linked: DataFrame, b_size: int) -> DataFrame:
    """Columns pair, n (links that hold it) and best (whether no pair with the same id of B has more)."""
    each = linked.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counted = each.groupBy("pair").agg(F.sum("times").alias("n"))
    b = F.col("pair") % b_size
    most = counted.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return counted.withColumn("_b", b).join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def hot_threshold(counted: DataFrame, limit: int) -> int:
    """The least power of two that at most so many pairs reach; 1 if they all may be broadcast."""
    by_power = {r.power: r.pairs for r in counted.groupBy(
        (F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("pairs")).collect()}  # at most 63 rows
    held, least = 0, 62  # no pair has so many links
    for power in sorted(by_power, reverse=True):
        held += by_power[power]
        if held > limit:
            return 1 << least
        least = power
    return 1


def with_pair_counts(linked: DataFrame, b_size: int, key: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """linked, which must be stored, with n_best (links whose pair is the best of its id of B) and count_sum (the sum of
    the counts over all links)."""
    counted = stored(pair_counts(linked, b_size), "pair-counts")
    least = hot_threshold(counted, hot_pairs)
    each = linked.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    met = each.join(F.broadcast(counted.filter(F.col("n") >= least)), "pair", "inner" if least == 1 else "left")
    if least > 1:
        rare = met.filter("n is null").drop("n", "best").join(counted.filter(F.col("n") < least), "pair")
        met = met.filter("n is not null").unionByName(rare)
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.join(sums, "_row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id",
                     hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Columns key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per row of docs."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    numbered = links(docs, a_path, b_path, text, key).withColumn("_row", F.monotonically_increasing_id())
    return with_pair_counts(stored(numbered, "links"), size, key, hot_pairs)
