"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right: each
phrase is the longest match that some place of the labelled text continues, and a symbol that the labelled text lacks is
a phrase of its own. Phrases per symbol, times the logarithm of the labelled text's length, estimate the entropy
of the text under that language; the lowest wins. The score is how far the winner lies below the
next language, as a share: 0 for a tie, 1 where only one language is known.

Whole texts are parsed from their first symbol to their last. Blocks of BLOCK symbols advance together, a step of an automaton at a
time, each as if a phrase began with it; then the parse of each block is carried on into the next until both are in the same
state, from where on they are the same, and the phrases up to there are counted anew. Phrases thus run across blocks, and the size
of a block changes no result. Symbols are the UTF-8 bytes of the text in lower case, with all ASCII characters that are not letters
as one.

The automata are fitted on a bounded sample of labelled rows. Whole texts are cut into windows of WINDOW_CHARS characters; of each
language those with the smallest hash of doc_id and place in each of SAMPLE_WINDOWS bins are learned, wherever in a text they
are. What is learned grows with the number of languages only. Languages are parsed in groups, one after another, whose table holds at
most TABLE_ENTRIES entries (or one language).

Result for a null text, or one without a letter, or where no labelled row exists: `und`, score 0. A null doc_id counts
as an empty string in its checksum. Ties between languages go to the first by name. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import map_slices, slices

#: Windows of labelled text that are learned from for each language at most, and characters of each.
SAMPLE_WINDOWS, WINDOW_CHARS = 32, 1000
#: Symbols of a text that are parsed together, and bytes of texts.
BLOCK, TOGETHER_BYTES = 512, 1 << 20
#: Entries (four bytes each) of a table of automata.
TABLE_ENTRIES = 1 << 26
#: Rows that are judged by one group of languages before the next.
JUDGED_ROWS = 1024
UNKNOWN = "und"


def symbols(text: str) -> bytes:
    """Bytes in lower case; what is neither a letter nor beyond ASCII becomes a space."""
    return text.lower().encode("utf-8").translate(PLAIN)


PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Automaton:
    """A suffix automaton's transitions (from, symbol, to), its states, and the length of its text."""
    source: np.ndarray
    symbol: np.ndarray
    target: np.ndarray
    states: int
    length: int


def suffix_automaton(texts: list[bytes]) -> Automaton:
    """The automaton of all substrings of the texts; a sign that no text has separates them."""
    following: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last, length = 0, 0
    for text in texts:
        for symbol in [*text, 256]:
            length += 1
            state = len(following)
            following.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in following[p]:
                following[p][symbol] = state
                p = link[p]
            if p >= 0:
                q = following[p][symbol]
                if longest[p] + 1 == longest[q]:
                    link[state] = q
                else:
                    copy = len(following)
                    following.append(dict(following[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(symbol) == q:
                        following[p][symbol] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
    moves = np.array([(s, c, t) for s, out in enumerate(following) for c, t in out.items() if c < 256],
                     np.int32).reshape(-1, 3)
    return Automaton(moves[:, 0].copy(), moves[:, 1].copy(), moves[:, 2].copy(), len(following), length)


class Parser:
    """All automata as one table. An entry is where a symbol leads from a state; where the match breaks, it is the
    complement of the state that the symbol starts anew from. Each automaton has one more state, in which nothing is
    matched: texts begin there, and symbols that the automaton lacks lead there."""

    def __init__(self, automata: dict[str, Automaton]) -> None:
        self.names = sorted(automata)
        used = symbols_of(automata)
        self.width = len(used) + 1  # the last column is for symbols that no language has
        self.column = np.full(256, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        sizes = [(automata[n].states + 1) * self.width for n in self.names]
        self.table = np.empty(sum(sizes), np.int32)
        self.starts, base = [], 0
        for name, size in zip(self.names, sizes):
            a = automata[name]
            moves = self.column[a.symbol]
            void = base + a.states * self.width
            root = np.full(self.width, void, np.int32)
            at_root = a.source == 0
            root[moves[at_root]] = base + a.target[at_root] * self.width
            own = self.table[base:base + size].reshape(-1, self.width)  # filled in place: no second copy of the table
            own[:] = ~root
            own[a.source, moves] = base + a.target * self.width
            self.starts.append(void)
            base += size
        self.bits = np.array([np.log2(max(2, automata[n].length)) for n in self.names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (row) under each language (column)."""
        total = np.zeros((len(texts), len(self.names)), np.int64)
        sizes = np.array([len(x) for x in texts], np.int64)
        data = self.column[np.frombuffer(b"".join(texts), np.uint8)]
        count = (sizes + BLOCK - 1) // BLOCK
        owner = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + place * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, count) - place * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        state = np.tile(np.array(self.starts, np.int32)[:, None], (1, len(owner)))
        found = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), "right")
        for step in range(int(size[0]) if len(size) else 0):
            n = active[step]
            to = self.table[state[:, :n] + data[begin[:n] + step]]
            broken = to >> 31
            found[:, :n] -= broken
            state[:, :n] = to ^ broken
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        found, state = found[:, back], state[:, back]
        for language, void in enumerate(self.starts):
            found[language] += self.carried(data, start, length, place, state[language], void)
        np.add.at(total, owner, found.T)
        return total

    def carried(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, own_end: np.ndarray,
                void: int) -> np.ndarray:
        """How many phrases more each block has, if the parse of the one before goes on into it; own_end: the state in
        which each block ends by its own parse."""
        more = np.zeros(len(start), np.int32)
        end = own_end.copy()  # the state in which each block really ends
        used = np.full(len(start), -1, np.int32)  # the state that was carried into each block
        todo = np.flatnonzero(place)
        while len(todo):
            used[todo] = end[todo - 1]
            carry, own = used[todo], np.full(len(todo), void, np.int32)
            change, at, block = np.zeros(len(todo), np.int32), start[todo], np.arange(len(todo))
            left = length[todo]
            end[todo] = own_end[todo]
            step = 0
            while len(block):
                symbol = data[at[block] + step]
                x, y = self.table[carry[block] + symbol], self.table[own[block] + symbol]
                x_broken, y_broken = x >> 31, y >> 31
                change[block] += y_broken - x_broken
                carry[block], own[block] = x ^ x_broken, y ^ y_broken
                step += 1
                ended = left[block] <= step
                end[todo[block[ended]]] = carry[block[ended]]  # not in step until the end: what is carried counts
                block = block[~ended & (carry[block] != own[block])]
            more[todo] = change
            after = np.flatnonzero(place)
            todo = after[end[after - 1] != used[after]]
        return more


def symbols_of(automata: dict[str, Automaton]) -> np.ndarray:
    return np.unique(np.concatenate([a.symbol for a in automata.values()] or [np.empty(0, np.int32)]))


class Model:
    """Automata that become tables at the first text of a task. The tables go when the task ends, as workers live on
    and serve other operators."""

    def __init__(self, automata: dict[str, Automaton], entries: int = TABLE_ENTRIES) -> None:
        self.automata = automata
        self.names = sorted(automata)
        width = len(symbols_of(automata)) + 1
        self.groups: list[list[str]] = []
        held = entries
        for name in self.names:
            size = (automata[name].states + 1) * width
            if held + size > entries:
                self.groups.append([])
                held = 0
            self.groups[-1].append(name)
            held += size

    @cached_property
    def only_parser(self) -> Parser:
        return Parser(self.automata)

    def judge(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language and the score of each text."""
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        entropy = np.zeros((len(texts), len(self.names)))
        known = np.zeros(len(texts), bool)
        first = 0
        for group in self.groups:
            parser = self.only_parser if len(self.groups) == 1 else Parser({n: self.automata[n] for n in group})
            for numbers, some in together(texts):
                entropy[numbers, first:first + len(group)] = parser.phrases(some) * parser.bits
                known[numbers] = True
            first += len(group)
        for n in np.flatnonzero(known):
            best = int(np.argmin(entropy[n]))
            rest = np.delete(entropy[n], best)
            languages[n] = self.names[best]
            scores[n] = float(1 - entropy[n, best] / rest.min()) if len(rest) else 1.0
        return languages, scores


def together(texts: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """The numbers and symbols of texts that have a letter, so many bytes at a time (or one text)."""
    numbers: list[int] = []
    held: list[bytes] = []
    size = 0
    for n in range(len(texts)):
        text = texts[n].as_py()
        if text and any(map(str.isalpha, text)):
            numbers.append(n)
            held.append(symbols(text))
            size += len(held[-1])
            if size >= TOGETHER_BYTES:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def checksum(key: str) -> Column:
    """The remainder that deals rows into thirds; rows with remainder 1 are held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        windows: int = SAMPLE_WINDOWS, chars: int = WINDOW_CHARS) -> dict[str, Automaton]:
    """An automaton for each label of the rows that are not held out; windows x chars characters of each at most."""
    known = docs.filter((checksum(key) != 1) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(key).alias("_key"))
    number = F.ceil(F.char_length("text") / chars).cast("int")
    each = known.select("label", "_key", number.alias("number")).filter("number > 0").select(
        "label", "_key", F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("place"))
    hashed = each.withColumn("_hash", F.xxhash64("_key", "place"))
    least = hashed.groupBy("label", F.pmod("_hash", F.lit(windows)).alias("bin")).agg(F.min(F.struct("_hash", "_key", "place")).alias("least"))
    chosen = [(r["label"], *r["least"]) for r in least.collect()]  # at most windows rows for each label
    if not chosen:
        return {}
    wanted = docs.sparkSession.createDataFrame(chosen, "label string, _hash bigint, _key bigint, place int")
    found = known.join(F.broadcast(wanted), ["label", "_key"]).select(
        "label", "_hash", F.expr(f"substring(text, place * {chars} + 1, {chars})").alias("text"))
    by_label: dict[str, dict[int, str]] = {}
    for x in found.groupBy("label", "_hash").agg(F.min("text").alias("text")).collect():
        by_label.setdefault(x["label"], {})[x["_hash"]] = x["text"]
    return {name: suffix_automaton([symbols(own[h]) for h in sorted(own)]) for name, own in by_label.items()}


def identify(docs: DataFrame, automata: dict[str, Automaton], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, lang_pred and score, one row per row of docs."""
    kind = dict(docs.dtypes)[key]
    model = Model(automata)

    def work(part: pa.RecordBatch) -> dict:
        languages, scores = model.judge(part.column("text"))
        return {"key": part.column("key"), "lang_pred": languages, "score": scores}

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_slices(rows, work, f"key {kind}, lang_pred string, score double", rows=JUDGED_ROWS).withColumnRenamed("key", key)


def identified(docs: DataFrame, automata: dict[str, Automaton], text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is one of those learned; the others are rejected."""
    model = Model(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, JUDGED_ROWS):
            found, _ = model.judge(part.column(text))
            yield part.filter(pa.array([x != UNKNOWN for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs)).select("doc_id", (checksum("doc_id") == 1).alias("held_out"), "lang_pred", "score")
