"""Exact removal of repeated passages with suffix arrays.

A byte goes if a `WINDOW`-byte string that covers it also starts in a document with a smaller key. Every such string
has an anchor: the place in it whose `GRAM` bytes hash lowest, the leftmost of equals. Anchors depend on content alone,
so equal strings have equal anchors at equal places. The strings of one anchor lie one after another; the bytes
that they cover are its fragment.

1. Documents are dealt into parts of some megabytes. Each part sends every anchor hash it has once to the bucket of that
   hash, so a passage in a third of all documents arrives once from each part. Buckets answer each part with
   those of its anchors that occur in two documents or more.
2. Only the fragments of these anchors go on, distinct within a part, with their smallest document key.
   Fragments that agree in all parts need no sorting. Where different texts meet at one anchor, the suffix array of
   all of them is built (see `lyndon`), and the strings that stand next to each other in it and are equal share
   their smallest key.
3. The keys go back to the parts, where each document marks the strings that a smaller key has and drops their bytes.

The documents are shuffled once, for all three steps. Hashes of anchors only choose candidates; fragments within a part are told apart
by a 64-bit hash of their bytes, and strings are compared byte by byte.

A null text counts as empty. Rows with one and the same key do not shorten each other; a null key counts as larger than
any other, so such rows shorten no document. Texts shorter than the window stay as they are.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import whole_text
from shelfline.llm.lyndon import suffix_array

#: Bytes of a repeated string.
WINDOW = 50
#: Bytes whose hash chooses anchors.
GRAM = 20
#: Bytes of text in a part, on average, and string starts looked at together within it.
PART_BYTES, BLOCK = 8 << 20, 1 << 19
#: Bytes of text whose anchors meet in a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Bits of an anchor's name that tell its bucket; the others tell it apart from the bucket's other anchors.
BUCKET_BITS, NAME_BITS = 24, 40
#: Bytes before an anchor, or the rest of the window behind it, in which texts must agree to meet.
LEFT = 15
#: A null key.
LAST = np.iinfo(np.int64).max
LOW = np.uint64((1 << NAME_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, from hashes of 1, 2, 4, ... bytes."""
    hashed, length = byte_values()[data], 1
    powers = {1: hashed}
    while length * 2 <= GRAM:
        hashed = hashed[:-length] * np.uint64(2 * length * 0x9E3779B1 + 1) + hashed[length:]
        length *= 2
        powers[length] = hashed
    rest = GRAM - length
    while rest:
        step = 1 << (rest.bit_length() - 1)
        more = powers[step][length:]
        hashed = hashed[:len(more)] * np.uint64(2 * step * 0x85EBCA77 + 1) + more
        length, rest = length + step, rest - step
    return mixed(hashed)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15 | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Fragments:
    """The fragments of all documents of a part, or those whose anchors are wanted; places are in data."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, buckets: int, wanted: np.ndarray | None = None) -> None:
        found = [self.block(data, ends, start, buckets, wanted)
                 for start in range(0, max(0, len(data) - WINDOW + 1), BLOCK)]
        join = lambda n, kind: np.concatenate([x[n] for x in found]) if found else np.empty(0, kind)
        self.data = data
        #: The anchor's name, its place, the first and the last string's start, and a hash of the fragment.
        self.name, self.text = join(0, np.uint64), join(4, np.uint64)
        self.anchor, self.first, self.last = (join(n, np.int64) for n in (1, 2, 3))
        self.doc = np.searchsorted(ends, self.first, "right")

    @staticmethod
    def block(data: np.ndarray, ends: np.ndarray, start: int, buckets: int, wanted: np.ndarray | None) -> tuple:
        own = data[start:start + BLOCK + WINDOW - 1]
        hashes = gram_hashes(own)
        places = np.arange(len(hashes), dtype=np.uint64)
        ranked = (hashes & ~np.uint64(0xFFFF_FFFF)) | places
        anchor = (least_of(ranked, WINDOW - GRAM + 1) & np.uint64(0xFFFF_FFFF)).astype(np.int64)
        starts = np.arange(start, start + len(anchor))
        inside = ends[np.minimum(np.searchsorted(ends, starts, "right"), len(ends) - 1)] - starts >= WINDOW
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~inside[:-1])) & inside
        first = np.flatnonzero(fresh)
        close = np.concatenate(((anchor[1:] != anchor[:-1]) | ~inside[1:], [True])) & inside
        last = np.flatnonzero(close)
        anchor = anchor[first]
        spread = mixed(hashes[anchor])  # anchors are those that hash low
        bucket = ((spread >> np.uint64(NAME_BITS)) * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)
        name = (bucket << np.uint64(NAME_BITS)) | (spread & LOW)
        if wanted is not None:
            if not len(wanted):
                at = np.empty(0, np.int64)
            else:
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name)
            first, last, anchor, name = first[at], last[at], anchor[at], name[at]
        up, down = powers(BLOCK + WINDOW)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_values()[own] * up[:len(own)], dtype=np.uint64)))
        text = (sums[last + WINDOW] - sums[first]) * down[first]
        text = mixed(text + mixed(name + ((last - first) * 4096 + (anchor - first)).astype(np.uint64)))
        return name, anchor + start, first + start, last + start, text

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some fragments one after another, and their numbers."""
        sizes = self.last[at] - self.first[at] + WINDOW
        places = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return self.data[places], sizes


def compress(content: bytes) -> bytes:
    """Fragments one after another compress better together than by the shuffle's own fast codec."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=3).compress(content)


def decompress(content: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(content)


def part_data(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a part's documents, where each ends, and their keys."""
    texts = [x.as_buffer() for x in table.column("data").combine_chunks()] if table.num_rows else []
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    key = table.column("key").fill_null(LAST).to_numpy()
    return np.frombuffer(b"".join(texts), np.uint8), ends, key


def groups_of(x: np.ndarray) -> np.ndarray:
    """Where each run of equals begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def to_buckets(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of sorted names, and where each begins and ends."""
    bucket = (names >> np.uint64(NAME_BITS)).astype(np.int64)
    starts = groups_of(bucket)
    return bucket[starts], starts, np.append(starts, len(names))[1:]


def to_bytes(names: np.ndarray) -> bytes:
    """Names of one bucket without the bits that tell it."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BITS // 8].tobytes()


def from_bytes(packed: bytes, bucket: int) -> np.ndarray:
    size = NAME_BITS // 8
    wide = np.zeros((len(packed) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(packed, np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel() | np.uint64(bucket << NAME_BITS)


def shared_strings(texts: list[bytes], anchors: list[int], keys: list[int]) -> list[list[int]]:
    """For each text the smallest key that each of its strings has in any of the texts.

    All texts are alike from their anchors on for at least the hashed bytes, and no string starts behind an anchor. So what
    they have in common from there on is one symbol of the text that is sorted.
    """
    found = [[key] * (len(x) - WINDOW + 1) for x, key in zip(texts, keys, strict=True)]
    common = len(commonprefix([x[a:] for x, a in zip(texts, anchors, strict=True)]))
    symbols: list[int] = []
    owner: list[tuple[int, int]] = []
    count = len(texts)
    for n, (x, anchor) in enumerate(zip(texts, anchors, strict=True)):
        symbols += [b + count for b in x[:anchor]]
        symbols.append(count + 256)
        symbols += [b + count for b in x[anchor + common:]]
        symbols.append(count - 1 - n)  # a different end for each text, the last one's is the smallest symbol
        owner += [(n, p) for p in range(anchor + 1)]
        owner += [(n, WINDOW)] * (len(x) - anchor - common + 1)
    run: list[tuple[int, int]] = []
    least, string = 0, b""
    for place in suffix_array(symbols):
        n, p = owner[place]
        if p >= len(found[n]):
            continue  # no whole string starts here
        own = texts[n][p:p + WINDOW]
        if run and own == string:
            run.append((n, p))
            least = min(least, keys[n])
            continue
        if len(run) > 1:
            for a, b in run:
                found[a][b] = least
        run, least, string = [(n, p)], keys[n], own
    if len(run) > 1:
        for a, b in run:
            found[a][b] = least
    return found


def least_keys(texts: list[bytes], anchors: list[int], keys: list[int]) -> list[list[int]]:
    """What shared_strings gives, for texts that agree in little else than the anchor.

    A string starts at least LEFT bytes before its anchor or reaches at least WINDOW - LEFT + 1 bytes from its anchor on. So only
    texts meet that agree in the LEFT bytes before the anchor, with their strings of the first kind, or in the
    WINDOW - LEFT bytes from the anchor on, with the others. Pieces that are equal meet as one.
    """
    found = [[key] * (len(x) - WINDOW + 1) for x, key in zip(texts, keys, strict=True)]
    meet: dict[tuple[bool, bytes], dict[tuple[bytes, int], list[tuple[int, int]]]] = {}
    for n, (x, a) in enumerate(zip(texts, anchors, strict=True)):
        if a >= LEFT:
            piece = x[:a - LEFT + WINDOW], a - LEFT
            meet.setdefault((True, x[a - LEFT:a]), {}).setdefault(piece, []).append((n, 0))
        if len(x) - WINDOW > a - LEFT:
            begin = max(0, a - LEFT + 1)
            piece = x[begin:], a - begin
            meet.setdefault((False, x[a:a + WINDOW - LEFT]), {}).setdefault(piece, []).append((n, begin))
    for pieces in meet.values():
        least = [min(keys[n] for n, _ in held) for held in pieces.values()]
        if len(pieces) == 1:
            (text, _), = pieces
            results = [least * (len(text) - WINDOW + 1)]
        else:
            results = shared_strings([x for x, _ in pieces], [a for _, a in pieces], least)
        for held, result in zip(pieces.values(), results):
            for n, begin in held:
                found[n][begin:begin + len(result)] = result
    return found


def send_anchors(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        data, ends, _ = part_data(table)
        own = Fragments(data, ends, buckets)
        order = np.argsort(own.name, kind="stable")
        names, docs = own.name[order], own.doc[order]
        starts = groups_of(names)
        stops = np.append(starts, len(names))[1:]
        several = docs[starts] != docs[stops - 1]
        names = names[starts]
        bucket, begin, end = to_buckets(names)
        part = table.column("part")[0].as_py()
        return pa.table({
            "bucket": pa.array(bucket, pa.int32()), "part": pa.array([part] * len(bucket), pa.int32()),
            "names": pa.array([to_bytes(names[b:e]) for b, e in zip(begin, end)], pa.binary()),
            "several": pa.array([np.packbits(several[b:e]).tobytes() for b, e in zip(begin, end)], pa.binary())})
    return work


def answer_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    names = [from_bytes(x["names"], x["bucket"]) for x in rows]
    several = [np.unpackbits(np.frombuffer(x["several"], np.uint8), count=len(n)) for x, n in zip(rows, names)]
    every = np.sort(np.concatenate(names + [n[s == 1] for n, s in zip(names, several)]))
    starts = groups_of(every)
    twice = every[starts[np.append(starts, len(every))[1:] - starts > 1]]
    kept = [np.intersect1d(n, twice, assume_unique=True) for n in names]
    return pa.table({"part": pa.array([x["part"] for x in rows], pa.int32()),
                     "bucket": pa.array([x["bucket"] for x in rows], pa.int32()),
                     "names": pa.array([to_bytes(n) for n in kept], pa.binary())})


def wanted_names(table: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.uint64)] + [
        from_bytes(x["names"], x["bucket"]) for x in table.to_pylist()]))


SENT = "bucket int, part int, names binary, texts binary, keys binary, sizes binary, anchors binary, content binary"
FOUND = "part int, bucket int, texts binary, runs binary, lengths binary, least binary"


def send_fragments(buckets: int):
    def work(docs: pa.Table, replies: pa.Table) -> pa.Table:
        empty = {n: [] for n in ("bucket", "part", "names", "texts", "keys", "sizes", "anchors", "content")}
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        if docs.num_rows:
            data, ends, key = part_data(docs)
            own = Fragments(data, ends, buckets, wanted_names(replies))
            keys = key[own.doc]
            order = np.lexsort((keys, own.text, own.name))
            order = order[groups_of(own.text[order])] if len(order) else order
            bucket, begin, end = to_buckets(own.name[order])
            part = docs.column("part")[0].as_py()
            for n, b, e in zip(bucket.tolist(), begin, end):
                at = order[b:e]
                content, sizes = own.bytes_of(at)
                for name, value in zip(empty, (n, part, own.name[at].tobytes(), own.text[at].tobytes(), keys[at].tobytes(),
                                               sizes.astype("<u2").tobytes(),
                                               (own.anchor[at] - own.first[at]).astype(np.uint8).tobytes(),
                                               compress(content.tobytes()))):
                    empty[name].append(value)
        return pa.table({n: pa.array(x, kind) for (n, x), kind in zip(empty.items(), kinds)})
    return work


def sort_fragments(table: pa.Table) -> pa.Table:
    """For each part the strings of its fragments in runs of one smallest key."""
    rows = table.to_pylist()
    read = lambda n, kind: [np.frombuffer(x[n], kind) for x in rows]
    names, texts, keys, sizes = read("names", "<u8"), read("texts", "<u8"), read("keys", "<i8"), read("sizes", "<u2")
    content = b"".join(decompress(x["content"]) for x in rows)
    name, text, key = np.concatenate(names), np.concatenate(texts), np.concatenate(keys)
    size = np.concatenate(sizes).astype(np.int64)
    anchor = np.concatenate(read("anchors", np.uint8))
    begin = np.cumsum(size) - size
    order = np.lexsort((key, text, name))
    first = order[groups_of(text[order])]  # each different fragment with its smallest key
    starts = groups_of(name[first])
    stops = np.append(starts, len(first))[1:]
    # Runs of all fragments one after another; most fragments are alone with their anchor and have one run.
    runs, shared_lengths, shared_least = np.ones(len(first), np.int64), array("H"), array("q")
    shared = np.zeros(len(first), bool)
    several = stops - starts > 1
    for a, b in zip(starts[several].tolist(), stops[several].tolist()):
        some = first[a:b]
        strings = [content[begin[n]:begin[n] + size[n]] for n in some.tolist()]
        shared[a:b] = True
        for n, least in enumerate(least_keys(strings, anchor[some].tolist(), key[some].tolist()), a):
            same = [len(list(own)) for _, own in groupby(least)]
            runs[n] = len(same)
            shared_lengths.extend(same)
            shared_least.extend(k for k, _ in groupby(least))
    lengths = np.repeat(size[first] - WINDOW + 1, runs).astype("<u2")
    leasts = np.repeat(key[first], runs).astype("<i8")
    of_shared = np.repeat(shared, runs)
    lengths[of_shared], leasts[of_shared] = shared_lengths, shared_least
    run_start = np.cumsum(runs) - runs
    by_text = np.argsort(text[first])
    known = text[first][by_text]
    out: dict[str, list] = {n: [] for n in ("part", "bucket", "texts", "runs", "lengths", "least")}
    for row, own in zip(rows, texts):
        own = np.sort(own)
        at = by_text[np.searchsorted(known, own)]
        count = runs[at]
        place = np.repeat(run_start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        for n, value in zip(out, (row["part"], row["bucket"], own.tobytes(), count.astype("<u2").tobytes(),
                                  lengths[place].tobytes(), leasts[place].tobytes())):
            out[n].append(value)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({n: pa.array(x, kind) for (n, x), kind in zip(out.items(), kinds)})


def drop_repeats(buckets: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        data, ends, key = part_data(docs)
        rows = answers.to_pylist()
        read = lambda n, kind: np.concatenate([np.empty(0, kind)] + [np.frombuffer(x[n], kind) for x in rows])
        text, runs, length, least = read("texts", "<u8"), read("runs", "<u2").astype(np.int64), read("lengths", "<u2").astype(np.int64), read("least", "<i8")
        covered = np.zeros(len(data) + 1, np.int32)
        if len(text):
            order = np.argsort(text)
            text, run_start, runs = text[order], (np.cumsum(runs) - runs)[order], runs[order]
            own = Fragments(data, ends, buckets)
            at = np.minimum(np.searchsorted(text, own.text), len(text) - 1)
            hit = np.flatnonzero(text[at] == own.text)
            at, first, mine = at[hit], own.first[hit], key[own.doc[hit]]
            before = np.cumsum(length) - length  # strings before each run, over all fragments
            count = runs[at]
            place = np.repeat(run_start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            offset = before[place] - np.repeat(before[run_start[at]], count)
            taken = least[place] < np.repeat(mine, count)
            start = (np.repeat(first, count) + offset)[taken]
            np.add.at(covered, start, 1)
            np.subtract.at(covered, start + length[place][taken] + WINDOW - 1, 1)
        gone = np.cumsum(covered, out=covered)[:-1] > 0
        starts = ends - np.diff(ends, prepend=0)
        kept, removed, spans = [], [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            own = gone[a:b]
            kept.append(data[a:b][~own].tobytes())
            removed.append(int(own.sum()))
            spans.append(int(np.count_nonzero(np.diff(own.view(np.int8), prepend=np.int8(0)) == 1)))
        return pa.table({"row": docs.column("row"), "n_bytes": pa.array(ends - starts, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept": pa.array(kept, pa.binary())})
    return work


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = (),
                    part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Columns key, those carried, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (the rest).

    key must be an integer column; its largest value (2**63 - 1) counts as null.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, buckets = 1 + size // part_bytes, 1 + size // bucket_bytes
    if buckets > 1 << BUCKET_BITS:
        raise ValueError("more buckets than their bits tell apart; use larger ones")
    dealt = docs.select(F.struct(key, *carried).alias("row"), F.col(key).cast("bigint").alias("key"),
                        whole_text(text).cast("binary").alias("data")).withColumn(
        "part", F.pmod(F.xxhash64("key", "data"), F.lit(parts)).cast("int"))
    by_part = dealt.groupBy("part")
    anchors = by_part.applyInArrow(send_anchors(buckets), "bucket int, part int, names binary, several binary")
    replies = anchors.groupBy("bucket").applyInArrow(answer_anchors, "part int, bucket int, names binary")
    fragments = by_part.cogroup(replies.groupBy("part")).applyInArrow(send_fragments(buckets), SENT)
    found = fragments.groupBy("bucket").applyInArrow(sort_fragments, FOUND)
    row = dealt.schema["row"].dataType.simpleString()
    result = by_part.cogroup(found.groupBy("part")).applyInArrow(
        drop_repeats(buckets), f"row {row}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return result.select("row.*", "n_bytes", "n_removed", "n_spans", "kept")


def as_text(kept: str = "kept") -> Column:
    """The remaining bytes as text. A removed passage may begin or end within a character; its other bytes go too, while
    replacement characters that the text has itself stay: they are written otherwise as long as broken ones are dropped."""
    raw, own, mark = F.col(kept).cast("string"), "\ufffd", "\x01"
    held = F.replace(F.replace(raw, F.lit(mark), F.lit(mark + "\x02")), F.lit(own), F.lit(mark + "\x03"))
    whole = F.translate(F.make_valid_utf8(held), own, "")
    back = F.replace(F.replace(whole, F.lit(mark + "\x03"), F.lit(own)), F.lit(mark + "\x02"), F.lit(mark))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(back)


def removal_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                        F.sha2("kept", 256).alias("kept_sha256"))
