"""Context-triggered piecewise hashing: fingerprints of texts whose likeness is an edit distance.

A rolling hash of the last bytes ends a chunk wherever its remainder by the block size is the largest one, so chunks are
found again wherever their content moves. Each chunk is one character of the signature. The block size is the least that
keeps the signature within its length, halved while the signature is too short. A fingerprint holds the signatures at
that block size and at twice of it. Fingerprints whose block sizes are equal or differ by a factor of two are compared by
the edit distance of their signatures at a common size, computed bit-parallel for many pairs at once; others are
unlike.

A null text counts as empty; the fingerprint of an empty text has empty signatures. Equal fingerprints have likeness 1. Of rows with one
doc_id the order is by a hash of the text; null identifiers come last. A single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import cut_lineage, slices, whole_text

#: The least block size, the bytes in the rolling hash, and the length of a signature.
LEAST_BLOCK, ROLLING, LONGEST = 3, 7, 64
#: Fixed value: the characters of a signature.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALPHABET = np.frombuffer(ALPHABET.encode(), np.uint8)
_PLACE = np.zeros(256, np.int64)
_PLACE[_ALPHABET] = np.arange(64)
ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
                x = np.full(2 * size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:size], self.down[:size]


_powers = Powers()


def fingerprint(text: str) -> str:
    """Block size, signature, and signature at twice the block size, with colons between."""
    data = text.encode("utf-8")
    size = len(data)
    if not size:
        return f"{LEAST_BLOCK}::"
    values = _VALUES[np.frombuffer(data, np.uint8)]
    rolling = values.copy()
    for back in range(1, min(ROLLING, size)):
        rolling[back:] += values[:-back] * np.uint64(2 * back * 0x85EBCA77 + 1)
    rolling = (mixed(rolling) >> np.uint64(32)).astype(np.uint32)
    up, down = _powers.of(size + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:size])))

    def signature(ends: np.ndarray) -> str:
        ends = ends[:LONGEST - 1] + 1
        ends = ends if len(ends) and ends[-1] == size else np.append(ends, size)
        starts = np.concatenate(([0], ends[:-1]))
        chunks = mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(58)
        return _ALPHABET[chunks].tobytes().decode()

    block = LEAST_BLOCK
    while block * LONGEST < size:
        block *= 2
    while True:
        ends = np.flatnonzero(rolling % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= LONGEST // 2:
            break
        block //= 2
    wider = ends[rolling[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(ends)}:{signature(wider)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of signatures, all pairs a column at a time: a row of the table is the bits of one number."""
    count = len(pairs)
    sizes = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    own = np.zeros((count, 64), np.uint64)  # where each character stands in the first signature
    first, second = (np.frombuffer("".join(p[n] for p in pairs).encode(), np.uint8) for n in (0, 1))
    row = np.repeat(np.arange(count), sizes[:, 0])
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:, 0])
    np.bitwise_or.at(own, (row, _PLACE[first]), np.uint64(1) << place.astype(np.uint64))
    starts = np.cumsum(sizes[:, 1]) - sizes[:, 1]
    one = np.uint64(1)
    last = np.maximum(sizes[:, 0] - 1, 0).astype(np.uint64)
    plus, minus = np.full(count, ~np.uint64(0)), np.zeros(count, np.uint64)
    distance = sizes[:, 0].copy()
    order = np.argsort(-sizes[:, 1], kind="stable")
    for step in range(int(sizes[:, 1].max(initial=0))):
        at = order[:np.searchsorted(-sizes[order, 1], -step, "left")]  # pairs with a character here
        same = own[at, _PLACE[second[starts[at] + step]]]
        p, m = plus[at], minus[at]
        vertical = same | m
        horizontal = (((same & p) + p) ^ p) | same
        more, less = m | ~(horizontal | p), p & horizontal
        distance[at] += ((more >> last[at]) & one).astype(np.int64) - ((less >> last[at]) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        plus[at], minus[at] = less | ~(vertical | more), more & vertical
    return np.where(sizes[:, 0] == 0, sizes[:, 1], distance)


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """From 0 to 1, for pairs of fingerprints."""
    result = [0.0] * len(pairs)
    compared: list[tuple[str, str]] = []
    owner: list[int] = []
    for n, (a, b) in enumerate(pairs):
        if a == b:
            result[n] = 1.0
            continue
        (size_a, *both_a), (size_b, *both_b) = a.split(":"), b.split(":")
        by_size_a = {int(size_a): both_a[0], 2 * int(size_a): both_a[1]}
        by_size_b = {int(size_b): both_b[0], 2 * int(size_b): both_b[1]}
        for size in by_size_a.keys() & by_size_b.keys():
            compared.append((by_size_a[size], by_size_b[size]))
            owner.append(n)
    for n, (a, b), distance in zip(owner, compared, edit_distances(compared).tolist()):
        result[n] = max(result[n], 1 - distance / max(1, len(a), len(b)))
    return result


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following document's start, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(rows: list[tuple[str, str, str, str]]) -> dict[str, list]:
    """Results for rows of a text, its fingerprint, the next text and that one's fingerprint."""
    changed = [edited(text, following) for text, _, following, _ in rows]
    marks = [own if x == text else fingerprint(x) for x, (text, own, _, _) in zip(changed, rows)]
    near = likeness([(own, mark) for (_, own, _, _), mark in zip(rows, marks)]
                    + [(own, other) for _, own, _, other in rows])
    return {"n_chars": [len(x[0]) for x in rows],
            "edited_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in changed],
            "fingerprint": [x[1] for x in rows], "edited_fingerprint": marks,
            "near_edited": near[:len(rows)], "near_next": near[len(rows):]}


RESULT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key and fingerprint, one row per row of docs."""
    from shelfline.llm.common import map_slices

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_slices(rows, lambda part: {
        "key": part.column("key"), "fingerprint": [fingerprint(x) for x in part.column("text").to_pylist()]},
        f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next document's are.

    Documents are dealt by ranges of descending key and go through each range in order. The last of a range has its next
    document in another: only the first and the last of each range leave their tasks with their texts and are joined.
    """
    kind = dict(docs.dtypes)[key]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = (F.col("key").desc_nulls_last(), F.col("tie"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"role string, part int, key {kind}, text string, {RESULT}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target, pair_target = (to_arrow_schema(_parse_datatype_string(x)) for x in (schema, f"key {kind}, {RESULT}"))
    fields = [x.split()[0] for x in RESULT.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None

        def edge(role: str, row: tuple) -> pa.RecordBatch:
            held = {"role": role, "part": part, "key": row[0], "text": row[1], "fingerprint": row[2]}
            return pa.RecordBatch.from_pylist([{n: held.get(n) for n in target.names}], schema=target)

        for some in slices(batches):
            texts = some.column("text").to_pylist()
            seen = list(zip(some.column("key").to_pylist(), texts, map(fingerprint, texts)))
            if not seen:
                continue
            if before is None:
                yield edge("first", seen[0])
            seen = seen if before is None else [before, *seen]
            before = seen[-1]
            found = compare([(a[1], a[2], b[1], b[2]) for a, b in zip(seen, seen[1:])])
            size = len(seen) - 1
            columns = {"role": [None] * size, "part": [part] * size, "key": [x[0] for x in seen[:-1]],
                       "text": [None] * size} | found
            yield pa.RecordBatch.from_pydict(columns, schema=target)
        if before is not None:
            yield edge("last", before)

    done = cut_lineage(ranged.select("key", "text").mapInArrow(go, schema))
    first, last = (done.filter(F.col("role") == x).select("part", "key", "text", "fingerprint") for x in ("first", "last"))
    all_parts = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    follows = first.select("part").withColumn("next_part", F.coalesce(
        F.lead("part").over(all_parts), F.min("part").over(Window.partitionBy(F.lit(0)))))
    nexts = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                         F.col("fingerprint").alias("next_fingerprint"))
    pairs = last.join(follows, "part").join(nexts, "next_part").select(
        "key", "text", "fingerprint", "next_text", "next_fingerprint")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            values = [some.column(n).to_pylist() for n in ("text", "fingerprint", "next_text", "next_fingerprint")]
            yield pa.RecordBatch.from_pydict({"key": some.column("key").to_pylist()} | compare(list(zip(*values))),
                                             schema=pair_target)

    inner = done.filter(F.col("role").isNull()).select("key", *fields)
    return inner.unionByName(pairs.mapInArrow(meet, f"key {kind}, {RESULT}")).withColumnRenamed("key", key)
