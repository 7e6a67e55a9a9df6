"""SimHash fingerprints, and the groups of texts whose fingerprints lie close together.

A fingerprint's bit is set if it is set in over half the hashes of the text's shingles (repeats included). Equal
fingerprints are one node from then on, however many documents share them. Nodes that differ in at most `distance`
bits are linked: the 64 bits are split into blocks, and since a pair that differs in `distance` bits leaves all but
that many blocks alike, both of its nodes appear under at least one choice of `BLOCKS - distance` blocks. Nodes are sorted by choice
and value of these blocks, pairs within a run of equal values are verified by their Hamming distance, and only links
that connect two yet unconnected nodes of a run leave the task. A long run is split once more by blocks of its remaining
bits, by the same argument. Groups are the connected components of all links.

A null or empty text, or one without words, has fingerprint zero and is linked like any other. Repeated rows share a
group, whose id is its smallest doc_id; null identifiers count for that only where a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import cut_lineage, map_slices, whole_text
from shelfline.llm.graph import components

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
#: Blocks of a fingerprint; with DISTANCE 4, three of them agree in every close pair.
BLOCKS = 7
#: Runs longer than this are split by blocks of the remaining bits.
LONG_RUN = 4096


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of the text, A-Z in lower case; fewer words than a shingle has are one shingle."""
    from xxhash import xxh64_intdigest

    held = text.encode("utf-8").lower().split()  # of bytes: only A-Z, only space and \t to \r
    if not held:
        return []
    joined = b" ".join(held)
    if len(held) <= words:
        return [xxh64_intdigest(joined, SEED)]
    sizes = [len(x) for x in held]
    starts = [0, *accumulate(n + 1 for n in sizes)]
    return [xxh64_intdigest(joined[starts[n]:starts[n + words] - 1], SEED) for n in range(len(held) - words + 1)]


def majority(hashes: list[int]) -> int:
    """The fingerprint of these hashes, as a signed 64-bit number."""
    if not hashes:
        return 0
    held, counts = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for start in range(0, len(held), 65_536):
        part = held[start:start + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(held), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns key and bits (the fingerprint as a signed 64-bit number)."""
    kind = dict(docs.dtypes)[key]

    def work(part: pa.RecordBatch) -> dict:
        return {"key": part.column("key"),
                "bits": [majority(shingle_hashes(x, words)) for x in part.column("text").to_pylist()]}

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_slices(rows, work, f"key {kind}, bits bigint").withColumnRenamed("key", key)


def block_masks(bits: np.uint64 | int, number: int) -> list[int]:
    """The set bits of a mask, dealt in order over so many masks."""
    places = [n for n in range(64) if int(bits) >> n & 1]
    cuts = [len(places) * n // number for n in range(number + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]


class Links:
    """Connections among a sorted array of nodes; each link that joins two parts is kept."""

    def __init__(self, nodes: np.ndarray, distance: int) -> None:
        self.nodes, self.distance = nodes, distance
        self.label = np.arange(len(nodes))
        self.pairs: list[tuple[int, int]] = []

    def find(self, n: int) -> int:
        while self.label[n] != n:
            self.label[n] = self.label[self.label[n]]
            n = self.label[n]
        return n

    def run(self, at: np.ndarray, free: int) -> None:
        """Link the close pairs among the nodes at these places; free: the bits in which they may differ."""
        if len(at) > LONG_RUN and bin(free).count("1") > 2 * self.distance:
            for mask in block_masks(free, self.distance + 1):
                part = self.nodes[at] & np.uint64(mask)
                order = np.argsort(part, kind="stable")
                for same in np.split(at[order], np.flatnonzero(np.diff(part[order])) + 1):
                    if len(same) > 1:
                        self.run(same, free & ~mask)
            return
        for step in range(1, len(at)):
            self.verify(at[:-step], at[step:])

    def verify(self, left: np.ndarray, right: np.ndarray) -> None:
        close = np.bitwise_count(self.nodes[left] ^ self.nodes[right]) <= self.distance
        for a, b in zip(left[close].tolist(), right[close].tolist(), strict=True):
            if (x := self.find(a)) != (y := self.find(b)):
                self.label[max(x, y)] = min(x, y)
                self.pairs.append((a, b))


def linked(choice: np.ndarray, nodes: np.ndarray, masks: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among nodes sorted by choice and by the bits that the choice's mask leaves."""
    held = Links(nodes, distance)
    value = nodes & np.array(masks, np.uint64)[choice]
    same = (choice[1:] == choice[:-1]) & (value[1:] == value[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2] + 1  # the runs of two nodes and more
    short = ends - starts <= 64
    if short.any():  # all short runs together, a distance in the run at a time
        run_end = np.zeros(len(nodes), np.int64)
        for s, e in zip(starts[short].tolist(), ends[short].tolist(), strict=True):
            run_end[s:e] = e
        at = np.flatnonzero(run_end)
        step = 1
        while len(at := at[at + step < run_end[at]]):
            held.verify(at, at + step)
            step += 1
    for s, e in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
        held.run(np.arange(s, e), 0xFFFF_FFFF_FFFF_FFFF & ~masks[choice[s]])
    pairs = np.array(held.pairs, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]].view(np.int64), nodes[pairs[:, 1]].view(np.int64)


def close_pairs(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) among the distinct values of bits that connect what is within distance; not all such pairs."""
    every = block_masks(0xFFFF_FFFF_FFFF_FFFF, blocks)
    masks = [sum(some) for some in combinations(every, blocks - distance)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    choices = nodes.select("bits", F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(m)) for m in signed))))
    dealt = choices.repartition("pos", "col").sortWithinPartitions("pos", "col").select("pos", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, bits = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(c: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            left, right = linked(c, b, masks, distance)
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

        for batch in batches:
            choice = np.concatenate((choice, batch.column("pos").to_numpy().astype(np.int64)))
            bits = np.concatenate((bits, batch.column("bits").to_numpy().view(np.uint64)))
            if not len(bits):
                continue
            value = bits & np.array(masks, np.uint64)[choice]
            other = np.flatnonzero((choice != choice[-1]) | (value != value[-1]))
            end = other[-1] + 1 if len(other) else 0  # the last run may go on in the next batch
            if end:
                yield out(choice[:end], bits[:end])
                choice, bits = choice[end:], bits[end:]
        if len(bits):
            yield out(choice, bits)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """Columns key, bits and component_id, the smallest key of the group; one row per row of docs."""
    marked = cut_lineage(fingerprints(docs, text, key))
    nodes = marked.groupBy("bits").agg(F.min(key).alias("_first"))
    roots = components(close_pairs(nodes, distance))
    rooted = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "_first", F.coalesce("root", "bits").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return marked.join(rooted.join(least, "_root").select("bits", "component_id"), "bits").select(
        key, "bits", "component_id")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs for each group, all columns as they are: the one with the smallest key, of rows with that key the
    one with the smallest hash of its text, of rows that are alike in both any one. Null keys come last."""
    row = F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    grouped = groups(docs.select(row.alias("_row"), F.col(text).alias("text")), key="_row")
    first = grouped.filter(F.col("_row") == F.col("component_id")).select("_row").distinct()
    chosen = docs.withColumn("_row", row).join(first, "_row", "left_semi")
    alike = Window.partitionBy("_row").orderBy(F.lit(0))
    return chosen.withColumn("_n", F.row_number().over(alike)).filter("_n = 1").select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint in hex and the smallest doc_id of its group."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
