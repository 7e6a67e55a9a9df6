"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut into leaves of a fixed number of characters. Leaves are encoded on their own, those of long texts
as rows spread over the cluster, and neighbours are joined pairwise up a tree. At a join only a window around
the seam is encoded again, from a token start in the left half to a token end in the right half. The window
doubles until its first tokens are those of the left half and its last tokens those of the right half. Two
encodings that share a token continue each other exactly: a sequence of BPE tokens is the encoding of its bytes
if and only if every adjacent pair is, and splitting before the merges depends on nothing to the left of a split.

Null and empty texts have no tokens. Repeated rows are encoded each for itself. The special token's string inside
a text is that token, as the vocabulary's own library has it by default.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import map_slices, whole_text

#: Characters of a leaf; texts up to this length are one leaf.
LEAF_CHARS = 32_768
#: Bytes on either side of a seam that are encoded again at first.
WINDOW_BYTES = 64
#: Tokens that both sides of a window must share with the halves.
SHARED_TOKENS = 2
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stand for themselves, the others
    follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Part:
    """The tokens of data[start:end]; ends holds where each token ends."""
    start: int
    end: int
    ids: np.ndarray
    ends: np.ndarray

    def starts(self) -> np.ndarray:
        return np.concatenate(([self.start], self.ends[:-1])).astype(np.int64)


class TreeCodec:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_characters()
        vocabulary = {bytes(to_byte[c] for c in word): n for word, n in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word in self.special:
            vocabulary.pop(word.encode(), None)
        merged = [spec["model"]["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))]
                  for pair in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.table: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for word, n in vocabulary.items():
            self.table[n] = word
        for text, n in self.special.items():
            self.table[n] = text.encode()
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.leaf = tiktoken.Encoding("leaf", pat_str=SPLIT, mergeable_ranks=vocabulary,
                                      special_tokens={}).encode_ordinary

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """The ids of a whole text; each piece between special tokens is a tree of its own."""
        ids: list[int] = []
        for piece, after in self.segments(text):
            cut = leaves(piece, leaf_chars)
            ids += self.concatenate([self.leaf(x) for x in cut], cut)
            if after is not None:
                ids.append(after)
        return ids

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, each piece with the special token that follows."""
        pieces: list[tuple[str, int | None]] = [(text, None)]
        for word, n in self.special.items():
            split: list[tuple[str, int | None]] = []
            for piece, after in pieces:
                *heads, last = piece.split(word)
                split += [(head, n) for head in heads] + [(last, after)]
            pieces = split
        return pieces

    def concatenate(self, encoded: list[list[int]], cut: list[str]) -> list[int]:
        """The ids of the text that was cut into these leaves, from the ids of each leaf."""
        if len(encoded) < 2:
            return encoded[0] if encoded else []
        parts, start = [], 0
        for ids, leaf in zip(encoded, cut, strict=True):
            held, size = np.array(ids, np.int64), len(leaf.encode("utf-8"))
            parts.append(Part(start, start + size, held, start + np.cumsum(self.lengths[held])))
            start += size
        data = "".join(cut).encode("utf-8")
        while len(parts) > 1:  # one level of the tree
            pairs = [self.join(data, *parts[n:n + 2]) for n in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2:]
        return parts[0].ids.tolist()

    def join(self, data: bytes, left: Part, right: Part) -> Part:
        if not len(left.ids) or not len(right.ids):
            full = left if len(left.ids) else right
            return Part(left.start, right.end, full.ids, full.ends)
        seam, window, starts = left.end, WINDOW_BYTES, left.starts()
        while True:
            i = max(0, int(np.searchsorted(starts, seam - window, "right")) - 1)
            while i and data[starts[i]] & 0xC0 == 0x80:  # inside a character
                i -= 1
            last = len(right.ids) - 1
            j = min(last, int(np.searchsorted(right.ends, seam + window, "left")))
            while j < last and data[right.ends[j]] & 0xC0 == 0x80:
                j += 1
            ids = np.array(self.leaf(data[starts[i]:right.ends[j]].decode("utf-8")), np.int64)
            k = SHARED_TOKENS
            left_agrees = i == 0 or (i + k <= len(left.ids) and np.array_equal(ids[:k], left.ids[i:i + k]))
            right_agrees = j == last or (j + 1 >= k and np.array_equal(ids[-k:], right.ids[j + 1 - k:j + 1]))
            if left_agrees and right_agrees:
                ends = starts[i] + np.cumsum(self.lengths[ids])
                return Part(left.start, right.end, np.concatenate((left.ids[:i], ids, right.ids[j + 1:])),
                            np.concatenate((left.ends[:i], ends, right.ends[j + 1:])))
            window *= 2

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


def leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    return [text[n:n + leaf_chars] for n in range(0, len(text), leaf_chars)]


@lru_cache(maxsize=2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
           leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Columns key and ids (array of int, empty for a null or empty text), one row per row of docs.

    Texts of one leaf are encoded where they are read. The leaves of longer ones become rows, are dealt over the
    cluster and encoded there, and meet again by text for the joins; a task holds one text at a time.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    short = rows.filter(F.char_length("text") <= leaf_chars)
    long = rows.filter(F.char_length("text") > leaf_chars)

    def encode_short(part: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        return {"key": part.column("key"), "ids": [c.encode(x, leaf_chars) for x in part.column("text").to_pylist()]}

    def cut(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"row": [], "key": [], "leaf": [], "text": []}
        for row, k, x in zip(*(part.column(n).to_pylist() for n in ("row", "key", "text")), strict=True):
            for n, piece in enumerate(leaves(x, leaf_chars)):
                for name, value in zip(out, (row, k, n, piece), strict=True):
                    out[name].append(value)
        return out

    def encode_leaf(part: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        held = {n: part.column(n) for n in ("row", "key", "leaf", "text")}
        return held | {"ids": [c.leaf(x) for x in part.column("text").to_pylist()]}

    def join(part: pa.RecordBatch) -> dict:
        c, out = codec(vocabulary), []
        for row in part.column("leaves").to_pylist():
            cut = [x["text"] for x in row]
            whole = "".join(cut)
            if any(word in whole for word in c.special):  # it shifts the cuts
                out.append(c.encode(whole, leaf_chars))
            else:
                out.append(c.concatenate([x["ids"] for x in row], cut))
        return {"key": part.column("key"), "ids": out}

    cuts = map_slices(long.withColumn("row", F.monotonically_increasing_id()), cut,
                      f"row bigint, key {kind}, leaf int, text string", rows=8)
    encoded = map_slices(cuts.repartition("row", "leaf"), encode_leaf,
                         f"row bigint, key {kind}, leaf int, text string, ids array<int>", rows=8)
    met = encoded.groupBy("row", "key").agg(
        F.sort_array(F.collect_list(F.struct("leaf", "text", "ids"))).alias("leaves"))
    joined = map_slices(met.select("key", "leaves"), join, f"key {kind}, ids array<int>", rows=1)
    return (map_slices(short, encode_short, f"key {kind}, ids array<int>", rows=64).unionByName(joined)
            .withColumnRenamed("key", key))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Columns key, ids and text: the text that the ids stand for, special tokens included (null ids: empty)."""
    kind = dict(encoded.dtypes)[key]

    def work(part: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        return {"key": part.column("key"), "ids": part.column("ids"),
                "text": [c.decode(x or []) for x in part.column("ids").to_pylist()]}

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return (map_slices(rows, work, f"key {kind}, ids array<int>, text string", rows=64)
            .withColumnRenamed("key", key))


def round_trip_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document the number of its tokens and the digests of its ids and of the decoded text."""
    both = decode(encode(docs, vocabulary), vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

