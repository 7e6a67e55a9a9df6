"""Near duplicates, repeated passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from shelfline.llm import ctph, graph, simhash, suffix
from shelfline.llm.lyndon import suffix_array


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda n: text[n:])


def removed(rows):
    """(key, bytes) -> what the contract says, by a table of all strings."""
    first: dict[bytes, int] = {}
    known = [(suffix.LAST if k is None else k, k, x.encode()) for k, x in rows]
    for rank, _, data in sorted(known, key=lambda x: x[0]):
        for n in range(len(data) - 49):
            first.setdefault(data[n:n + 50], rank)
    for rank, key, data in known:
        gone = bytearray(len(data))
        for n in range(len(data) - 49):
            if first[data[n:n + 50]] < rank:
                gone[n:n + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        yield key, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("part_bytes", [3000, 1 << 23])
def test_repeats(tricky, pairs, part_bytes):
    found = suffix.without_repeats(tricky, part_bytes=part_bytes).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == Counter(removed(pairs))
    assert sum(r.n_removed for r in found) > 3000


def test_repeats_in_edited_copies(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdef ") for _ in range(600))
    rows = []
    for n in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(600)] = rng.choice("xyz")
        start = rng.randrange(200)
        rows.append((n, "".join(own[start:start + rng.randint(40, 400)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffix.without_repeats(docs, part_bytes=2000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) \
        == Counter(removed(rows))


def test_no_repeats(nothing, spark):
    assert suffix.removal_digest(nothing).count() == 0
    cut = spark.createDataFrame([(bytearray("é".encode()[1:] + b"ab" + "中".encode()[:2]),)], "kept binary")
    assert cut.select(suffix.as_text().alias("x")).first().x == "ab"
    own = "\ufffda\x01\x02\x01\x03\ufffd"
    cut = spark.createDataFrame([(bytearray("é".encode()[1:] + own.encode() + "中".encode()[:2]),)], "kept binary")
    assert cut.select(suffix.as_text().alias("x")).first().x == own


@pytest.mark.parametrize("bucket_bytes", [1000, 40_000])
def test_buckets_do_not_depend_on_parts(tricky, pairs, bucket_bytes):
    found = suffix.without_repeats(tricky, part_bytes=5000, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) \
        == Counter(removed(pairs))


def plain_fingerprint(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[n:n + 4]) for n in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(marks: list[int], distance: int = 4) -> list[int]:
    """The number of each node's component."""
    label = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if bin(marks[a] ^ marks[b]).count("1") <= distance and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def test_simhash_rows(tricky, nothing, pairs):
    marks = [plain_fingerprint(x) for _, x in pairs]
    label = classes(marks)
    least = {n: min((k for (k, _), own in zip(pairs, label) if own == n and k is not None), default=None) for n in set(label)}
    expected = Counter((k, format(m, "016x"), least[n]) for (k, _), m, n in zip(pairs, marks, label))
    assert Counter(map(tuple, simhash.near_duplicates(tricky).collect())) == expected
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.representatives(tricky)
    assert kept.columns == tricky.columns
    assert kept.count() == len(set(label))


@pytest.mark.parametrize("long_run", [8, 4096])
def test_close_pairs_connect_all(spark, monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    rng = random.Random(long_run)
    marks = [rng.getrandbits(64) for _ in range(40)]
    for m in list(marks):
        for _ in range(6):
            m ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            marks.append(m)
    hub = rng.getrandbits(64)
    marks = list(dict.fromkeys(marks + [hub ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(a)]))
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    found = graph.components(simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "bits bigint")))
    root = {r.node: r.root for r in found.collect()}
    groups: dict = {}
    for x, n in zip(signed, classes(marks)):
        groups.setdefault(n, set()).add(root.get(x, x))
    assert all(len(x) == 1 for x in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(n, 0) for n in range(61)} | {(100, 100), (101, 100)}
    assert graph.components(edges.limit(0)).count() == 0


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for n, x in enumerate(a, 1):
        new = [n]
        for k, y in enumerate(b, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(4)
    some = [tuple("".join(rng.choice("ABCD") for _ in range(rng.choice([0, 1, 5, 63, 64]))) for _ in range(2)) for _ in range(300)]
    assert ctph.edit_distances(some).tolist() == [plain_distance(a, b) for a, b in some]


def test_fingerprints_with_next(spark, nothing, pairs):
    rows = [(k, x) for k, x in pairs if k not in (None, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r for r in ctph.with_next(docs).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (k, x), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        changed, r = x[:len(x) - len(x) // 2] + following[:len(x) // 2], found[k]
        marks = [ctph.fingerprint(y) for y in (x, changed, following)]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == marks[:2]
        assert (r.near_edited, r.near_next) == tuple(ctph.likeness([(marks[0], marks[1]), (marks[0], marks[2])]))
    assert ctph.with_next(nothing).count() == 0
    one = ctph.with_next(docs.filter("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_fingerprint_rows(tricky, pairs):
    assert ctph.with_next(tricky).count() == len(pairs)
    plain = Counter(map(tuple, ctph.fingerprints(tricky).collect()))
    assert plain == Counter((k, ctph.fingerprint(x)) for k, x in pairs)


def test_likeness_follows_content():
    from llm_samples import prose

    for n in range(10):
        x, y = prose(100 + n, 400), prose(200 + n, 400)
        half = ctph.likeness([(ctph.fingerprint(x), ctph.fingerprint(x[:len(x) // 2] + y[:len(x) // 2]))])[0]
        other = ctph.likeness([(ctph.fingerprint(x), ctph.fingerprint(y))])[0]
        assert half > 0.3 > other
