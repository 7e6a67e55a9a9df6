"""Language, quality, personal data, archives and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from llm_samples import prose

from shelfline.llm import langid, pii, quality, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_phrases(text: bytes, learned: list[bytes]) -> int:
    """Longest matches in any learned text, from the first symbol to the last."""
    n = count = 0
    while n < len(text):
        k = 1
        while n + k < len(text) and any(text[n:n + k + 1] in x for x in learned):
            k += 1
        n, count = n + k, count + 1
    return count


@pytest.mark.parametrize("block", [1, 2, 7, 64, 512])
def test_cross_parsing_is_the_plain_one(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    words = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    learned = {"a": [words("abc ", 300), words("abc ", 50), b"ab" * 200], "b": [words("bcd ", 200), b"x" * 300]}
    parser = langid.Parser({n: langid.suffix_automaton(x) for n, x in learned.items()})
    texts = [words("abcd ", n) for n in (0, 1, 5, 100, 511, 512, 513, 1400)]
    texts += [b"ab" * 700, b"x" * 1500, b"q" * 600, b"ab" * 90 + b"x" * 700 + b"ba" * 300, learned["a"][0] + learned["a"][0][40:]]
    assert parser.phrases(texts).tolist() == [[plain_phrases(x, learned[n]) for n in ("a", "b")] for x in texts]


def test_labels_are_parsed_group_after_group(spark):
    """Sixty labels, each with words of its own; one group, some groups, or a group for each label give the same rows."""
    rows = []
    for n in range(60):
        words = [prose(1000 + n, 1) + str(chr(97 + n % 26)) * 2 for _ in range(12)]
        rng = random.Random(n)
        rows += [(60 * k + n, " ".join(rng.choice(words) + prose(n * 7 + rng.randint(0, 5), 1) for _ in range(60)), f"l{n:02d}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    automata = langid.fit(docs)
    assert len(automata) == 60
    texts = [t for _, t, _ in rows]
    import pyarrow as pa

    found = [langid.Model(automata, entries).judge(pa.array(texts)) for entries in (1 << 30, 1 << 21, 1)]
    assert found[0] == found[1] == found[2]
    assert len(langid.Model(automata, 1).groups) == 60 and 1 < len(langid.Model(automata, 1 << 21).groups) < 60
    held = [r for r in langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held) > 0


def test_windows_come_from_the_whole_text(spark):
    """Texts that begin alike in both languages and differ far behind their start."""
    head = prose(1, 400)
    rows = [(n, head + " " + prose(2 if n % 2 else 3, 300) + " " + prose(10 + n, 300).replace("e", "u" if n % 2 else "o"),
             "a" if n % 2 else "b") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {name: a.length for name, a in langid.fit(docs, windows=16, chars=100).items()}
    assert all(1000 < n <= 16 * 101 for n in learned.values())
    held = [r for r in langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert held and all(r.lang == r.lang_pred for r in held)


def test_held_out_accuracy(documents):
    rows = langid.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_language_rows(tricky, nothing, pairs):
    rows = langid.languages(tricky).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in pairs)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6, 7, None}
    assert langid.languages(nothing).count() == 0
    unlabelled = nothing.sparkSession.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert langid.languages(unlabelled).first().lang_pred == "und"
    kept = langid.identified(tricky, langid.fit(tricky))
    assert kept.columns == tricky.columns
    assert kept.filter("doc_id in (4, 5, 6, 7)").count() == 0


def plain_quality(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[n:n + 3]) for n in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {n + k for n, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(x in quality.SYMBOLS for x in text), lines, len(repeated), failed)


def test_quality_rows(tricky, nothing, pairs, documents):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for rows, expected in ((tricky, pairs), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        found = quality.verdicts(rows)
        assert Counter(map(tuple, found.select(*names).collect())) == Counter((k, *plain_quality(x)) for k, x in expected)
        assert found.filter("base_failed and kept").count() == 0
    assert quality.verdicts(nothing).count() == 0


def test_ablations(documents):
    book = quality.ledger(documents)
    rows = [r.failures for r in book.collect()]
    whole = quality.mask(quality.POLICIES["v1"])
    for r in quality.ablations(book, "v1").collect():
        bit = quality.BITS[r.rule]
        assert r.n_failed == sum(bool(x & bit) for x in rows)
        assert r.n_failed_alone == sum(x & whole == bit for x in rows)
        assert r.n_kept_without == sum(not x & whole & ~bit for x in rows)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind: str, hit: str) -> bool:
    digits = [int(x) for x in hit if x.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        folded = [d if n % 2 == 0 else 2 * d - 9 * (d > 4) for n, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(folded) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    return [(rank, m.start(), m.end()) for rank, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text)
            if holds(kind, m.group())]


def test_base_spans_are_the_plain_ones(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "x@y.z", "_", "-", ".", "..", " ", "  ", "+1", "1", "12", "255", "256", "1.2.3.4", "007", "(", ")", "é",
            "𝄞", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (555) 010-9999", "\n", "000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    trees = {kind: pii.Trees(0.0, (), None) for kind in pii.KINDS}
    for r in pii.find(docs, trees).collect():
        assert [tuple(x) for x in r.base] == plain_spans(texts[r.doc_id]), texts[r.doc_id]
        assert [tuple(x) for x in r.spans] == sorted(set(map(tuple, r.base)))


def test_long_runs_do_not_overflow(spark):
    texts = ["1 " * 30_000, "1." * 30_000, "a" * 60_000, "a.b@" * 15_000, "+1" + "-" * 60_000, "x@" + "a." * 30_000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.findings(docs).collect()}
    assert rows[5].n_email == 1


def test_personal_data_rows(tricky, nothing, pairs):
    found = pii.findings(tricky).collect()
    digest = lambda x: hashlib.sha256(",".join(
        f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(x)).encode()).hexdigest()
    assert Counter((r.doc_id, r.base_sha256) for r in found) == Counter((k, digest(x)) for k, x in pairs)
    assert pii.findings(nothing).count() == 0


def test_trees_select_what_the_base_confirms(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # smaller ones support no threshold
    trees = pii.fit(documents)
    assert any(t.threshold is not None for t in trees.values())
    base, spans = 0, 0
    for r in pii.find(documents, trees).collect():
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
        base, spans = base + len(r.base), spans + len(r.spans)
    assert spans <= 1.1 * base


def test_redaction(spark):
    rows = [("mail a@b.cc or +1 555 010 9999 now", [(0, 5, 11), (3, 15, 30)]), ("é x@y.zz", [(0, 2, 8), (3, 4, 6)]), ("plain", [])]
    docs = spark.createDataFrame(rows, "text string, spans array<struct<rank:int,start:int,end:int>>")
    assert [r.x for r in docs.select(pii.redacted().alias("x")).collect()] == ["mail [EMAIL] or [PHONE] now", "é [EMAIL]", "plain"]


def test_calibration():
    cells = [{"score": s, "yes": y, "n": n} for s, y, n in ((-1, 0, 50), (0, 30, 60), (1, 98, 100), (2, 40, 40))]
    assert pii.calibrated_threshold(cells) == pytest.approx(1, abs=1e-3)
    assert pii.calibrated_threshold(cells[:2]) is None


PAGES = "page_id bigint, url string, html string, type string, digest string, fields string"


def test_archives(spark):
    same, odd = "<p>" + "é" * 80, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" + "x" * 90
    rows = [(1, "http://a.b/c?d", same), (2, None, same), (3, "x\r\ny", odd), (4, "", None), (5, "http://e", ""), (6, "u", "s" * 99),
            (7, "u", "s" * 99), (0, "u", odd), (None, "u", same), (8, "u", "lone"), (0, "u", odd)]
    pages = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], PAGES).repartition(3)
    expected = Counter()
    for k, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, other in rows if other == html and j is not None), default=None) if len(data) >= 100 else None
        again = first is not None and (k is None or k > first)
        expected[k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == expected
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def archives(folder) -> list[bytes]:
    return [p.read_bytes() for p in sorted(folder.rglob("part-*"))]


def members(content: bytes) -> list[tuple[int, bytes]]:
    """Each gzip member that has content, with its place."""
    found, place = [], 0
    while place < len(content):
        one = zlib.decompressobj(wbits=31)
        data = one.decompress(content[place:])
        assert one.eof
        if data:
            found.append((place, data))
        place = len(content) - len(one.unused_data)
    return found


def test_captures_are_nested(spark, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(1, "http://a.b/c", "<p>hi"), (2, "http://a.b/d", same), (3, "http://a.b/e", same)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_archives(warc.archive_records(warc.with_first_pages(pages)), folder)
    found = {r.metadata.fields["page-id"]: r for r in warc.with_originals(warc.assemble(warc.read_records(spark, folder))).collect()}
    row = found["1"]
    assert row.target_uri == "http://a.b/c" and row.response.payload == b"<p>hi" and row.original is None
    assert row.request.headers["host"] == "a.b"
    assert found["2"].response.payload == same.encode()
    assert found["3"].response.payload is None and found["3"].response.refers_to == found["2"].capture_id
    assert found["3"].original.target_uri == "http://a.b/d" and found["3"].original.metadata.fields["page-id"] == "2"
    held = archives(tmp_path / "warc")
    assert b"".join(map(gzip.decompress, held)).count(b"WARC/1.1\r\n") == 9
    for content in held:
        for place, data in members(content):
            alone = list(warc.parse_archive(zlib.decompressobj(wbits=31).decompress(content[place:])))
            assert len(alone) == 1 and data.endswith(b"\r\n\r\n") and f"<{alone[0]['record_id'][1:-1]}>".encode() in data


def test_files_are_bounded_by_bytes(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(n, f"http://a.b/{n}", rng.randbytes(rng.choice([10, 300, 9000])).hex()) for n in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    folder = str(tmp_path / "warc")
    warc.write_archives(warc.archive_records(warc.with_first_pages(pages)), folder, file_bytes=50_000)
    held = archives(tmp_path / "warc")
    assert len(held) > 10 and all(len(x) <= 50_000 or len(members(x)) == 1 for x in held)
    found = warc.assemble(warc.read_records(spark, folder)).select("response.payload").collect()
    assert Counter(r.payload.decode() for r in found) == Counter(h for *_, h in rows)
    one = spark.createDataFrame([(1, "http://a.b", "y" * 3_000_000)], "page_id bigint, url string, html string")
    assert warc.archive_round_trip(one).first().payload_bytes == 3_000_000


def test_archives_of_others_resolve(spark, tmp_path):
    """Records in other files and in any order, without compression; a revisit of a response that is not there."""
    def record(kind, name, block, **headers):
        lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{name}>".encode(),
                 *(f"{k.replace('_', '-')}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
        return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    (tmp_path / "part-1").write_bytes(record("warcinfo", "i", b"x: y\r\n") + record("revisit", "b", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<a>")
                                      + record("revisit", "c", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<gone>"))
    (tmp_path / "part-2").write_bytes(gzip.compress(record("metadata", "m", b"page-id: 7\r\n", WARC_Concurrent_To="<a>"))
                                      + gzip.compress(record("response", "a", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n")))
    found = {r.capture_id: r for r in warc.with_originals(warc.assemble(warc.read_records(spark, str(tmp_path)))).collect()}
    assert found["<a>"].response.payload == b"WARC/1.1\r\n\r\n"
    assert found["<b>"].original.metadata.fields["page-id"] == "7" and found["<c>"].original is None


@pytest.mark.parametrize("broadcast_digests", [0, 500_000])
def test_repeated_payloads_by_either_join(spark, broadcast_digests):
    rows = [(n, "u", f"payload {n % 3} " * 20) for n in range(30)] + [(None, "u", "payload 1 " * 20), (3, "u", "payload 0 " * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = warc.with_first_pages(pages, broadcast_digests=broadcast_digests).collect()
    assert Counter((r.page_id, r.again) for r in found) == Counter(
        (k, k is None or k > int(h.split()[1])) for k, _, h in rows)
    assert sorted(r.page_id for r in found if r.original) == [0, 1, 2]


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_pipeline(spark):
    import corpus_pipeline
    from shelfline.llm.common import table

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = table(spark, FOLDER, "documents")
    assert 0 < len({r.doc_id for r in rows}) < docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes, name
    passed = corpus_pipeline.without_personal_data(spark, docs, FOLDER)
    assert passed.filter("text like '%[EMAIL]%'").count() > 0
    assert corpus_pipeline.without_personal_data(spark, passed, FOLDER).exceptAll(passed).count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_registered():
    import __spark_entry__

    found = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(found) == 14
