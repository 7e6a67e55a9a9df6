"""Personal data that the base patterns miss."""

from __future__ import annotations

import random
import re

from llm_samples import prose

from shelfline.llm import pii


def test_what_the_base_misses_is_added_in_a_telling_context(spark):
    rng, rows, wanted, plain = random.Random(4), [], {}, {}
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for n in range(400):
        before, after = prose(1000 + n, 12), prose(2000 + n, 12)
        form = n % 8
        hit = {0: f"phone +1 {digits(3)} {digits(3)} {digits(4)}", 1: f"please call ({digits(3)}) {digits(3)}-{digits(4)}",
               2: f"mail to user{n}@host{n}.com", 3: f"contact: user{n} (at) host{n} (dot) com",
               4: f"parts {digits(3)} {digits(3)} {digits(4)}", 5: f"stock {digits(3)}-{digits(3)}-{digits(4)}",
               6: f"{digits(3)} {digits(3)} {digits(4)}", 7: f"thus +1 {digits(3)} {digits(3)} {digits(4)}"}[form]
        text = f"{before} {hit} {after}"
        rows.append((n, text))
        if form in (1, 3):
            span = hit.removeprefix("please call ").removeprefix("contact: ")
            start = text.index(span)
            wanted[n] = (0 if form == 3 else 3, start, start + len(span))
        elif form in (4, 5, 6):
            plain[n] = text
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert all(tuple(x) not in map(tuple, found[n].base) for n, x in wanted.items())
    assert {n for n, x in wanted.items() if x not in set(map(tuple, found[n].spans))} == set()
    assert {n for n in plain if found[n].spans} == set()


def test_without_a_telling_context_nothing_is_added(spark):
    """Numbers among which telling words are no more frequent than anywhere."""
    rng, rows = random.Random(5), []
    for n in range(300):
        word = "call" if n % 10 == 0 else "thus"
        number = f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(2000, 9999)}"
        rows.append((n, " ".join(f"{rng.choice(['call', *['thus'] * 9])} {prose(n * 9 + k, 5)}" for k in range(4)) + f" {word} {number}"
                     + (f" phone +1 {number}" if n % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(len(r.spans) == len(r.base) for r in pii.find(docs, pii.fit(docs)).collect())


def planted(number: int, seed: int) -> tuple[list[tuple], dict, dict]:
    """Rows, the spans that are personal data beyond the base, and those of like context that are not: they stand behind the
    same telling words in forms that confirmed data never has."""
    rng, rows, wanted, unlike = random.Random(seed), [], {}, {}
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    for n in range(number):
        word = rng.choice(["phone", "please call", "tel", "fax"])
        mail = rng.choice(["mail to", "contact:", "write"])
        form = n % 8
        hit, kind = {
            0: (f"{word} +1 {digits(3)} {digits(3)} {digits(4)}", None), 1: (f"{mail} user{n}@host{n}.com", None),
            2: (f"{word} +1 {digits(3)}-{digits(3)}-{digits(4)}", None),
            3: (f"{digits(3)} {digits(3)}-{digits(4)}", 3), 4: (f"user{n} (at) host{n} (dot) com", 0),
            5: (f"{digits(2)}/{digits(4)}{digits(6)}", -1), 6: (f"{digits(3)} {digits(3)} {digits(4)}", 0 - 2), 7: ("nothing", None)}[form]
        before, after = prose(7000 + seed * 1000 + n, 10), prose(9000 + seed * 1000 + n, 10)
        lead = {3: word, 4: mail, 5: word}.get(form, "")
        text = f"{before} {lead} {hit} {after}"
        rows.append((n, text))
        start = text.index(hit)
        if kind in (0, 3):
            wanted[n] = (kind, start, start + len(hit))
        elif kind in (-1, -2):
            unlike[n] = (3, start, start + len(hit))
    return rows, wanted, unlike


def test_precision_and_recall_of_added_spans(spark):
    """Equal telling words, different formats: only forms that confirmed data has are added, and only in such a context."""
    for seed in (1, 2):
        rows, wanted, unlike = planted(640, seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        trees = pii.fit(docs)
        assert any(split.first[0] in pii.FORMAT or split.low[0] in pii.FORMAT or split.high[0] in pii.FORMAT
                   for split in trees["phone"].splits)
        added = {(r.doc_id, tuple(x)) for r in pii.find(docs, trees).collect() for x in r.spans if x not in r.base}
        right = {(n, x) for n, x in wanted.items()}
        assert len(added & right) >= 0.95 * len(right)
        assert len(added & right) >= 0.95 * len(added)
        assert not added & {(n, x) for n, x in unlike.items()}


def test_all_documents_count_however_many_there_are(spark):
    """What confirms the added numbers stands in documents that a half chosen by hash would leave out."""
    rng, text = random.Random(6), []
    for n in range(400):
        number = f"{rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(2000, 9999)}"
        lead = "phone +1 (" if n % 2 else "please call ("
        text.append((n, f"{prose(n, 10)} {lead}{number} {prose(n + 900, 10)}"))
    told = spark.createDataFrame(text, "n bigint, text string")
    left_out = spark.range(2000).filter("pmod(xxhash64(id), 2) = 1").limit(400).rdd.map(lambda r: r.id).zipWithIndex().toDF(["doc_id", "n"])
    plain = spark.range(5000, 46_000).selectExpr("id as doc_id", "'stone over water' as text")
    docs = told.join(left_out, "n").select("doc_id", "text").unionByName(plain)
    found = pii.find(docs, pii.fit(docs)).filter("doc_id < 5000").selectExpr(
        "count(*)", "sum(size(base))", "sum(size(spans))").first()
    assert tuple(found) == (400, 200, 400)


def test_every_word_counts_as_background(spark):
    """The counts of words by context, against a plain search of every word."""
    rng, texts = random.Random(7), ["", "no", "mail", "é call ßet\nfax x", "a@b c", "visa " * 30]
    choices = ["call", "email:", "card", "host", "stone", "wärme", "12", "x@y.de", "(at)", "-", "\n", "ip", "CALL,"]
    for n in range(60):
        texts.append(" ".join(rng.choice(choices[4:6] + choices if n % 2 else choices[:6]) for _ in range(n * 3)))
    wanted = dict.fromkeys(["texts", "words", "clear", *pii.KINDS], 0)
    for text in texts:
        wanted["texts"] += text != ""
        for word in re.finditer(r"[^\W\d_]+", text):
            start = word.start()
            wanted["words"] += 1
            signs = [x for x in re.finditer(r"[0-9@]|[(\[]at[)\]]", text)
                     if start <= x.start() <= start + pii.CONTEXT or start - pii.CONTEXT <= x.end() <= start]
            if not signs:
                wanted["clear"] += 1
                for kind in pii.KINDS:
                    wanted[kind] += bool(re.search(pii.TELLING[kind], text[max(0, start - pii.CONTEXT):start]))
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string")
    assert pii.words_by_kind(docs, "text").first().asDict() == wanted
    assert wanted["clear"] > 500 and all(wanted[kind] for kind in pii.KINDS)
