"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import align, bpe, ctph, htmltext, langid, packing, phrases, pii, quality, simhash, suffix, tokencount, warc
from shelfline.llm.common import table


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of every document."""
    return tokencount.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    return suffix.removal_digest(table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return langid.languages(table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.archive_round_trip(table(spark, folder, "pages"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The measurements of every document and whether it is kept."""
    return quality.verdicts(table(spark, folder, "documents"))


def quality_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What the quality policy would keep without each of its rules."""
    return quality.ablations(quality.ledger(table(spark, folder, "documents")), "v1")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.findings(table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return ctph.with_next(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Two tokenisations of every document, aligned."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignment_digest(table(spark, folder, "documents"), *paths)


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


def op13_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_warc": op2_warc,
        "op3_pii": op3_pii,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_language": op5_language,
        "op7_fingerprints": op7_fingerprints,
        "op8_quality": op8_quality,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "op11_alignment": op11_alignment,
        "op12_phrases": op12_phrases,
        "op13_html": op13_html,
        "op6_token_counts": op6_token_counts,
        "quality_ablations": quality_ablations,
    }


OP2 = """
with p as (
    select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n,
           sha256(coalesce(html, '')) as digest
    from pages),
f as (select digest, min(page_id) as first_id from p where n >= 100 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
       case when p.page_id > f.first_id then 'revisit' else 'response' end as record_type,
       case when p.page_id > f.first_id then f.first_id end as refers_to
from p left join f on p.digest = f.digest and p.n >= 100
"""


OP4 = r"""
with h as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select *, unnest(range(0, n - 49)) as i from h where n >= 50)),
f as (select g, min(doc_id) as first_id from s group by g),
hit as (select doc_id, i from s join f using (g) where first_id < doc_id),
marked as (
    select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from hit),
runs as (
    select doc_id, min(i) as b, max(i) + 50 as e
    from (select *, sum(fresh) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
gaps as (
    select doc_id, b, e, coalesce(lag(e) over (partition by doc_id order by b), 0) as before from runs),
cut as (
    select doc_id, sum(e - b) as removed, count(*) as spans, max(e) as last_end,
           string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' order by b) as kept
    from gaps join h using (doc_id) group by doc_id)
select h.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
       coalesce(spans, 0) as n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) as kept_sha256
from h left join cut using (doc_id)
"""

OP8 = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
    select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
m as (
    select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
           length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
           length(t) - length(replace(t, '!', '')) as n_exclamations,
           length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as n_digits
    from w),
words as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
following as (
    select doc_id, i, x, lead(x) over own as y, lead(x, 2) over own as z from words
    window own as (partition by doc_id order by i)),
windows as (
    select doc_id, i, count(*) over (partition by doc_id, x, y, z) as times from following where z is not null),
repeated as (
    select doc_id, count(distinct place) as n_repeat_words
    from (select doc_id, unnest([i, i + 1, i + 2]) as place from windows where times > 1) group by doc_id),
r as (select m.*, coalesce(n_repeat_words, 0) as n_repeat_words from m left join repeated using (doc_id)),
b as (
    select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when 10 * n_symbols > n_words then 4 else 0 end)
        + (case when n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
        + (case when 100 * n_capitals > 40 * word_chars then 16 else 0 end)
        + (case when 2 * n_exclamations > n_words then 32 else 0 end)
        + (case when word_chars < 2 * n_words then 64 else 0 end)
        + (case when word_chars > 40 * n_words then 128 else 0 end)
        + (case when 100 * n_digits > 50 * word_chars then 256 else 0 end) as failures
    from r)
"""

OP8_ROWS = """
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, failures % 4 > 0 as base_failed, failures = 0 as kept,
       cast(failures as bigint) as failures
from b
"""

OP8_ABLATIONS = """
select rule, count(*) filter (where failures // bit % 2 = 1) as n_failed,
       count(*) filter (where failures = bit) as n_failed_alone,
       count(*) filter (where failures = 0 or failures = bit) as n_kept_without
from b, (values ('few_words', 1), ('repeated_words', 2), ('many_symbols', 4), ('repeated_lines', 8), ('capitals', 16),
                ('exclamations', 32), ('short_words', 64), ('long_words', 128), ('many_digits', 256)) as rules(rule, bit)
group by rule, bit
"""

OP12 = r"""
with t as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from t),
totals as (select lang, sum(len(ws)) as n from p group by lang),
grams as (
    select lang, k, array_to_string(ws[i:i + k - 1], ' ') as g
    from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from p, range(1, 6) as sizes(k) where len(ws) >= k)),
f as (select lang, k, g, count(*) as f from grams group by lang, k, g),
c as (select lang, k, g, f as a, string_split(g, ' ') as ws from f where k > 1 and f >= 100),
alone as (
    select * from c where not exists (
        select 1 from c as o where o.lang = c.lang and o.k > c.k and o.a >= c.a
        and contains(' ' || o.g || ' ', ' ' || c.g || ' '))),
cuts as (
    select lang, g, a, k, cut, array_to_string(ws[1:cut], ' ') as lg, array_to_string(ws[cut + 1:], ' ') as rg
    from (select *, unnest(range(1, k)) as cut from alone)),
scored as (
    select cuts.lang, cuts.g as phrase, a, cut, l.f as l, r.f as r, n,
           (cast(1000 as hugeint) * a * cast(n as hugeint)) // (cast(l.f as hugeint) * r.f) as score
    from cuts join f as l on l.lang = cuts.lang and l.k = cut and l.g = lg
    join f as r on r.lang = cuts.lang and r.k = cuts.k - cut and r.g = rg join totals on totals.lang = cuts.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
       cast(n as bigint) as n, cast(score as bigint) as score
from lowest qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op4_suffix_dedup": OP4, "op8_quality": OP8 + OP8_ROWS, "quality_ablations": OP8 + OP8_ABLATIONS,
            "op12_phrases": OP12}
