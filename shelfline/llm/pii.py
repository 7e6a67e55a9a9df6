"""Personal data in texts: base patterns, and further spans that boosted trees select among generous candidates.

Base spans are the matches of one pattern for each kind that pass that kind's check. Generators of high recall propose further
spans, which may overlap. Each candidate is described by the format of its core (digits, groups, their lengths, brackets, checks) and its
context (the characters around it, a telling word before it). The core is the candidate without what alone makes it a base
span: a plus and country code, the sign of an address, spaces within an address, the signs between a card's digits. So a
form that the base patterns miss may look like one that they find.

What the base patterns miss is unlabelled, not negative, and counts for little while boosted trees tell confirmed candidates from
background, by format and by context. Background are the candidates that are of no valid form or of another kind, and the words of all texts: as any
candidate may stand there by chance, a word counts with its own context and with the formats of all
candidates of the kind in their proportions. A kind's threshold is the lowest score from which on its precision is high enough,
either as confirmed candidates are nearly all there, or as the background explains few of the unlabelled ones. Candidates
that overlap a base span are not added again.

Finding, describing, scoring and redacting are built-in functions. The trees are fitted on counts: features are binned,
so the candidates of all texts fall into a bounded number of cells, each with how many of its candidates the base
patterns confirm, how many are unlabelled and how many are background. Every candidate and every word of every text counts.

Places are code points, the end is exclusive. They come from the lengths of what lies between matches, so no text is
searched twice for one span. A null or empty text has no spans. Repeated rows are searched each for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import settled, whole_text

#: Calibrated precision that a kind's threshold must reach, and candidates that must support it.
PRECISION, SUPPORT = 0.97, 20
TREES, SHRINKAGE = 24, 0.3
#: What an unlabelled candidate counts as background while the trees are fitted, and the share of confirmed candidates that
#: a score must have among its confirmed and unlabelled ones.
UNLABELLED, CONFIRMED = 0.25, 0.1
#: Characters before a candidate that are searched for a telling word.
CONTEXT = 24
KINDS = ("email", "ip", "card", "phone")

#: Fixed values. The base patterns find what the plain ones do; lookbehinds and possessive quantifiers keep them linear, as no
#: match can start within a run of the characters that it begins with. A card is a whole run of 16 to 19 digits.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators by kind: what a span of the kind may look like.
CANDIDATES = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|\(at\)|\[at\]) ?{LABEL}++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{{2,12}}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[-._\x20]?[0-9]{3,7}+){2,5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}[-.\x20])?\(?[0-9]{2,4}+\)?[-./\x20][0-9]{3,4}+[-./\x20]?[0-9]{3,6}+(?![0-9])",
}
CANDIDATE_NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.", "card": "[0-9]{3}", "phone": "[0-9]{2}"}
TELLING = {"email": "(?i)mail|contact|write", "ip": "(?i)ip|host|server|addr", "card": "(?i)card|visa|pay|account",
           "phone": "(?i)phone|tel|call|fax|mobile"}
FORMAT = ("digits", "groups", "last", "fits")
CONTEXT_FEATURES = ("telling", "before", "after")
FEATURES = FORMAT + CONTEXT_FEATURES
#: What the words of a text count as background, all together and on average: as many candidates.
PLACES = 4
#: What candidates have within them; near one, words may tell of it.
SIGN = r"(?:[0-9@]|[(\[]at[)\]])"
#: Where a word begins that has no sign within CONTEXT characters on either side.
CLEAR = rf"(?<!\p{{L}})(?=\p{{L}})(?<!{SIGN}.{{0,{CONTEXT}}})(?!.{{0,{CONTEXT}}}{SIGN})"


def only(hit: Column, characters: str) -> Column:
    """The hit without these characters."""
    return F.translate(hit, characters, "")


def luhn(digits: Column, longest: int = 19) -> Column:
    padded, total = F.lpad(digits, longest, "0"), F.lit(0)
    for place in range(1, longest + 1):
        value = F.substring(padded, place, 1).cast("int")
        total = total + (F.when(value < 5, 2 * value).otherwise(2 * value - 9) if (longest - place) % 2 else value)
    return total % 10 == 0


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda hit: luhn(only(hit, " -")),
    "phone": lambda hit: F.char_length(only(hit, "+ ().-")).between(8, 15),
}


def with_matches(rows: DataFrame, name: str, pattern: str, needs: Column) -> DataFrame:
    """Column name: the matches of pattern in text with their places and what stands around them."""
    gaps, hits = f"{name}_gaps", f"{name}_hits"
    there = needs & F.col("text").rlike(pattern)
    cut = rows.withColumns({gaps: F.when(there, F.split("text", pattern, -1)),
                            hits: F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))})
    described = F.transform(hits, lambda hit, n: F.struct(
        F.char_length(F.get(F.col(gaps), n)).alias("gap"), hit.alias("hit"),
        F.right(F.get(F.col(gaps), n), F.lit(CONTEXT)).alias("before"),
        F.substring(F.get(F.col(gaps), n + 1), 1, 1).alias("after")))
    found = cut.withColumn(f"{name}_list", described).drop(gaps, hits)
    empty = F.struct(F.lit(0).alias("place"), F.array().cast(
        "array<struct<start:int,end:int,hit:string,before:string,after:string>>").alias("out"))
    def place(held: Column, x: Column) -> Column:
        start = held["place"] + x["gap"]
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"),
                        x["after"].alias("after"))
        return F.struct(end.alias("place"), F.concat(held["out"], F.array(span)).alias("out"))

    placed = F.aggregate(f"{name}_list", empty, place, lambda held: held["out"])
    return found.withColumn(name, F.coalesce(placed, F.array().cast(
        "array<struct<start:int,end:int,hit:string,before:string,after:string>>"))).drop(f"{name}_list")


def with_base(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, text and for each kind its base spans."""
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    for kind in KINDS:
        needs = F.lit(True) if NEEDS[kind] is None else F.contains("text", F.lit(NEEDS[kind]))
        rows = with_matches(rows, f"base_{kind}", BASE[kind], needs)

    def checked(kind: str) -> Column:
        passing = F.filter(f"base_{kind}", lambda x: CHECKS[kind](x["hit"]))
        return F.transform(passing, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(kind)

    return rows.select("key", "text", *(checked(kind) for kind in KINDS))


def binned(value: Column, *cuts: int) -> Column:
    """How many of the cuts the value reaches."""
    total = F.lit(0)
    for cut in cuts:
        total = total + F.when(value >= cut, 1).otherwise(0)
    return total


def core(kind: str, hit: Column) -> Column:
    """The hit without what alone makes it a base span."""
    if kind == "email":
        signs = F.regexp_replace(F.regexp_replace(hit, r"\(at\)|\[at\]", "@"), r"\(dot\)|\[dot\]", ".")
        return only(signs, " ")
    if kind == "ip":
        return only(hit, " ")
    if kind == "card":
        return F.regexp_replace(hit, "[^0-9]+", " ")
    return F.regexp_replace(hit, r"^\+[0-9]{1,3}(?=[^0-9])[ .-]?", "")


def character(text: Column, place: str) -> Column:
    """2 for a letter at this end of the text, 1 for a digit, else 0."""
    return F.when(text.rlike(f"[A-Za-z]{place}"), 2).when(text.rlike(f"[0-9]{place}"), 1).otherwise(0)


def context_features(kind: str, before: Column, after: Column) -> list[Column]:
    return [F.when(before.rlike(TELLING[kind]), 1).otherwise(0), character(before, "$"), character(after, "$")]


def features(kind: str, x: Column) -> list[Column]:
    """The features of a candidate, small whole numbers."""
    held = core(kind, x["hit"])
    digits = F.regexp_replace(held, "[^0-9]", "")
    number = F.char_length(digits)
    parts = F.regexp_extract_all(held, F.lit("[A-Za-z0-9]+"), F.lit(0))
    fits = {"email": F.lit(True), "ip": CHECKS["ip"](held), "card": number.between(13, 19) & luhn(digits),
            "phone": F.char_length(F.regexp_replace(x["hit"], "[^0-9]", "")).between(8, 15)}[kind]
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [binned(number, 1, 7, 9, 10, 11, 13, 16), binned(F.size(parts), 2, 3, 4, 5),
            binned(F.char_length(F.element_at(parts, -1)), 2, 3, 4, 5), flag(fits),
            *context_features(kind, x["before"], x["after"])]


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds candidates: kind, place, features, and whether a base span of the kind confirms it or any overlaps it."""
    for kind in KINDS:
        rows = with_matches(rows, f"more_{kind}", CANDIDATES[kind], F.col("text").rlike(CANDIDATE_NEEDS[kind]))
    overlaps = lambda of, x: F.exists(of, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    def described(kind: str) -> Column:
        def one(x: Column) -> Column:
            any_ = overlaps(KINDS[0], x)
            for other in KINDS[1:]:
                any_ = any_ | overlaps(other, x)
            named = [c.cast("int").alias(n) for n, c in zip(FEATURES, features(kind, x))]
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                            overlaps(kind, x).alias("confirmed"), any_.alias("known"), *named)
        return F.transform(f"more_{kind}", one)

    return rows.select("key", "text", *KINDS, F.concat(*(described(kind) for kind in KINDS)).alias("candidates"))


@dataclass(frozen=True)
class Split:
    """One tree: a first test, and a second one on either side; values are what the leaves add to the score."""
    first: tuple[str, int]
    low: tuple[str, int]
    high: tuple[str, int]
    values: tuple[float, float, float, float]

    def leaf(self, cell: dict) -> int:
        if cell[self.first[0]] < self.first[1]:
            return int(cell[self.low[0]] >= self.low[1])
        return 2 + int(cell[self.high[0]] >= self.high[1])

    def score(self, x: Column) -> Column:
        below = F.when(x[self.low[0]] < self.low[1], self.values[0]).otherwise(self.values[1])
        above = F.when(x[self.high[0]] < self.high[1], self.values[2]).otherwise(self.values[3])
        return F.when(x[self.first[0]] < self.first[1], below).otherwise(above)


@dataclass(frozen=True)
class Trees:
    """Boosted trees for one kind, and the score from which on a candidate is selected (None: never)."""
    start: float
    splits: tuple[Split, ...]
    threshold: float | None

    def selects(self, x: Column) -> Column:
        if self.threshold is None:
            return F.lit(False)
        total = F.lit(self.start)
        for split in self.splits:
            total = total + split.score(x)
        return total >= self.threshold


def best_test(cells: list[dict], tests: list[tuple[str, int]]) -> tuple[str, int]:
    """The test that lowers the loss most, by the sums of gradients and curvatures on both sides."""
    all_g, all_h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    best, gain = tests[0], -1.0
    for name, cut in tests:
        g = sum(c["g"] for c in cells if c[name] < cut)
        h = sum(c["h"] for c in cells if c[name] < cut)
        now = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1)
        if now > gain + 1e-12:
            best, gain = (name, cut), now
    return best


def boost(cells: list[dict]) -> Trees:
    """Trees for cells of features with their numbers of confirmed candidates (yes), of these and background places
    (n), of unlabelled candidates (open), and of background places at random (random) and among candidates (other)."""
    total, yes = sum(c["n"] for c in cells), sum(c["yes"] for c in cells)
    if not total:
        return Trees(0.0, (), None)
    start = log((yes + 1) / (total - yes + 1))
    tests = [(name, cut) for name in FEATURES for cut in sorted({c[name] for c in cells})[1:]]
    splits: list[Split] = []
    for c in cells:
        c["score"] = start
    for _ in range(TREES if tests else 0):
        for c in cells:
            p = 1 / (1 + exp(-c["score"]))
            c["g"], c["h"] = c["yes"] - c["n"] * p, c["n"] * p * (1 - p)
        first = best_test(cells, tests)
        sides = [[c for c in cells if (c[first[0]] >= first[1]) == side] for side in (False, True)]
        shape = Split(first, best_test(sides[0], tests), best_test(sides[1], tests), (0.0,) * 4)
        leaves = [shape.leaf(c) for c in cells]
        values = tuple(SHRINKAGE * sum(c["g"] for c, own in zip(cells, leaves) if own == n)
                       / (1 + sum(c["h"] for c, own in zip(cells, leaves) if own == n)) for n in range(4))
        splits.append(Split(shape.first, shape.low, shape.high, values))
        for c, own in zip(cells, leaves):
            c["score"] += values[own]
    confirmed = calibrated_threshold([{"score": c["score"], "yes": c["yes"], "n": c["yes"] + c["open"]} for c in cells
                                      if c["yes"] + c["open"]])
    found = [x for x in (confirmed, unlabelled_threshold(cells)) if x is not None]
    return Trees(start, tuple(splits), min(found) if found else None)


def unlabelled_threshold(cells: list[dict]) -> float | None:
    """The lowest score from which on the background explains few enough of the unlabelled candidates, and all scores have
    confirmed candidates among them: what is never confirmed in any form like this is not added.

    The share r of background places that reach a score is what negatives reach it by chance; of two kinds of background the larger one
    counts. All unlabelled candidates below the score taken as negatives, those above it hold below * r / (1 - r) more.
    """
    total = {n: sum(c[n] for c in cells) for n in ("open", "random", "other")}
    above, best = dict.fromkeys(total, 0), None
    ordered = sorted(cells, key=lambda c: -c["score"])
    yes = unlabelled = 0
    for n, c in enumerate(ordered):
        for name in above:
            above[name] += c[name]
        yes, unlabelled = yes + c["yes"], unlabelled + c["open"]
        if n + 1 < len(ordered) and ordered[n + 1]["score"] > c["score"] - 1e-9:
            continue
        if unlabelled and yes < CONFIRMED * (yes + unlabelled):
            break
        yes = unlabelled = 0
        rates = [(above[name] + 1) / (total[name] + 1) for name in ("random", "other") if total[name] >= SUPPORT]
        if not rates or (rate := max(rates)) >= 1 or above["open"] < SUPPORT:
            continue
        if (total["open"] - above["open"]) * rate / (1 - rate) <= (1 - PRECISION) * above["open"] and rate < 0.5:
            best = c["score"] - 1e-6
    return best


def calibrated_threshold(cells: list[dict]) -> float | None:
    """The lowest score whose calibrated precision suffices. Calibration is isotonic: neighbours by score are pooled
    until their shares of confirmed candidates ascend."""
    pools: list[list[float]] = []  # lowest score, confirmed, all
    for c in sorted(cells, key=lambda c: c["score"]):
        if pools and abs(pools[-1][0] - c["score"]) < 1e-9:
            pools[-1][1] += c["yes"]
            pools[-1][2] += c["n"]
        else:
            pools.append([c["score"], c["yes"], c["n"]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    fit = [p for p in pools if p[1] >= PRECISION * p[2] and p[2] >= SUPPORT]
    return fit[0][0] - 1e-6 if fit else None


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, Trees]:
    """Trees by kind, from all documents."""
    found = with_candidates(with_base(docs, text, key)).select(F.explode("candidates").alias("x"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fits, known, confirmed = F.col("x.fits") == 1, F.col("x.known"), F.col("x.confirmed")
    cells = found.groupBy("x.kind", *(f"x.{n}" for n in FEATURES)).agg(
        count(confirmed).alias("yes"), count(~known & fits).alias("open"),
        count(~confirmed & (known | ~fits)).alias("other")).collect()  # bounded by the bins
    held: dict[str, dict[tuple, dict]] = {kind: {} for kind in KINDS}
    for c in cells:
        held[c["kind"]][tuple(c[n] for n in FEATURES)] = c.asDict() | {"random": 0.0}
    for kind, contexts in word_contexts(docs, text).items():
        add_random(held[kind], contexts)
        for c in held[kind].values():
            c["n"] = c["yes"] + c["random"] + c["other"] + UNLABELLED * c["open"]
    return {kind: boost([held[kind][k] for k in sorted(held[kind])]) for kind in KINDS}


def add_random(cells: dict[tuple, dict], contexts: dict[tuple, float]) -> None:
    """Words by their context, each with the formats of valid candidates in their proportions."""
    formats: dict[tuple, int] = {}
    for place, c in cells.items():
        if c["fits"]:
            formats[place[:len(FORMAT)]] = formats.get(place[:len(FORMAT)], 0) + c["yes"] + c["open"] + c["other"]
    total = sum(formats.values())
    for context, number in contexts.items():
        for form, share in formats.items():
            empty = dict(zip(FEATURES, form + context)) | {"yes": 0, "open": 0, "other": 0, "random": 0.0}
            cells.setdefault(form + context, empty)["random"] += number * share / total


def told(kind: str) -> str:
    """What holds where a telling word of the kind stands within the CONTEXT characters before."""
    words = TELLING[kind].removeprefix("(?i)").split("|")
    return "(?<=(?i:{}))".format("|".join(f"{word}.{{0,{CONTEXT - len(word)}}}" for word in words))


def words_by_kind(docs: DataFrame, text: str) -> DataFrame:
    """One row: texts that are not empty, their words, those far from any sign (clear), and for each kind how many of these a telling
    word stands before."""
    rows = docs.select(whole_text(text).alias("text")).filter("text <> ''")
    number = lambda pattern: F.regexp_count("text", F.lit(f"(?s){pattern}"))
    counted = rows.select(number(r"\p{L}++").alias("words"), number(CLEAR).alias("clear"), *(F.when(
        F.col("text").rlike(TELLING[kind]), number(f"(?<!\\p{{L}})(?=\\p{{L}}){told(kind)}{CLEAR}")).otherwise(0).alias(kind)
        for kind in KINDS))
    return counted.agg(F.count("*").alias("texts"), *(
        F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counted.columns))


def word_contexts(docs: DataFrame, text: str) -> dict[str, dict[tuple, float]]:
    """For each kind what the words of all texts that are clear of any sign count in each context. No letter or digit stands right before
    a word or behind it, so that contexts differ by whether a telling word stands before."""
    row = words_by_kind(docs, text).first()
    each = PLACES * row["texts"] / row["words"] if row["words"] else 0.0
    counts = {kind: {(0, 0, 0): row["clear"] - row[kind], (1, 0, 0): row[kind]} for kind in KINDS}
    return {kind: {context: n * each for context, n in held.items() if n} for kind, held in counts.items()}


def find(docs: DataFrame, trees: dict[str, Trees], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, text, base and spans: arrays of (rank of the kind, start, end), in this order; spans holds base."""
    rows = with_candidates(with_base(docs, text, key))

    def ranked(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda x: F.struct(rank.alias("rank"), x["start"].alias("start"), x["end"].alias("end")))

    x_kind = lambda x, kind: x["kind"] == kind

    def chosen(x: Column) -> Column:
        out = F.lit(False)
        for kind in KINDS:
            out = out | (x_kind(x, kind) & trees[kind].selects(x))
        return ~x["known"] & (x["fits"] == 1) & out

    def as_span(x: Column) -> Column:
        out = F.lit(0)
        for n, kind in enumerate(KINDS):
            out = F.when(x_kind(x, kind), n).otherwise(out)
        return F.struct(out.alias("rank"), x["start"].alias("start"), x["end"].alias("end"))

    base = F.concat(*(ranked(kind) for kind in KINDS))
    more = F.transform(F.filter("candidates", chosen), as_span)
    return settled(rows.select("key", "text", *KINDS, base.alias("base"), more.alias("more"))).select(
        F.col("key").alias(key), F.col("text").alias(text), "base",
        F.array_distinct(F.sort_array(F.concat("base", "more"))).alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined with commas."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes under the first."""
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"))))
    start = F.struct(F.lit(0).alias("place"), F.lit("").alias("out"))
    return F.aggregate(
        ordered, start,
        lambda held, x: F.struct(
            F.greatest(held["place"], x["end"]).alias("place"),
            F.when(x["start"] < held["place"], held["out"]).otherwise(F.concat(
                held["out"], F.substring(F.col(text), held["place"] + 1, x["start"] - held["place"]),
                F.get(names, x["rank"]))).alias("out")),
        lambda held: F.concat(held["out"], F.substring(F.col(text), held["place"] + 1, F.lit(2147483647))))


def findings(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    found = find(docs, fit(docs))
    count = lambda n: F.size(F.filter("base", lambda x: x["rank"] == n)).cast("long")
    return found.select("doc_id", *(count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)),
                        F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
