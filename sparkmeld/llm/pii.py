"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation estimates how
reliable each labeler is, and its posteriors train the span classifier that decides on candidates beyond the base rules.

Only DataFrame expressions touch documents. A span's offsets come from the lengths of what lies between matches. The
votes are counted by pattern (a few hundred at most), so what the driver fits on does not grow with the corpus.
"""

from __future__ import annotations

import math
import operator
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Repeats are possessive where what follows cannot need them back, and a look-behind starts a search at
#: the beginning of a run (or where the last match ended): the matches are the contract's, in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes that are candidates only: addresses written out, IPv6 and defanged addresses, grouped card numbers with
#: other separators, telephone numbers without a plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]at[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,2}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])",
    "phone": r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-][0-9\x20.-]{6,14}[0-9]|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9.-])",
}
#: Gazetteers. Top-level domains; country calling codes (ranges are inclusive); issuers' first digits with
#: the lengths of their card numbers.
DOMAINS = "com net org edu gov mil int info biz name io ai app dev me tv co eu de fr es it uk ie us ca mx br ar cl ch at be nl lu dk se no fi is pt pl cz sk hu ro bg gr tr ru ua jp cn kr in id au nz za ng ke eg il ae sa example test"
CALLING_CODES = "1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81 82 84 86 90-95 98 211-213 216 218 220-269 290 291 297-299 350-359 370-389 420 421 423 500-509 590-599 670 672-692 800 808 850 852 853 855 856 870 880 886 888 960-968 970-977 992-996 998"
ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (36, 36, (14,)), (38, 39, (14,)), (300, 305, (14,)), (6011, 6011, (16, 19)), (644, 659, (16, 19)), (3528, 3589, (16, 19)), (62, 62, (16, 17, 18, 19)))
#: Context: words shortly before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|correo|courriel|write to|reach|escrib",
    "ip": r"(?i)\bip\b|address|host|server|client|gateway|ping",
    "card": r"(?i)card|visa|credit|tarjeta|carte|karte|\bpay",
    "phone": r"(?i)phone|\btel|call|mobile|\bfax|tel[eé]fono|telefon|dial|ring",
}
AGAINST = r"(?i)token|hash|version|serial|isbn|checksum|\bid\b|release|order|part no"
CONTEXT_CHARS = 24

#: Rounds of expectation-maximisation, votes that the first beliefs count for, and the probability at which a candidate becomes a span.
ROUNDS, PSEUDO, ADD_AT = 30, 10.0, 0.5
#: The regex labeler's chance to refuse a true span is not estimated: a failed checksum or range is seldom wrong.
REFUSED = 0.01
#: Characters of the pieces that a text is cut from.
PIECE = 1024


def _may_have(kind: str, text: Column, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if loose:
        return {
            "email": text.contains("at)") | text.contains("at]") | text.contains("at}") | text.contains(" at ") | text.contains(" AT "),
            "ip": text.contains(":") | text.contains("[.]"), "card": text.rlike(r"[0-9]{4}[./_][0-9]{4}"),
            "phone": text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20.-][0-9]"),
        }[kind]
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: what a lambda only refers to is computed again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of array<int>, it and all before it under the associative `add`.

    Blocks of about the square root of the array's size are folded, then their last values: a fold copies its list at
    every step, and so no list is longer than that.
    """
    state = F.struct(F.lit(zero).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(add(s["at"], x))).alias("out"))
    before = lambda s, x: F.struct(add(s["at"], F.element_at(x, -1)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def of(v: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = _let(size, lambda b: F.transform(F.sequence(F.lit(0), F.size(v) - 1, b), lambda i: F.slice(v, i + 1, b)))
        scanned = F.transform(blocks, lambda block: F.aggregate(block, state, step, lambda s: s["out"]))
        joined = lambda parts: F.flatten(F.zip_with(parts, F.aggregate(parts, state, before, lambda s: s["out"]), lambda part, o: F.transform(part, lambda x: add(o, x))))
        return F.when(F.size(v) == 0, v).when(F.size(v) <= 64, F.aggregate(v, state, step, lambda s: s["out"])).otherwise(_let(scanned, joined))

    return _let(values, of)


def matches(text: Column, pattern: str, may: Column) -> Column:
    """array<struct<m, start, end, before>> of leftmost non-overlapping matches; offsets in code points, end exclusive."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda p: F.length(p["b"]) + F.coalesce(F.length(p["m"]), F.lit(0))
    one = lambda p, end: F.struct(p["m"].alias("m"), (end - F.length(p["m"])).alias("start"), end.alias("end"), F.right(p["b"], F.lit(CONTEXT_CHARS)).alias("before"))
    pairs = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))  # the last has no match
    placed = _let(pairs, lambda all_: F.zip_with(all_, running(F.transform(all_, size), 0, operator.add), one))
    return F.when(may, F.filter(placed, lambda x: x["m"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<m:string,start:int,end:int,before:string>>)"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    one = lambda i: F.when((n - i) % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & ~F.exists(F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) > 255)
    if kind == "card":
        return _let(_digits(m), lambda d: F.when((F.length(d) >= 14) & (F.length(d) <= 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _calling_codes() -> list[str]:
    ends = [x.split("-") for x in CALLING_CODES.split()]
    return [str(n) for x in ends for n in range(int(x[0]), int(x[-1]) + 1)]


def known(kind: str, m: Column) -> Column:
    """Whether the kind's gazetteer holds a candidate: its domain, its network, its issuer, its country or area."""
    digits = _digits(m)
    head = lambda k: F.substring(digits, 1, k)
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS.split())
    if kind == "ip":
        first = F.regexp_extract(m, r"^0*([0-9]{1,3})(?:\.|\[)", 1).try_cast("int")
        return F.when(m.contains(":"), m.rlike(r"^(?:[23][0-9A-Fa-f]{3}|f[cdCD][0-9A-Fa-f]{2}|[fF][eE]80):")).otherwise(F.coalesce(first.between(1, 223) & (first != 127), F.lit(False)))
    if kind == "card":
        of = F.lit(False)
        for low, high, sizes in ISSUERS:
            of = of | (head(len(str(low))).try_cast("int").between(low, high) & F.length(digits).isin(*sizes))
        return F.coalesce(of, F.lit(False))
    codes = _calling_codes()
    prefix = lambda d: F.substring(d, 1, 1).isin(codes) | F.substring(d, 1, 2).isin(codes) | F.substring(d, 1, 3).isin(codes)
    return F.when(m.startswith("+"), prefix(digits)).when(digits.startswith("00"), prefix(F.substring(digits, 3, 3))).otherwise(digits.rlike(r"^[2-9][0-9]{2}[2-9]"))


def _labelled(kind: str, found: Column, base: bool) -> Column:
    """Candidates with the labelers' votes: 1 for, -1 against, 0 none. The regex labeler accepts base shapes only, and
    refuses what fails their test of digits."""
    rank = KINDS.index(kind)
    cut = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))

    def one(x: Column) -> Column:
        plain = F.replace(F.replace(x["m"], F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
        regex = cut(valid(kind, x["m"])) if base else F.when(valid(kind, plain) | (x["m"].contains(":") if kind == "ip" else F.lit(False)), F.lit(0)).otherwise(F.lit(-1))
        context = F.when(x["before"].rlike(CONTEXT[kind]), F.lit(1)).when(x["before"].rlike(AGAINST), F.lit(-1)).otherwise(F.lit(0))
        long = F.least(F.floor(F.length(_digits(x["m"])) / 4), F.lit(5)).cast("int")
        spaced = x["m"].rlike(r"[\x20().-]").cast("int")
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("kind"), x["end"].alias("end"), regex.alias("regex"), cut(known(kind, x["m"])).alias("gazetteer"), context.alias("context"), (long * 2 + spaced).alias("shape"))

    return F.transform(found, one)


def _clear(spans: Column) -> Column:
    """Of sorted spans: the base ones, and candidates that overlap none of them and no candidate before them."""
    far = 2**31 - 1
    sure = lambda x: x["regex"] == 1

    def of(s: Column) -> Column:
        until = running(F.transform(s, lambda x: F.when(sure(x), x["end"]).otherwise(0)), 0, F.greatest)
        nearest = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(sure(x), x["start"]).otherwise(far))), far, F.least))
        seen = F.zip_with(F.zip_with(s, until, lambda x, a: F.struct(x.alias("x"), a.alias("a"))), nearest, lambda y, b: F.struct(y["x"].alias("x"), y["a"].alias("a"), b.alias("b")))
        kept = F.filter(seen, lambda y: sure(y["x"]) | ((y["a"] <= y["x"]["start"]) & (y["b"] >= y["x"]["end"])))
        return F.transform(kept, lambda y: y["x"])

    return _let(spans, of)


def candidates(text: Column) -> Column:
    """array of base spans and candidates that overlap none of them, each with votes, by start and kind."""
    text = F.coalesce(text, F.lit(""))
    base = [_labelled(k, matches(text, BASE[k], _may_have(k, text, False)), True) for k in KINDS]
    loose = [_labelled(k, matches(text, LOOSE[k], _may_have(k, text, True)), False) for k in KINDS]
    return _clear(F.array_sort(F.concat(*base, *loose)))


class Aggregator:
    """Dawid-Skene over three labelers, by kind: prior of a true span, and by labeler the chance of each vote given the truth."""

    def __init__(self, counts: dict[tuple[int, int, int, int], int]) -> None:
        self.prior, self.rate = {}, {}
        for kind in range(len(KINDS)):
            own = {k[1:]: n for k, n in counts.items() if k[0] == kind}
            prior, rate = 0.5, [{True: {1: 0.7, 0: 0.2, -1: 0.1}, False: {1: 0.2, 0: 0.3, -1: 0.5}} for _ in range(3)]
            rate[0] = {True: {1: 0.8, 0: 0.19, -1: REFUSED}, False: {1: 0.02, 0: 0.18, -1: 0.8}}
            belief = [{t: {v: PSEUDO * p for v, p in of[t].items()} for t in of} for of in rate]
            for _ in range(ROUNDS if any(votes[0] == 1 for votes in own) else 0):  # without one sure span nothing tells the classes apart
                true_n, sums = 0.0, [{t: dict(of[t]) for t in of} for of in belief]
                for votes, n in own.items():
                    p = self._posterior(prior, rate, votes)
                    true_n += n * p
                    for j, v in enumerate(votes):
                        sums[j][True][v] += n * p
                        sums[j][False][v] += n * (1 - p)
                prior = (true_n + PSEUDO / 2) / (sum(own.values()) + PSEUDO)
                for j in range(3):
                    for t in (True, False):
                        for v in (1, 0, -1):
                            rate[j][t][v] = sums[j][t][v] / sum(sums[j][t][w] for w in (1, 0, -1))
                rest = rate[0][True][1] + rate[0][True][0]
                rate[0][True] = {1: rate[0][True][1] / rest * (1 - REFUSED), 0: rate[0][True][0] / rest * (1 - REFUSED), -1: REFUSED}
            self.prior[kind], self.rate[kind] = prior, rate

    @staticmethod
    def _posterior(prior: float, rate: list, votes: tuple) -> float:
        yes, no = math.log(prior), math.log(1 - prior)
        for j, v in enumerate(votes):
            yes, no = yes + math.log(rate[j][True][v]), no + math.log(rate[j][False][v])
        return 1 / (1 + math.exp(min(no - yes, 700)))

    def posterior(self, kind: int, votes: tuple[int, int, int]) -> float:
        return self._posterior(self.prior[kind], self.rate[kind], votes)


def train_classifier(counts: dict[tuple, int], model: Aggregator) -> dict[tuple, float]:
    """The final classifier over (kind, regex, gazetteer, context, shape): logistic regression on the aggregated posteriors by gradient steps.

    counts: {(kind, regex, gazetteer, context, shape): n}. Returns the probability of each combination that occurs,
    among them those that the regex labeler abstains on or votes against.
    """
    rows: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for (kind, regex, gaz, ctx, shape), n in sorted(counts.items()):
        p = model.posterior(kind, (regex, gaz, ctx))
        cell = rows[(kind, regex, gaz, ctx, shape)]
        cell[0] += n * p
        cell[1] += n
    weight: dict[tuple, float] = defaultdict(float)
    feats = {r: [("kind", r[0]), ("regex", *r[:2]), ("gaz", r[0], r[2]), ("ctx", r[0], r[3]), ("shape", r[0], r[4])] for r in rows}
    total = {k: sum(c[1] for r, c in rows.items() if r[0] == k) for k in range(len(KINDS))}
    for _ in range(400):
        grad: dict[tuple, float] = defaultdict(float)
        for r, (yes, n) in rows.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in feats[r])))))
            for f in feats[r]:
                grad[f] += (yes - n * p) / total[r[0]]
        for f, g in grad.items():
            weight[f] += 1.0 * (g - 1e-4 * weight[f])
    return {r: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in feats[r]))))) for r in rows}


def decide(rows: DataFrame) -> DataFrame:
    """rows(spans, ...) with spans narrowed to base spans and the candidates that the trained classifier accepts."""
    votes = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.regex", "s.gazetteer", "s.context", "s.shape").count().collect()
    counts = {tuple(r[:5]): r[5] for r in votes}
    by_vote: dict[tuple, int] = defaultdict(int)
    for k, n in counts.items():
        by_vote[k[:4]] += n
    probability = train_classifier(counts, Aggregator(dict(by_vote)))
    anchored = {k[0] for k in counts if k[1] == 1}
    added = sorted(k for k, p in probability.items() if p >= ADD_AT and k[1] != 1 and k[0] in anchored)
    code = lambda x: F.concat_ws(":", x["kind"], x["regex"], x["gazetteer"], x["context"], x["shape"])
    accept = lambda x: (x["regex"] == 1) | code(x).isin([":".join(map(str, k)) for k in added])
    return rows.withColumn("spans", F.filter("spans", accept if added else lambda x: x["regex"] == 1))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))


def without(text: Column, spans: Column) -> Column:
    """text with sorted spans replaced by their kind in brackets, overlapping ones by that of the first.

    The text is cut up once, so that reaching a span's place costs a piece and not the text before it.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        at = lambda x: F.floor(x / PIECE).cast("int")
        part = lambda i, lo, n: F.substring(F.coalesce(F.get(pieces, i), F.lit("")), lo, n)
        across = F.concat(part(at(a), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, at(a) + 2, F.greatest(at(b) - at(a) - 1, F.lit(0))), ""), part(at(b), F.lit(1), b % PIECE))
        return F.when(at(a) == at(b), part(at(a), a % PIECE + 1, b - a)).otherwise(across)

    def of(pieces: Column, s: Column, ends: Column) -> Column:
        since = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(s))
        kept = F.filter(F.zip_with(s, since, lambda x, a: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), a.alias("at"))), lambda y: y["start"] >= y["at"])
        told = F.array_join(F.transform(kept, lambda y: F.concat(cut(pieces, y["at"], y["start"]), F.get(names, y["kind"]))), "")
        return F.concat(told, cut(pieces, F.element_at(ends, -1), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = lambda s: running(F.transform(s, lambda x: x["end"]), 0, F.greatest)
    return _let(pieces, lambda p: _let(spans, lambda s: _let(ends(s), lambda e: of(p, s, e))))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every accepted span of text replaced by its kind in brackets; other columns of any name stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), candidates(F.col("text")).alias("spans"))
    out = decide(materialize(rows, "pii"))
    text = F.col("row").getField("text")
    clean = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(without(text, F.col("spans")))
    return out.select(*[(clean if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans.

    Null and empty texts have no spans (the digest is that of an empty text). Spans that start alike keep the order of
    kinds; spans of different kinds may overlap if both are base spans. Texts of any length and number of spans: work
    grows with the text's length and the spans' number to the power 1.5. Repeated rows are each answered; other columns
    are not read; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decide(materialize(docs.select("doc_id", candidates(F.col("text")).alias("spans")), "pii"))
    base = F.filter("spans", lambda x: x["regex"] == 1)
    count = lambda i: F.size(F.filter("spans", lambda x: (x["regex"] == 1) & (x["kind"] == i))).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
