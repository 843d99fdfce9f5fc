"""Personal data by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, stored

KINDS = ["email", "ip", "card", "phone"]

# What a span must look like. Possessive repeats and the look-behinds find what
# the plain patterns find, without trying again inside a run of characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Candidates that these do not find: written-out addresses and bare numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
_NEEDS = {"email": r"[@\[({]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Gazetteers (fixed values): top-level domains, first digits of card issuers,
# calling codes; and words that announce a kind in four languages.
DOMAINS = ("com org net edu gov int mil info biz io co eu de fr es it uk us ca au at ch nl be se no dk fi pl pt "
           "ie mx ar br cl jp cn in ru kr za nz me tv").split()
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|36|38|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8]))"
CALLING = r"^\+(?:1[ .(-]*[2-9]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
ANNOUNCED = {
    "email": "e-?mail|mail|contact|write to|kontakt|courriel|correo",
    "ip": r"\bip\b|host|server|address|adresse|direcci|login|logged",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment|zahlung|paiement|pago",
    "phone": "phone|tel|call|mobile|cell|fax|handy|anruf|appel|llam|m[oó]vil",
}
LABELERS = ["pattern", "gazetteer", "context", "alone", "form"]
EM_ROUNDS = 40
CONTEXT = 40  # characters before a span in which it may be announced


def _found(text: str, stream: str, kind: str, pattern: str) -> Column:
    """Array of the matches of a pattern with the length of the text before
    each since the last one, and what stands around them."""
    pattern_sql = F.lit(pattern)
    pieces = F.split(F.col(text), pattern, -1)
    matches = F.regexp_extract_all(F.col(text), pattern_sql, F.lit(0))
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("b"),
                     F.slice(pieces, 2, F.size(matches)).alias("a")),
        lambda x, i: F.struct(
            F.lit(stream).alias("stream"), F.lit(kind).alias("kind"), i.alias("i"),
            F.length(x["b"]).cast("long").alias("gap"), x["m"].alias("text"),
            F.right(x["b"], F.lit(CONTEXT)).alias("before"), F.left(x["a"], F.lit(1)).alias("after")))
    none = F.expr("cast(array() as array<struct<stream: string, kind: string, i: int, gap: bigint, "
                  "text: string, before: string, after: string>>)")
    return F.when(F.rlike(F.col(text), F.lit(_NEEDS[kind])), rows).otherwise(none)


def _digits(text) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled and reduced: the sum ends in 0."""
    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _in(low: int, value: Column, high: int) -> Column:
    return (value >= low) & (value <= high)


def candidates(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, kind, start, end, base, ...): all matches, base or candidate, in
    code points, with the votes of the labelers and the classifier's features.

    A vote is 1, 0 or null (no opinion): the base pattern with its check; a
    gazetteer of domains, networks, issuers and calling codes; an announcing
    word before; no letter or digit at either side; the form of the number.
    """
    arrays = [_found(text, f"base {k}", k, p) for k, p in BASE.items()]
    arrays += [_found(text, f"loose {k}", k, p) for k, p in LOOSE.items()]
    rows = docs.select(F.col(row).alias("row"), F.explode(F.concat(*arrays)).alias("s")).select("row", "s.*")
    order = Window.partitionBy("row", "stream").orderBy("i")
    upto = F.sum(F.col("gap") + F.length("text")).over(order)
    rows = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("text"))
    digits, kind = F.col("digits"), F.col("kind")
    n = F.length(digits)
    rows = rows.withColumn("digits", _digits("text"))
    whole = F.regexp_replace("text", r"\[dot\]|[\[\]()]", F.when(kind == "ip", ".").otherwise(""))
    octets = F.rlike(F.regexp_replace(whole, r"\.{2,}", "."), F.lit(_OCTETS))
    card_ok = _in(13, n, 19) & F.when(_in(13, n, 19), _luhn(digits))
    form = (F.when(kind == "card", card_ok).when(kind == "phone", _in(9, n, 15))
            .when(kind == "ip", octets).otherwise(F.rlike("text", F.lit("[A-Za-z0-9]"))))
    gazetteer = (
        F.when(kind == "email", F.lower(F.regexp_extract("text", r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS))
        .when(kind == "ip", F.rlike("text", F.lit(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[^0-9]")))
        .when(kind == "card", F.rlike(digits, F.lit(ISSUERS)))
        .otherwise(F.rlike("text", F.lit(CALLING)) | F.rlike("text", F.lit(r"^\(?[2-9]"))))
    announced = F.lower("before")
    context = F.lit(None).cast("boolean")
    for k, words in ANNOUNCED.items():
        context = F.when((kind == k) & F.rlike(announced, F.lit(words)), F.lit(True)).otherwise(context)
    alone = ~F.rlike("before", F.lit(r"[\p{L}0-9_]$")) & ~F.rlike("after", F.lit(r"^[\p{L}0-9_]"))
    checked = F.when(kind == "email", F.lit(True)).otherwise(F.coalesce(form, F.lit(False)))  # e-mails have no check
    rows = rows.withColumn("base", F.col("stream").startswith("base") & checked)
    votes = {"pattern": F.col("base"), "gazetteer": gazetteer, "context": context, "alone": alone, "form": form}
    gap_marks = F.regexp_replace("text", "[A-Za-z0-9]", "")
    features = {
        "size": F.least(n, F.lit(24)).cast("string"),
        "marks": F.left(F.array_join(F.array_sort(F.array_distinct(F.split(gap_marks, ""))), ""), F.lit(6)),
        "left": F.when(F.rlike("before", F.lit(r"\p{L}$")), "letter").when(F.rlike("before", F.lit("[0-9]$")), "digit")
                 .when(F.rlike("before", F.lit(r"\s$")), "blank").when(F.col("before") == "", "start").otherwise("mark"),
        "right": F.when(F.rlike("after", F.lit(r"^\p{L}")), "letter").when(F.rlike("after", F.lit("^[0-9]")), "digit")
                  .when(F.rlike("after", F.lit(r"^\s")), "blank").when(F.col("after") == "", "end").otherwise("mark"),
        "lead": F.left(digits, F.lit(1)),
        "said": F.coalesce(context, F.lit(False)).cast("string"),
    }
    return rows.select("row", "kind", "stream", "start", "end", "base",
                       *[v.cast("int").alias(f"v_{c}") for c, v in votes.items()],
                       *[f.alias(f"f_{c}") for c, f in features.items()])


FEATURES = ["size", "marks", "left", "right", "lead", "said"]


def reliabilities(patterns: list[tuple]) -> dict[tuple, float]:
    """(kind, votes) -> probability that the span is personal data.

    ``patterns``: (kind, votes, number of spans). For each kind expectation-
    maximisation estimates how often each labeler votes 1 on true and on other
    spans, and the share of true ones, from the votes alone; it starts from
    the share of positive votes, with one span of doubt in each estimate.
    """
    out = {}
    for kind in {p[0] for p in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        belief = {v: (sum(x == 1 for x in v) + 0.5) / (sum(x is not None for x in v) + 1) for v, _ in rows}
        for _ in range(EM_ROUNDS):
            true = sum(n * belief[v] for v, n in rows)
            other = sum(n * (1 - belief[v]) for v, n in rows)
            share = min(0.99, max(0.01, (true + 0.5) / (true + other + 1)))
            rates = []
            for j in range(len(LABELERS)):
                said = [(v, n) for v, n in rows if v[j] is not None]
                a = (sum(n * belief[v] * v[j] for v, n in said) + 0.9) / (sum(n * belief[v] for v, n in said) + 1)
                b = (sum(n * (1 - belief[v]) * v[j] for v, n in said) + 0.1) / (
                    sum(n * (1 - belief[v]) for v, n in said) + 1)
                rates.append((min(a, 0.999), max(b, 0.001)))
            for v, _ in rows:
                logit = math.log(share / (1 - share))
                for x, (a, b) in zip(v, rates):
                    if x is not None:
                        logit += math.log(a / b) if x else math.log((1 - a + 1e-9) / (1 - b + 1e-9))
                belief[v] = 1 / (1 + math.exp(-max(-30, min(30, logit))))
        out |= {(kind, v): p for v, p in belief.items()}
    return out


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    if not table:
        return F.lit(default)
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def find_private_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``private_data``: array of (kind, start, end, base, score).

    Base spans (see BASE, with the check of the kind) are all there. Other
    candidates - numbers that fail a check, written-out addresses, numbers
    without a country - are there if the classifier gives them a half or more
    and no base span overlaps them. The labelers' votes are counted by pattern
    over all documents, the reliabilities are estimated from the counts (at
    most 3 ** 5 patterns of a kind), and a naive Bayes classifier of the span's
    own features is trained on all spans with the estimated probabilities as
    weights. Order: by kind as in KINDS, then start. Null and empty texts have
    none; an empty table gives an empty table; repeated rows are each
    returned; a column named ``private_data`` is replaced.
    """
    docs = docs.drop("private_data")
    row = fresh(docs, "row_no")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    spans = stored(candidates(numbered, row, text), "spans")
    votes = [f"v_{c}" for c in LABELERS]
    counted = spans.groupBy("kind", *votes).agg(F.count("*").alias("n")).collect()
    belief = reliabilities([(r["kind"], tuple(r[v] for v in votes), r["n"]) for r in counted])
    key = F.concat_ws(" ", "kind", *[F.coalesce(F.col(v).cast("string"), F.lit("-")) for v in votes])
    table = {" ".join([k, *("-" if x is None else str(x) for x in v)]): p for (k, v), p in belief.items()}
    believed = spans.withColumn("belief", _lookup(key, table, 0.5))

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f_{c}").alias("value"))
                                for c in FEATURES])).alias("f")
    sums = believed.select("kind", "belief", pairs).groupBy("kind", "f.feature", "f.value").agg(
        F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no")).collect()
    total = {}
    for r in sums:
        yes, no, values = total.get((r["kind"], r["feature"]), (0.0, 0.0, 0))
        total[r["kind"], r["feature"]] = yes + r["yes"], no + r["no"], values + 1
    weights, prior = {}, {}
    for r in sums:
        yes, no, values = total[r["kind"], r["feature"]]
        weights[f"{r['kind']} {r['feature']} {r['value']}"] = (
            math.log((r["yes"] + 0.5) / (yes + 0.5 * values)) - math.log((r["no"] + 0.5) / (no + 0.5 * values)))
        prior[r["kind"]] = math.log((yes + 0.5) / (no + 0.5))
    logit = _lookup(F.col("kind"), prior, 0.0)
    for c in FEATURES:
        logit = logit + _lookup(F.concat_ws(" ", "kind", F.lit(c), f"f_{c}"), weights, 0.0)
    scored = spans.withColumn("score", 1 / (1 + F.exp(-logit)))

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(0, Window.unboundedFollowing)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    begin = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(begin, F.col("end")) >= F.col("end"))
    kept = scored.withColumn("clear", clear).where(F.col("base") | (F.col("clear") & (F.col("score") >= 0.5)))
    place = F.array_position(F.lit(KINDS), F.col("kind")).cast("int")
    span = F.struct(place.alias("place"), "start", "end", "kind", "base", "score")
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("s")).select(
        F.col("row").alias(row),
        F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                            x["base"].alias("base"), x["score"].alias("score"))).alias("private_data"))
    none = F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, "
                  "base: boolean, score: double>>)")
    return numbered.join(per_row, row, "left").withColumn(
        "private_data", F.coalesce("private_data", none)).select(*docs.columns, "private_data")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
