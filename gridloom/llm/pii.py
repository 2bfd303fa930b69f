"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how reliable
each is, and a span classifier is trained on the result. DataFrame expressions only.

Candidates are the base patterns' matches (e-mail, IP address, card, phone) and looser ones: obfuscated e-mails, IPv6,
card-like numbers whose check digit fails, phone numbers without a country code. Five labelers vote yes, no or
nothing: the strict pattern, a gazetteer (top-level domains, calling codes, issuer ranges, plausible first octets), the words before the
span, its neighbouring letters, its digits' variety. The corpus is reduced to counts of patterns of votes and features
(a bounded number, whatever its size), on which EM fits a prior for each kind and a confusion table for each labeler, and
a logistic span classifier learns the posteriors from kind and votes and from features that no labeler sees: length,
separators, and what stands on either side. Base spans always stay; others are added where the classifier gives
``ACCEPT`` or more and they overlap no base span.

The patterns use possessive loops and ask that a match starts a run, or where the last match ended: the same matches
as the plain patterns, without their quadratic time on long runs or their deep recursion. Positions, overlaps and the
redacted text come from running sums and extremes in chunks of the square root of the spans' number (``running``).

Null or empty text: no spans. Positions count code points. A very long text is one row as any other. Repeated rows are
judged each. Ties: equal starts can't occur within a kind; across kinds the kinds' order decides. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import documents, materialize, table

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?=[{LOCAL}])(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    # Only whole runs of 13 to 19 digits: shorter or longer ones would be dropped.
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[A-Za-z0-9._%+-]{{2,64}}\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{{2,63}}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{{2,24}}|\.[A-Za-z]{{2,24}})",
    "ip": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?=[(0-9])(?<![0-9+.-])(?<!\+1\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])",
}
#: What a text must contain, one of these, before a pattern is tried.
NEEDS = {("email", False): "@", ("phone", False): "+", ("email", True): "[(", ("ip", True): ":"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|int|io|info|biz|de|fr|es|uk|eu|us|it|nl|ch|at|be|pl|se|no|dk|fi|pt|jp|cn|in|br|ca|au|mx|ru|kr"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|61|62|63|64|65|66|81|82|84|86|90|91|92|98|351|352|353|358|380|420|421|852|886|971|972"
ISSUERS = "3[47]|30[0-5]|36|38|4|5[1-5]|2[2-7]|6011|64|65|35"
WORDS = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach|correo|courriel|kontakt)\W{0,6}(?:\w+\W+){0,3}$",
    "ip": r"(?i)(?:\bip|address|host|server|login|connect|from)\W{0,6}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\W{0,6}(?:\w+\W+){0,3}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone|contact)\W{0,6}(?:\w+\W+){0,3}$",
}
LABELERS = ["strict", "gazetteer", "context", "neighbours", "variety"]
#: What the classifier sees besides: length class, separators, and the class of the letters before and after.
FEATURES = ["size", "separators", "before", "after"]
ACCEPT = 0.9
ROUNDS = 60


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def strict(kind: str, text: Column) -> Column:
    """Whether a base match passes its check."""
    if kind == "ip":
        return text.rlike(OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def votes(kind: str, base: Column, loose: bool, text: Column, left: Column, right: Column) -> list[Column]:
    """The labelers' votes in their order: 1 yes, -1 no, 0 nothing."""
    number = digits(text)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    if kind == "email":
        known = F.lower(text).rlike(rf"(?:\.|dot[\])]\x20?)(?:{DOMAINS})$")
    elif kind == "ip":
        known = ~text.rlike(r"^(?:0|2[4-5][0-9])\.")
    elif kind == "card":
        known = number.rlike(f"^(?:{ISSUERS})")
    else:
        known = F.when(text.startswith("+"), number.rlike(f"^(?:{CALLING})")).otherwise(number.rlike("^[2-9][0-9]{2}[2-9]"))
    return [
        F.lit(0) if loose else F.when(base, 1).otherwise(-1),  # a failed check speaks against the span
        vote(known, ~known),
        vote(left.rlike(WORDS[kind]), F.lit(False)),
        vote((left == "") | left.rlike(r"[\s|:(>]$"), left.rlike(r"[A-Za-z0-9_.\"=-]$") | right.rlike(r"^[A-Za-z0-9_\"]")),
        vote(F.length(F.array_join(F.array_distinct(F.split(text, "")), "")) >= 6, number.rlike(r"^([0-9])\1*$")),
    ]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), 0)


def running(values: Column, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or extremes: ``merge`` is associative, ``zero`` its neutral value) of an array of integers. An array
    grows by copies, so it is worked on in chunks of the square root of its length."""
    empty = F.expr("CAST(array() AS array<int>)")

    def prefix(x: Column) -> Column:
        start = F.struct(empty.alias("out"), F.lit(zero).alias("at"))
        return F.aggregate(x, start, lambda s, v: let(merge(s["at"], v), lambda at: F.struct(F.concat(s["out"], F.array(at)).alias("out"), at.alias("at"))), lambda s: s["out"])

    def whole(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / wide).cast("int")), lambda j: prefix(F.slice(x, j * wide + 1, wide)))
        return let(parts, lambda p: let(prefix(F.transform(p, lambda q: F.element_at(q, -1))), lambda tops: F.flatten(F.transform(p, lambda q, i: F.transform(q, lambda v: F.when(i == 0, v).otherwise(merge(F.get(tops, i - 1), v)))))))

    return let(values, lambda x: F.when(F.size(x) == 0, empty).otherwise(whole(x)))


def matches(kind: str, regex: str, loose: bool) -> Column:
    """All spans that a pattern finds in ``text``, with their votes: an array of structs. The text is matched again, for
    what lies between the matches, only where there are any."""
    text = F.col("text")
    side = lambda x: F.when(x == "", 0).when(x.rlike(r"^\s"), 1).when(x.rlike(r"^\w"), 2).otherwise(3).cast("tinyint")

    def spans(m: Column, p: Column, end: Column) -> Column:
        def span(found: Column, i: Column) -> Column:
            base = F.lit(False) if loose else strict(kind, found)
            left, right = F.right(F.get(p, i), F.lit(40)), F.left(F.get(p, i + 1), F.lit(4))
            marks = [v.cast("tinyint").alias(n) for n, v in zip(LABELERS, votes(kind, base, loose, found, left, right))]
            size = F.least(F.length(found).cast("int") / 8, F.lit(4)).cast("tinyint")
            separators = F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(5)).cast("tinyint")
            own = [size, separators, side(F.right(F.get(p, i), F.lit(1))), side(right)]
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (F.get(end, i) - F.length(found)).alias("start"), F.get(end, i).alias("end"), base.alias("base"), *marks, *[c.alias(n) for n, c in zip(FEATURES, own)])

        return F.transform(m, span)

    def placed(m: Column, p: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        return let(running(steps, 0, lambda a, b: a + b), lambda end: spans(m, p, end))

    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, regex, -1), lambda p: placed(m, p))))
    need = NEEDS.get((kind, loose))
    if need:
        there = F.lit(False)
        for letter in need:
            there = there | F.contains(text, F.lit(letter))
        found = F.when(there, found)
    return found


SPAN = "struct<kind:int,start:int,end:int,base:boolean," + ",".join(f"{n}:tinyint" for n in [*LABELERS, *FEATURES]) + ">"


def every_span() -> Column:
    """All spans that any pattern finds in ``text``."""
    every = [matches(k, BASE[k], False) for k in KINDS] + [matches(k, LOOSE[k], True) for k in LOOSE]
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    return F.flatten(F.array(*[F.coalesce(x, none) for x in every]))


def parted(name: str = "all") -> Column:
    """Of a column of spans, the ``base`` spans and the ``loose`` candidates that overlap none of them: no base span that
    starts before ends after their start, and none that starts after starts before their end."""
    last = 2**31 - 1

    def apart(x: Column) -> Column:
        ordered = F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))

        def free(o: Column) -> Column:
            ends = running(F.transform(o, lambda e: F.when(e["s"]["base"], e["s"]["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
            starts = F.reverse(running(F.transform(F.reverse(o), lambda e: F.when(e["s"]["base"], e["at"]).otherwise(last)), last, lambda a, b: F.least(a, b)))
            marked = lambda before, after: F.transform(o, lambda e, i: F.struct(e["s"].alias("s"), (~e["s"]["base"] & (F.get(before, i) <= e["at"]) & (F.get(after, i) >= e["s"]["end"])).alias("free")))
            return let(ends, lambda before: let(starts, lambda after: F.transform(F.filter(marked(before, after), lambda e: e["free"]), lambda e: e["s"])))

        return let(ordered, free)

    all_ = F.col(name)
    base, loose = F.filter(all_, lambda s: s["base"]), F.filter(all_, lambda s: ~s["base"])
    return F.struct(base.alias("base"), F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(apart(all_)).alias("loose"))


class SpanModel:
    """What EM and the logistic fit leave: weights by feature value."""

    def __init__(self, patterns: dict[tuple, int]):
        """``patterns``: (kind, votes..., features...) and how often it was seen."""
        self.reliability, posterior = em(patterns)
        self.weights = logistic(patterns, posterior)

    def score(self, span: Column) -> Column:
        total = F.lit(self.weights.get(("bias", 0), 0.0))
        for name in ["kind", *LABELERS, *FEATURES]:
            known = {v: w for (n, v), w in self.weights.items() if n == name}
            value = F.lit(0.0)
            for v, w in sorted(known.items()):
                value = F.when(span[name] == v, F.lit(w)).otherwise(value)
            total = total + value
        return 1 / (1 + F.exp(-total))


def em(patterns: dict[tuple, int]) -> tuple[dict, dict[tuple, float]]:
    """Priors by kind and P(vote | truth) by labeler, and each pattern's posterior."""
    post = {p: 0.95 if p[1] == 1 else 0.5 if p[1] == 0 and sum(p[1:6]) > 1 else 0.05 for p in patterns}
    table: dict = {}
    for _ in range(ROUNDS):
        yes, all_ = defaultdict(float), defaultdict(float)
        seen = {t: defaultdict(float) for t in (0, 1)}
        for p, n in patterns.items():
            yes[p[0]] += n * post[p]
            all_[p[0]] += n
            for i, v in enumerate(p[1:6]):
                if v:  # a labeler that says nothing says nothing about the truth
                    seen[1][i, v] += n * post[p]
                    seen[0][i, v] += n * (1 - post[p])
        prior = {k: (yes[k] + 1) / (all_[k] + 2) for k in all_}
        # A yes is likelier for what is personal data: the labelers' smoothing says so, which also fixes which class is which.
        smooth = {(t, v): 4.0 if v == (1 if t else -1) else 1.0 for t in (0, 1) for v in (-1, 1)}
        chance = {}
        for t in (0, 1):
            for i in range(len(LABELERS)):
                total = sum(seen[t][i, v] + smooth[t, v] for v in (-1, 1))
                for v in (-1, 1):
                    chance[t, i, v] = (seen[t][i, v] + smooth[t, v]) / total
        table = {"prior": prior, "chance": chance}
        fresh = {}
        for p in patterns:
            log = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(chance[1, i, v] / chance[0, i, v]) for i, v in enumerate(p[1:6]) if v)
            fresh[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, log))))
        moved = max((abs(fresh[p] - post[p]) for p in patterns), default=0.0)
        post = fresh
        if moved < 1e-6:
            break
    return table, post


def logistic(patterns: dict[tuple, int], posterior: dict[tuple, float], steps: int = 400) -> dict[tuple, float]:
    """A ridge logistic fit of the posteriors, weighted by count, by gradient steps over the patterns."""
    names = ["kind", *LABELERS, *FEATURES]
    rows = sorted(patterns)
    keys = sorted({("bias", 0), *((n, v) for p in rows for n, v in zip(names, p))})
    at = {k: i for i, k in enumerate(keys)}
    design = np.zeros((len(rows), len(keys)))
    for r, p in enumerate(rows):
        design[r, [at["bias", 0], *(at[k] for k in zip(names, p))]] = 1
    share = np.array([patterns[p] for p in rows], float) / max(1, sum(patterns.values()))
    y = np.array([posterior[p] for p in rows])
    weights = np.zeros(len(keys))
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-np.clip(design @ weights, -40, 40))) - y) * share
        weights -= design.T @ miss + 1e-4 * weights
    return dict(zip(keys, weights.tolist()))


def train(found: DataFrame, name: str = "all") -> SpanModel:
    spans = found.select(parted(name).alias("x")).select(F.explode(F.concat("x.base", "x.loose")).alias("s"))
    rows = spans.groupBy("s.kind", *[f"s.{n}" for n in [*LABELERS, *FEATURES]]).count().collect()  # 4 x 3^5 x 5 x 6 x 4 x 4 at most
    return SpanModel({tuple(r[:-1]): r[-1] for r in rows})


def short(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def decided(model: SpanModel, name: str = "all") -> Column:
    """``base_spans`` and ``spans``: arrays of (kind, start, end), by kind as listed, then start."""

    def decide(x: Column) -> Column:
        added = F.filter(x["loose"], lambda s: model.score(s) >= ACCEPT)
        return F.struct(short(x["base"]).alias("base_spans"), short(F.concat(x["base"], added)).alias("spans"))

    return F.get(F.transform(F.array(parted(name)), decide), 0)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, base_spans, spans`` of every document."""
    docs = documents(docs)
    found = materialize(docs.select("doc_id", every_span().alias("all")), "spans")  # what follows reads the spans, not the texts
    return found.select("doc_id", decided(train(found)).alias("x")).select("doc_id", "x.base_spans", "x.spans")


def without(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in its text, and ``n_chars`` of the new text if there is such a
    column. A null text stays null."""
    name = next(n for n in ("_all", "_all_spans", "_all_spans_found") if n not in docs.columns)
    found = materialize(docs.withColumn(name, every_span()), "spans")
    model = train(found, name)
    out = found.withColumn("text", F.when(F.size(name) == 0, F.col("text")).otherwise(redact(F.col("text"), decided(model, name)["spans"])))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap are one, named by the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(heads: Column, tails: Column) -> Column:
        """``heads`` are the first spans of each run that overlaps, ``tails`` where the runs end."""

        def by(piece: Callable[[Column, Column], Column]) -> Column:
            gap = lambda h, i: let(F.when(i == 0, 0).otherwise(F.get(tails, i - 1)), lambda at: piece(at, h["start"] - at))
            parts = F.transform(heads, lambda h, i: F.concat(gap(h, i), F.get(names, h["kind"])))
            return F.concat(F.array_join(parts, ""), let(F.element_at(tails, -1), lambda at: piece(at, F.length(text) - at)))

        few = by(lambda at, n: F.substring(text, at + 1, n))  # walks from the text's start
        many = let(F.split(text, ""), lambda letters: by(lambda at, n: F.array_join(F.slice(letters, at + 1, n), "")))
        return F.when(F.size(heads) <= 64, few).otherwise(many)

    def whole(o: Column, end: Column) -> Column:
        heads = F.filter(o, lambda s, i: (i == 0) | (s["start"] >= F.get(end, i - 1)))
        tails = F.filter(end, lambda e, i: (i == F.size(o) - 1) | (F.get(o, i + 1)["start"] >= e))
        return let(heads, lambda h: let(tails, lambda t: cut(h, t)))

    def ends(o: Column) -> Column:
        return let(running(F.transform(o, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b)), lambda e: whole(o, e))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, ends))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base_spans", (lambda i: lambda s: s["kind"] == i)(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
