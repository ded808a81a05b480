"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP numbers, payment cards and phone numbers; looser patterns propose further
spans. Three labelers vote on each span: a pattern check, a gazetteer and the words before it. Expectation-
maximisation over the table of vote patterns, which has at most 4 * 2 * 27 rows, estimates how reliable each labeler
is; a logistic span classifier is trained on the estimates. Base spans stay, proposed ones need a probability of 0.5.

Patterns run over forms of the text that are as long as the text, with separators inside a span replaced by
noncharacters, so that each is a run of one character class and no match needs nested repetition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
EDGE, DOT, GAP, ODD = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
# Endings of domains, and words that announce a span.
ENDINGS = "com org net edu gov info io co de fr es uk eu us ch at it nl be ca au jp cn br in ru pl se no dk fi pt mx ar"
CUES = {
    "email": "e-?mail|mail|contact|write|adresse|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|from|adresse|servidor|serveur",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|sms|telefon|téléphone|teléfono|móvil|handy",
}
AGAINST = "version|release|isbn|issn|page|seite|section|chapter|figure|table|order|invoice|article|id"
_LOCAL, _LABEL = f"[A-Za-z0-9._%+{DOT}-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{GAP}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z]{2,10}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
SPAN = "struct<kind:int,start:long,stop:long,base:boolean,shape:int,gazetteer:int,context:int>"


def _clean(text: Column) -> Column:
    """The text without the four noncharacters used as marks; each becomes the replacement character."""
    t = F.coalesce(text, F.lit(""))
    marked = F.lit(False)
    for c in (EDGE, DOT, GAP, ODD):
        marked = marked | t.contains(c)
    return F.when(marked, F.translate(t, EDGE + DOT + GAP + ODD, "\ufffd" * 4)).otherwise(t)


def _found(text: Column, pattern: str, when: Column) -> Column:
    """(start, stop, value) of the leftmost non-overlapping matches, in code points."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", F.lit(f"{EDGE}$1{EDGE}")), EDGE, -1)
    empty = F.array().cast("array<struct<start:long,stop:long,value:string>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), empty.alias("out"))

    def step(s: Column, p: Column) -> Column:
        stop = s["at"] + F.length(p)
        one = F.array(F.struct(s["at"].alias("start"), stop.alias("stop"), p.alias("value")))
        return F.struct(stop.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.when(when, F.aggregate(pieces, state, step, lambda s: s["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    twice = F.transform(back, lambda d, k: F.when(k % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    """1, -1 or 0 (abstains)."""
    if kind == "email":
        ending = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
        return F.when(ending.isin(*ENDINGS.split()), 1).when(ending == "", -1).otherwise(0)
    if kind == "ip":
        head = F.regexp_extract(value, r"^([0-9]{1,3})\.", 1)
        return F.when(head == "", 0).when(head.cast("int").isin(0, 127) | (head.cast("int") >= 224), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)
    return F.when(_digits(value).rlike(r"^(?:\d{3}5550[0-9]{2}|0{6,}|(\d)\1{8,})"), -1).when(value.startswith("+"), 1).otherwise(0)


def _context(kind: str, text: Column, start: Column) -> Column:
    left = F.lower(F.substring(text, F.greatest(start - 24, F.lit(0)).cast("int") + 1, F.least(start, F.lit(24)).cast("int")))
    return F.when(left.rlike(rf"\b(?:{CUES[kind]})\b[^\n]{{0,12}}$"), 1).when(left.rlike(rf"\b(?:{AGAINST})\b[^\n]{{0,6}}$"), -1).otherwise(0)


def _spans(text: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    digit = text.rlike("[0-9]")
    if kind == "email":
        form, when = F.regexp_replace(text, rf"(?<={_LABEL})\.(?={_LABEL})", DOT), text.contains("@")
    elif kind == "card":
        form, when = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", GAP), digit
    else:
        form, when = text, text.contains("+") if kind == "phone" else digit

    def span(m: Column, base: bool) -> Column:
        value = F.translate(m["value"], DOT + GAP, ". ")
        shape = F.lit(1) if base else F.when(_loose_ok(kind, value), 1).otherwise(-1)
        return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(base).alias("base"), shape.alias("shape"), _gazetteer(kind, value).alias("gazetteer"), _context(kind, text, m["start"]).alias("context"))

    base = F.filter(_found(form, PATTERNS[kind], when), lambda m: _valid(kind, F.translate(m["value"], DOT, ".")))
    loose_when = {"email": text.rlike(r"[\[(](?:at|AT)[\])]"), "ip": text.contains(":"), "card": digit, "phone": digit}[kind]
    loose = _found(text, LOOSE[kind], loose_when)
    return F.concat(F.transform(base, lambda m: span(m, True)), F.transform(loose, lambda m: span(m, False))).cast(f"array<{SPAN}>")


def _loose_ok(kind: str, value: Column) -> Column:
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)) == 10
    return F.lit(True)


def candidates(docs: DataFrame, text_col: str = "text", out: str = "spans", keep_text: bool = False) -> DataFrame:
    """All columns of docs, the text only if asked for, and the candidate spans with their votes; proposed spans that
    overlap a base span fall away. A column named `out` is replaced."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != out and (keep_text or c != text_col)]
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):  # columns of docs may have any name
        mark += "_"
    src = docs.select(*keep, _clean(F.col(f"`{text_col}`")).alias(f"{mark}text"))
    per_kind = src.select(*keep, *(_spans(F.col(f"{mark}text"), k).alias(f"{mark}{k}") for k in KINDS))
    spans = F.concat(*(F.col(f"{mark}{k}") for k in KINDS))
    base = F.filter(spans, lambda s: s["base"])
    free = F.filter(spans, lambda s: ~s["base"] & ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return per_kind.select(*keep, F.concat(base, free).alias(out))


LABELERS = ["shape", "gazetteer", "context"]


def reliabilities(patterns: list[dict], rounds: int = 50) -> tuple[list[float], list[list[dict[int, float]]]]:
    """Expectation-maximisation over vote patterns {shape, gazetteer, context, n}.

    Returns for each pattern the probability that it is personal data, and for either class the votes' distribution
    by labeler. Starts from labelers that are right four times in five; counts are smoothed by one.
    """
    votes = (-1, 0, 1)
    dist = [[{-1: 0.6, 0: 0.3, 1: 0.1} for _ in LABELERS], [{-1: 0.1, 0: 0.3, 1: 0.6} for _ in LABELERS]]
    prior, post = 0.5, [0.5] * len(patterns)
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            like = [math.prod(dist[c][k][p[name]] for k, name in enumerate(LABELERS)) for c in (0, 1)]
            post[i] = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
        total = sum(p["n"] for p in patterns) + 2
        prior = (sum(q * p["n"] for q, p in zip(post, patterns, strict=True)) + 1) / total
        for c in (0, 1):
            for k, name in enumerate(LABELERS):
                mass = {v: 1 + (2.0 if (v > 0) == (c == 1) and v else 0) + sum((q if c else 1 - q) * p["n"] for q, p in zip(post, patterns, strict=True) if p[name] == v) for v in votes}
                dist[c][k] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return post, dist


def train(patterns: list[dict], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights (bias, base, labelers) on the estimated probabilities; base spans count as personal data."""
    post, _ = reliabilities(patterns)
    rows = [([1.0, float(p["base"]), *(float(p[n]) for n in LABELERS)], 1.0 if p["base"] else q, math.log1p(p["n"])) for p, q in zip(patterns, post, strict=True)]
    rows += [([1.0, 0.0, -1.0, -1.0, -1.0], 0.0, 1.0), ([1.0, 0.0, 1.0, 1.0, 1.0], 1.0, 1.0), ([1.0, 0.0, 1.0, 0.0, -1.0], 0.0, 1.0), ([1.0, 0.0, 1.0, 0.0, 0.0], 1.0, 1.0)]
    w, total = [0.0] * 5, sum(r[2] for r in rows)
    for _ in range(rounds):
        grad = [0.0] * 5
        for x, y, n in rows:
            e = n * (y - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))))
            grad = [g + e * a for g, a in zip(grad, x, strict=True)]
        w = [a + rate * g / total - 1e-4 * a for a, g in zip(w, grad, strict=True)]
    return w


def _probability(s: Column, w: list[float]) -> Column:
    z = F.lit(w[0]) + F.lit(w[1]) * s["base"].cast("double")
    for k, name in enumerate(LABELERS):
        z = z + F.lit(w[2 + k]) * s[name].cast("double")
    return 1 / (1 + F.exp(-z))


def learn(found: DataFrame, spans: str = "spans") -> list[float]:
    """Classifier weights from the candidates of all documents; the driver gets one row for each vote pattern."""
    votes = found.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.base", *(f"s.{n}" for n in LABELERS)).agg(F.count("*").alias("n"))
    return train([r.asDict() for r in votes.orderBy("kind", "base", *LABELERS).collect()])


def accepted(found: DataFrame, weights: list[float], spans: str = "spans") -> DataFrame:
    """Keeps base spans and those that the classifier takes for personal data, sorted by kind (as in KINDS) and start."""
    return found.withColumn(spans, F.array_sort(F.filter(spans, lambda s: s["base"] | (_probability(s, weights) >= 0.5))))


def personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """All columns of docs but the text, and the accepted spans.

    A null or empty text has none. Offsets are code points, the end is exclusive. Candidates are written to the shared
    folder, so that texts are searched once.
    """
    found = written(candidates(docs, text_col, out), "span-candidates")
    return accepted(found, learn(found, out), out)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans a later one counts from where the one before ends."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.element_at(names, s["kind"] + 1))
        return F.when(s["stop"] <= a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["out"], piece).alias("out")))

    done = F.aggregate(order, state, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
