"""Personal data by candidate gradient boosting.

Base patterns give spans of their own. High-recall generators propose further, overlapping candidates (obfuscated
addresses, numbers inside longer runs, national phone formats, IPv6); boosted trees score each from its format and
context, and a threshold per kind, calibrated on held-out examples, selects what is redacted besides. Everything but
the fit is DataFrame expressions: positions come from the gaps between matches, so a row never leaves the JVM.

Limits of the generators: local parts of 64 and labels of 63 characters, four labels behind an obfuscated sign, IPv6 in
full or with one run of zeros left out, card numbers of 13 to 19 digits. What lies beyond is found by base patterns only.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, threshold
from .common import text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns, possessive where no match can depend on giving back (no recursion on long runs).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

PROPOSED = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({<]\x20?(?:dot|\.)\x20?[\])}>]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4})",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?|00[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
WORDS = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)[^0-9]{0,16}$",
    "ip": r"(?i)(?:\bip|addr|host|server|client|from)[^0-9]{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)[^0-9]{0,16}$",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|cell|whatsapp|t[ée]l[ée]phone|telefon|tel[ée]fono)[^0-9]{0,16}$",
}
#: What comes before numbers that name no person.
OTHER_WORDS = r"(?i)(?:version|\bv|token|\bkey|\bid|hash|serial|order|isbn|invoice|page|section|release|build|article)[^0-9]{0,8}$"
NEAR = 24

FEATURES = ("kind", "valid", "digits", "groups", "plus", "parens", "dots", "dashes", "spaces", "bracketed", "word", "other_word", "tight_left", "tight_right", "same_digit", "hex_like")


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start, text, before, after>> of leftmost non-overlapping matches, in code points.

    Starts are running sums of gap and match lengths.
    """
    kind = "array<struct<start:long,text:string,before:string,after:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column, g: Column, ends: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).cast("long").alias("start"), x.alias("text"), F.right(F.get(g, i), F.lit(NEAR)).alias("before"), F.left(F.get(g, i + 1), F.lit(NEAR)).alias("after")))

    def all_ends(m: Column, g: Column) -> Column:
        return running(F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long")), lambda a, b: a + b)

    placed = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: let(all_ends(m, g), lambda e: place(m, g, e)))))
    return F.coalesce(F.when(guard, placed), F.array().cast(kind))


def running(values: Column, join) -> Column:
    """Running totals of array<long> from 0, over blocks of 256, so that the work stays nearly in proportion to the values."""

    def within(steps: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
        return F.aggregate(steps, zero, lambda s, x: let(join(s["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(s["all"], y).alias("all"))), lambda s: s["all"])

    blocks = let(values, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(s) - 1) / 256).cast("int"), F.lit(0))), lambda b: F.slice(s, b * 256 + 1, 256)))
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), join)
    shift = lambda b, tops: F.flatten(F.transform(b, lambda x, i: let(F.coalesce(F.get(tops, i - 1), F.lit(0).cast("long")), lambda t: F.transform(within(x), lambda e: join(e, t)))))
    return let(blocks, lambda b: let(within(F.transform(b, total)), lambda tops: shift(b, tops)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(12, 19), digits).otherwise("1"))


def octets_fit(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, text: Column) -> Column:
    """Whether a base match of the kind stands."""
    digits = digits_of(text)
    if kind == "ip":
        return octets_fit(text)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def span(kind: str, m: Column, **more: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["text"])).cast("long").alias("end"), *[v.alias(k) for k, v in more.items()])


def features(kind: str, m: Column) -> Column:
    t, digits = m["text"], digits_of(m["text"])
    ok = {
        "email": t.rlike(r"(?i)[^A-Za-z0-9](?:com|org|net|edu|gov|io|info|[a-z]{2})$"),
        "ip": F.when(F.contains(t, F.lit(":")), F.lit(True)).otherwise(octets_fit(t)),
        "card": luhn(digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]
    has = lambda p: t.rlike(p)
    values = (
        F.lit(KINDS.index(kind)), ok, F.length(digits), F.size(F.split(t, r"[^0-9A-Za-z]+")), has(r"^(?:\+|00)"), has(r"[()]") & F.lit(kind == "phone"), has(r"\."), has(r"-"), has(r"\x20"), has(r"[\[({<]"),
        m["before"].rlike(WORDS[kind]), m["before"].rlike(OTHER_WORDS), m["before"].rlike(r"[A-Za-z0-9_.:=\"#/-]$"), m["after"].rlike(r"^[A-Za-z0-9_:=\"/-]"), digits.rlike(r"^(.)\1*$"), t.rlike("[A-Fa-f]") & F.lit(kind != "email"),
    )
    return F.array(*[v.cast("double") for v in values])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def count_below(sorted_starts: Column, value: Column) -> Column:
    """How many of an ascending array<long> are below a value, by halving."""
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(sorted_starts, mid(s)) < value, pair(mid(s) + 1, s["hi"])).otherwise(pair(s["lo"], mid(s)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), pair(F.lit(0), F.size(sorted_starts)), step, lambda s: s["lo"])


def latest_end(spans: Column) -> Column:
    """Of spans by start: the largest end so far."""
    return running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def clusters(spans: Column) -> Column:
    """Of spans by start: array of arrays that overlap nothing outside themselves."""
    starts = lambda s, ends: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
    cut = lambda s, at: F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a))
    found = lambda s: F.when(F.size(s) > 0, let(latest_end(s), lambda ends: let(starts(s, ends), lambda at: cut(s, at)))).otherwise(F.slice(F.array(s), 1, 0))
    return let(spans, found)


def examples(seed: int = 11, each: int = 300) -> list[tuple[str, int, int]]:
    """Labelled texts (text, kind, label), ``each`` per kind and label: the bounded training table."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))

    def card(good: bool) -> str:
        body = r.choice(("4", "51", "34", "6011")) + n(11)
        body = body[:15] if r.random() < 0.8 else body[:14]
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        check = (-total) % 10
        return body + str(check if good else (check + r.randint(1, 9)) % 10)

    def grouped(d: str) -> str:
        return r.choice((" ", "-", ".", "")).join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else d

    said = {0: ("mail", "write to", "contact:"), 1: ("server", "host", "ip"), 2: ("card", "visa", "credit card"), 3: ("call", "tel.", "phone")}
    aside = ("version", "token", "serial", "order", "id", "build", "section", "hash")
    out = []
    for kind in range(4):
        for label in (1, 0):
            for _ in range(each):
                if kind == 0:
                    at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" (at) ", " (dot) ")))
                    local, host = r.choice((word() + "." + word(), word(), word() + n(2), word()[0] + "." + word(), f"{word()[0]}.{word()[0]}.{word()}", word() + "_" + word())), r.choice((word(), word(), word() + "-" + word(), word() + "-" + word()[:2]))
                    body = f"{local}{at}{host}{dot}{r.choice(('com', 'org', 'net', 'edu', 'io', 'de', 'fr', 'es', 'uk', 'jp', 'nl', 'it'))}" if label else r.choice((f"{word()} at {word()} dot {word()}", f"{word()} (at) {word()}.{word()}", f"{word()}[at]{word()}. {word()}"))
                elif kind == 1:
                    body = ":".join("%x" % r.randint(0, 65535) for _ in range(8)) if label else r.choice((f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(256, 999)}.{r.randint(0, 999)}", ":".join("%02d" % r.randint(0, 59) for _ in range(8))))
                    if r.random() < 0.3:
                        body = ".".join(str(r.randint(0, 255)) for _ in range(4)) if label else "%s::%s" % tuple(r.choice(("face", "bad", "add", "dead", "cafe", "beef", "fade", "ab")) for _ in range(2))
                    elif label and r.random() < 0.4:
                        body = "::".join(":".join("%x" % r.randint(16, 65535) for _ in range(r.randint(1, 3))) for _ in range(2))
                elif kind == 2:
                    body = grouped(card(bool(label))) if r.random() < 0.9 else f"{card(bool(label))} {n(16)}"
                else:
                    body = r.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"{n(3)}.{n(3)}.{n(4)}")) if label else r.choice((f"{n(2)} {n(3)} {n(3)}", f"{n(4)}-{n(4)}", f"{n(2)}.{n(3)}.{n(3)}", f"{n(3)} {n(4)} {n(4)} {n(4)}"))
                if label:
                    before = r.choice((*said[kind], word(), word()))
                else:
                    before = r.choice((*aside, word(), word(), word()))
                if kind == 3 and label and not body.startswith(("+", "(")):
                    before = r.choice(said[kind])  # bare groups of digits are a phone number only where one is announced
                out.append((f"{word()} {before} {body} {word()}", kind, label))
    r.shuffle(out)
    return out


def candidates(text: Column) -> list[Column]:
    """Per kind, the generators' spans with features and score inputs."""
    digit = text.rlike("[0-9]")
    guards = {"email": text.rlike(r"(?i)[\[({<\x20](?:at|@)[\])}>\x20]"), "ip": digit, "card": digit, "phone": digit}

    def of(kind: str) -> Column:
        return F.transform(matches(text, PROPOSED[kind], guards[kind]), lambda m: span(kind, m, features=features(kind, m)))

    return [of(k) for k in KINDS]


_fitted: dict[tuple, tuple[Boosted, dict[int, float]]] = {}


def fit(spark: SparkSession, precision: float = 0.98, seed: int = 11, each: int = 300) -> tuple[Boosted, dict[int, float]]:
    """Model and thresholds from ``examples``: two thirds fit the trees, one third calibrates a threshold per kind."""
    key = precision, seed, each
    if key not in _fitted:
        rows = spark.createDataFrame(examples(seed, each), "text string, kind int, label int").coalesce(1)
        rows = rows.select("kind", "label", F.flatten(F.array(*candidates(F.col("text")))).alias("c"))
        rows = rows.select("kind", "label", F.explode(F.filter("c", lambda c: c["kind"] == F.col("kind"))).alias("c")).select("kind", "label", "c.features").collect()
        kind, y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
        held = np.arange(len(y)) % 3 == 0
        model = Boosted().fit(x[~held], y[~held])
        p = model.probability(x[held])
        _fitted[key] = model, {k: max(0.5, threshold(p[kind[held] == k], y[held][kind[held] == k], precision)) for k in range(len(KINDS))}
    return _fitted[key]


def find(df: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.98) -> DataFrame:
    """One row per input row: key, base and added spans as array<struct<start, kind, end>>, each by start, then kind.

    Spans are code points, end exclusive. An added span overlaps no base span and no added span of a higher score.
    Null text is empty. Repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
    """
    model, cuts = fit(df.sparkSession, precision)
    t = F.col("t")
    rows = df.select(df[key].alias("id"), text_of(df, text).alias("t"))
    digit = t.rlike("[0-9]")
    guard = {k: F.contains(t, F.lit(NEEDS[k])) & digit if k != "email" else F.contains(t, F.lit("@")) for k in KINDS}

    def standing(kind: str) -> Column:
        return F.transform(F.filter(matches(t, BASE[kind], guard[kind]), lambda m: valid(kind, m["text"])), lambda m: span(kind, m))

    base = [standing(k) for k in KINDS]
    rows = rows.select("id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*candidates(t)).alias("c"))

    def scored(c):
        limit = F.element_at(F.array(*[F.lit(cuts[k]) for k in range(len(KINDS))]), c["kind"] + 1)
        p = model.column(lambda k: F.get(c["features"], F.lit(k)))
        return F.struct((-p).alias("order"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), (p >= limit).alias("passes"))

    # of base spans that start before a candidate ends, the latest end tells whether one reaches into it
    reach = lambda starts, ends: F.filter("c", lambda c: F.coalesce(F.get(ends, count_below(starts, c["end"]) - 1), F.lit(0)) <= c["start"])
    free = let(F.transform("base", lambda b: b["start"]), lambda starts: let(latest_end(F.col("base")), lambda ends: reach(starts, ends)))
    passing = F.filter(F.transform(free, scored), lambda c: c["passes"])
    by_start = F.array_sort(F.transform(passing, lambda c: F.struct(*[c[k].alias(k) for k in ("start", "end", "order", "kind")])))
    bare = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    ranked = lambda cluster: F.array_sort(F.transform(cluster, lambda c: F.struct(*[c[k].alias(k) for k in ("order", "start", "kind", "end")])))
    best = lambda cluster: F.aggregate(ranked(cluster), none, lambda a, c: F.when(F.exists(a, lambda b: overlaps(b, c)), a).otherwise(F.array_append(a, bare(c))))
    added = F.when(F.size("c") > 0, F.flatten(F.transform(clusters(by_start), best))).otherwise(none)
    return rows.select(F.col("id").alias(key), "base", F.array_sort(added).alias("added"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.98) -> DataFrame:
    """The input with every found span, base and added, replaced by its kind in brackets; same columns.

    Spans that overlap become one, under the kind of the first. Null text stays null.
    """
    row = F.struct(*[df[c] for c in df.columns])
    found = find(df.select(row.alias("row"), df[text].alias("text")), "row", "text", precision)
    merged = lambda spans: F.transform(clusters(spans), lambda c: F.struct(c[0]["start"].alias("start"), c[0]["kind"].alias("kind"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end")))
    spans = found.select("row", merged(F.array_sort(F.concat("base", "added"))).alias("s"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(f"row.{text}")
    parts = F.transform("s", lambda s, i: F.concat(F.substr(t, (F.coalesce(F.get("s", i - 1)["end"], F.lit(0)) + 1).cast("int"), (s["start"] - F.coalesce(F.get("s", i - 1)["end"], F.lit(0))).cast("int")), F.element_at(names, s["kind"] + 1)))
    clean = F.when(F.size("s") > 0, F.concat(F.array_join(parts, ""), F.substr(t, (F.get("s", F.size("s") - 1)["end"] + 1).cast("int")))).otherwise(t)
    return spans.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    found = find(df, key, text, **options)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select(key, *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"))

