"""License scans by ordered signature rules.

Hundreds of hand-written patterns (``signatures``) run over a text's words. A text's distinct words fetch the rules that
they could satisfy, so most texts run none. Of overlapping detections, one whose interval lies inside that of another is
suppressed if the other has the higher priority: a higher tier, then more words, then the earlier rule.
Everything is row-local DataFrame expressions: no shuffle, and no row leaves the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pii import count_below, latest_end, let, running
from .signatures import CONFIDENCE, Rule, rules

#: Words of the contract in texts whose A-Z are lower-cased, and what lies between words.
WORDS, GAPS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = tuple(rules())
RULE = "array<struct<number:int,label:string,tier:int,base:boolean,regex:string,needs:array<array<string>>>>"
FOUND = "array<struct<start:long,neg_end:long,number:int,end:long,tier:int,label:string,base:boolean>>"


def words_in(spaced: Column) -> Column:
    """Words of a text in which each stands between two blanks of its own."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def fetched(words: Column, by_word: Column) -> Column:
    """The rules whose needs are all among the words, each once."""
    lists = F.transform(words, lambda w: F.coalesce(F.try_element_at(by_word, w), F.from_json(F.lit("[]"), RULE)))
    return F.array_distinct(F.filter(F.flatten(lists), lambda r: F.forall(r["needs"], lambda n: F.arrays_overlap(n, words))))


def places(spaced: Column, rule: Column) -> Column:
    """Leftmost non-overlapping matches of one rule as word intervals: ends are running sums over gaps and matches."""
    ends = lambda m, g: running(F.transform(m, lambda x, i: words_in(F.get(g, i)) + words_in(x)), lambda a, b: a + b)

    def place(m: Column, e: Column) -> Column:
        fields = lambda x, end: F.struct((end - words_in(x)).alias("start"), (-end).alias("neg_end"), rule["number"].alias("number"), end.alias("end"), *[rule[k].alias(k) for k in ("tier", "label", "base")])
        return F.transform(m, lambda x, i: fields(x, F.get(e, i)))

    some = lambda m: let(F.split(spaced, rule["regex"], -1), lambda g: let(ends(m, g), lambda e: place(m, e)))
    return let(F.regexp_extract_all(spaced, rule["regex"], F.lit(0)), lambda m: F.coalesce(F.when(F.size(m) > 0, some(m)), F.array().cast(FOUND)))


def standing(found: Column) -> Column:
    """The detections that no other suppresses.

    Within a tier, sorted by start, then the longer, then the earlier rule, one is suppressed if an earlier one reaches as
    far. Of higher tiers, the latest end among those that start no later decides. So the work is that of sorting.
    """

    def of_tier(tier: Column) -> Column:
        own = F.array_sort(F.filter(found, lambda d: d["tier"] == tier))
        above = F.array_sort(F.filter(found, lambda d: d["tier"] > tier))
        inner = lambda own, ends: F.filter(own, lambda d, i: F.coalesce(F.get(ends, i - 1), F.lit(-1)) < d["end"])
        kept = let(own, lambda s: F.when(F.size(s) > 0, let(latest_end(s), lambda ends: inner(s, ends))).otherwise(s))
        free = lambda s, starts, ends: F.filter(s, lambda d: F.coalesce(F.get(ends, count_below(starts, d["start"] + 1) - 1), F.lit(-1)) < d["end"])
        outer = lambda s, a: let(F.transform(a, lambda d: d["start"]), lambda starts: let(latest_end(a), lambda ends: free(s, starts, ends)))
        return let(kept, lambda s: let(above, lambda a: F.when((F.size(a) > 0) & (F.size(s) > 0), outer(s, a)).otherwise(s)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(CONFIDENCE) - 1)), of_tier))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", signatures: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: key, n_words, ``found`` (every detection) and ``standing`` (those that no other suppresses).

    Detections have start and end in words (from 0, end exclusive), tier, label and whether their phrase is a base one.
    Null text has no words and no detections. Repeated rows each get a row, null keys too; an empty table gives an empty
    result; extra columns are ignored. A text's words are held while its row is worked on.
    """
    by_word: dict[str, list] = {}
    for r in signatures:
        for word in r.needs[0]:
            by_word.setdefault(word, []).append({"number": r.number, "label": r.label, "tier": r.tier, "base": r.base, "regex": r.regex, "needs": r.needs})
    index = F.from_json(F.lit(json.dumps(by_word)), f"map<string,{RULE}>")
    gate = F.array(*[F.lit(w) for w in sorted({w for r in signatures for n in r.needs for w in n})])
    # lower() goes beyond A-Z, which moves no word's end and can only let more words through the gate
    rows = df.select(df[key].alias("id"), text_of(df, text).alias("t"))
    rows = rows.select("id", "t", F.split(F.lower("t"), GAPS).alias("w"))
    outer = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1).otherwise(0)
    rows = rows.select("id", "t", (F.size("w") - outer).cast("long").alias("n_words"), F.array_intersect("w", gate).alias("hits"))
    rows = rows.select("id", "t", "n_words", F.when(F.size("hits") > 0, fetched(F.col("hits"), index)).alias("rules"))
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(WORDS), F.lit(0)), "  "), F.lit(" "))
    detections = let(spaced, lambda t: F.flatten(F.transform("rules", lambda r: places(t, r))))
    none = F.array().cast(FOUND)
    rows = rows.select("id", "n_words", F.when(F.size("rules") > 0, detections).otherwise(none).alias("found"))
    return rows.select(F.col("id").alias(key), "n_words", "found", F.when(F.size("found") > 0, standing(F.col("found"))).otherwise(none).alias("standing"))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", signatures: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score: base places and the labels that stand.

    ``score`` is the worth of the best detection that stands, 0 without any.
    """
    d = scan(df, key, text, signatures).withColumn("b", F.filter("found", lambda x: x["base"]))
    starts, worth = F.transform("b", lambda x: x["start"]), F.array(*map(F.lit, CONFIDENCE))
    label = lambda c: F.transform(c, lambda x: x["label"])
    best = F.array_max(F.transform("standing", lambda x: x["tier"]))
    score = F.coalesce(F.get(worth, best), F.lit(0.0))
    return d.select(key, "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(label("b")).alias("base_labels"), joined(F.concat(label("b"), label("standing"))).alias("labels"), score.alias("score"))


def reference_sql(signatures: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL that runs every rule on every text and compares all pairs of a text's detections."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({r.number}, {quote(r.label)}, {r.tier}, {r.base}, {quote(r.regex)})" for r in signatures)
    worth = ", ".join(map(str, CONFIDENCE))
    return rf"""
WITH r AS (SELECT * FROM (VALUES {values}) v(number, label, tier, base, regex)),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
t AS (SELECT i, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
m AS (SELECT i, number, label, tier, base, regexp_extract_all(t, regex) AS m, string_split_regex(t, regex) AS g FROM t, r WHERE regexp_matches(t, regex)),
u AS (SELECT i, number, label, tier, base, unnest(range(1, len(m) + 1)) AS k, m, g FROM m),
p AS (SELECT i, number, label, tier, base, k, len(m[k]) - len(replace(m[k], ' ', '')) AS own, len(g[k]) - len(replace(g[k], ' ', '')) AS gap FROM u),
e AS (SELECT *, (sum(own + gap) OVER (PARTITION BY i, number ORDER BY k) // 2)::BIGINT AS stop, (own // 2)::BIGINT AS n FROM p),
f AS (SELECT i, number, label, tier, base, stop - n AS start, stop FROM e),
x AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.i = b.i AND b.start <= a.start AND b.stop >= a.stop
  AND (b.tier > a.tier OR b.tier = a.tier AND (b.stop - b.start > a.stop - a.start OR b.stop - b.start = a.stop - a.start AND b.number < a.number)))),
b AS (SELECT i, count(*) AS n, min(start) AS first, max(start) AS last, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM f WHERE base GROUP BY i),
l AS (SELECT i, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT i, label FROM x UNION ALL SELECT i, label FROM f WHERE base) GROUP BY i),
s AS (SELECT i, max(tier) AS tier FROM x GROUP BY i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first AS first_word, b.last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  coalesce(([{worth}]::DOUBLE[])[s.tier + 1], 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (i) LEFT JOIN l USING (i) LEFT JOIN s USING (i)"""
