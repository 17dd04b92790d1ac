"""License scans, spelling variants and source divergence: brute force, planted cases, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetrace.llm import divergence, licenses, signatures, spelling

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "All rights reserved. CC-BY 4.0, " * 3000


def table(spark, texts):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, found string, w int").withColumn("id", F.lit("y")).withColumn("rules", F.lit(2))


# --- license scans


def scan_plain(text, rules=licenses.RULES):
    words = re.findall(licenses.WORDS, (text or "").translate(AZ))
    spaced = " " + "  ".join(words) + " "
    found = []
    for r in rules:
        for m in re.finditer(r.regex, spaced):
            start = spaced[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2, r))
    rank = lambda d: (d[2].tier, d[1] - d[0], -d[2].number)
    stands = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and rank(b) > rank(a) for b in found)]
    base = [d for d in found if d[2].base]
    join = lambda ds: ",".join(sorted({d[2].label for d in ds}))
    score = max((signatures.CONFIDENCE[d[2].tier] for d in stands), default=0.0)
    return len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), join(base), join([*base, *stands]), score


LICENSE_TEXTS = [
    None, "", "...", "no words of that kind", "Licensed under CC BY-NC 4.0.", "cc by cc-by CC\nBY x cc", "the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0 OR MIT",
    "Alle Rechte vorbehalten. mit Lizenz", "TOUS DROITS RÉSERVÉS", "ccé by, cc éby, 0cc by", "All rights\nreserved ALL RIGHTS RESERVED", "http://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-sa/4.0/",
    "either version 3 of the License: GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "general public licence, General Public License", "Copyright (c) 2020 by X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the MIT License.",
]


def test_license_rules_against_loops(spark):
    r = random.Random(3)
    vocabulary = "cc by nc sa nd 4 0 3 2 general public license licence gnu gpl version all rights reserved the mit apache bsd clause under licensed copyright c 2019 or later lesser x é".split()
    texts = [*LICENSE_TEXTS, *(" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 120))) for _ in range(150))]
    got = {x.doc_id: x for x in licenses.report(table(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == scan_plain(t), (t, got[i])


def test_license_suppression():
    label = lambda t: scan_plain(t)[5]
    assert label("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0,licensed"
    assert label("GNU Lesser General Public License version 2.1") == "gpl,lgpl-2.1"  # the base phrase stays
    assert label("under the Apache License, Version 2.0") == "apache-2.0" and label("nothing here") == ""


def test_license_odd_rows(spark):
    d = table(spark, [(None, LONG), (None, LONG), (1, "cc by"), (1, "cc by")])
    got = licenses.report(d).collect()
    assert sorted((x.doc_id is None, x.n_base, x.last_word) for x in got) == [(False, 1, 0), (False, 1, 0), (True, 6000, 20996), (True, 6000, 20996)]
    assert licenses.report(d.limit(0)).count() == 0


# --- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def variants_plain(texts):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w, c in n.items():
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * c else None
        out[w] = [form, c, len(close), None if form is None else n[form]]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return out


def test_spelling_against_loops(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    r = random.Random(8)
    words = ["colour", "color", "colours", "kolour", "Straße", "strasse", "straßen", "naïve", "naive", "aaaaa", "aaaaaa", "aaaab", "abcde", "abced", "bcdef", "Éclair", "éclair", "xyzzy", "xyzz", "b" * 300, "b" * 301, "b" * 150 + "c" + "b" * 150]
    chain = ["chaina", "chainab", "chainabc", "chainabcd", "chainabcde", "chainabcdef", "chainabcdefg"]
    texts = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(120)]
    texts += [(1000 + k, f"{w}. " * (3 * 2**k)) for k, w in enumerate(chain)] + [(None, "nulls nulls nulls"), (5, None), (6, ""), (7, "123 ..."), (8, "xyzzy1xyzzy_xyzzy")]
    got = {x.word: [x.form, x.n, x.n_near, x.form_n, x.root] for x in spelling.variants(table(spark, texts)).collect()}
    want = variants_plain(texts)
    assert got == want
    assert got["chaina"][4] == "chainabcdefg" and got["chaina"][0] == "chainab"


def test_spelling_empty_and_repeats(spark):
    assert spelling.variants(table(spark, [(1, "abcdef")]).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, "ab cd")])).count() == 0
    assert [tuple(x) for x in spelling.variants(table(spark, [(2, "letters"), (2, "letters"), (2, "letters")])).collect()] == [("letters", None, "letters", 3, 0, None)]


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Every side grows with the words, and Spark takes keys to be as many as the words they are made of; not even small ones are broadcast."""
    plans, cut = [], spelling.cut

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "cut", lambda df, name: cut(ran(df), name))
    rows = ran(spelling.variants(table(spark, [(i, "chaina chainab chainab chainabc chainabc chainabc chainabc") for i in range(9)]))).collect()
    assert {x.word: x.root for x in rows} == dict.fromkeys(("chaina", "chainab", "chainabc"), "chainabc")
    joins = [plan.count("Join") for plan in plans]
    assert sum(joins) >= 7 and not any("Broadcast" in plan for plan in plans)


def test_deletion_keys_agree_with_strings(spark):
    rows = spark.createDataFrame([(0, "abbc"), (1, "abc"), (2, "abbbc"), (3, "éé")], "id long, word string")
    keys = {}
    for x in spelling.deletion_keys(rows).collect():
        keys.setdefault(x.key, set()).add((x.id, x.lo, x.hi))
    assert {frozenset(v) for v in keys.values() if len(v) > 1} == {frozenset({(0, -1, -1), (2, 1, 3)}), frozenset({(1, -1, -1), (0, 1, 2)})}
    assert sum(map(len, keys.values())) == (1 + 3) + (1 + 3) + (1 + 3) + (1 + 1)


# --- source divergence


def audit_plain(rows, least=3, top=200):
    docs, counts, groups, out = Counter(), Counter(), set(), {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(divergence.TERM, (text or "").translate(AZ))
        groups.add((lang, source))
        docs.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    for lang in {g for g, _ in groups}:
        kept = sorted(t for g, t in docs if g == lang and docs[g, t] >= least)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(n[s]) for s in sources}, share({t: sum(n[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            out[lang, s, "pair"] = sorted(((-sum(f(p[s][t], p[x][t]) for t in kept), x) for x in sources if x != s))
            out[lang, s, "term"] = sorted((-f(p[s][t], q[t]), t) for t in kept if n[s][t] and p[s][t] > q[t])[:top]
    return {(*g, item, -v, k + 1) for g, items in out.items() for k, (v, item) in enumerate(items)}


SCHEMA = "lang string, source string, text string, t int, value string"


@pytest.mark.parametrize("width", [None, 64])
def test_divergence_against_loops(spark, monkeypatch, width):
    """Whatever the sketch discards or lets through, results are the same; a narrow one only lets more through."""
    if width:
        monkeypatch.setattr(divergence, "sketch_width", lambda rows: width)
    monkeypatch.setattr(divergence, "HELD", 40)
    r = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "été", "ÉTÉ", "x"]
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "", "é"]), " ".join(r.choices(vocabulary, k=r.randint(0, 40)))) for _ in range(150)]
    rows += [("lone", "only", "one text of its own"), ("bare", "a", None), ("bare", "b", ""), ("en", "empty", None), ("en", "big", "bulk Word-bulk " * 4000), ("en", "s1", "same same"), ("en", "s1", "same same"), ("en", "s2", "same")]
    d = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA)
    got = divergence.audit(d, top=20).collect()
    assert {tuple(x) for x in got} == audit_plain(rows, top=20) and len(got) == len(audit_plain(rows, top=20))


def test_terms_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(chr(r.choice([r.randint(0, 127), r.randint(128, 0x2FFF), 0x85, 0xA0, 0x2028, 0x1F600])) for _ in range(60))
        assert [x.decode() for x in divergence.terms_of(t)] == re.findall(divergence.TERM, t.translate(AZ))


def test_sketch_never_underestimates(spark):
    rows = [("en", "s", " ".join(f"t{chr(97 + j)}{chr(97 + i % 20)}" for j in range(26))) for i in range(300)]
    d = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA).repartition(4).withColumn("t", F.col("text"))
    import numpy as np

    for width in (64, 4096):
        held = np.frombuffer(divergence.sketch(d, width), "u1").reshape(divergence.ROWS, width)
        terms = [f"t{chr(97 + j)}{chr(97 + k)}".encode() for j in range(26) for k in range(20)]
        least = held[np.arange(divergence.ROWS)[:, None], divergence.cells("en", terms, width)].min(axis=0)
        assert (least >= 15).all()
    assert (least == 15).mean() > 0.5


def test_divergence_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
