"""Exact dedup, SimHash, quality, mixing: fixtures and brute force, odd inputs included."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kinetrace.llm import exact, mixing, quality, simhash

SCHEMA = "doc_id long, text string, source string, keep_id string, row string, t int"
LONG = "word " * 30000


def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b c", "s1"), (2, "a b c", "s1"), (3, None, None), (4, "", "s2"), (5, LONG, "s2"), (6, LONG, "s2"), (7, "a b c ", "s1"), (None, "a b c", "s1"), (None, "lone", None), (9, "x", "s3"), (9, "x", "s3")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    got = exact.exact_groups(docs(spark, ROWS), keep=keep).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    best = {t: (min if keep == "min" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        assert not r.kept or r.doc_id == best[t]
    assert sum(r.kept for r in got) == len(groups)  # repeated rows and null keys: one stays


def test_exact_hot_text_is_salted(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}", "s") for i in range(3000)]
    got = exact.exact_groups(docs(spark, rows), keep="max").filter("group_size > 1").agg(F.count(F.lit(1)), F.min("keep_id"), F.sum(F.col("kept").cast("int")), F.min("group_size")).first()
    assert tuple(got) == (1000, 2997, 1, 1000)


def test_exact_splits_behind_long_shared_prefixes(spark):
    head = "the same licence stands ahead of every text " * 500
    rows = [(i, head + f"{i // 2:05d}", "s") for i in range(2000)]
    d = docs(spark, rows)
    bounds = exact.splitters(d.select(F.col("text").alias("t")), 8)
    n, part, hot = exact.deal(F.col("text"), F.lit(0), bounds)
    assert n > 4 and all(len(b) > len(head) for b, _ in bounds)
    assert max(r["count"] for r in d.groupBy(part.alias("p")).count().collect()) < 800
    got = exact.exact_groups(d).agg(F.sum(F.col("kept").cast("int")), F.min("group_size"), F.max("group_size")).first()
    assert tuple(got) == (1000, 2, 2)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_hot_rows_that_are_equal(spark, keep, monkeypatch):
    """A third of all rows are one text: without keys, under one key, and under keys of their own."""
    monkeypatch.setattr(exact, "partitions", lambda spark: 16)
    for own in (lambda i: None, lambda i: 5, lambda i: i, lambda i: i % 2):
        rows = [(own(i), "hot", "s") if i % 3 == 0 else (i, f"text {i}", "s") for i in range(1500)]
        d = docs(spark, rows)
        assert any(p > 1 for _, p in exact.splitters(d.select(F.col("text").alias("t")), 16))
        got = exact.exact_groups(d, keep=keep).filter("group_size > 1").collect()
        ids = [own(i) for i in range(0, 1500, 3) if own(i) is not None]
        assert {(r.keep_id, r.group_size) for r in got} == {((min if keep == "min" else max)(ids, default=None), 500)}
        assert sum(r.kept for r in got) == 1 and len(got) == 500
        assert exact.drop_copies(d, keep=keep).count() == 1001


def test_drop_copies_keeps_columns(spark):
    d = docs(spark, ROWS)
    assert exact.drop_copies(d).columns == d.columns
    assert exact.drop_copies(d).count() == len({t or "" for _, t, _ in ROWS})


def test_near_drop_by_shingle_similarity(spark):
    """Five-word shingle sets: pairs of 0.83 and more go, pairs below 0.72 stay, brute force over all pairs."""
    r = random.Random(4)
    texts = []
    for k in range(120):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.choice((6, 30, 120, 600)))]
        texts.append(" ".join(words))
        for _ in range(2):
            own = list(words)
            for _ in range(max(1, int(len(own) * r.choice((0.0, 0.005, 0.02, 0.03, 0.08))))):
                own[r.randrange(len(own))] = "new"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    got = [c.component_id for c in sorted(simhash.near_groups(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), shingle=5, similar=0.8).collect(), key=lambda c: c.doc_id)]
    near = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    sure = [p for p, x in near.items() if x >= 0.83]
    assert len(sure) > 60 and sum(got[i] == got[j] for i, j in sure) >= 0.98 * len(sure)
    lower = plain_components_of(range(len(texts)), [p for p, x in near.items() if x >= 0.72])
    assert all(lower[i] == lower[c] for i, c in enumerate(got))


def plain_components_of(ids, pairs):
    root = {i: i for i in ids}
    for _ in ids:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
        if not changed:
            return root


@pytest.mark.parametrize("run", [exact.exact_groups, exact.drop_copies, simhash.report, simhash.drop_near, quality.assess, quality.keep_good, mixing.mix, mixing.mixture])
def test_empty_table(spark, run):
    assert run(docs(spark, [])).count() == 0


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {id: fingerprint} -> {id: smallest id reachable}."""
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


TEXTS = ["", None, "One", "one two", "A B C d e", "a b c D e", "É a b\x0bc\u00a0d", LONG, "x y z " * 5, "x y z " * 6, *[f"the quick brown fox {i % 4} jumps over the lazy dog number {i % 7} again" for i in range(60)]]


def test_simhash_against_plain(spark):
    got = {r.doc_id: r for r in simhash.report(docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = plain_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_links_clusters_and_chains(spark):
    """Fingerprints laid out by hand: a chain of 3-bit steps, a dense cube and far strangers."""
    fps, x = [], 0x0123456789ABCDEF
    for i in range(0, 60, 3):
        fps.append(x)
        x ^= 0b111 << i
    fps += [0xFEDCBA9876543210 ^ k for k in range(128)] + [int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16) for i in range(300)]
    d = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in dict.fromkeys(fps)], "fp long")
    roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(simhash.pivot_table(d.withColumn("node", F.col("fp"))))).collect()}
    want = plain_components({i: f for i, f in enumerate(dict.fromkeys(fps))})
    order = list(dict.fromkeys(fps))
    sets = {}
    for i, r in want.items():
        sets.setdefault(r, set()).add(order[i])
    got = {}
    for f, r in roots.items():
        got.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in sets.values() if len(s) > 1)


def test_crowded_meeting_places_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEETING", 40)
    far = [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) << 3 for i in range(100)]
    d = spark.createDataFrame([(k,) for k in (*range(256), *far)], "fp long")
    assert {r.root for r in simhash.components(simhash.links(simhash.pivot_table(d.withColumn("node", F.col("fp"))))).collect()} == {0}


def test_crowded_bands_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEETING", 40)
    words = " ".join(f"w{i}" for i in range(300))
    kept = simhash.drop_near(docs(spark, [(i, f"{words} end {i}", "s") for i in range(150)] + [(900 + i, f"{i} " * 30, "s") for i in range(5)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 900, 901, 902, 903, 904]


def test_near_drop_keeps_one_of_each(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, "", "s"), (None, "null key only, and nothing like it anywhere", "s")]
    d = docs(spark, rows)
    kept = simhash.drop_near(d, shingle=3, similar=None)
    assert kept.columns == d.columns
    want = plain_components({i: plain_fingerprint(t) for i, t in enumerate(TEXTS)})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id IS NULL").count() == 1


def test_near_drop_keeps_components_of_null_and_repeated_keys(spark):
    unlike = [" ".join(hashlib.md5(f"{k} {w}".encode()).hexdigest() for w in range(30)) for k in range(12)]
    rows = [(None, t, "s") for t in unlike[:6]] + [(7, t, "s") for t in unlike[6:]] + [(None, unlike[0], "s"), (7, unlike[6], "s"), (None, unlike[7], "s")]
    kept = simhash.drop_near(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(r.text for r in kept) == sorted(unlike)
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted(unlike[6:])


def plain_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_against_plain(spark):
    texts = [*TEXTS, "a\nb\n\n \na\n a\nb" * 3, "#$ |<>é\u2028x \x1c y" * 4, "one two three four five six " * 2 + "seven eight nine ten " * 1, " ".join(map(str, range(200))), "same line here of words\n" * 20]
    got = {r.doc_id: r for r in quality.assess(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), i
        assert not (r.base_failed and r.kept)
    assert got[texts.index(" ".join(map(str, range(200))))].kept


def test_quality_hash_hits_are_compared(monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "_MULTIPLIER", 1)  # sums of words: any order collides
    assert not quality.repeated(np.array([1, 2, 3, 4, 5, 5, 4, 3, 2, 1]), 5).any()
    assert quality.repeated(np.array([1, 2, 3, 9, 1, 2, 3, 3, 2, 1]), 3).tolist() == [True] * 3 + [False] + [True] * 3 + [False] * 3


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), None if i % 10 == 9 else f"s{i % 3}") for i in range(4000)]
    got = mixing.mix(docs(spark, rows)).collect()
    total = sum(r.size for r in got)
    by = {}
    for (_, _, s), r in zip(sorted(rows), sorted(got, key=lambda r: r.doc_id), strict=True):
        by.setdefault(s, []).append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        size = sum(r.size for r in v)
        assert v[0].source_size == size and v[0].target <= 2 * size
        assert abs(sum(r.taken for r in v) - v[0].target) <= 50
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_mix_odd_rows(spark):
    got = mixing.mix(docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got)
    d = docs(spark, ROWS)
    assert mixing.mixture(d).columns == d.columns
    assert mixing.mixture(d).count() == sum(r.copies for r in got)


def test_mix_quality_odds(spark):
    rows = [(i, "w w w w", "a") for i in range(2000)]
    d = docs(spark, rows)
    got = mixing.mix(d, weights=(1,), share=0.5, quality=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    even, odd = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert 2.4 < even / odd < 3.7 and abs(even + odd - 4000) <= 4
