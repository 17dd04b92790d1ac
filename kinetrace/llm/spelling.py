"""Spelling variants by a symmetric-delete join.

Words are counted by document in workers and summed up by Spark. Every counted word then emits itself and its distinct
single deletions as 64-bit keys; words that share a key meet in an equi-join, and those exactly one insertion, deletion
or replacement apart are near. Each word's form is its commonest near word, if that is common enough, and forms are
followed to their roots by joins whose number grows as the logarithm of the longest chain.

Keys travel as numbers beside the word's number: a word of n code points emits n + 1 short rows, never n copies of itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, DIVISOR, TIMES = 5, 3, 97, 2
#: Distinct words that a worker holds before it passes its counts on.
HELD = 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PRIME = (1 << 61) - 1
_BASE = 1_000_003 * 911_382_323 % _PRIME


def garbled(key: str, run: str, divisor: int = DIVISOR) -> str:
    """The run, or without one code point where the checksum of ``key:run`` is a multiple of the divisor."""
    import zlib

    h = zlib.crc32(f"{key}:{run}".encode())
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def partial_counts(df: DataFrame, key: str, text: str, least_length: int, divisor: int) -> DataFrame:
    """word, n: counts of parts of the rows. A worker holds one text's runs and at most ``HELD`` words besides."""

    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa

        find = re.compile(RUN.replace("+", f"{{{least_length},}}")).findall  # shorter runs can't grow
        crc, total = zlib.crc32, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                found = Counter(find(t.as_py().encode().translate(_LOWER).decode()))
                start = crc(f"{i}:".encode())
                odd = [w for w in found if not crc(w.encode(), start) % divisor]
                for w in odd:
                    n, short = found.pop(w), garbled(i, w, divisor)
                    if len(short) >= least_length:
                        total[short] += n
                total.update(found)
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    return df.select(F.coalesce(df[key].cast("string"), F.lit("null")).alias("id"), text_of(df, text).alias("t")).mapInArrow(run, "word string, n long")


def deletion_keys(words: DataFrame) -> DataFrame:
    """key, id, lo, hi of every word of (id, word): itself (lo -1) and its distinct single deletions.

    Deleting any code point from lo to hi, a run of equal ones, gives the same key. Keys are polynomial hashes, so a
    word's deletions cost one pass over it; equal strings have equal keys, and what else shares one is sorted out later.
    """

    def keys(word: str):
        codes = [ord(c) + 1 for c in word]
        ahead, behind, power = [0], [0], [1]
        for c in codes:
            ahead.append((ahead[-1] * _BASE + c) % _PRIME)
            power.append(power[-1] * _BASE % _PRIME)
        for k, c in enumerate(reversed(codes)):
            behind.append((behind[-1] + c * power[k]) % _PRIME)
        n, i = len(codes), 0
        yield (ahead[n] + n) % _PRIME, -1, -1
        while i < n:
            j = i
            while j + 1 < n and codes[j + 1] == codes[i]:
                j += 1
            yield (ahead[i] * power[n - 1 - i] + behind[n - 1 - i] + n - 1) % _PRIME, i, j
            i = j + 1

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            rows = []
            for i, w in zip(batch.column("id").to_pylist(), batch.column("word"), strict=True):
                for k, lo, hi in keys(w.as_py()):
                    rows.append((k, i, lo, hi))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "id", "lo", "hi"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "id", "lo", "hi"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, lo int, hi int")


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side that grows with the words: never broadcast, though Spark sizes words by their compressed files, and keys by the words they are made of."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, word_a, n_a, word_b, n_b of words exactly one insertion, deletion or replacement apart, in both orders.

    Two words that share a key are near only if one is the key itself or both lost a code point at the same place, so the
    join itself leaves out transpositions and the like; each near pair shares one such key. What is left differs from the
    near pairs by collisions of keys, and the exact distance removes those. A key's words differ from it by one code
    point, so a key has at most (its length + 1) times the alphabet of them.
    """
    keys = deletion_keys(words)
    other = keys.select("key", F.col("id").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    same_place = (F.col("lo") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi"))
    one_is_key = (F.col("lo") < 0) != (F.col("lo_b") < 0)
    met = keys.join(by_shuffle(other), "key").filter((F.col("id") < F.col("b")) & (one_is_key | ((F.col("lo") >= 0) & (F.col("lo_b") >= 0) & same_place)))
    # a collision may repeat a near pair's key, so pairs are made distinct before they are counted
    pairs = met.select(F.col("id").alias("a"), "b").distinct()
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = pairs.join(by_shuffle(side("a")), "a").join(by_shuffle(side("b")), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1)
    flipped = [F.col(f"{c}{x}").alias(f"{c}{y}") for x, y in (("b", "a"), ("a", "b")) for c in ("", "word_", "n_")]
    return pairs.unionByName(pairs.select(*flipped))


def roots(forms: DataFrame) -> DataFrame:
    """id, root of (id, form_id): what is reached by following forms. Each round doubles the steps; only rows on the way join again."""
    todo = cut(forms.select("id", F.col("form_id").alias("at"), F.lit(False).alias("ends")), "spelling-hops")
    done = todo.filter("ends")
    while not todo.isEmpty():
        hops = todo.unionByName(done).select(F.col("id").alias("at"), F.col("at").alias("next"))  # an ended row hops to its root
        step = cut(todo.join(by_shuffle(hops), "at", "left").select("id", F.coalesce("next", "at").alias("at"), F.col("next").isNull().alias("ends")), "spelling-hops")
        done, todo = done.unionByName(step.filter("ends")), step.filter("NOT ends")
    return done.select("id", F.col("at").alias("root"))


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, divisor: int = DIVISOR, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word.

    Null text has no words; rows that repeat count again; a null key reads ``null`` in the checksum. An empty table, or one
    without counted words, gives an empty result; extra columns are ignored. Ties of the largest n go to the word that is
    smallest in code-point order. A form has at least twice the word's count, so that chains have no cycles.
    """
    counts = partial_counts(df, key, text, least_length, divisor).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    words = cut(cut(counts, "spelling-counts").withColumn("id", F.monotonically_increasing_id()), "spelling-words")  # numbers stand in the written table
    near = near_pairs(words).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("neg"), F.col("word_b").alias("form"), F.col("b").alias("form_id"))).alias("best"), F.first("n_a").alias("own"))
    fits = F.col("best.neg") <= -times * F.col("own")
    near = cut(near.select("id", "n_near", *[F.when(fits, c).alias(a) for c, a in ((F.col("best.form"), "form"), (F.col("best.form_id"), "form_id"), (-F.col("best.neg"), "form_n"))]), "spelling-near")
    ends = roots(near.filter("form_id IS NOT NULL"))
    named = ends.join(by_shuffle(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    out = words.join(by_shuffle(near), "id", "left").join(by_shuffle(named), "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def reference_sql() -> str:
    """DuckDB SQL: checksums byte by byte, near words by their strings with one place left out, chains by recursion."""
    crc = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        crc.append(c)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS x FROM r),
b AS (SELECT doc_id, run, n, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::INT::BIGINT) AS bytes FROM x),
h AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, ({crc}::BIGINT[])[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS h FROM b),
g AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM g WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
q AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS s FROM q),
p AS (
  SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.i = b.i AND a.l = b.l AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word FROM k a JOIN w b ON a.l || a.s = b.word UNION SELECT b.word, a.word FROM k a JOIN w b ON a.l || a.s = b.word
),
c AS (SELECT a AS word, b AS form, o.n AS n, m.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m.n DESC, b) AS place FROM p JOIN w o ON o.word = a JOIN w m ON m.word = b),
f AS (SELECT w.word, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n FROM w LEFT JOIN c ON c.word = w.word AND place = 1),
t AS (SELECT word, word AS top, 0 AS steps FROM f UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON f.word = t.top WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(top, steps) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN e USING (word)"""
