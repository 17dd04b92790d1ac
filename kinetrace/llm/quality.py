"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find repeated n-grams; the rules measure the characters of words inside
them, and of repeated lines, against all word characters. Hash hits are compared word for word, so that no count
depends on the hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SYMBOLS = "#*$%&|<>"
_SPACE = "\t\n\x0b\x0c\r "
_MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Limits:
    """Shares of word characters that a kept document may have in repeated lines and in repeated n-grams by length."""

    least_words: int = 10
    repeat_words: float = 0.20
    line_chars: float = 0.30
    gram_chars: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.25), (10, 0.20))


def repeated(ids, n: int):
    """Mask of words inside n-grams that occur twice or more, the first occurrence included."""
    import numpy as np

    count = len(ids) - n + 1
    mask = np.zeros(len(ids), bool)
    if count < 2:
        return mask
    with np.errstate(over="ignore"):
        rolled = np.zeros(count, "u8")
        spread = (ids.astype("u8") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        for k in range(n):  # Horner's rule over the window, all windows at once
            rolled = rolled * np.uint64(_MULTIPLIER) + spread[k : k + count]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return mask
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), bool)
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # two n-grams share a hash: count them apart
        _, inverse, times = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True, return_counts=True)
        start = times[inverse.reshape(-1)] > 1
    else:
        start = np.zeros(count, bool)
        start[a] = True
        start[b] = True
    steps = np.zeros(len(ids) + 1, "i8")
    np.add.at(steps, np.nonzero(start)[0], 1)
    np.add.at(steps, np.nonzero(start)[0] + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str, limits: Limits = Limits()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line share, largest n-gram share over its limit."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup_lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            line_chars += len(line) - sum(map(line.count, _SPACE))
        elif line.strip(_SPACE):
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n_words)
    inside = repeated(ids, 5)
    n_repeat = int(inside.sum())
    over = 0.0
    if n_repeat:
        length = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), "i8", n_words)
        for n, most in limits.gram_chars:
            mask = inside if n == 5 else repeated(ids, n)
            over = max(over, float(length[mask].sum()) / chars / most)
    share = line_chars / chars if chars else 0.0
    failed = n_words < limits.least_words or 100 * n_repeat > round(100 * limits.repeat_words) * n_words
    kept = not failed and share <= limits.line_chars and over <= 1.0
    return n_words, chars, symbols, dup_lines, n_repeat, failed, kept, share, over


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, gram_share double"


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per input row: key and the measures of its whole text.

    Null text has no words and fails. Documents without words measure zero everywhere. Repeated rows each get a row;
    an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]
        for batch in batches:
            found = [measure(t.as_py(), limits) for t in batch.column("t")]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=["id", *names])

    rows = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("t"))
    return rows.mapInArrow(run, f"id long, {COLUMNS}").withColumnRenamed("id", key)


def keep_good(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The input without rejected rows; same columns. Null text has no words and goes; rows that repeat are judged alike; null keys don't matter."""

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: measure(t, limits)[6])

    return df.filter(good(text_of(df, text)))


def reference_sql(limits: Limits = Limits()) -> str:
    """DuckDB SQL that compares every n-gram with every other of its document."""
    parts, joins, shares = [], [], []
    for n, most in limits.gram_chars:
        parts.append(f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[p])) AS chars FROM (SELECT DISTINCT doc_id, i + k AS p FROM g{n}, (SELECT unnest(range({n})) AS k) WHERE times > 1) JOIN d USING (doc_id) GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        shares.append(f"coalesce(c{n}.chars, 0) / nullif(word_chars, 0) / {most}")
    space = "[\\x20\\x09-\\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l0 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS seen FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
l AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '{space}', '', 'g'))) AS chars FROM l0 WHERE seen > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),{",".join(parts)},
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
s AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c5.words, 0) AS n_repeat_words, coalesce(l.chars / nullif(word_chars, 0), 0) AS line_share, coalesce(greatest({", ".join(shares)}), 0) AS gram_share FROM m LEFT JOIN l USING (doc_id) {" ".join(joins)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {limits.least_words} OR 100 * n_repeat_words > {round(100 * limits.repeat_words)} * n_words AS base_failed,
  NOT (n_words < {limits.least_words} OR 100 * n_repeat_words > {round(100 * limits.repeat_words)} * n_words) AND line_share <= {limits.line_chars} AND gram_share <= 1 AS kept FROM s"""
