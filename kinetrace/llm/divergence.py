"""Source divergence audit by sketch-prefiltered counting.

A first pass over the texts builds a count-min sketch of document frequencies in every task; merged, it never
underestimates, so a term whose estimate is below the least number of documents cannot be kept and is discarded before
anything of it is shuffled. A second pass counts the survivors exactly. Sources are then compared by joins of the counts
that are there: what a pair of sources would give for terms that both lack is one number, and only differences to it are
summed.

Counters stop at 255 and the least number is at most that, so a cell is one byte and merging is a saturating sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small, text_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
ROWS = 2
#: Cells of a sketch row: at least, and at most (64 MB a row: the bound of what the driver and each worker hold).
CELLS = 1 << 16, 1 << 26
BLOCK = 1 << 15
#: Distinct terms that a worker holds before it empties its counts.
HELD = 300_000
#: Bytes of UTF-8: A-Z lower-cased, every other ASCII character that is no letter a blank.
_TERMS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The matches of ``TERM`` in UTF-8, A-Z lower-cased."""
    return text.encode().translate(_TERMS).split()


def cells(lang: str, terms: list[bytes], width: int):
    """Of each term its cell in every row, as array (rows, terms)."""
    import numpy as np
    import xxhash

    head = lang.encode() + b"\0"
    h = np.fromiter((xxhash.xxh64_intdigest(head + t) for t in terms), "u8", len(terms))
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(r) * step) % np.uint64(width) for r in range(ROWS)]).astype("i8")


def sketch_width(rows: DataFrame) -> int:
    """A power of two, about two to four cells for each distinct term that texts of this size hold (12 * bytes ** 0.63), within ``CELLS``.

    Beyond the upper bound the sketch discards less; results never depend on the width.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    return min(max(1 << int(12 * total**0.63).bit_length(), CELLS[0]), CELLS[1])


def sketch(rows: DataFrame, width: int) -> bytes:
    """The merged count-min sketch of (lang, t): ``ROWS`` rows of ``width`` one-byte counters, at most 128 MB."""

    def add(batches):
        from collections import Counter, defaultdict

        import numpy as np
        import pyarrow as pa

        held, seen = np.zeros((ROWS, width), "u1"), defaultdict(Counter)

        def empty():
            for lang, counts in seen.items():
                n = np.fromiter(counts.values(), "i8", len(counts))
                for row, at in zip(held, cells(lang, list(counts), width), strict=True):
                    more = np.bincount(at, n, width) if len(at) > width // 8 else None
                    if more is None:
                        here, back = np.unique(at, return_inverse=True)
                        row[here] = np.minimum(row[here] + np.bincount(back, n), 255)
                    else:
                        row[:] = np.minimum(row + more, 255)
            seen.clear()

        for batch in batches:
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t"), strict=True):
                seen[lang].update(set(terms_of(t.as_py())))
                if len(seen[lang]) > HELD:
                    empty()
        empty()
        blocks = held.reshape(-1, min(BLOCK, width))
        used = np.nonzero(blocks.any(axis=1))[0]
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([blocks[k].tobytes()])], names=["block", "cells"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        now, total = None, None
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(raw.as_py(), "u1").astype("u2")
                if k == now:
                    total = np.minimum(total + more, 255)
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.astype("u1").tobytes()])], names=["block", "cells"])
                now, total = k, more
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.astype("u1").tobytes()])], names=["block", "cells"])

    parts = rows.select("lang", "t").mapInArrow(add, "block long, cells binary")
    merged = parts.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block").mapInArrow(merge, "block long, cells binary")
    out, size = bytearray(ROWS * width), min(BLOCK, width)
    for r in merged.collect():  # at most ROWS * width bytes, whatever the input
        out[r["block"] * size : (r["block"] + 1) * size] = r["cells"]
    return bytes(out)


def partial_counts(rows: DataFrame, estimates, width: int, least: int) -> DataFrame:
    """lang, source, term, n, docs of parts of the rows: terms whose estimate is below the least are left out."""

    def run(batches):
        from collections import Counter, defaultdict

        import numpy as np
        import pyarrow as pa

        held = np.frombuffer(estimates.value, "u1").reshape(ROWS, width)
        counts, docs = defaultdict(Counter), defaultdict(Counter)
        names = ["lang", "source", "term", "n", "docs"]

        def out():
            for (lang, source), n in counts.items():
                terms = list(n)
                possible = (held[np.arange(ROWS)[:, None], cells(lang, terms, width)].min(axis=0) >= least).tolist() if terms else []
                terms = [t for t, p in zip(terms, possible, strict=True) if p]
                own = docs[lang, source]
                for k in range(0, len(terms), 20_000):
                    some = terms[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([own[t] for t in some], pa.int64())], names=names)
            counts.clear()
            docs.clear()

        size = 0
        for batch in batches:
            for lang, source, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("t"), strict=True):
                found = terms_of(t.as_py())
                n = counts[lang, source]
                size -= len(n)
                n.update(found)
                docs[lang, source].update(set(found))
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact at any size."""
    return (F.lit(1) + F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(19,0)"))).cast("long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def excess(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms are from every other source's and from its language's.

    Null text, lang and source count as empty strings. Groups without terms, and languages that keep none, still get
    their pairs. Rows that repeat count again. An empty table gives an empty result; extra columns are ignored. Ties go
    to the item smaller in UTF-8. A worker holds one text's terms, ``HELD`` counts and the sketch.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = df.sparkSession
    rows = df.select(text_of(df, lang).alias("lang"), text_of(df, source).alias("source"), text_of(df, text).alias("t"))
    width = sketch_width(rows)
    estimates = spark.sparkContext.broadcast(sketch(rows, width))
    counts = partial_counts(rows, estimates, width, least)
    # one exchange by term: a term's rows of all sources lie in one partition for the sums and the window
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("all_docs", F.sum("docs").over(term)).filter(F.col("all_docs") >= least)
    counts = counts.withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    counts = cut(counts.select("lang", "source", "term", "n", "lang_n", "first"), "divergence-counts")

    by_lang = counts.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")]).withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))), "divergence-groups")

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    placed = counts.join(small(groups), ["lang", "source"]).withColumn("p", p)
    ranked = lambda d, part, order: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    over = placed.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("p > q")
    terms = ranked(over.select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value")), "term", None).filter(F.col("rank") <= top)
    return terms.unionByName(ranked(pairs(placed, groups), "pair", None))


def pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources.

    With f0 the value of a term that both lack, the sum over all terms is terms * f0, and for terms of either source the
    difference when the other lacks it, and for terms of both what that leaves. The first differences depend on a term's
    count only, so they are summed per distinct count.
    """
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"p0_{x}"), "terms" if x == "source" else F.lit(None).alias("_")).drop("_")
    both = side("source").join(side("item"), "lang").filter(F.col("source") != F.col("item"))
    f0 = excess(F.col("p0_source"), F.col("p0_item"))
    base = both.select("lang", "source", "item", F.coalesce(F.col("terms") * f0, F.lit(0).cast("long")).alias("value"))
    steps = placed.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    bare = both.select("lang", "source", "item", "p0_source", "p0_item")
    of_source = steps.join(bare, ["lang", "source"]).select("lang", "source", "item", (F.col("times") * (excess(F.col("p"), F.col("p0_item")) - f0)).alias("value"))
    of_item = steps.withColumnRenamed("source", "item").join(bare, ["lang", "item"]).select("lang", "source", "item", (F.col("times") * (excess(F.col("p0_source"), F.col("p")) - f0)).alias("value"))
    here = placed.select("lang", "term", "source", F.col("p").alias("ps"), F.col("p0").alias("p0_source"))
    there = placed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pi"), F.col("p0").alias("p0_item"))
    shared = here.join(there, ["lang", "term"]).filter(F.col("source") != F.col("item"))
    rest = excess(F.col("ps"), F.col("pi")) - excess(F.col("ps"), F.col("p0_item")) - excess(F.col("p0_source"), F.col("pi")) + f0
    shared = shared.select("lang", "source", "item", rest.alias("value"))
    sums = [d.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for d in (base, of_source, of_item, shared)]
    out = sums[0]
    for d in sums[1:]:
        out = out.unionByName(d)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def reference_sql(least: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL on the dense table of groups and kept terms."""
    share = lambda c, n: f"1 + ({SCALE}::HUGEINT * ({c} + 1)) // ({n} + v)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {least}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL), ls AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL), lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "coalesce(s.n, 0)")} AS p
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
q AS (SELECT k.lang, k.term, {share("lc.n", "ls.n")} AS q FROM k JOIN lc USING (lang, term) JOIN ls USING (lang) JOIN l USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""
