"""Near-duplicates by SimHash with pivot distance tables.

Distances of every fingerprint to many reference fingerprints are tabled once. Where fingerprints meet, a pair whose
coordinates differ by more than the limit anywhere is discarded by the triangle inequality, and survivors are verified
by their own distance. Pivot distances can narrow a search but not deal it over tasks, so pairs meet in one of two ways:

- at a few bits, under the values of bit groups: two fingerprints within DISTANCE bits agree in at least
  GROUPS - DISTANCE of GROUPS groups, so no pair is lost;
- at a shingle similarity (``similar``), under bands of smallest shingle hashes; then survivors are verified further by
  sketches of their shingle sets.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

BITS, DISTANCE, GROUPS = 64, 3, 6
#: Reference fingerprints of the distance tables.
PIVOTS = 32
#: Members of one meeting place beyond which it is split.
MEETING = 20_000
#: Fingerprints compared with each other at a time.
TILE = 1024
#: For a shingle similarity: bands and hashes in each (0.8 meets with odds of 0.997), bits within which shingle sets of
#: 0.8 stay but for odds of 1e-5, and 4-bit values of a sketch, whose estimate has a deviation of 0.018 at 0.8. Links
#: start SLACK below the similarity asked for.
BANDS, ROWS, WIDE, SKETCH, SLACK = 8, 3, 22, 512, 0.015


def shingle_hashes(text: str, shingle: int, seed: int):
    """XXH64 of each shingle (big-endian unsigned), repeats included. ASCII lower case, ASCII white space."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.frombuffer(digest(joined, seed) if words else b"", ">u8")
    lengths = np.fromiter(map(len, words), "i8", len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[shingle - 1 :].tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)]), ">u8")


def fingerprint(hashes) -> int:
    """Bits that over half of the hashes have set; 0 without any."""
    import numpy as np

    ones, step = np.zeros(BITS, "i8"), 1 << 16
    for i in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[i : i + step].view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@cache
def _draws():
    """Odd multipliers of the bands, and for each round the bin that every empty bin asks; the same in every worker."""
    import numpy as np

    return np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1), np.random.default_rng(13).integers(0, SKETCH, (256, SKETCH))


def sketch(hashes):
    """Of a set of hashes: BANDS band keys, and SKETCH 4-bit values, each of the smallest hash of a bin (empty bins borrow).

    Both come from the set alone: the share of equal values estimates the sets' similarity. No hashes count as one of 0.
    """
    import numpy as np

    h = np.unique(hashes.astype("u8")) if len(hashes) else np.zeros(1, "u8")
    odd, lenders = _draws()
    with np.errstate(over="ignore"):
        spread = h ^ (h >> np.uint64(29))
        least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
        for i in range(0, len(h), 1 << 14):
            least = np.minimum(least, np.multiply.outer(odd, spread[i : i + (1 << 14)]).min(1))
        keys = np.zeros(BANDS, "u8")
        for k in range(ROWS):
            keys = (keys ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
    bins = (h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype("i8")  # ascending, as the hashes are
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    values = np.full(SKETCH, 255, "u1")
    values[bins[first]] = (h[first] & np.uint64(15)).astype("u1")
    full = values < 255
    empty = np.nonzero(~full)[0]
    for asked in lenders:
        if not len(empty):
            break
        asked = asked[empty]
        lent = full[asked]
        values[empty[lent]] = values[asked[lent]]
        empty = empty[~lent]
    values[empty] = h[0] & np.uint64(15)  # of very small sets a few bins find no lender
    return keys.view("i8"), values[0::2] | values[1::2] << 4


def with_fingerprints(df: DataFrame, key: str, text: str, shingle: int, seed: int, sets: bool = False) -> DataFrame:
    """id, h (hash of the text, tells rows of one id apart), fp (signed long); with ``sets`` also node (one per row), bands, sketch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 40
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle, seed) for t in batch.column("t")]
            prints = np.array([fingerprint(h) for h in hashes], "u8").view("i8")
            cols = {"id": batch.column("id"), "h": batch.column("h"), "fp": pa.array(prints)}
            if sets:
                own = [sketch(h) for h in hashes]
                cols |= {"node": pa.array(np.arange(node, node + len(own))), "bands": pa.array([k for k, _ in own], pa.list_(pa.int64())), "sketch": pa.array([v.tobytes() for _, v in own], pa.binary())}
                node += len(own)
            yield pa.RecordBatch.from_pydict(cols)

    t = text_of(df, text)
    return df.select(df[key].cast("long").alias("id"), F.xxhash64(t).alias("h"), t.alias("t")).mapInArrow(run, "id long, h long, fp long" + ", node long, bands array<long>, sketch binary" * sets)


def pivot_table(prints: DataFrame) -> DataFrame:
    """With column pivots: each fingerprint's distances to PIVOTS reference fingerprints, once for all meetings."""
    import random

    r = random.Random(7)
    return prints.withColumn("pivots", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r.getrandbits(64) - 2**63))).cast("byte") for _ in range(PIVOTS)]))


def meetings(prints: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Every row under each of its meeting places: place (which groups, their bits) for every choice of groups that may agree."""
    return _places(prints, 0, (1 << BITS) - 1, distance, groups)


def _places(rows: DataFrame, fixed: int, free: int, distance: int, groups: int, which=None) -> DataFrame:
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    cuts = [round(i * len(bits) / groups) for i in range(groups + 1)]
    masks = [sum(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    chosen = [fixed | sum(m) for m in combinations(masks, groups - distance)]
    number = lambda i: F.lit(i) if which is None else F.col("which") * len(chosen) + F.lit(i)
    places = F.array(*[F.struct(number(i).cast("int").alias("which"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(chosen)])
    keep = [c for c in rows.columns if c not in ("which", "bits")]
    return rows.select(*keep, F.explode(places).alias("p")).select("p.which", "p.bits", *keep)


def _links(fps, tables, distance: int, alike=None):
    """Index pairs that join the members of one meeting place into its linked groups (a spanning forest).

    ``alike(i, j)`` verifies survivors further. Members already joined are not compared again.
    """
    import numpy as np

    n = len(fps)
    axis = int(np.argmax(tables.std(axis=0)))  # the pivot that spreads this place most orders it
    order = np.argsort(tables[:, axis], kind="stable")
    fps, tables = fps[order], tables[order]
    first = tables[:, axis]
    group, out = np.arange(n), []
    for a in range(0, n, TILE):
        last = int(np.searchsorted(first, first[min(a + TILE, n) - 1] + distance, "right"))
        for b in range(a, last, TILE):
            x, y = slice(a, min(a + TILE, n)), slice(b, min(b + TILE, last))
            i, j = np.nonzero((np.abs(first[x, None] - first[None, y]) <= distance) & (group[x, None] != group[None, y]))
            keep = i + a < j + b
            i, j = i[keep] + a, j[keep] + b
            for k in range(PIVOTS):  # maximum coordinate difference, coordinate by coordinate
                stay = np.abs(tables[i, k] - tables[j, k]) <= distance
                i, j = i[stay], j[stay]
            true = np.bitwise_count(fps[i] ^ fps[j]) <= distance
            i, j = i[true], j[true]
            while len(i):  # one member against all that survived beside it
                head, own = i[0], j[: np.searchsorted(i, i[0], "right")]
                i, j = i[len(own) :], j[len(own) :]
                if alike is not None:
                    own = own[alike(order[head], order[own])]
                if len(own):
                    groups, at = np.unique(group[own], return_index=True)
                    out += [(order[head], order[q]) for q in own[at]]
                    group[np.isin(group, groups)] = group[head]
                    apart = group[i] != group[j]
                    i, j = i[apart], j[apart]
    return out


def links(prints: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, similar: float | None = None) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly those reachable over links.

    ``prints`` has node, fp, pivots; for a similarity also bands and sketch. A crowded place of bit groups is met again
    under groups of the bits that are still free, so that work stays in proportion to its members; a crowded band is
    split into chunks, of which each pair meets.
    """
    sets = similar is not None
    met = prints.select(F.posexplode("bands").alias("which", "bits"), "node", "fp", "pivots", "sketch") if sets else meetings(prints.select("node", "fp", "pivots"), distance, groups)
    crowd = met.groupBy("which", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEETING)
    crowd = cut(crowd.select("which", "bits", F.ceil(F.col("n") / (MEETING / 2)).cast("int").alias("chunks")), "simhash-crowds")
    plain = [F.lit(0).alias("c"), F.lit(0).alias("d")]
    if crowd.isEmpty():
        met = met.select("*", *plain)
    else:
        met = met.join(small(crowd), ["which", "bits"], "left")
        calm, met = met.filter("chunks IS NULL").drop("chunks").select("*", *plain), met.filter("chunks IS NOT NULL")
        if sets:
            own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
            met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            met = met.withColumn("c", F.least("own", "other")).withColumn("d", F.greatest("own", "other")).drop("own", "other", "chunks")
        else:
            met = met.drop("chunks")
            again, bits = None, [1 << i for i in range(BITS)]
            cuts = [round(i * BITS / groups) for i in range(groups + 1)]
            masks = [sum(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for i, m in enumerate(combinations(masks, groups - distance)):  # by choice of groups: each has other free bits
                part = _places(met.filter(F.col("which") == i), sum(m), ((1 << BITS) - 1) ^ sum(m), distance, groups, which=i)
                again = part if again is None else again.unionByName(part)
            met = again.withColumn("which", F.col("which") + 1000).select("*", *plain)
        met = calm.unionByName(met)

    def join(batches):
        import numpy as np
        import pyarrow as pa

        names = ["which", "bits", "c", "d"]
        held = None
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])

        def run(keys, node, fps, tables, marks):
            change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.concatenate([[0], np.nonzero(change)[0] + 1, [len(fps)]])
            a, b = [], []
            for s in np.nonzero(np.diff(starts) > 1)[0]:
                own = slice(starts[s], starts[s + 1])
                alike = None
                if sets:
                    mark = marks[own]

                    def alike(i, j, mark=mark):
                        other = mark[i] ^ mark[j]
                        share = ((other & 15 == 0).sum(1) + (other >> 4 == 0).sum(1)) / SKETCH
                        return (share - 1 / 16) * 16 / 15 >= similar - SLACK

                for p, q in _links(fps[own], tables[own], distance, alike):
                    a.append(int(node[own][p]))
                    b.append(int(node[own][q]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = [batch.column(x).to_numpy() for x in names], batch.num_rows
            values = [batch.column("node").to_numpy(), batch.column("fp").to_numpy().view("u8"), batch.column("pivots").flatten().to_numpy().reshape(n, PIVOTS)]
            values.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "u1").reshape(n, SKETCH // 2) if sets else np.zeros(n, "u1"))
            if held is not None:
                keys, values = ([np.concatenate(x) for x in zip(h, now, strict=True)] for h, now in zip(held, (keys, values), strict=True))
            # the last place may go on in the next batch; a place has few members, as crowded ones are split
            same = np.all([k == k[-1] for k in keys], axis=0)
            tail = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                yield run([k[:tail] for k in keys], *(v[:tail] for v in values))
            held = [k[tail:] for k in keys], [v[tail:] for v in values]
        yield run(held[0], *held[1]) if held is not None else empty

    by = ["which", "bits", "c", "d"]
    return met.repartition(*by).sortWithinPartitions(*by).mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges reaches.

    Every round points each node at its smallest neighbour, follows the pointers twice and contracts; nodes that stay
    in the edges at least halve, so rounds grow as the logarithm of the largest component. Each round's tables are
    written to the shared folder.
    """
    edges = cut(edges.filter("a <> b"), "cc-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
        to = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "cc-to")
        hop = lambda t: t.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        to = cut(hop(hop(to)), "cc-hop")
        if roots is None:
            roots = to
        else:
            roots = cut(roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("x")), to.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = cut(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(df: DataFrame, key: str, text: str, shingle: int, seed: int, distance: int, groups: int, similar: float | None) -> DataFrame:
    """One row per input row: id, h, fp, root (names the component), component_id."""
    rows = cut(with_fingerprints(df, key, text, shingle, seed, similar is not None), "simhash-prints")
    if similar is not None:
        prints = cut(pivot_table(rows.select("node", "fp", "bands", "sketch")), "simhash-pivots")
        rows = rows.select("id", "h", "fp", "node")
        roots = components(links(prints, WIDE, similar=similar))
        linked = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = linked.groupBy("root").agg(F.min("id").alias("component_id"))
        return linked.join(best, "root").select("id", "h", "fp", "root", "component_id")
    prints = cut(pivot_table(rows.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least")).withColumn("fp", F.col("node"))), "simhash-pivots")
    roots = components(links(prints, distance, groups))
    linked = prints.select("node", "fp", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "fp"))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(linked.select("fp", "root").join(best, "root"), "fp").select("id", "h", "fp", "root", "component_id")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, distance: int = DISTANCE, groups: int = GROUPS, similar: float | None = None) -> DataFrame:
    """One row per input row: key, h, fp, component_id (smallest key reachable over links, itself included).

    Links are of ``distance`` bits or, if ``similar`` is given, of that Jaccard similarity of the shingle sets, by
    estimate. Null text is the empty text, fingerprint zero, linked like any other. A null key is reached but never
    named while its component has another key. Repeated rows each get a row. An empty table gives an empty result;
    extra columns are ignored.
    """
    return _rooted(df, key, text, shingle, seed, distance, groups, similar).select(F.col("id").alias(key), "h", "fp", "component_id")


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42, distance: int = DISTANCE, groups: int = GROUPS, similar: float | None = 0.8) -> DataFrame:
    """One row of each component: smallest key, nulls last, then text hash; same columns.

    By default texts link from a similarity of 0.8 of their sets of five-word shingles. Components are told apart by
    their root: keys may be null or repeat over unlike texts.
    """
    rooted = _rooted(df, key, text, shingle, seed, distance, groups, similar).groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    keep = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")).alias("k"))
    keep = cut(keep.select(F.col("k.id").alias("keep_id"), F.col("k.h").alias("keep_h"), F.col("k.n").alias("n")), "simhash-keep")
    rows = df.select(df[key].cast("long").alias("id"), F.xxhash64(text_of(df, text)).alias("h"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    one = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))).select("id", "h", "n", "row")
    if not keep.filter("n > 1").isEmpty():  # rows that repeat key and text: any one of them
        w = Window.partitionBy("id", "h").orderBy("id")
        one = one.filter("n = 1").unionByName(one.filter("n > 1").withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i"))
    return one.select("row.*")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, fingerprint (16 lowercase hex digits), component_id."""
    g = near_groups(df, key, text, **options)
    return g.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
