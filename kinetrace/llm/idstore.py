"""Token ids in binary shards with a minimal perfect hash index from document keys to places.

A shard file holds, in this order: the raw ids (unsigned, 2 bytes each where the vocabulary fits, else 4); the hash
levels' bits in blocks of 512, each behind its rank sample (the number of bits set in all blocks before); for each
hash slot the key's fingerprint (32-bit), number of documents and first document; each document's first id, and the
number of ids; the levels' sizes in blocks; a foot of 8 little-endian unsigned 64-bit integers (magic, version, bytes
per id, ids, documents, distinct keys, blocks, levels). The ids stream to the file; only 24 bytes a document are held.

A key's slot is found by at most a few probes of one block each and checked by its fingerprint, so keyed reading takes
a constant number of short reads, and no key is stored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, partitions, put_file, shared_dir, text_of
from .tokens import default_tokenizer, encoder

MAGIC, VERSION, FOOT = 0x6B74_6964_7368_6431, 3, 64
#: Bits per remaining key and level; about half of the keys settle in each level.
SPREAD = 2.0
#: Bits per block, and bytes of a block with its rank sample.
BLOCK, BLOCK_BYTES = 512, 72
#: Characters of text per shard, at most about this many beside one long document.
SHARD_CHARS = 256 << 20
#: Key that stands for null in the index.
NULL_KEY = -(2**63)


def mixed(keys, level: int):
    """A 64-bit mix (splitmix finaliser) of keys for one level."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype("u8") + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Index:
    """Minimal perfect hash over distinct keys: level by level, keys that hash alone get a bit; a slot is the bit's rank.

    ``blocks(numbers)`` reads blocks as an array of (rank, 8 words of 64 bits), so that the index may lie in a file.
    """

    def __init__(self, sizes: list[int], blocks):
        self.sizes, self.blocks = sizes, blocks

    @classmethod
    def build(cls, keys) -> Index:
        import numpy as np

        sizes, parts = [], []
        while len(keys):
            size = max(1, -(-int(SPREAD * len(keys)) // BLOCK))
            at = (mixed(keys, len(sizes)) % np.uint64(size * BLOCK)).astype("i8")
            alone = np.bincount(at, minlength=size * BLOCK) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8").reshape(size, 8))
            sizes.append(size)
            keys = keys[~alone[at]]
        table = np.zeros(sum(sizes), BLOCK_TYPE)
        if parts:
            table["bits"] = np.concatenate(parts)
            table["rank"][1:] = np.cumsum(np.bitwise_count(table["bits"]).sum(1, dtype="u8"))[:-1]
        return cls(sizes, table.__getitem__)

    def slots(self, keys):
        """Slot of each key; -1 for some keys that are not indexed. Others of those are told by their fingerprint."""
        import numpy as np

        out, left, first = np.full(len(keys), -1, "i8"), np.arange(len(keys)), 0
        for k, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mixed(keys[left], k) % np.uint64(size * BLOCK)
            block = self.blocks(first + (at // np.uint64(BLOCK)).astype("i8"))
            word, bit = ((at % np.uint64(BLOCK)) // np.uint64(64)).astype("i8"), at % np.uint64(64)
            own = block["bits"][np.arange(len(at)), word]
            hit = (own >> bit & np.uint64(1)) == 1
            before = np.where(np.arange(8) < word[:, None], np.bitwise_count(block["bits"]), 0).sum(1, dtype="u8")
            rank = block["rank"] + before + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left, first = left[~hit], first + size
        return out


#: Record types of the file.
BLOCK_TYPE = [("rank", "<u8"), ("bits", "<u8", 8)]
SLOT_TYPE = [("mark", "<u4"), ("docs", "<u4"), ("doc", "<u8")]


def fingerprints(keys):
    import numpy as np

    return (mixed(keys, 1000) & np.uint64(0xFFFFFFFF)).astype("u4")


def write_shard(out, rows: Iterable[tuple[int, bytes]], width: int = 4) -> tuple[int, int]:
    """Write one shard of (key, ids of the given width) in ascending order of keys; returns its documents and ids."""
    from array import array

    import numpy as np

    keys, starts, n = array("q"), array("Q", [0]), 0
    for key, ids in rows:
        out.write(ids)
        n += len(ids) // width
        keys.append(key)
        starts.append(n)
    distinct, first, count = np.unique(np.frombuffer(keys, "i8") if keys else np.zeros(0, "i8"), return_index=True, return_counts=True)
    index = Index.build(distinct)
    table = np.zeros(len(distinct), SLOT_TYPE)
    slots = index.slots(distinct)
    table["mark"][slots], table["docs"][slots], table["doc"][slots] = fingerprints(distinct), count, first
    blocks = sum(index.sizes)
    out.write(index.blocks(slice(0, blocks)).tobytes())
    out.write(table.tobytes())
    out.write(np.frombuffer(starts, "<u8").tobytes())
    out.write(np.array(index.sizes, "<u8").tobytes())
    out.write(np.array([MAGIC, VERSION, width, n, len(keys), len(distinct), blocks, len(index.sizes)], "<u8").tobytes())
    return len(keys), n


class Shard:
    """Keyed access to one shard file: opening reads its foot, a key's look-up a few blocks and entries."""

    def __init__(self, uri: str):
        import numpy as np

        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        self.bytes_read, end = 0, self.file.size()
        magic, version, self.width, self.ids, self.docs, self.keys, blocks, levels = map(int, np.frombuffer(self._bytes(end - FOOT, FOOT), "<u8"))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a shard of version {VERSION}: {uri}")
        sizes = np.frombuffer(self._bytes(end - FOOT - 8 * levels, 8 * levels), "<u8").astype("i8").tolist()
        self.at_blocks = self.width * self.ids
        self.at_table = self.at_blocks + BLOCK_BYTES * blocks
        self.at_starts = self.at_table + 16 * self.keys
        self.index = Index(sizes, lambda numbers: self._records(BLOCK_TYPE, self.at_blocks, numbers))
        self.held = {}

    def _bytes(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)

    def _records(self, kind: list, at: int, numbers):
        """Records of one part of the file: from memory if ``load`` put it there, else by a short read each."""
        import numpy as np

        if at in self.held:
            return self.held[at][numbers]
        size = np.dtype(kind).itemsize
        return np.frombuffer(b"".join([self._bytes(at + size * int(i), size) for i in numbers]), kind)

    def load(self) -> Shard:
        """Hold the index in memory, for one that reads most of the keys."""
        import numpy as np

        for kind, at, n in ((BLOCK_TYPE, self.at_blocks, (self.at_table - self.at_blocks) // BLOCK_BYTES), (SLOT_TYPE, self.at_table, self.keys), ("<u8", self.at_starts, self.docs + 1)):
            self.held[at] = np.frombuffer(self._bytes(at, np.dtype(kind).itemsize * n), kind)
        return self

    def find(self, keys):
        """First document and number of documents of each key; 0 documents where the key is absent (a stranger passes with odds of one in 2**32)."""
        import numpy as np

        keys = np.asarray(keys, "i8")
        slots = self.index.slots(keys)
        first, docs, known = np.zeros(len(keys), "i8"), np.zeros(len(keys), "i8"), np.nonzero(slots >= 0)[0]
        entries = self._records(SLOT_TYPE, self.at_table, slots[known])
        right = entries["mark"] == fingerprints(keys[known])
        first[known[right]], docs[known[right]] = entries["doc"][right], entries["docs"][right]
        return first, docs

    def read(self, doc: int) -> tuple[int, bytes]:
        """First id (counted in the shard) and 32-bit ids of a document."""
        import numpy as np

        start, stop = map(int, self._records("<u8", self.at_starts, np.array([doc, doc + 1])))
        raw = self._bytes(self.width * start, self.width * (stop - start))
        return start, raw if self.width == 4 else np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def get(self, key: int | None, turn: int = 0) -> bytes | None:
        """32-bit ids of a key's document, ``turn`` picking among several; None beyond them or for an absent key."""
        first, docs = self.find([NULL_KEY if key is None else key])
        return self.read(int(first[0]) + turn)[1] if 0 <= turn < docs[0] else None


class Ranges:
    """Ascending key ranges with shard numbers: a range for each mark (its keys end with the mark), one for the rest.

    A mark that comes several times is a hot key; it takes as many shards, over which its documents go by checksum.
    """

    def __init__(self, marks: list[int]):
        import numpy as np

        self.marks, self.pieces = np.unique(np.array(marks, "i8"), return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(self.pieces)])
        self.count = int(self.first[-1]) + 1

    def of(self, keys):
        """First shard, and number of shards, of each key."""
        import numpy as np

        at = np.searchsorted(self.marks, keys)
        hot = (at < len(self.marks)) & (np.append(self.marks, 0)[at] == keys)
        return self.first[at], np.where(hot, np.append(self.pieces, 1)[at], 1)


def write_store(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None, shards: int | None = None) -> tuple[DataFrame, list[int]]:
    """Encode every whole text, append the end id and write shards in ascending key order below ``folder``.

    Returns one row per shard (shard, path, docs, ids, first_id) and the marks between shards. Shards hold consecutive
    key ranges, as many as the texts' characters ask for; null keys come first; rows of one key stand together by
    ascending ids, but a key of more than a shard's rows goes over several
    by the checksum of its ids, the task and the turn among equal rows of it. Null text is the end id alone; rows that
    repeat are documents of their own. An empty table writes nothing. Marks are quantiles of the keys.
    """
    path, spark = tokenizer or default_tokenizer(), df.sparkSession
    width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    known = df.select(F.coalesce(df[key].cast("long"), F.lit(NULL_KEY)).alias("key"), text_of(df, text).alias("t"))
    n = shards or max(partitions(spark), -(-(known.select(F.sum(F.length("t"))).first()[0] or 0) // SHARD_CHARS))
    marks = known.select(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("marks")).first()["marks"] if n > 1 else None
    marks = list(marks or [])
    ranges = Ranges(marks)

    def encode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, turns = TaskContext.get().partitionId(), {}
        run, end = encoder(path), end_id.to_bytes(4, "little")
        narrow = lambda x: x if width == 4 else np.frombuffer(x, "<u4").astype("<u2").tobytes()
        for batch in batches:
            ids = [narrow(run(t.as_py()) + end) for t in batch.column("t")]
            shard, pieces = ranges.of(batch.column("key").to_numpy())
            for i in np.nonzero(pieces > 1)[0]:
                own = batch.column("key")[i].as_py(), zlib.crc32(ids[i])  # equal rows of a hot key are dealt by task and turn
                turns[own] = turns.get(own, 0) + 1
                shard[i] += zlib.crc32(b"%d %d %d" % (own[1], task, turns[own])) * int(pieces[i]) >> 32
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("key"), pa.array(ids, pa.binary())], names=["shard", "key", "ids"])

    def save(batches):
        from itertools import groupby

        import pyarrow as pa

        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "ids")), strict=True))
        for number, own in groupby(rows, key=lambda r: r[0]):
            uri, said = f"{folder}/shard-{number:06d}.ids", []
            put_file(uri, lambda out, own=own, said=said: said.append(write_shard(out, ((k, x) for _, k, x in own), width)))
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": uri, "docs": said[0][0], "ids": said[0][1]}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = known.mapInArrow(encode, "shard int, key long, ids binary").repartitionById(ranges.count, F.col("shard")).sortWithinPartitions("shard", "key", "ids")
    manifest = [r.asDict() for r in rows.mapInArrow(save, "shard int, path string, docs long, ids long").collect()]  # one short row per shard
    first = 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        r["first_id"] = first
        first += r["ids"]
    return spark.createDataFrame(manifest, "shard int, path string, docs long, ids long, first_id long"), marks


def read_store(df: DataFrame, manifest: DataFrame, marks: list[int], key: str = "doc_id") -> DataFrame:
    """Look up every row's key through the shards' indexes: key, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. Rows that repeat a key get that key's documents in turn, and
    nulls beyond them; so do keys that are not in the store. Rows of one key are counted before the shuffle and read
    by the shards that have them.
    """
    shards = {r["shard"]: (r["path"], r["first_id"]) for r in manifest.collect()}
    ranges = Ranges(marks)
    hot = [(int(m), int(f) + i) for m, f, p in zip(ranges.marks, ranges.first, ranges.pieces, strict=False) if p > 1 for i in range(p)]

    def count_hot(batches):  # documents of a hot key in each of its shards
        import pyarrow as pa

        for batch in batches:
            for k, number in zip(*(batch.column(c).to_pylist() for c in ("key", "shard")), strict=True):
                docs = int(Shard(shards[number][0]).find([k])[1][0]) if number in shards else 0
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([number], pa.int32()), pa.array([docs], pa.int64())], names=["key", "shard", "docs"])

    spans: dict[int, list[tuple[int, int, int]]] = {}  # of each hot key: shard, first turn, documents
    if hot:  # at most one short row per shard
        for r in sorted(df.sparkSession.createDataFrame(hot, "key long, shard int").mapInArrow(count_hot, "key long, shard int, docs long").collect()):
            own = spans.setdefault(r.key, [])
            own.append((r.shard, own[-1][1] + own[-1][2] if own else 0, r.docs))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            keys, asked = batch.column("key").to_numpy(), batch.column("asked").to_pylist()
            out = []
            for k, n, shard in zip(keys.tolist(), asked, ranges.of(keys)[0].tolist(), strict=True):
                if k not in spans:
                    out.append((shard, k, n))
                    continue
                for i, (number, turn, docs) in enumerate(spans[k]):
                    mine = n - turn if i == len(spans[k]) - 1 else min(n - turn, docs)
                    if mine > 0:
                        out.append((number, k, mine))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["shard", "key", "asked"])

    def look(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "start", "n_tokens", "ids_crc32"])
        number, store = None, None
        for batch in batches:
            numbers, out = batch.column("shard").to_numpy(), []
            for now in np.unique(numbers).tolist():
                if now != number:
                    number, store = now, Shard(shards[now][0]).load() if now in shards else None
                mine = numbers == now
                keys, asked = batch.column("key").to_numpy()[mine], batch.column("asked").to_pylist()
                asked = [a for a, m in zip(asked, mine, strict=True) if m]
                first, docs = store.find(keys) if store else (np.zeros(len(keys), "i8"),) * 2
                for k, n, doc, held in zip(keys.tolist(), asked, first.tolist(), docs.tolist(), strict=True):
                    for turn in range(n):
                        if turn < held:
                            start, ids = store.read(doc + turn)
                            out.append((k, shards[now][1] + start, len(ids) // 4, zlib.crc32(ids)))
                        else:
                            out.append((k, None, None, None))
                        if len(out) == 10_000:
                            yield pack(out)
                            out = []
            if out:
                yield pack(out)

    wanted = df.select(F.coalesce(df[key].cast("long"), F.lit(NULL_KEY)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    wanted = wanted.mapInArrow(place, "shard int, key long, asked long")
    found = wanted.repartitionById(ranges.count, F.col("shard")).sortWithinPartitions("shard", "key").mapInArrow(look, "key long, start long, n_tokens long, ids_crc32 long")
    return found.select(F.nullif("key", F.lit(NULL_KEY)).alias(key), "start", "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the store below the shared folder and read every document back by its key."""
    manifest, marks = write_store(df, shared_dir(df.sparkSession, "ids"), key, text, **options)
    return read_store(df, manifest, marks, key)
