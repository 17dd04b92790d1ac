"""Cost-balanced packing of documents into training sequences.

A document is cut into pieces of a whole sequence each and a remainder. Remainders are dealt over blocks by a hash
of their key and ids, and equal rows of a task by their number, so that no block gets a whole group of them. In a block, descending remainders each go to the sequence of the lowest attention cost (linear plus
quadratic in the piece's length) that still has room; what fits nowhere is cut to fill the gaps. A block has as few
sequences as its tokens need, so its padding is less than one sequence.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import default_tokenizer, encoder

#: Documents per block; a block is what one call has in memory (lengths and remainders of under one sequence each).
BLOCK_ROWS = 2048
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (projections against attention scores).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUTS = "id long, doc_tokens long, crcs array<long>, rest binary, twin long"


def assign(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items shorter than the capacity; as few sequences as the sum allows.

    Ties go to the earlier item and the lower sequence, so equal inputs pack equally.
    """
    total = sum(lengths)
    if not total:
        return []
    n = -(-total // capacity)
    room, out = [capacity] * n, [[] for _ in range(n)]
    heap = [(0.0, s) for s in range(n)]  # sequences with room for the present size
    parked: list[list[tuple[float, int]]] = [[] for _ in range(capacity)]  # by room: too full now, open to later, shorter items
    late, reach = [], capacity
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        if not size:
            break
        for r in range(size, reach):
            for x in parked[r]:
                heapq.heappush(heap, x)
            parked[r].clear()
        reach = min(reach, size)
        if not heap:
            late.append(item)
            continue
        cost, s = heapq.heappop(heap)
        out[s].append((item, 0, size))
        room[s] -= size
        x = (cost + LINEAR * size + QUADRATIC * size * size, s)
        if room[s] >= size:
            heapq.heappush(heap, x)
        elif room[s]:
            parked[room[s]].append(x)
    gaps = [s for s in range(n) if room[s]]
    for item in late:
        start = 0
        while start < lengths[item]:
            s = gaps[0]
            take = min(room[s], lengths[item] - start)
            out[s].append((item, start, take))
            room[s] -= take
            start += take
            if not room[s]:
                gaps.pop(0)
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is a document of the end id alone. Rows that repeat a key are documents of their own, told
    apart by nothing but their pieces; equal rows too. Null keys stay null. An empty table gives an empty result;
    extra columns are ignored. Rows are dealt over blocks by their content, their task and their turn among equal rows of
    it, so that any number of equal rows spreads, whatever the number of tasks. A task holds one short count per distinct
    row of less than a sequence (some 200 bytes each).
    """
    path = tokenizer or default_tokenizer()
    rows = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("t"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def cut(batches):
        import zlib

        import pyarrow as pa

        encode, end, width = encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        schema = pa.schema([("id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.binary()), ("twin", pa.int64())])
        met: dict[tuple, int] = {}
        for batch in batches:
            n_tokens, crcs, rest, twin = [], [], [], []
            for key, t in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                ids = encode(t.as_py()) + end
                full = len(ids) // width * width
                n_tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + width]) for i in range(0, full, width)])
                rest.append(ids[full:])
                own = key, zlib.crc32(ids), len(ids)
                twin.append(met.get(own, 0))
                if not full:
                    met[own] = twin[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(twin, pa.int64())], schema=schema)

    def place(group_key, table):
        import zlib

        import pyarrow as pa

        # an order of their own content, so that a retried task packs alike
        table = table.sort_by([("id", "ascending"), ("doc_tokens", "ascending"), ("rest", "ascending")])
        ids, tokens, crcs, rest = (table.column(c).to_pylist() for c in ("id", "doc_tokens", "crcs", "rest"))
        sequence, out = group_key[0].as_py() << 40, []
        for i, own in enumerate(crcs):
            for k, crc in enumerate(own):
                out.append((ids[i], k * capacity, capacity, crc, tokens[i], sequence, 0))
                sequence += 1
        for members in assign([len(r) // 4 for r in rest], capacity):
            offset = 0
            for i, start, length in members:
                crc = zlib.crc32(rest[i][4 * start : 4 * (start + length)])
                out.append((ids[i], len(crcs[i]) * capacity + start, length, crc, tokens[i], sequence, offset))
                offset += length
            sequence += 1
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    cuts = rows.mapInArrow(cut, _CUTS)
    block = F.pmod(F.xxhash64("id", "doc_tokens", "rest", "twin", F.spark_partition_id()), F.lit(blocks)).alias("block")
    packed = cuts.select(block, "id", "doc_tokens", "crcs", "rest").groupBy("block").applyInArrow(place, PIECES)
    return packed.withColumnRenamed("id", key)
