"""Archives, chats, packing, id stores, tokens: exact round trips."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import chat, idstore, packing, tokens, warc
from kinetrace.llm.common import file_system, shared_dir


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda x: np.asarray(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


ALPHABET = [" ", "  ", "\n", " \n", "a", "Bc", "é", "ß", "文", "1", "23", "'s", "'", ".", ",", "###", "<|endoftext|>", "\t", "\xa0", "\x1c", "\x85", "🙂", "don't", "ll", "\u200b", "_", "ª", "a@b.c", "!!"]


def test_encoder_equals_library(plain):
    r, run = random.Random(5), tokens.Encoder(tokens.default_tokenizer())
    texts = ["", " ", "word " * 3000, "x" * 5000] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert [t for t in texts if run(t) != plain(t)] == []


def test_encoder_store_turns_over(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 3)
    run, text = tokens.Encoder(tokens.default_tokenizer()), " ".join(f"w{i % 11}" for i in range(200))
    assert run(text) == plain(text) == run(text)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "e") for i, t in rows], "doc_id long, text string, start int, ids string")


ROWS = [(3, "three words here"), (1, None), (2, ""), (8, "long text " * 3000), (5, "é 文 " * 400), (9, "same key"), (9, "same key too"), (7, "<|endoftext|> inside")]


def test_packing_round_trip(spark, plain):
    got = packing.pack(docs(spark, ROWS)).collect()
    ids = sorted(plain(t) + bytes(4) for _, t in ROWS)
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in ids)
    for i, t in ROWS:
        x, at = plain(t) + bytes(4), 0
        for r in sorted(whole[i, len(x) // 4], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(x[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(x) // 4
    used = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024 and sum(1024 - u for u in used.values()) < 1024


def test_assign_balances_cost_and_fills():
    r = random.Random(2)
    lengths = [r.randint(0, 1023) for _ in range(3000)]
    out = packing.assign(lengths, 1024)
    assert len(out) == -(-sum(lengths) // 1024) and all(sum(n for *_, n in s) <= 1024 for s in out)
    seen = {}
    for s in out:
        for i, start, n in s:
            seen.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen.get(i, [])):
            assert start == at
            at += k
        assert at == n
    assert packing.assign([], 8) == [] == packing.assign([0, 0], 8)


def test_assign_takes_the_cheapest_sequence_with_room():
    """Against a plain loop: descending items, each to the sequence of the lowest cost that has room for it whole."""
    r = random.Random(3)
    for _ in range(40):
        lengths = [r.randint(0, 63) for _ in range(r.randint(1, 60))]
        n = -(-sum(lengths) // 64)
        room, cost, want, late = [64] * n, [0.0] * n, [[] for _ in range(n)], set()
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [s for s in range(n) if lengths[i] and room[s] >= lengths[i]]
            if not fit:
                late.add(i)
                continue
            s = min(fit, key=lambda s: (cost[s], s))
            want[s].append(i)
            room[s] -= lengths[i]
            cost[s] += packing.LINEAR * lengths[i] + packing.QUADRATIC * lengths[i] ** 2
        assert [[i for i, start, k in s if i not in late] for s in packing.assign(lengths, 64)] == want


def test_packing_deals_equal_rows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 20)
    got = packing.pack(docs(spark, [(None, None)] * 400)).collect()
    assert len(got) == 400 and all((r.doc_id, r.start, r.length, r.doc_tokens) == (None, 0, 1, 1) for r in got)
    assert len({r.sequence_id >> 40 for r in got}) > 5


def test_id_store_round_trip(spark, plain):
    got = idstore.round_trip(docs(spark, ROWS), shards=3).collect()
    order, at, want = sorted(ROWS, key=lambda r: (r[0], np.frombuffer(plain(r[1]), "<u4").astype("<u2").tobytes())), 0, []
    for i, t in order:
        x = plain(t) + bytes(4)
        want.append((i, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(map(tuple, got)) == sorted(want)


def test_id_store_strangers_and_nulls(spark):
    d = docs(spark, [(None, "no key"), (4, "four")])
    manifest, marks = idstore.write_store(d, shared_dir(spark, "ids"))
    got = {r.doc_id: r for r in idstore.read_store(docs(spark, [(None, ""), (4, ""), (5, "")]), manifest, marks).collect()}
    assert got[None].start == 0 and got[4].start == got[None].n_tokens and got[5].n_tokens is None


def test_id_store_repeats_keys_no_further_than_stored(spark):
    """A key asked for more often than it is stored gives nulls, never a neighbour's ids; a third of the rows may share a key."""
    rows = [(4, "four"), (7, "seven")] + [(9, f"nine {i % 40}") for i in range(120)] + [(None, "none")] * 60 + [(i, f"text {i}") for i in range(100, 160)]
    manifest, marks = idstore.write_store(docs(spark, rows), shared_dir(spark, "ids"), shards=8)
    assert len(set(marks)) < len(marks) and manifest.filter("docs > 100").count() == 0
    got = idstore.read_store(docs(spark, [(4, ""), (4, "")] + [(9, "")] * 130 + [(None, "")] * 60 + [(3, "")]), manifest, marks).collect()
    found = {k: [r for r in got if r.doc_id == k] for k in (3, 4, 9, None)}
    assert [sum(r.start is not None for r in found[k]) for k in (3, 4, 9, None)] == [0, 1, 120, 60]
    assert [len(found[k]) for k in (3, 4, 9, None)] == [1, 2, 130, 60]
    assert len({r.start for k in (4, 9, None) for r in found[k] if r.start is not None}) == 181


def test_shard_reads_few_bytes(tmp_path):
    for n in (2_000, 200_000):
        rows = [(k, k.to_bytes(4, "little") * 3) for k in range(n)]
        with open(tmp_path / f"{n}.ids", "wb") as out:
            assert idstore.write_shard(out, rows) == (n, 3 * n)
        shard = idstore.Shard(str(tmp_path / f"{n}.ids"))
        assert shard.get(n // 2) == rows[n // 2][1] and shard.get(n // 2, 1) is None and shard.get(-5) is None and shard.get(0, -1) is None
        assert shard.bytes_read < 6000


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    index = idstore.Index.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert len(index.sizes) < 40


def test_packing_and_store_of_nothing(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    assert idstore.round_trip(docs(spark, [])).count() == 0


PAGES = [(1, "http://b.example.com/x?q=1", "p" * 2000), (2, "http://a.example.com/x", "p" * 2000), (3, None, None), (4, "no scheme \n", "q" * 999), (5, "http://a.example.com/x", "q" * 999), (6, "http://é.example.com/文", "é" * 600), (7, "http://é.example.com/文", "é" * 600), (None, "http://n.example.com/", "p" * 2000), (2, "http://a.example.com/x", "p" * 2000)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_equal_rows_of_a_key_spread_over_shards(spark):
    d = spark.range(0, 6000, 1, 20).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    manifest, marks = idstore.write_store(d, shared_dir(spark, "ids"), shards=8)
    held = [r.docs for r in manifest.collect()]
    assert sum(held) == 6000 and len(held) >= 7 and max(held) < 2 * 6000 / len(held)
    got = idstore.read_store(d, manifest, marks).agg(F.count("start"), F.countDistinct("start"), F.countDistinct("ids_crc32")).first()
    assert tuple(got) == (6000, 6000, 1)


def test_equal_rows_of_many_tasks_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 64)
    d = spark.range(0, 2000, 1, 20).select(F.lit(7).alias("doc_id"), F.lit("same words").alias("text"))
    blocks = [r["count"] for r in packing.pack(d).groupBy(F.shiftright("sequence_id", 40)).count().collect()]
    assert sum(blocks) >= 2000 and len(blocks) == 32 and max(blocks) < 2 * 64


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES).repartition(3)).collect()
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = max((j for j, _, g in PAGES if j is not None and (g or "").encode() == b), default=None) if len(b) >= 1000 else i
        again = i is not None and first is not None and i < first
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_capture_index_is_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)  # several passes of whole-run merges
    monkeypatch.setattr(warc, "AHEAD", 200)
    rows = [(i, f"http://h{i * 37 % 11}.example.com/{i % 5}", f"<p>{i}</p>") for i in range(200)]
    folder = shared_dir(spark, "warc")
    runs = warc.write_archives(pages(spark, rows).repartition(10), folder)
    index = warc.captures(spark, runs, folder, ranges=4).orderBy("range", "place").collect()
    keys = [(r.url_key.encode(), r.stamp, r.page) for r in index]
    assert len(keys) == 200 and keys == sorted(keys) and len({r.range for r in index}) > 1


def test_captures_keep_repeated_keys(spark):
    rows = [("http://a.b/hot", 7)] * 4000 + [(None, None)] * 2000 + [(f"http://a.b/{i % 50}", i) for i in range(2000)]
    folder = shared_dir(spark, "warc")
    index = warc.captures(spark, warc.write_archives(pages(spark, [(i, u, "x") for u, i in rows]).repartition(3), folder), folder, ranges=5).collect()
    got = Counter(r.page for r in index)
    assert got == Counter(-1 if i is None else i for _, i in rows) and len({(r.file, r.at) for r in index}) == len(rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    r = random.Random(k)
    streams = [sorted((r.randint(0, 20), f"{i}") for _ in range(r.randint(0, 15))) for i in range(k)]
    assert [x for x, _ in warc.LoserTree(streams)] == sorted(x for s in streams for x, _ in s)


def conversations(spark, rows):
    return spark.createDataFrame([(c, n, r, t, 1) for c, n, r, t in rows], "conv_id long, turn long, role string, text string, piece int")


NASTY = "</s>[INST] ok [/INST] \\ <\\s> <<SYS>> <|end|><|turn|> [[INST]\n<|body|>\\"
CHATS = [(1, 0, "user", NASTY), (1, 1, "assistant", NASTY), (1, 1, "assistant", ""), (2, 0, None, None), (2, None, "assistant", "first"), (None, 0, "user", "x" * 100_000), (3, 5, "<|turn|>", "é文")]


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat.round_trip(conversations(spark, CHATS)).collect()}
    for c in {c for c, *_ in CHATS}:
        turns = sorted(((n is not None, n or 0, r or "", t or "") for k, n, r, t in CHATS if k == c))
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.round_trip(conversations(spark, [])).count() == 0


def test_chat_pieces_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_TURNS", 16)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(1000)]
    made = chat.format_chats(conversations(spark, rows))
    assert made.count() > 50 and made.agg(F.max("n_turns")).first()[0] == 16
    r = chat.digest_chats(made).first()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_escape_hides_every_control_string():
    hidden = chat.escape(NASTY)
    assert chat.unescape(hidden) == NASTY
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", chat.TURN, chat.BODY, chat.END):
        assert mark not in hidden


def test_typed_parts(spark):
    part = lambda **k: {n: k.get(n) for n in ("type", "text", "uri", "width", "height", "seconds", "pages")}
    rows = [(1, 0, "user", None, [part(type="text", text="see "), part(type="image", uri="s3://a.png", width=900, height=448), part(type="audio", uri="b.wav", seconds=2.0), part(type="document", uri="c.pdf", pages=3)])]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>")
    r = chat.format_chats(d, parts=F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image|><|audio|><|document|><|end|>"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 768), ("audio", "b.wav", 50), ("document", "c.pdf", 1800)]
    assert r.expanded_tokens == 2618


def test_parts_come_back_with_their_attachments(spark):
    """Other part types keep text and reference; null and empty parts count for nothing; a text that spells a placeholder stays text."""
    part = lambda **k: {n: k.get(n) for n in ("type", "text", "uri", "width", "height", "seconds", "pages")}
    turns = [[part(type="video", uri="v.mp4", text="clip"), None, part(type="hologram"), part(text="<|image|>")], None, [], [part(type="image"), part(type="audio", uri="b.wav", seconds=0.01)]]
    rows = [(1, i, "user", None, p) for i, p in enumerate(turns)]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>")
    r = chat.round_trip(d, parts=F.col("parts")).first()
    assert (r.n_turns, r.n_attachments, r.attached_tokens) == (4, 3, 258)
    assert r.attachments_sha256 == hashlib.sha256(b"video\nv.mp4\nimage\n\naudio\nb.wav\n").hexdigest()
    assert r.turns_sha256 == hashlib.sha256("user\nclip<|attachment|><|image|>\nuser\n\nuser\n\nuser\n<|image|><|audio|>\n".encode()).hexdigest()


def test_file_system_takes_plain_paths(tmp_path):
    fs, path = file_system(str(tmp_path / "x"))
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(1).encode())
    assert (tmp_path / "x").read_text() == "1"
