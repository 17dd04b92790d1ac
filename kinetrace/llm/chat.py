"""Chat formatting of typed content parts.

A visitor flattens each turn's parts (text, image, audio, document) into text with ordered placeholders, recording
attachment references and how many tokens each placeholder stands for. Turns are marked by control strings; a
backslash inside whatever looks like one in a text, and before every backslash, keeps texts apart from the template
and is undone on reading.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

# Fixed values of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL_TAILS = {"<": ["s>", "/s>", "<SYS>>", "</SYS>>", "|"], "[": ["INST]", "/INST]"]}
_CONTROL = re.compile("|".join(f"{re.escape(a)}(?={'|'.join(map(re.escape, t))})" for a, t in CONTROL_TAILS.items()))
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|attachment|>"}

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Turns and characters of one stored piece; longer conversations go on in the next.
PIECE_TURNS, PIECE_CHARS = 1024, 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class Visitor:
    """Walks typed parts in order. Costs: 256 tokens per 448-pixel tile of an image, 25 per second of sound, 600 per page.

    A part of another type keeps its text and, if it has a reference, a placeholder of one token under its own kind.
    """

    def __init__(self):
        self.out, self.attachments = [], []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        tiles = -(-(part["width"] or 448) // 448) * -(-(part["height"] or 448) // 448)
        self._place(part, 256 * max(1, tiles))

    def visit_audio(self, part: dict) -> None:
        self._place(part, max(1, round(25 * (part["seconds"] or 0))))

    def visit_document(self, part: dict) -> None:
        self._place(part, 600 * max(1, part["pages"] or 1))

    def visit_other(self, part: dict) -> None:
        if part["text"]:
            self.visit_text(part)
        if part["uri"]:
            self._place(part, 1)

    def _place(self, part: dict, tokens: int) -> None:
        self.out.append(PLACEHOLDER.get(part["type"], PLACEHOLDER["other"]))
        self.attachments.append({"kind": part["type"], "uri": part["uri"], "tokens": tokens})


def text_part(text: Column) -> Column:
    """A turn's plain text as its only part, whatever it looks like."""
    absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *absent))


FORMATTED = "conv_id long, part int, piece long, formatted string, n_turns long, loss array<struct<start:long,stop:long>>, attachments array<struct<at:long,kind:string,uri:string,tokens:long>>, expanded_tokens long"


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: Column | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per piece of a conversation, ordered by part, piece: formatted text, loss mask, attachments.

    The loss mask has code-point spans of the piece. Turns go by turn number (null first), then role and text. Null
    text, role and parts are empty; rows of a null conversation form one of its own. Conversations are sorted over
    range partitions by conversation and turn and written as they stream by, so that a conversation of any length
    takes bounded memory. An empty table gives an empty result; extra columns are ignored.
    """
    content = F.coalesce(parts, F.array().cast(f"array<{PART}>")) if parts is not None else text_part(df[text])
    rows = df.select(df[conv].cast("long").alias("conv_id"), df[turn].cast("long").alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    order = ["conv_id", "turn", "role", "parts"]
    rows = rows.repartitionByRange(partitions(df.sparkSession), "conv_id", "turn").sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("attachments", pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])
        part, done, now, piece = TaskContext.get().partitionId(), [], None, 0
        text, at, turns, loss, attached = [], 0, 0, [], []

        def close():
            done.append({"conv_id": now[0], "part": part, "piece": piece, "formatted": "".join(text), "n_turns": turns, "loss": loss, "attachments": attached, "expanded_tokens": sum(a["tokens"] for a in attached)})

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and (now[0] != r["conv_id"] or turns >= PIECE_TURNS or at >= PIECE_CHARS):
                    close()
                    piece, text, at, turns, loss, attached = piece + 1, [], 0, 0, [], []
                now = (r["conv_id"],)
                walk = Visitor()
                for p in r["parts"] or []:
                    if p is not None:
                        walk.visit(p)
                head, body = f"{TURN}{escape(r['role'])}{BODY}", "".join(walk.out)
                start = at + len(head)
                if r["role"] in learn:
                    loss.append({"start": start, "stop": start + len(body)})
                attached += [{"at": start, **a} for a in walk.attachments]
                text.append(head + body + END)
                at, turns = start + len(body) + len(END), turns + 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kinds)
                done.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return rows.mapInArrow(run, FORMATTED)


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Parse formatted pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and of the
    attachments their number, the tokens they stand for and a digest of their kinds and references in order.

    A piece must have as many placeholders as attachments. The pieces of a conversation stream by in order, so that its digests, which are sequential, take bounded memory.
    """
    rows = formatted.select("conv_id", "part", "piece", "formatted", "loss", "attachments")
    rows = rows.repartitionByRange(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(batches):
        import hashlib

        import pyarrow as pa

        turn = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)
        held = re.compile("|".join(map(re.escape, PLACEHOLDER.values())))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attached_tokens", "attachments_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        ended = lambda now: (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6], now[7], now[8].hexdigest())
        now, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        out.append(ended(now))
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256()]
                at = 0
                for m in turn.finditer(r["formatted"]):
                    if m.start() != at:
                        raise ValueError(f"text between turns in {r['conv_id']}")
                    at = m.end()
                    now[1] += 1
                    now[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(r["formatted"]):
                    raise ValueError(f"text after the last turn in {r['conv_id']}")
                for span in r["loss"]:
                    learned = unescape(r["formatted"][span["start"] : span["stop"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(r["formatted"])
                if len(held.findall(r["formatted"])) != len(r["attachments"]):
                    raise ValueError(f"placeholders and attachments differ in {r['conv_id']}")
                for a in r["attachments"]:
                    now[6], now[7] = now[6] + 1, now[7] + a["tokens"]
                    now[8].update(f"{a['kind']}\n{a['uri'] or ''}\n".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if now:
            out = [ended(now)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long, attachments_sha256 string")


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Format, write to the shared folder, read and parse again."""
    return digest_chats(cut(format_chats(df, **options), "chats"))
