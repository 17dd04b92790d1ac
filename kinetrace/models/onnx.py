"""Dense scoring of segments with an exported network (M08): exact chunking with a halo of the receptive field."""

from __future__ import annotations

from pyspark.sql import DataFrame


def chunks(steps: int, size: int, halo: int) -> list[tuple[int, int, int, int]]:
    """(from, to, keep from, keep to) steps: the kept parts tile the segment, the rest is halo."""
    out = []
    for a in range(0, steps, size):
        b = min(a + size, steps)
        lo, hi = max(0, a - halo), min(steps, b + halo)
        out.append((lo, hi, a - lo, b - lo))
    return out


def score_segments(signal: DataFrame, model: bytes, channels: list[str], mean: list[float], std: list[float], stride: int, halo: int, heads: list[str], size: int = 7200, session: str = "cache_key", segment: str = "segment_id", index: str = "frame_index") -> DataFrame:
    """session, segment, step and one probability per head. The model takes (1, channels, frames) and gives (1, heads, steps).

    Each worker opens its own session of the network; a segment streams through it chunk by chunk.
    """
    kinds = signal.schema

    def run(key, table):
        import numpy as np
        import onnxruntime as ort
        import pyarrow as pa

        net = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
        table = table.sort_by(index)
        x = np.column_stack([table.column(c).to_numpy() for c in channels])
        x = ((x - np.array(mean)) / np.maximum(np.array(std), 1e-6)).astype("f4")
        steps, parts = len(x) // stride, []
        for lo, hi, a, b in chunks(steps, size, halo):
            y = net.run(None, {net.get_inputs()[0].name: x[lo * stride : hi * stride].T[None]})[0][0]
            parts.append(y[:, a:b])
        y = np.concatenate(parts, axis=1) if parts else np.zeros((len(heads), 0), "f4")
        own = [pa.array([k.as_py()] * y.shape[1], table.schema.field(c).type) for k, c in zip(key, (session, segment), strict=True)]
        return pa.table([*own, pa.array(np.arange(y.shape[1])), *[pa.array(v.astype("f8")) for v in y]], names=[session, segment, "step", *heads])

    schema = f"{session} {kinds[session].dataType.simpleString()}, {segment} {kinds[segment].dataType.simpleString()}, step long, " + ", ".join(f"{h} double" for h in heads)
    return signal.select(session, segment, index, *channels).groupBy(session, segment).applyInArrow(run, schema)
