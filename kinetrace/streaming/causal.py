"""Causal operators on Structured Streaming (section 2.10): sessions, day counts, state machine, event intervals, features.

Only operators that look back may run on a stream. Late rows beyond the watermark are dropped; batch plans keep them.
``in_order`` holds rows until the watermark has passed them, so that rows late within it take their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import features
from ..operators.posture import Machine, State


def sessions(stream: DataFrame, by: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Runs of points no further apart than the gap: start, stop, points (streaming form of W01 and W08)."""
    w = F.session_window(time, gap)
    d = stream.withWatermark(time, late).groupBy(*by, w).agg(F.min(time).alias("start_t"), F.max(time).alias("stop_t"), F.count(F.lit(1)).alias("points"))
    return d.drop("session_window")


def daily_counts(stream: DataFrame, by: list[str], time: str, late: str, **flags) -> DataFrame:
    """Steps and flag counts per animal and day, by tumbling windows (streaming form of A09)."""
    d = stream.withWatermark(time, late).groupBy(*by, F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    return d.select(*by, F.col("w.start").cast("date").alias("day"), "steps", *flags)


def sliding_mean(stream: DataFrame, entity: str, time: str, value: str, rows: int) -> DataFrame:
    """Mean of the last ``rows`` values up to each point, the last ones held per animal between micro-batches (2.10).

    Rows of a micro-batch are put in order of time, then value; rows older than the last one seen are dropped.
    """

    def step(key, frames: Iterator, held: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        last, ring = (held.get[0], list(held.get[1])) if held.exists else (None, [])
        t, v = (np.concatenate(x) for x in zip(*[(f[time].to_numpy(), f[value].to_numpy()) for f in frames], strict=True))
        order = np.lexsort((v, t))
        order = order[t[order] >= last] if last is not None else order
        if len(order):
            t, joined = t[order], np.concatenate([ring, v[order]])
            sums, stop = np.concatenate([[0.0], np.cumsum(joined)]), np.arange(len(ring) + 1, len(joined) + 1)
            first = np.maximum(stop - rows, 0)
            held.update((int(t[-1]), joined[-(rows - 1) :].tolist() if rows > 1 else []))
            yield pd.DataFrame({entity: key[0], time: t, "mean": (sums[stop] - sums[first]) / (stop - first), "points": stop - first})

    cols = stream.select(entity, time, value)
    return cols.groupBy(entity).applyInPandasWithState(step, f"{entity} long, {time} long, mean double, points long", "last long, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def state_machine(stream: DataFrame, entity: str, time: str, machine: Machine = Machine()) -> DataFrame:
    """Confirmed posture per point, the run's state kept between micro-batches (streaming form of W24).

    Rows of a micro-batch are put in order; rows older than the last one seen are dropped, as a step back in time
    would start a run in the batch form. A row of the same time starts a run, as there; rows of one time are ordered
    by their values. ``stream`` has entity (long), time (long ms), upright, lying, up, down.
    """
    out = f"{entity} long, {time} long, state_sm int"

    def step(key, frames: Iterator, held: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        last, state, asking, dwell = held.get if held.exists else (None, -1, 0, 0)
        values = ["upright", "lying", "up", "down"]
        columns = [np.concatenate(x) for x in zip(*[[f[c].to_numpy() for c in (time, *values)] for f in frames], strict=True)]
        order = np.lexsort(columns[::-1])
        s, done = State(state, asking, dwell), []
        for t, upright, lying, up, down in zip(*[c[order].tolist() for c in columns], strict=True):
            if last is not None and t < last:
                continue
            if last is not None and (t == last or t - last > machine.gap):
                s = State()
            done.append((key[0], t, s.step(machine, upright, lying, up, down)))
            last = t
        held.update((last, s.state, s.asking, s.dwell))
        yield pd.DataFrame(done, columns=[entity, time, "state_sm"])

    cols = stream.select(entity, time, "upright", "lying", "up", "down")
    return cols.groupBy(entity).applyInPandasWithState(step, out, "last long, state int, asking int, dwell int", "append", GroupStateTimeout.NoTimeout)


def positive_runs(stream: DataFrame, entity: str, time: str, score: str, threshold: float, gap: int, step: int) -> DataFrame:
    """Closed intervals of points over a threshold (streaming form of W08 with one threshold).

    An interval is given out when a later point of its animal shows that it is over; the open one stays in state.
    """
    out = f"{entity} long, start_t long, end_t long"

    def run(key, frames: Iterator, held: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        start, last, seen = held.get if held.exists else (None, None, None)
        columns = [np.concatenate(x) for x in zip(*[(f[time].to_numpy(), f[score].to_numpy()) for f in frames], strict=True)]
        order, done = np.argsort(columns[0], kind="stable"), []
        for t, v in zip(*[c[order].tolist() for c in columns], strict=True):
            if seen is not None and t < seen:
                continue
            seen = t
            if start is not None and t - last > gap:
                done.append((key[0], start, last + step))
                start = last = None
            if v >= threshold:
                start, last = (t if start is None else start), t
        held.update((start, last, seen))
        yield pd.DataFrame(done, columns=[entity, "start_t", "end_t"])

    return stream.select(entity, time, score).groupBy(entity).applyInPandasWithState(run, out, "start long, last long, seen long", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame, entity: str, time: str, values: list[str], late: str, out: str, carry: str, step: Callable) -> DataFrame:
    """A stateful operator over rows in order of event time, whatever order they come in (2.10g).

    Rows wait in state until the watermark, ``late`` behind the newest time of any entity, has passed them; event-time
    timers give them out although no more rows of their entity come. ``step(key, rows, carry, mark)`` gets the rows that
    are due, sorted by time and values (a float matrix of those columns), the carried tuple (None at first) and the
    watermark in ms; it returns result rows, the new carry, and the time at which it wants to be called without rows, or
    None. ``time`` is long ms. What is held is the rows of one lateness per entity. A replay gives what the batch form
    gives for rows up to the last watermark.
    """
    fields = [f.strip().rsplit(" ", 1) for f in out.split(",")]
    kinds = {"long": "int64", "int": "int32", "double": "float64"}
    n, columns = len(carry.split(",")), [time, *values]

    def run(key, frames: Iterator, held: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        waiting, *carried = held.get if held.exists else (b"", *[None] * n)
        known = held.exists and carried[0] is not None
        rows = [np.frombuffer(waiting, float).reshape(-1, len(columns))]
        if not held.hasTimedOut:
            rows += [f[columns].to_numpy(float) for f in frames]
        rows, mark = np.concatenate(rows), held.getCurrentWatermarkMs()
        rows = rows[np.lexsort(rows.T[::-1])]
        due = np.searchsorted(rows[:, 0], mark, "right")
        done, after, alarm = step(key, rows[:due], tuple(carried) if known else None, mark)
        rest = rows[due:]
        held.update((rest.tobytes(), *(after or [None] * n)))
        times = [t for t in (rest[0, 0] if len(rest) else None, alarm) if t is not None]
        if times:
            held.setTimeoutTimestamp(max(int(min(times)), mark + 1))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=[f for f, _ in fields]).astype({f: kinds[k] for f, k in fields if k in kinds})

    rows = stream.select(entity, *columns, F.timestamp_millis(time).alias("_event")).withWatermark("_event", late)
    return rows.groupBy(entity).applyInPandasWithState(run, out, f"waiting binary, {carry}", "append", GroupStateTimeout.EventTimeTimeout)


def ordered_runs(stream: DataFrame, entity: str, time: str, score: str, threshold: float, gap: int, step: int, late: str) -> DataFrame:
    """``positive_runs`` over rows in order of event time; an interval ends once the watermark is past its last point by the gap."""

    def run(key, rows, carry, mark):
        start, last = carry[1:] if carry else (None, None)
        done = []
        for t, v in rows:
            if start is not None and t - last > gap:
                done.append((start, last + step))
                start = None
            if v >= threshold:
                start, last = (int(t) if start is None else start), int(t)
        if start is not None and mark > last + gap:
            done.append((start, last + step))
            start = None
        return done, (1, start, last if start is not None else None), None if start is None else last + gap + 1

    return in_order(stream, entity, time, [score], late, f"{entity} long, start_t long, end_t long", "known int, start long, last long", run)


def ordered_state_machine(stream: DataFrame, entity: str, time: str, late: str, machine: Machine = Machine()) -> DataFrame:
    """``state_machine`` over rows in order of event time: rows late within the watermark count as in the batch form."""

    def run(key, rows, carry, mark):
        last, *held = carry or (None, -1, 0, 0)
        s, done = State(*held), []
        for t, *scores in rows:
            if last is not None and (t == last or t - last > machine.gap):
                s = State()
            done.append((int(t), s.step(machine, *scores)))
            last = int(t)
        return done, (last, s.state, s.asking, s.dwell) if last is not None else None, None

    return in_order(stream, entity, time, ["upright", "lying", "up", "down"], late, f"{entity} long, {time} long, state_sm int", "last long, state int, asking int, dwell int", run)


def feature_bank(stream: DataFrame, references: DataFrame, session: str = "cache_key", segment: str = "segment_id", index: str = "frame_index", version: int = 2, step: int = 25) -> DataFrame:
    """The causal feature bank as a stream: columns as in ``features.build`` but for the segment's position and length, which only its end tells.

    ``references`` has session, ux, uy, uz, gyro_scale, known before. State per segment: the rows that windows and filters
    still feel (about 230 kB) and the coarse tilts of the baseline. The first 64 rows of a segment are held until
    there are so many, as the batch form treats shorter segments apart; those give nothing here. Rows of a micro-batch
    are put in order; rows that are not later than the last one seen are dropped. Rows of a segment that come together
    travel as one row, so that the shuffle, the join and Python's call per segment don't handle single samples.
    """
    cols, coarse_rows = [c for c in features.names(version) if c not in ("segment_position", "segment_length")], features.COARSE
    before, _ = features.halo(True)
    columns = [index, *features.CHANNELS, "quality"]
    kind = {c: stream.schema[c].dataType.simpleString() for c in (session, segment)}

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table in (pa.Table.from_batches([b]) for b in batches if b.num_rows):
            order, found = features.parts(table, [session, segment])
            x, first = np.column_stack([table.column(c).to_numpy() for c in columns])[order].astype(float), pa.array(order[[one.start for one in found]])
            keys = [table.column(c).combine_chunks().take(first) for c in (session, segment)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([x[one].tobytes() for one in found], pa.binary())], names=[session, segment, "_rows"])

    def run(key, frames: Iterator, held: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        total, given, rows, coarse = held.get if held.exists else (0, 0, b"", b"")
        rows, coarse = np.frombuffer(rows, float).reshape(-1, len(columns)), np.frombuffer(coarse, float)
        new = []
        for f in frames:
            new += [np.frombuffer(x, float).reshape(-1, len(columns)) for x in f["_rows"]]
            *unit, scale = f["_reference"].iloc[0]
        fresh, unit = np.concatenate(new), np.array(unit)
        fresh = fresh[np.argsort(fresh[:, 0], kind="stable")]
        fresh = fresh[fresh[:, 0] > rows[-1, 0]] if len(rows) else fresh
        rows, total = np.concatenate([rows, fresh]), total + len(fresh)
        first, centre = total - len(rows), -(-given // step) * step
        if total < 64 or centre >= total:
            held.update((total, given, rows.tobytes(), coarse.tobytes()))
            return
        core, following = centre // coarse_rows * coarse_rows, -(-total // step) * step // coarse_rows * coarse_rows
        centres = np.arange(centre, total, step)
        series = features.series(rows[:, 1:7], True, unit, scale, version)
        out = features.bank(rows[:, 1:7], rows[:, 7], centres - first, True, unit, scale, version, first, core - first, total, coarse, series)
        coarse = np.concatenate([coarse, series["tilt"][core - first : max(following - first, 0) : coarse_rows]])[-features.BASELINE :]
        held.update((total, total, rows[-before:].tobytes(), coarse.tobytes()))
        done = pd.DataFrame(np.column_stack([out[c] for c in cols]), columns=cols)  # one block of floats, not a column each
        for i, (name, value) in enumerate(((session, key[0]), (segment, key[1]), ("center_index", rows[centres - first, 0].astype("i8")))):
            done.insert(i, name, value)
        yield done

    packed = stream.select(session, segment, *columns).mapInArrow(pack, f"{session} {kind[session]}, {segment} {kind[segment]}, _rows binary")
    known = packed.join(references.select(session, F.array("ux", "uy", "uz", "gyro_scale").alias("_reference")), session)
    out = f"{session} {kind[session]}, {segment} {kind[segment]}, center_index long, " + ", ".join(f"{c} float" for c in cols)
    return known.groupBy(session, segment).applyInPandasWithState(run, out, "total long, given long, rows binary, coarse binary", "append", GroupStateTimeout.NoTimeout)
