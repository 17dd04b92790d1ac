"""Every feature column against plain loops over each window; session references against a plain loop over a session."""

import numpy as np
import pytest

from kinetrace.functions import filters
from kinetrace.operators import features
from kinetrace.operators.features import BANDS, LEVELS, SCALES, TRANSITIONS

KIND = "cache_key string, segment_id int, frame_index long, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double, quality int"


def motion(n, seed=1):
    r = np.random.default_rng(seed)
    t = np.arange(n) / 50
    acc = np.column_stack([0.3 * np.sin(t / 3), 0.2 * np.cos(t), 1 + 0.1 * np.sin(7 * t)]) + r.normal(0, 0.05, (n, 3))
    return np.column_stack([acc, 40 * np.sin(np.outer(t, [1.0, 2.3, 5.1])) + r.normal(0, 3, (n, 3))])


def plain_reference(segments, causal):
    """Unit gravity, gyro scale and quiet share of a session, sample by sample."""
    still, rates = [], []
    for block in segments:
        if len(block) >= 32:
            static, dyn = filters.gravity_split(block[:, :3], causal)
            still += [(float(np.sqrt((dyn[i] ** 2).sum())), static[i]) for i in range(0, len(block), 10)]
            rates += [float(np.sqrt((block[i, 3:6] ** 2).sum())) for i in range(0, len(block), 10)]
    if not still:
        return None
    edge = np.quantile([m for m, _ in still], 0.3)
    quiet = [s for m, s in still if m <= edge]
    used = quiet if len(quiet) >= 10 else [s for _, s in still]
    g = np.array([np.median([s[k] for s in used]) for k in range(3)])
    scale = max(5.0, float(np.quantile(rates, 0.9))) if len(rates) >= 10 else 1.0
    return g / np.linalg.norm(g), scale, len(used) / len(still)


def plain_bank(block, quality, causal, unit, scale, version):
    """One dictionary of columns per decision point."""
    n = len(block)
    static, dyn = filters.gravity_split(block[:, :3], causal)
    gyro = block[:, 3:] / scale if version >= 2 else block[:, 3:]
    axis = np.cross(unit, [0, 0, 1.0])
    s, c = np.linalg.norm(axis), unit[2]
    k = axis / s if s > 0 else np.array([1.0, 0, 0])
    k = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    turn = np.eye(3) + s * k + (1 - c) * k @ k  # Rodrigues
    body = np.array([turn @ (v / np.linalg.norm(v)) for v in static])
    deg = lambda x: np.degrees(np.arccos(np.clip(x, -1, 1)))
    x = {"tilt": deg(body[:, 2]), "vedba": np.sqrt((dyn**2).sum(1)), "odba": np.abs(dyn).sum(1), "gyro_norm": np.sqrt((gyro**2).sum(1)), "quality": quality}
    for i, a in enumerate("xyz"):
        x |= {f"body_u{a}": body[:, i], f"gyro_{a}": gyro[:, i], f"dyn_{a}": dyn[:, i]}
    x["pitch_deg"] = np.degrees(np.arctan2(static[:, 0], np.sqrt(static[:, 1] ** 2 + static[:, 2] ** 2)))
    x["roll_deg"] = np.degrees(np.arctan2(static[:, 1], np.sqrt(static[:, 0] ** 2 + static[:, 2] ** 2)))
    for b, (lo, hi) in BANDS.items():
        x[f"band_{b}_energy"] = sum(filters.band(gyro[:, i], lo, hi, causal) ** 2 for i in range(3))
    if version >= 2:
        x["acc_dot_gyro"] = np.array([a @ g for a, g in zip(dyn, gyro, strict=True)])
        x["acc_cross_gyro"] = np.array([np.linalg.norm(np.cross(a, g)) for a, g in zip(dyn, gyro, strict=True)])
    out = []
    for at in range(0, n, 25):

        def window(name, lo, hi):
            rows = [j for j in range(at + lo, at + hi) if 0 <= j < n]
            return x[name][rows or [0 if at + hi <= 0 else n - 1]]

        row = {}
        for sec in SCALES:
            span = sec * 50
            lo, hi = (1 - span, 1) if causal else (-(span // 2), span // 2 + 1)
            put = lambda name, kind, f: row.__setitem__(f"{name}_{kind}_{sec}s", f(window(name, lo, hi)))  # noqa: B023, E731
            for name in ("tilt", "vedba", "odba", "gyro_norm", *(("acc_dot_gyro", "acc_cross_gyro") if version >= 2 else ())):
                put(name, "mean", np.mean)
                put(name, "std", np.std)
            for d in LEVELS:
                row[f"tilt_frac_gt{d}_{sec}s"] = np.mean(window("tilt", lo, hi) > d)
            for b in BANDS:
                put(f"band_{b}_energy", "mean", np.mean)
            last = min(at + hi - 1, n - 1)
            for name in ("tilt", "vedba"):
                row[f"{name}_max_{sec}s"] = max(x[name][max(0, last - (hi - lo) + 1) : last + 1])
            if sec <= 5:
                for name in ("gyro_x", "gyro_y", "gyro_z", "dyn_x", "dyn_y", "dyn_z"):
                    put(name, "std", np.std)
                for name in ("body_ux", "body_uy", "body_uz", "pitch_deg", "roll_deg"):
                    put(name, "mean", np.mean)
        for sec in TRANSITIONS:
            w = sec * 50
            before, after = (-2 * w, -w), ((-w, 1) if causal else (w, 2 * w))
            a, b = (np.array([np.mean(window(f"body_u{k}", *f)) for k in "xyz"]) for f in (before, after))
            row[f"transition_angle_{sec}s"] = deg(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
            row[f"transition_tilt_delta_{sec}s"] = np.mean(window("tilt", *after)) - np.mean(window("tilt", *before))
            row[f"transition_vedba_ratio_{sec}s"] = (np.mean(window("vedba", *after)) + 1e-6) / (np.mean(window("vedba", *before)) + 1e-6)
        row["tilt_baseline"] = np.median(x["tilt"][0 : at + 1 : 50][-1800:])
        row["tilt_rel_baseline"] = x["tilt"][at] - row["tilt_baseline"]
        row["quality_mean_5s"] = np.mean(window("quality", *((-249, 1) if causal else (-125, 126))))
        row["segment_position"], row["segment_length"] = at / (n - 1), n
        out.append(row)
    return out


@pytest.mark.parametrize("causal,version", [(True, 2), (False, 1), (False, 2)])
def test_every_column_against_loops(causal, version):
    block = motion(2600)
    quality = (np.arange(2600) % 7 == 0).astype(int)
    unit, scale, _ = plain_reference([block], causal)
    got = features.bank(block, quality, np.arange(0, 2600, 25), causal, unit, scale, version)
    want = plain_bank(block, quality, causal, unit, scale, version)
    assert list(got) == features.names(version) and set(want[0]) == set(got)
    for k, v in got.items():
        assert list(v) == pytest.approx([r[k] for r in want], rel=2e-4, abs=2e-4), k


def test_references_and_build_against_loops(spark):
    """Sessions of one, several and only short segments; frames come in any order."""
    sessions = {"a": [motion(700), motion(90, 2)], "b": [motion(40, 3), motion(20, 4)], "c": [motion(20, 5)]}
    rows = [(k, s, i, *map(float, v), i % 2) for k, segments in sessions.items() for s, block in enumerate(segments) for i, v in enumerate(block)]
    d = spark.createDataFrame(rows, KIND).repartition(5)
    got = {r.cache_key: r for r in features.references(d, "cache_key", "segment_id", "frame_index", True).collect()}
    assert set(got) == {"a", "b"}
    for k in got:
        unit, scale, quiet = plain_reference(sessions[k], True)
        assert [got[k].ux, got[k].uy, got[k].uz, got[k].gyro_scale, got[k].quiet] == pytest.approx([*unit, scale, quiet], abs=1e-9)
    unit, scale, _ = plain_reference(sessions["a"], True)
    built = features.build(d).filter("cache_key = 'a' AND segment_id = 1").orderBy("center_index").collect()
    want = plain_bank(sessions["a"][1], np.arange(90) % 2, True, unit, scale, 2)
    assert [r.center_index for r in built] == [0, 25, 50, 75]
    for k in features.names(2):
        assert [getattr(r, k) for r in built] == pytest.approx([w[k] for w in want], rel=2e-4, abs=2e-4), k


@pytest.mark.parametrize("causal", [True, False])
def test_derived_series_of_a_block_with_its_halo(causal):
    """What a filter forgot before the block is below 1e-9 of every series."""
    block = motion(12_000)
    unit, scale, _ = plain_reference([block], causal)
    whole = features.series(block, causal, unit, scale, 2)
    before, after = features.halo(causal)
    lo, hi = 6_000, 7_000
    part = features.series(block[lo - before : hi + after], causal, unit, scale, 2)
    for k, v in whole.items():
        assert part[k][before : before + hi - lo] == pytest.approx(v[lo:hi], rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("causal", [True, False])
def test_split_segments_equal_whole_ones(spark, monkeypatch, causal):
    """Segments of several blocks, one ending just behind a block's end, one short; the index has holes in some buckets and starts below zero."""
    monkeypatch.setattr(features, "BLOCK", 4_000)
    segments = [motion(21_300), motion(4_003, 2), motion(50, 3)]
    index = [np.arange(len(b)) * (1 + s) + 37 * (np.arange(len(b)) // 9_000) - 500 for s, b in enumerate(segments)]
    rows = [("a", s, int(index[s][i]), *map(float, v), i % 2) for s, block in enumerate(segments) for i, v in enumerate(block)]
    got = features.build(spark.createDataFrame(rows, KIND).repartition(7), causal=causal).toPandas()
    unit, scale, _ = plain_reference(segments, causal)
    for s, block in enumerate(segments):
        centres = np.arange(0, len(block), 25)
        want = features.bank(block, np.arange(len(block)) % 2, centres, causal, unit, scale, 2)
        mine = got[got.segment_id == s].sort_values("center_index")
        assert list(mine.center_index) == list(index[s][centres])
        for k in features.names(2):
            assert mine[k].to_numpy() == pytest.approx(want[k], rel=1e-6, abs=1e-6), (s, k)
