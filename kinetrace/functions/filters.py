"""Butterworth sections and their evaluation in numpy (W17, W18), for Arrow-fed workers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64


@lru_cache(maxsize=64)
def butterworth(order: int, cutoff: float | tuple[float, float], rate: float) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2] of a low-pass (one cut-off) or band-pass (two), by bilinear transform."""
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if isinstance(cutoff, tuple):
        lo, hi = map(warp, cutoff)
        half, centre = poles * (hi - lo) / 2, lo * hi
        root = np.sqrt(half * half - centre + 0j)
        poles, numerator = np.concatenate([half + root, half - root]), np.array([1.0, 0.0, -1.0])
        at = np.exp(2j * np.arctan(np.sqrt(centre) / (2 * rate)))
    else:
        poles, numerator, at = poles * warp(cutoff), np.array([1.0, 2.0, 1.0]), 1.0
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[z.imag > 0]
    z = z[np.argsort(np.abs(z), kind="stable")]
    sections = np.array([[*numerator, 1.0, -2 * p.real, abs(p) ** 2] for p in z])
    gain = np.prod([np.polyval(s[:3], at) / np.polyval(s[3:], at) for s in sections])
    sections[0, :3] /= abs(gain)
    return sections


def settling(sections: np.ndarray, rest: float = 1e-13) -> int:
    """Samples after which the slowest pole has left at most ``rest`` of what the filter started from."""
    slowest = max(np.sqrt(s[5]) for s in sections)  # poles are conjugate pairs
    return int(np.ceil(np.log(rest) / np.log(slowest)))


@lru_cache(maxsize=256)
def _block_form(section: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Of one section: a block's response to itself, to the state before it, what it leaves, and the state's step."""
    b0, b1, b2, _, a1, a2 = section
    step, entry = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = np.empty((BLOCK + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(BLOCK):
        powers[i + 1] = step @ powers[i]
    impulse = np.concatenate([[b0], powers[: BLOCK - 1, 0, :] @ entry])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), powers[:BLOCK, 0, :], (powers[BLOCK - 1 :: -1] @ entry).T, powers[BLOCK]


def _section(x: np.ndarray, s: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section over (n, channels) in blocks: own responses are one matrix product, states go from block to block."""
    response, seen, carry, leap = _block_form(tuple(s))
    n, channels = x.shape
    whole = -(-n // BLOCK)
    blocks = np.zeros((whole * BLOCK, channels))
    blocks[:n] = x
    wide = blocks.reshape(whole, BLOCK, channels).transpose(1, 0, 2).reshape(BLOCK, -1)
    left = (carry @ wide).reshape(2, whole, channels).transpose(1, 0, 2)
    states = np.empty((whole, 2, channels))
    for k in range(whole):
        states[k] = state
        state = leap @ state + left[k]
    out = response @ wide + seen @ states.transpose(1, 0, 2).reshape(2, -1)
    return out.reshape(BLOCK, whole, channels).transpose(1, 0, 2).reshape(-1, channels)[:n]


@lru_cache(maxsize=256)
def _steady(section: tuple[float, ...]) -> np.ndarray:
    """The state of a section at which an input of one has stood for ever."""
    b0, b1, b2, _, a1, a2 = section
    return np.linalg.solve(np.array([[1 + a1, -1.0], [a2, 1.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]))


def forward(sections: np.ndarray, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Causal filtering of (n,) or (n, channels), from rest or as if ``start`` had stood for ever."""
    y = np.asarray(x, float).reshape(len(x), -1)
    level = None if start is None else np.asarray(start, float).reshape(1, -1)
    for s in sections:
        state = np.zeros((2, y.shape[1]))
        if level is not None:
            b0, b1, b2, _, a1, a2 = s
            state = _steady(tuple(s))[:, None] * level
            level = level * ((b0 + b1 + b2) / (1 + a1 + a2))
        y = _section(y, s, state)
    return y.reshape(np.shape(x))


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension of 3 * (2 * sections + 1) samples, from steady state at either end."""
    pad = 3 * (2 * len(sections) + 1)
    x = np.asarray(x, float)
    if len(x) <= pad:
        return forward(sections, x)
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    y = forward(sections, ext, ext[0])[::-1]
    return forward(sections, y, y[0])[::-1][pad:-pad]


def gravity_split(acc: np.ndarray, causal: bool, rate: float = 50.0, cutoff: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Static and dynamic parts; under 64 samples the static part is the mean."""
    acc = np.asarray(acc, float)
    if len(acc) < 64:
        static = np.repeat(acc.mean(axis=0, keepdims=True), len(acc), axis=0)
    else:
        static = (forward if causal else zero_phase)(butterworth(4, cutoff, rate), acc)
    return static, acc - static


def band(x: np.ndarray, low: float, high: float, causal: bool, rate: float = 50.0) -> np.ndarray:
    """Band-passed series; under 64 samples unchanged."""
    if len(x) < 64:
        return np.asarray(x, float)
    return (forward if causal else zero_phase)(butterworth(4, (low, high), rate), x)
