"""Applications of the fold contract (L1, L3, L4, L7): packets, trackers, gesture decisions, correlation and gait."""

from __future__ import annotations

import math

import numpy as np

from dopplerlake.operators.gesture import CORRELATED, LENGTH, PROBABILITY, VOTES
from dopplerlake.sources.wire import Scanner, directory

from .fold import Fold, register

SCAN = "data binary, base long, gap long, frame long, searching boolean, begun boolean"


@register
def packets() -> Fold:
    """L1: packets from the byte pieces of a recording (`seq`, `bytes`, and `ts`, the host's seconds, or null). `t` counts from
    the piece that completed the first packet; a partial packet waits in the state."""

    def step(state, row):
        (scan, first), (_, data, ts), out = state, row, []
        for at, gap, packet in scan.feed(data or b""):
            first = ts if first is None else first
            out.append((scan.frame - 1, at, gap, len(packet), None if ts is None or first is None else round(ts - first, 6), packet))
        return (scan, first), out

    return Fold(
        "packets", ("seq",), ("bytes", "ts"), "frame_idx long, byte_offset long, skipped_before long, length long, t double, packet binary", f"{SCAN}, first double",
        lambda: (Scanner(), None), step, save=lambda s: (*s[0].save(), s[1]), load=lambda s: (Scanner.load(s[:-1]), s[-1]),
    )


ACCOUNT = (*Scanner.COUNTS, "truncated_tail", "padded_frames", "padding_bytes", "anomalous_frames")


def accounts() -> Fold:
    """A1: where the bytes of a recording went, told at its end."""

    def step(state, row):
        scan, n = state
        for _, _, packet in scan.feed(row[1] or b""):
            _, odd, padding = directory(packet)
            n["padded_frames"] += padding > 0
            n["padding_bytes"] += padding
            n["anomalous_frames"] += bool(odd)
        return state, []

    def finish(state):
        counts = state[0].finish() | state[1]
        return [tuple(counts[c] for c in ACCOUNT)]

    start = lambda: (Scanner(), {"padded_frames": 0, "padding_bytes": 0, "anomalous_frames": 0})
    return Fold("accounts", ("seq",), ("bytes",), ", ".join(f"{c} long" for c in ACCOUNT), "", start, step, finish)


@register
def tracker(targets: int = 1, jump: float = 0.6, hold: int = 10) -> Fold:
    """Follows up to `targets` candidates a frame (`ranges`, strongest first, apart from each other).

    Nearest pairs of track and candidate first, none beyond `jump`. A track without a candidate keeps its last range for `hold`
    frames; it is deleted after more misses, but only in a frame that has candidates. Where no track is alive, all are seeded
    from the frame's candidates, nearest first.
    """

    def step(state, row):
        last, missed = list(state[0]), list(state[1])
        frame, found = row
        found = [] if found is None else [float(x) for x in found]
        alive = [k for k in range(targets) if last[k] is not None]
        value, coasted = [None] * targets, [False] * targets
        if found and not alive:
            for k, x in enumerate(sorted(found)[:targets]):
                value[k] = last[k] = x
                missed[k] = 0
        else:
            pairs = sorted((abs(x - last[k]), k, j) for k in alive for j, x in enumerate(found))
            used: set[int] = set()
            for d, k, j in pairs:
                if value[k] is None and j not in used and d <= jump:
                    value[k] = last[k] = found[j]
                    missed[k] = 0
                    used.add(j)
            for k in alive:
                if value[k] is None:
                    missed[k] += 1
                    if missed[k] <= hold:
                        value[k], coasted[k] = last[k], True
                    elif found:
                        last[k], missed[k] = None, 0
        return (last, missed), [(frame, k, value[k], coasted[k]) for k in range(targets)]

    return Fold(
        "tracker", ("frame_idx",), ("ranges",), "frame_idx long, target long, range_m double, coasted boolean", "last array<double>, missed array<int>",
        lambda: ([None] * targets, [0] * targets), step, load=lambda s: ([None if x is None or x != x else float(x) for x in s[0]], [int(x) for x in s[1]]),
    )


@register
def decisions(thresholds=PROBABILITY, votes=VOTES, length: int = LENGTH) -> Fold:
    """L4: debounced gesture state and events of each frame (`probs`), as the batch operator gives them."""
    k, limit, need = len(thresholds), np.array(thresholds), np.array(votes)

    def step(state, row):
        past, before = state
        frame, probs = row
        past = np.concatenate([past, (np.asarray(probs, float) >= limit).astype(int)[None, :]])[-length:]
        passing = np.flatnonzero(past.sum(axis=0) > need)
        now = int(passing[-1]) if len(passing) else 0
        return (past, now), [(frame, now, now != before and now != 0)]

    return Fold(
        "decisions", ("frame_idx",), ("probs",), "frame_idx long, state int, fired boolean", "past array<int>, before int", lambda: (np.zeros((0, k), int), 0), step,
        save=lambda s: (s[0].ravel().tolist(), s[1]), load=lambda s: (np.array(s[0], int).reshape(-1, k), int(s[1])),
    )


@register
def correlation(length: int = CORRELATED) -> Fold:
    """L4: correlation of azimuth and Doppler over the last frames, 0 before there are enough and where either is constant."""

    def step(state, row):
        frame, x, y = row
        a, d = [*state[0], float(x)][-length:], [*state[1], float(y)][-length:]
        full = len(a) == length and min(a) < max(a) and min(d) < max(d)
        return (a, d), [(frame, float(np.corrcoef(a, d)[0, 1]) if full else 0.0)]

    return Fold("correlation", ("frame_idx",), ("azimuth", "doppler"), "frame_idx long, correlation double", "a array<double>, d array<double>", lambda: ([], []), step, load=lambda s: (list(s[0]), list(s[1])))


@register
def walking(on: float = 0.35, off: float = 0.20, v_min: float = 0.20) -> Fold:
    """Gait as it happens, from a smoothed envelope (`t`, `v`): whether the person walks (hysteresis, a missing value as zero),
    the number of the walk, its seconds so far, and whether the frame before was a step: a local maximum of `v_min` or more in a walk."""

    def step(state, row):
        walks, number, since, older, old, was = state
        frame, t, v = row
        v = 0.0 if v is None or math.isnan(v) else float(v)
        peak = bool(was and older is not None and old is not None and older < old > v and old >= v_min)
        now = True if v >= on else False if v < off else walks
        if now and not walks:
            number, since = number + 1, t
        out = (frame, now, number if now else None, t - since if now else None, peak)
        return (now, number, since, old, v, now), [out]

    return Fold(
        "walking", ("frame_idx",), ("t", "v"), "frame_idx long, walking boolean, walk long, seconds double, step_before boolean", "walks boolean, number long, since double, older double, old double, was boolean",
        lambda: (False, 0, None, None, None, False), step, load=lambda s: tuple(None if isinstance(x, float) and math.isnan(x) else x for x in s),
    )
