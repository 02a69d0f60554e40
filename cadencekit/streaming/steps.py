"""Steps of the streaming operators: the batch rules restated row by row over a small state.

A step takes ordered rows and the state before them, and returns new columns and the state after
(see ``operators.folds``).  States stay small: the previous sample, or at most one trailing window.
``held`` gives a state's types for the state store; ``kind`` names the type of an input column.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd

from cadencekit.functions.sizes import LAYOUTS
from cadencekit.operators import continuity as C
from cadencekit.operators import rates as R


def _null(x: object) -> bool:
    return x is None or x != x


def _rows(pdf: pd.DataFrame, *names: str):
    return zip(*(pdf[n].tolist() for n in names), strict=True)


class Changes:
    """Change flags against the previous row; the state is that row's content."""

    columns = {"changed_exact": "boolean", "changed": "boolean"}

    def __init__(self, content: str = "content", near: str | None = None) -> None:
        self.content, self.near = content, near or content

    def held(self, kind) -> str:
        return f"_1 {kind(self.content)}, _2 {kind(self.near)}"

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        exact, loose = [], []
        for now in _rows(pdf, self.content, self.near):
            if state is None:
                exact.append(None)
                loose.append(None)
            else:
                exact.append(now[0] != state[0])
                loose.append(now[0] != state[0] and now[1] != state[1])
            state = list(now)
        return {"changed_exact": exact, "changed": loose}, state


class Epochs:
    """Running epoch number, as ``with_epoch``; the state is the last size, time and number."""

    columns = {"cut_epoch": "bigint"}

    def __init__(self, pts: str = "pts_ns", lo_ns: int = C.SHORTEST_NS, hi_ns: int = C.LONGEST_NS) -> None:
        self.pts, self.lo_ns, self.hi_ns = pts, lo_ns, hi_ns

    def held(self, kind) -> str:
        return f"_1 bigint, _2 bigint, _3 {kind('width')}, _4 {kind('height')}"

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        out = []
        for pts, width, height in _rows(pdf, self.pts, "width", "height"):
            pts = None if _null(pts) else int(pts)
            number = 0
            if state is not None:
                number, was, w, h = state
                known = pts is not None and was is not None
                steady = known and (width, height) == (w, h) and self.lo_ns <= pts - was <= self.hi_ns
                number += not steady
            state = [number, pts, width, height]
            out.append(number)
        return {"cut_epoch": out}, state


class Cadence:
    """Cadence state of every sample over a trailing window, as ``plans.cadence``."""

    columns = {"state": "string", "state_reason": "string", "fps": "double", "updates": "bigint",
               "strict_fps": "double", "repeat_proof": "boolean"}

    def __init__(self, content: str = "content", near: str | None = None, window_ns: int = C.WINDOW_NS,
                 max_gap_ns: int = C.MAX_GAP_NS, max_age_ns: int = R.MAX_AGE_NS) -> None:
        self.content, self.near = content, near or content
        self.window_ns, self.max_gap_ns, self.max_age_ns = window_ns, max_gap_ns, max_age_ns

    def held(self, kind) -> str:
        layout = ", ".join(f"_{i}: {kind(n)}" for i, n in enumerate(("width", "height", "pixel_format", "plane_count"), 1))
        return (f"prev struct<epoch: {kind('epoch')}, seq: {kind('seq')}, layout: struct<{layout}>, pts: bigint, "
                f"content: {kind(self.content)}, near: {kind(self.near)}>, start bigint, loose array<bigint>, exact array<bigint>, "
                "seen array<struct<_1: bigint, _2: boolean>>")

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        s = dict(state) if state else {"prev": None, "start": None, "loose": [], "exact": [], "seen": []}
        out: dict[str, list] = {n: [] for n in self.columns}
        names = ("pts_ns", "epoch", "seq", "width", "height", "pixel_format", "plane_count", self.content, self.near)
        for pts, epoch, seq, *layout, content, near in _rows(pdf, *names):
            pts = None if _null(pts) else int(pts)
            supported = LAYOUTS.get(layout[2]) == layout[3]
            reason = self._reason(s["prev"], pts, epoch, seq, layout, supported)
            if reason is None:
                before = s["prev"]
                differs = content != before["content"]
                s["seen"].append([pts, differs])
                if differs:
                    s["exact"].append(pts)
                    if near != before["near"]:
                        s["loose"].append(pts)
            else:
                s.update(start=pts, loose=[], exact=[], seen=[])
            usable = supported and pts is not None
            s["prev"] = {"epoch": epoch, "seq": seq, "layout": layout if supported else None,
                         "pts": pts if usable else None, "content": content, "near": near}
            warm = reason is None and pts - s["start"] >= self.window_ns
            if warm:
                self._prune(s, pts - self.window_ns)
            for name, value in zip(self.columns, self._row(s, reason, warm, pts), strict=True):
                out[name].append(value)
        return out, s

    def _reason(self, prev, pts, epoch, seq, layout, supported) -> str | None:
        if pts is None:
            return "invalid_timestamp"
        if not supported:
            return "unsupported_format"
        if prev is None:
            return "warming_up"
        if prev["epoch"] != epoch:
            return "epoch_changed"
        if seq != prev["seq"] + 1:
            return "sequence_gap"
        if prev["layout"] is not None and prev["layout"] != layout:
            return "layout_changed"
        if prev["pts"] is None:
            return "warming_up"
        step = pts - prev["pts"]
        return "timestamp_discontinuity" if step <= 0 or step > self.max_gap_ns else None

    @staticmethod
    def _prune(s: dict, start: int) -> None:
        for name in ("loose", "exact"):
            s[name] = s[name][bisect_right(s[name], start):]
        s["seen"] = s["seen"][bisect_right(s["seen"], start, key=lambda e: e[0]):]

    def _row(self, s: dict, reason: str | None, warm: bool, pts: int | None) -> tuple:
        if not warm:
            return "unknown", reason or "warming_up", None, 0, None, False
        strict, proof = self._strict(s, pts)
        loose = s["loose"]
        n = len(loose)
        if n == 0 or pts - loose[-1] > self.max_age_ns:
            return "unknown", "static_content", None, n, strict, proof
        if n < R.MIN_UPDATES or loose[-1] <= loose[0]:
            return "unknown", "insufficient_changes", None, n, strict, proof
        return "estimated", None, (n - 1) * 1e9 / (loose[-1] - loose[0]), n, strict, proof

    def _strict(self, s: dict, pts: int) -> tuple[float | None, bool]:
        times = s["exact"]
        if len(times) < R.MIN_UPDATES or pts - times[-1] > self.max_age_ns:
            return None, False
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        middle = sorted(gaps)[len(gaps) // 2]
        even = sum(abs(g - middle) <= middle * R.GAP_TOLERANCE for g in gaps)
        if middle <= 0 or even * 4 < len(gaps) * 3:
            return None, False
        repeats = sum(not differs for _, differs in s["seen"])
        proof = repeats >= R.MIN_REPEATS and repeats >= len(s["seen"]) * R.REPEAT_SHARE
        return (len(times) - 1) * 1e9 / (times[-1] - times[0]), proof


class PinnedEpoch:
    """After a reset only the named epoch is accepted; everything else is refused.

    A row with ``reset_to`` set is the reset itself.
    """

    columns = {"accepted": "boolean", "pinned": "bigint"}

    def held(self, kind) -> str:
        return "value bigint"

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        accepted, pinned = [], []
        for reset, epoch in _rows(pdf, "reset_to", "epoch"):
            if not _null(reset):
                state = int(reset)
            accepted.append(_null(reset) and (state is None or epoch == state))
            pinned.append(state)
        return {"accepted": accepted, "pinned": pinned}, state


class Increasing:
    """Keep rows later than all before them, and count the rest."""

    columns = {"late": "boolean", "n_late": "bigint"}

    def __init__(self, time: str = "pts_ns") -> None:
        self.time = time

    def held(self, kind) -> str:
        return "_1 bigint, _2 bigint"

    def __call__(self, pdf: pd.DataFrame, state: object) -> tuple[dict[str, list], object]:
        top, lost = state or (None, 0)
        late, counts = [], []
        for time in pdf[self.time].tolist():
            behind = _null(time) or (top is not None and time <= top)
            if behind:
                lost += 1
            else:
                top = int(time)
            late.append(behind)
            counts.append(lost)
        return {"late": late, "n_late": counts}, [top, lost]
