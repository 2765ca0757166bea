"""Adaptive windowing over one ordered series (Bifet and Gavaldà, 2007), as a small state machine.

The window is an exponential histogram: buckets of (count, sum, sum of squared deviations), at most
``MAX_BUCKETS`` per level, so the state is logarithmic in the window. The same kernel runs in batch tasks
and in stream state.
"""

from __future__ import annotations

from math import log

# Our constants: buckets per level, elements before the first test, and the least size of either half.
MAX_BUCKETS = 5
GRACE = 10
MIN_HALF = 5


class Adwin:
    """``add`` returns True when the window was cut."""

    __slots__ = ("delta", "levels", "n", "total", "spread")

    def __init__(self, delta: float = 0.1):
        self.delta = delta
        self.levels: list[list[tuple[int, float, float]]] = [[]]  # per level, oldest first
        self.n, self.total, self.spread = 0, 0.0, 0.0

    def add(self, value: float, count: int = 1, spread: float = 0.0) -> bool:
        """One element, or ``count`` neighbouring ones given by their sum and squared deviations."""
        if self.n:
            gap = value / count - self.total / self.n
            self.spread += spread + gap * gap * count * self.n / (count + self.n)
        else:
            self.spread = spread
        self.n += count
        self.total += value
        self.levels[0].append((count, value, spread))
        level = 0
        while len(self.levels[level]) > MAX_BUCKETS:
            (n1, t1, s1), (n2, t2, s2) = self.levels[level][:2]
            del self.levels[level][:2]
            if level + 1 == len(self.levels):
                self.levels.append([])
            gap = t1 / n1 - t2 / n2
            self.levels[level + 1].append((n1 + n2, t1 + t2, s1 + s2 + gap * gap * n1 * n2 / (n1 + n2)))
            level += 1
        return self._shrink() if self.n > GRACE else False

    def _shrink(self) -> bool:
        changed = False
        while self.n > GRACE and self._has_cut():
            self._drop_oldest()
            changed = True
        return changed

    def _has_cut(self) -> bool:
        """Whether the means left and right of some bucket border differ by more than the bound allows."""
        n, total = self.n, self.total
        bound = log(2.0 * log(n) / self.delta)
        by_variance = 2.0 * (self.spread / n) * bound
        by_range = 2.0 / 3.0 * bound
        most = n - MIN_HALF
        n0, t0 = 0, 0.0
        for level in reversed(self.levels):
            for count, value, _ in level:
                n0 += count
                t0 += value
                if n0 > most:
                    return False
                if n0 >= MIN_HALF:
                    harmonic = n / (n0 * (n - n0))
                    over = abs(t0 / n0 - (total - t0) / (n - n0)) - by_range * harmonic
                    if over > 0.0 and over * over > by_variance * harmonic:
                        return True
        return False

    def _drop_oldest(self) -> None:
        level = len(self.levels) - 1
        while not self.levels[level]:
            level -= 1
        count, value, spread = self.levels[level].pop(0)
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()
        rest = self.n - count
        if rest:
            mean = (self.total - value) / rest
            gap = value / count - mean
            self.spread = max(0.0, self.spread - spread - gap * gap * count * rest / self.n)
        else:
            self.spread = 0.0
        self.n, self.total = rest, self.total - value

    def dump(self) -> dict:
        return {"levels": self.levels, "n": self.n, "total": self.total, "spread": self.spread}

    @classmethod
    def load(cls, delta: float, state: dict) -> Adwin:
        out = cls(delta)
        out.levels = [[tuple(b) for b in level] for level in state["levels"]]
        out.n, out.total, out.spread = state["n"], state["total"], state["spread"]
        return out


class DriftMonitor:
    """Adaptive windowing with gates: enough samples, the window filled to them, the last alarm long ago.

    An alarm restarts the window and opens a pause of ``cooldown`` rows. With a window smaller than
    ``min_samples`` the gate never opens.
    """

    def __init__(self, window: int = 150, delta: float = 0.1, min_samples: int = 50, cooldown: int = 50):
        self.window, self.delta, self.min_samples, self.cooldown = window, delta, min_samples, cooldown
        self.adwin = Adwin(delta)
        self.seen, self.total, self.quiet_until = 0, 0.0, -1

    def add(self, error: float, count: int = 1, spread: float = 0.0) -> tuple[int, int, float] | None:
        """(index, window size, mean error so far) on an alarm; ``count`` neighbouring rows come as their sum."""
        self.seen += count
        index = self.seen - 1
        self.total += error
        cut = self.adwin.add(error, count, spread)
        filled = min(self.seen, self.window)
        if not (cut and self.seen >= self.min_samples and index > self.quiet_until and filled >= self.min_samples):
            return None
        self.adwin = Adwin(self.delta)
        self.quiet_until = index + self.cooldown
        return index, filled, self.total / self.seen

    def dump(self) -> dict:
        return {"adwin": self.adwin.dump(), "seen": self.seen, "total": self.total, "quiet_until": self.quiet_until}

    def restore(self, state: dict) -> DriftMonitor:
        self.adwin = Adwin.load(self.delta, state["adwin"])
        self.seen, self.total, self.quiet_until = state["seen"], state["total"], state["quiet_until"]
        return self
