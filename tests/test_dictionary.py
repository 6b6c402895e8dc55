"""M3 without a pass of Python over its lines."""

import numpy as np
import pytest

from quirelab.operators import coded, mechanisms


def test_many_lines_at_once(monkeypatch):
    """No line is looked up by its words, and lines go back no further than they may."""
    monkeypatch.setattr(mechanisms, "Growing", None)
    seed = [["a", "b", "c"], [], ["d", "e"], ["b"]]
    rng = lambda: np.random.default_rng(7)
    lines = mechanisms.dictionary(seed, 40_000, mechanisms.Dictionary(0.6, 0.3, 0.1, 50), rng())
    assert len(lines) == 40_000 and lines[:4] == seed
    kept = [tuple(x) in {tuple(y) for y in lines[max(0, i - 50) : i]} for i, x in enumerate(lines)][100:]
    assert np.mean(kept) > 0.6
    # A changed line has as many words as one of the last fifty and differs from it in one.
    near = [any(len(x) == len(y) and sum(a != b for a, b in zip(x, y)) <= 1 for y in lines[i - 50 : i]) for i, x in enumerate(lines[:4000]) if i >= 100]
    assert np.mean(near) > 0.9
    assert {w for x in lines for w in x} == set("abcde") and max(map(len, lines)) == 8
    # Nothing but changes: lines with words keep their lengths, and one word is put into an empty line.
    changed = mechanisms.dictionary(seed, 5000, mechanisms.Dictionary(0, 1, 0, 1), rng())
    assert {len(x) for x in changed[4:]} == {1} and all(a != b for a, b in zip(changed[3:], changed[4:]))
    from_empty = mechanisms.dictionary([["a"], ["b"], []], 4000, mechanisms.Dictionary(0, 1, 0, 1), rng())
    assert {len(x) for x in from_empty[3:]} == {1}
    assert mechanisms.dictionary([["a"]], 9, mechanisms.Dictionary(0, 1, 0), rng()) == [["a"]] * 9
    assert mechanisms.dictionary(seed, 2, mechanisms.Dictionary(), rng()) == seed[:2]


def test_fields_beside_each_other():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 900)
    c = coded.Numbers((rng.zipf(1.3, int(sizes.sum())) % 200).astype(np.int32), sizes, (np.arange(900) // 60).astype(np.int32), 200)
    assert coded.signature(c, True, beside=True) == pytest.approx(coded.signature(c), rel=0, abs=0)
