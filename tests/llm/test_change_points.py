"""Change points against the plain search over all starts, and its odd tables."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from lexspark.llm.change_points import _Search, _Series, change_points, segment_series


def plain(values, least=7, penalty=20_000):
    """Best cost and starts, every start tried for every end."""
    n, one, two = len(values), [0], [0]
    for v in map(int, values):
        one.append(one[-1] + v)
        two.append(two[-1] + v * v)

    def cost(a, e):
        k, s, q = e - a, one[e] - one[a], two[e] - two[a]
        return k * math.floor(1000 * math.log(1 + (k * q - s * s) // (k * k)))

    least = min(least, n)
    # starts from the last segment backwards, so that tuples compare as the rule asks
    best = {0: (-penalty, 0, ())}
    for e in range(least, n + 1):
        best[e] = min((best[a][0] + penalty + cost(a, e), best[a][1] + 1, (a, *best[a][2])) for a in best if a <= e - least)
    return best[n][0], list(best[n][2][::-1])


def many(rnd):
    for k in range(50):
        n = int(rnd.integers(1, 130))
        yield [
            lambda: rnd.integers(0, 3, n),
            lambda: np.concatenate([rnd.integers(0, 10 ** int(rnd.integers(0, 5)) + 1, 13) for _ in range(n // 13 + 1)])[:n],
            lambda: np.tile([0] * 7 + [9] * 7, n // 14 + 1)[:n],
            lambda: np.zeros(n, dtype=np.int64),
            lambda: rnd.integers(-(10**12), 10**12, n),
        ][k % 5]().astype(np.int64)


@pytest.mark.parametrize("penalty", [0, 500, 20_000])
def test_equals_the_plain_search(penalty):
    series = list(many(np.random.default_rng(5)))
    for values, (starts, _, _, best) in zip(series, segment_series(series, penalty=penalty), strict=True):
        assert (best, starts.tolist()) == plain(values, penalty=penalty)


def test_blocks_that_cannot_win_stay_closed():
    rnd = np.random.default_rng(6)
    values = np.stack([rnd.integers(0, 100, 400) for _ in range(4)])
    search = _Search(_Series(values, np.full(4, 400)), 7, 20_000)
    search.run()
    blocks = 2 * sum(-(-e // 8) for e in range(400))
    assert search.pops / 4 < 0.6 * blocks


def test_segments_of_a_table(spark):
    day = datetime(2024, 2, 27)
    rows = []
    for i in range(60):
        value = 5 if i < 30 else 5 + 400 * (i % 3)
        rows += [("a", day + timedelta(days=i, hours=23), value - 2, "x")] + [("a", day + timedelta(days=i), 1, "y")] * 2
    rows += [("short", day, 3, None), ("short", day + timedelta(days=2), 4, None), (None, day, 1, "z"), ("none", None, 1, "z"), ("none", day, None, "z")]
    table = spark.createDataFrame(rows, "vendor string, at timestamp, n int, day string").repartition(5)
    found = {}
    for r in change_points(table, "vendor", "at", "n").orderBy("vendor", "segment_no").collect():
        found.setdefault(r.vendor, []).append(tuple(r)[1:])
    first = (day - datetime(1970, 1, 1)).days
    best, starts = plain([5 if i < 30 else 5 + 400 * (i % 3) for i in range(60)])
    assert [f[1] - first for f in found["a"]] == starts and {f[7] for f in found["a"]} == {best} and [f[0] for f in found["a"]] == list(range(1, len(starts) + 1))
    assert len(starts) == 2 and sum(f[3] for f in found["a"]) == sum(5 if i < 30 else 5 + 400 * (i % 3) for i in range(60))
    assert found["short"] == [(1, first, 3, 7, 3, 3 * 1098, 1, 3 * 1098)]
    assert found[None] == [(1, first, 1, 1, 1, 0, 1, 0)] and "none" not in found


def test_an_empty_table_and_clashing_names(spark):
    table = spark.createDataFrame([], "cost string, day date, value long, total int")
    out = change_points(table, "cost", "day", "value")
    assert out.count() == 0
    one = spark.sql("select 1 as vendor, date'2024-01-01' as day, 2 as value, 3 as total, 4 as best_cost")
    assert change_points(one, "vendor", "day", "value").first().total == 2
