import random
from collections import Counter, defaultdict

import pytest

from quorix.llm import term_counts as T

SCHEMA = "rb int, cb int, num_rows int, num_cols int, row_ptr array<int>, col_idx array<int>, value_r array<float>, row_map array<int>, col_map array<int>, mark string"


def blocks(seed=0):
    rng = random.Random(seed)
    out = []
    for rb in range(8):
        rows = [rng.randrange(60) for _ in range(10)]
        terms = sorted(rng.sample(range(200), 30)) + [500, 501]
        ptr, idx = [0], []
        for _ in rows:
            idx += [rng.choice([-1, None, 30, 31, 31, rng.randrange(30)]) for _ in range(rng.randrange(8))]
            ptr.append(len(idx))
        out.append((rb, 0, 10, 32, ptr, idx, None, rows, terms, "clash"))
    out.append(out[0])
    out.append((99, 0, 0, 0, None, None, None, None, None, None))
    out.append((98, 0, 0, 0, [0], [], None, [], [], None))
    out.append((97, 0, 1, 0, [0, 0], [], None, [1000], [], None))
    return out


def brute(data):
    entries, holders, records = Counter(), defaultdict(set), set()
    for b in {str(x): x for x in data}.values():
        records |= set(b[7] or [])
        for r, row in enumerate(b[7] or []):
            for c in b[5][b[4][r] : b[4][r + 1]] if b[5] else []:
                if c is not None and c >= 0:
                    entries[b[8][c]] += 1
                    holders[b[8][c]].add(row)
    return entries, {t: len(h) for t, h in holders.items()}, len(records)


@pytest.mark.parametrize(("share", "most"), [(0.002, 512), (0.1, 512), (0.002, 1), (2.0, 512)])
def test_heavy_and_light_agree_with_brute_force(spark, share, most):
    data = blocks()
    entries, holders, _ = brute(data)
    for parts in (1, 5):
        got = {r.term_id: (r.n_entries, r.n_records) for r in T.count_terms(spark.createDataFrame(data, SCHEMA).repartition(parts), share, most).collect()}
        assert got == {t: (entries[t], holders[t]) for t in entries}


def test_marks(spark):
    data = blocks(1)
    _, holders, n = brute(data)
    got = {r.term_id: r.mark for r in T.mark_terms(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {t: "rare" if h <= 3 else "common" if h >= 0.2 * n else None for t, h in holders.items()}
    assert "common" in got.values()


def test_empty(spark):
    assert T.mark_terms(spark.createDataFrame([], SCHEMA)).count() == 0
