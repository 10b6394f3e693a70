"""Vector codes against loops over Python's whole numbers, and against SQL."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ledgerwood import llm
from ledgerwood.llm import vector_codes

SF = "/root/testdata/sf0.001"


def brute(rows, rounds=6):
    """rows: (id, vector, label) of one length of vector."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    sizes = [dims // 8 + (k < dims % 8) for k in range(8)]
    starts = [sum(sizes[:k]) for k in range(8)]
    whole = [[math.floor(Fraction(c) * 4096) for c in v] for _, v, _ in kept]
    parts = [[tuple(w[s : s + n]) for w in whole] for s, n in zip(starts, sizes)]
    books = [own[:16] for own in parts]

    def assign(k):
        out = []
        for p in parts[k]:
            d = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in books[k]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for k in range(8):
            at = assign(k)
            new = list(books[k])
            for e in range(len(new)):
                own = [p for p, (i, _) in zip(parts[k], at) if i == e]
                if own:
                    new[e] = tuple(sum(c) // len(own) for c in zip(*own))
            books[k] = new
    final = [assign(k) for k in range(8)]
    sha = hashlib.sha256(",".join(str(c) for own in books for e in own for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{final[k][i][0]:02x}" for k in range(8)), sum(final[k][i][1] for k in range(8)), sha, r[2]) for i, r in enumerate(kept)]


def expected(groups):
    rows = [x for g in groups for x in brute(g)]
    sums = {}
    for r in rows:
        sums[r[4]] = sums.get(r[4], 0) + r[2]
    top = vector_codes.LARGEST
    return sorted(map(repr, [(i, code, min(e, top), min(sums[label], top), sha) for i, code, e, sha, label in rows]))


def got(df):
    return sorted(repr((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in df.collect())


@pytest.mark.parametrize("few", [False, True])
def test_awkward_rows(spark, monkeypatch, few):
    monkeypatch.setattr(vector_codes, "LABELS", 1 if few else 100_000)
    rng = np.random.default_rng(3)
    draw = lambda n, d: [[float(c) for c in row] for row in rng.normal(size=(n, d)).round(3)]
    sixteen = [(i, v, i % 4 or None) for i, v in enumerate(draw(120, 16))]
    sixteen += [(200 + i, [0.25] * 16, 1) for i in range(90)]  # a third of all rows is one vector
    sixteen += [(None, draw(1, 16)[0], 2), (3, draw(1, 16)[0], 2), (3, sixteen[3][1], None), (-5, draw(1, 16)[0], None)]
    bad = [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [float("inf")] + [0.0] * 15, 1), (503, [None] + [0.5] * 15, 1)]
    odd = [(600 + i, v, 9) for i, v in enumerate(draw(40, 11))]
    few_rows = [(700 + i, v, 9) for i, v in enumerate(draw(5, 24))]
    huge = [(800 + i, [c * 10.0 ** (i % 40) for c in v], 8) for i, v in enumerate(draw(30, 8))]
    empty = [(900, [], 7), (901, [], 7)]
    groups = [sixteen + bad, odd, few_rows, huge, empty]
    df = spark.createDataFrame([(*r, "x", 1) for g in groups for r in g], "vec_id bigint, embedding array<double>, label int, code string, part int").repartition(3)
    assert got(vector_codes.compress(df)[0]) == expected(groups)


def test_bounds_drop_entries_and_lose_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 32))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 32))
    at, d, computed = vector_codes.nearest(x, centres)
    all_ = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    assert computed < 2 * len(x)  # of 16 each
    same = np.array([[1, 2], [1, 2], [3, 4]])
    assert vector_codes.nearest(np.array([[1, 2], [2, 3]]), same)[0].tolist() == [0, 0]


def test_sql_and_empty_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(vector_codes.ORACLE)
    df = llm.QUERIES["op13_vector_codes"](spark, SF)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.compress(none)[0].collect() == []
