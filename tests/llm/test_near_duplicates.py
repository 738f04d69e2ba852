import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tickweave.llm import components, lattice, minhash, queries
from tickweave.session import cut

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets_of(rows, n=2):
    out = {}
    for i, text in rows:
        w = (text or "").encode().translate(LOW).split()
        out[i] = frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def roots(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def similar(sets):
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        met = Counter(j for g in s for j in where[g] if j > i)
        for j, k in met.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                yield i, j


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
@pytest.mark.parametrize("name", ["op1_near_duplicates", "op8_near_duplicate_vectors"])
def test_query_equals_sql(spark, sample, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sample}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    got = queries.QUERIES[name](spark, sample)
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(want)


def test_chains_copies_and_near_copies(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [rnd.choice(words) for _ in range(120)]
    for k in range(60):  # one group: each is the base with a few words changed, far ones are similar only to nearer ones
        own = list(base)
        for j in rnd.sample(range(120), k % 12):
            own[j] = rnd.choice(words)
        rows.append((k, " ".join(own)))
    chain = [rnd.choice(words) for _ in range(80)]
    for k in range(60, 90):  # a chain: every step changes one more word
        chain = list(chain)
        chain[(k * 2) % 80] = f"new{k}"
        rows.append((k, " ".join(chain)))
    rows += [(k, rows[5][1].upper()) for k in range(90, 120)]
    rows += [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for k in range(120, 300)]
    rows += [(300, None), (301, ""), (302, "w1"), (303, "W1"), (304, " \n")]
    sets = sets_of(rows)
    want = roots(list(sets), similar(sets))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_awkward_documents(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == by_id[6].component_id == by_id[7].component_id == by_id[9].component_id == 5
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[2].component_id == 2 and by_id[8].n_shingles == 1
    assert by_id[None].kept and by_id[None].component_id is None
    left = minhash.without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 8, 10, 11, 12, 12]
    assert minhash.near_duplicates(none).count() == 0 and minhash.without_near_duplicates(none).count() == 0


def test_registers_agree_as_often_as_sets():
    rnd = np.random.default_rng(1)
    for n, shared in ((5, 4), (60, 50), (3000, 2400)):
        agree = []
        for _ in range(60):
            pool = rnd.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            a, b = minhash.registers(np.unique(pool[:n])), minhash.registers(np.unique(pool[n - shared :]))
            agree.append(minhash.estimate(a[None], b[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.05


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 200)] + [(7, 7), (3, 2), (2, 3)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.id, r.component) for r in got} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_points_are_nearest():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 8)) * 3
    near = lattice.decode(x)
    twice = 2 * near
    assert (twice == np.rint(twice)).all() and ((near % 1 == 0).all(axis=1) | (near % 1 == 0.5).all(axis=1)).all() and (near.sum(axis=1) % 2 == 0).all()
    own = ((x - near) ** 2).sum(axis=1)
    for step in lattice._shortest():
        assert (((x - near - step) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_vectors(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(40, 16))
    rows = [(k, [float(x) for x in v[k]], 1) for k in range(40)]
    for k in range(40, 160):  # around the threshold
        noise = rnd.normal(size=16)
        c = rnd.uniform(0.8, 0.99)
        a = v[k % 8] / np.linalg.norm(v[k % 8])
        noise -= (noise @ a) * a
        rows.append((k, [float(x) for x in 3 * (c * a + (1 - c * c) ** 0.5 * noise / np.linalg.norm(noise))], 2))
    rows += [(k, rows[3][1], 0) for k in range(160, 170)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [], 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    good = {i: np.array(e, np.float32).astype(float) for i, e, _ in rows if e and None not in e and np.isfinite(e).all() and any(e)}
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    n, want = Counter(x for p in pairs for x in p), roots([r[0] for r in rows], pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}
    assert lattice.near_duplicates(cut(df.limit(0))).count() == 0


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    a = rnd.normal(size=8)
    rows = [(k, [float(x) for x in a + 0.01 * rnd.normal(size=8)]) for k in range(90)]
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 16)
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all(r.n_links == 89 and r.component_id == 0 for r in got)


def test_double_vectors_of_any_size(spark):
    """Cosines are taken in double precision: exactly 0.9 links, and so do huge and tiny equal vectors."""
    line = [0.9, math.sqrt(1 - 0.9 ** 2)] + [0.0] * 62
    axis = [1.0] + [0.0] * 63
    exact = float(np.dot(line, axis) / (np.linalg.norm(line) * np.linalg.norm(axis)))
    rows = [(1, axis), (2, line)] + [(10 + k, [10.0 ** (300 if k < 2 else -300) * (-1 if k % 4 > 1 else 1)] * 64) for k in range(4)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (got[2].component_id == 1) == (exact >= 0.9) and {got[10].component_id, got[11].component_id} == {10} and got[12].component_id == got[13].component_id == 12
