"""Bit-plane clusters, addressable token files and the prefix trie against plain versions."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tickweave.llm import bitplanes, codes, prefix_trie, queries

SQL_SAMPLE = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")


@SQL_SAMPLE
@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_prefix_trie"])
def test_query_equals_sql(spark, sample, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sample}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, sample).select(*names).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_dots_are_exact():
    rnd = np.random.default_rng(1)
    for top in (1, 2, 100, 1 << 20, bitplanes.LIMIT):
        v, c = rnd.integers(-top, top + 1, (40, 64)), rnd.integers(-top // 3 - 1, top + 1, (5, 64))
        assert (bitplanes.dots(bitplanes.pack(v), bitplanes.pack(c)) == v @ c.T).all()
        planes = bitplanes.pack(v)
        assert (np.einsum("j,njd->nd", bitplanes.weights(planes.shape[1]), bitplanes.unpacked(planes).astype(np.int64)) == v).all()
    zero = np.zeros((2, 64), np.int64)
    assert (bitplanes.dots(bitplanes.pack(zero), bitplanes.pack(zero - 1)) == 0).all()


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    c = [list(v) for _, v in first]
    far = lambda v, u: sum((a - b) ** 2 for a, b in zip(v, u))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)].append(v)
        for j, vs in mine.items():
            c[j] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted((str(i), near(v), far(v, c[near(v)])) for i, v in kept)


def test_clusters_with_awkward_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 3) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (None, [0.5] * 64), ((1 << 60) + 1, [0.25] * 64), (301, [1000.0] * 64), (302, [-1000.0] * 64)]
    rows += [(401, None), (402, []), (403, [1.0] * 63), (404, [1.0] * 63 + [None]), (405, [1.0] * 63 + [float("nan")]), (406, [1.0] * 63 + [float("inf")]), (407, [-0.0] * 64)]
    schema = "vec_id long, embedding array<double>, planes int, norm string, `a b` int, cluster int"
    df = spark.createDataFrame([(i, v, 1, "n", 2, 9) for i, v in rows], schema).repartition(4)
    assigned, centroids = bitplanes.clusters(df)
    assert centroids.shape == (16, 64)
    got = bitplanes.with_inertia(assigned, centroids).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == plain_clusters(rows)
    per = defaultdict(int)
    for r in got:
        per[r.cluster] += r.distance
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in got)
    assert {r.cluster: r.centroid_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest() for k in per}


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert bitplanes.with_inertia(*bitplanes.clusters(spark.createDataFrame([], schema))).collect() == []
    got = bitplanes.with_inertia(*bitplanes.clusters(spark.createDataFrame([(1, [1.0] * 64), (2, [3e38] * 64), (3, [-3e38] * 64)], schema))).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (2, 0), (3, 0)] and len({r.cluster for r in got}) == 3


def test_segment_is_directly_addressable():
    rnd = random.Random(2)
    for most in (0, 255, 256, 70_000, (1 << 32) - 1):
        docs, every = [], []
        for d in [None, -5, 3, 3, 1 << 62]:
            ids = [rnd.randint(0, most) if rnd.random() < 0.5 else rnd.randint(0, min(most, 300)) for _ in range(rnd.choice([0, 1, 700, 5000]))]
            docs.append((d, np.array(ids, np.uint32)))
            every += ids
        part = codes.Segment(codes.segment(docs, 3, 4) + b"\n")
        assert (part.n_ids, part.n_docs, part.place, part.turn) == (len(every), 5, 3, 4)
        assert [part.at(i) for i in range(0, len(every), 7)] == every[::7]
        assert [(d, i.tolist()) for d, _, i in part.documents()] == [(d, i.tolist()) for d, i in docs]
        for _ in range(50):
            a, b = sorted(rnd.choices(range(len(every) + 1), k=2))
            assert part.between(a, b).tolist() == every[a:b]
    with pytest.raises(ValueError):
        codes.Segment(codes.segment(docs)[:-9])


def test_encoder_equals_library():
    plain = Tokenizer.from_file(codes.MODEL)
    plain.encode_special_tokens = True
    rnd, near = random.Random(3), [chr(c) for c in range(0x250)]
    texts = ["", " ", "it's we'll I'd 'S ''t", "a b \u0085 c  \n\n d", "<|endoftext|>", "x <|endoftext|> y", "日本語 text space", "\U0001f600 ok", "a\x1cb \x1f c", "tab\t\tand  two  "]
    texts += ["".join(rnd.choices(near + [" ", "\n", "'", "s", "é"] * 60, k=rnd.randint(1, 200))) for _ in range(400)]
    small = codes.Encoder(kept=50)
    for _ in range(2):  # the second pass starts with kept words
        got = [np.frombuffer(b, "<u4").tolist() for b in map(small.encode, texts)]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def plain_tokens(rows):
    plain = Tokenizer.from_file(codes.MODEL)
    plain.encode_special_tokens = True
    out, every = [], []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    return out, every


def test_files_round_trip_and_lookup(spark, odd, tmp_path):
    folder = f"{tmp_path}/ids"
    codes.write(odd, folder, most=50)
    got = codes.read(spark, folder).collect()
    assert len(list(tmp_path.glob("ids/part-*"))) > 2
    want, every = plain_tokens([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    at = [0, 5, 17, 17, len(every) - 1, len(every), -1, None] + list(range(100, len(every), 997))
    found = {r.position: r.id for r in codes.lookup(spark, folder, spark.createDataFrame([(p,) for p in at], "position long")).collect()}
    assert found == {p: every[p] for p in at if p is not None and 0 <= p < len(every)}


def test_no_documents(spark, none, tmp_path):
    codes.write(none, f"{tmp_path}/none")
    assert codes.read(spark, f"{tmp_path}/none").collect() == []


@SQL_SAMPLE
def test_token_query(spark, sample):
    rows = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_token_files(spark, sample).collect()), key=lambda r: r[1]) == plain_tokens(rows)[0]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends, whole = defaultdict(set), defaultdict(list), {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].add(c)
        ends[whole[c]].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(out[q][6] for q in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(out[q][5] for q in below) or 1, saved, digest)
    return sorted(map(str, out.values()))


TALK = "conv_id long, turn long, role string, text string, depth int, x string, n long, `a b` int, `at` int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], TALK).repartition(3)


def test_trie_with_copies_nulls_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "ENDS_SHIFT", 2)
    rnd, rows = random.Random(4), []
    for c in range(0, 420):
        if c % 100 == 0 and c in (200,):
            continue  # 201 to 299 have no first conversation
        base = 7 if c % 3 == 0 else c
        for t in range(rnd.choice([1, 2, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else None, f"text {base if c % 2 else 7} {t}" if t else "hello"))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(100) for t in range(30)]
    rows += [(5000, t, "bot", f"long {t}") for t in range(300)] + [(5001, t, "bot", f"long {t}") for t in range(280)]
    rows += [(6001, None, "a", "null first"), (6001, 0, "a", "then"), (6001, 0, "a", "then"), (6001, 0, None, None), (6002, 3, "", ""), (None, 0, "user", "nobody"), (6100, 0, "a", "b")]
    got = prefix_trie.trie(talk(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rows)


@pytest.mark.parametrize("cells", [1, 1 << 16])
def test_a_full_sketch_changes_nothing(spark, monkeypatch, cells):
    rows = [(c, t, "u", f"{c % 9} {t * (c % 4)}") for c in range(60) for t in range(6)]
    monkeypatch.setattr(prefix_trie.Sketch, "places", lambda self, x, y: [x.view(np.uint64) % np.uint64(cells)] * prefix_trie.ROWS)
    assert sorted(str(tuple(r)) for r in prefix_trie.trie(talk(spark, rows)).collect()) == plain_trie(rows)


def test_screening_proves_tails(spark):
    rows = [(c, t, "u", f"{c} {t}") for c in range(1, 40) for t in range(20)]
    flagged = prefix_trie.screened(prefix_trie.prefixes(*prefix_trie.rebuilt(prefix_trie.turns(talk(spark, rows)))))
    n = flagged.filter("shared AND depth > 0").count()
    assert n < 0.01 * flagged.count() and flagged.filter("depth = 0 AND shared").count() == 39


def test_no_conversations(spark):
    assert prefix_trie.trie(talk(spark, [])).collect() == [] and prefix_trie.trie(talk(spark, [(None, 1, "a", "b")])).collect() == []


def test_turnless_conversation(spark):
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its own turns go, the first conversation is absent
    rows = [(lost, 0, "u", "gone"), (300, 0, "u", "x")]
    assert sorted(str(tuple(r)) for r in prefix_trie.trie(talk(spark, rows)).collect()) == plain_trie(rows)
