"""Periodic runs against their definition; whitening against a covariance in exact and long arithmetic."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidebook.llm import queries, runs, whitening

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(row, shortest=6, times=4):
    """Every stretch on which words q apart are the same, for every q; the smallest q of equal stretches."""
    row, best = np.asarray(row), {}
    for q in range(1, len(row) // times + 1):
        same = np.concatenate([[0], (row[:-q] == row[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(shortest, times * q):
                best.setdefault((a, b - a + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def made(draw, most=70):
    n, k, row = draw.randint(0, most), draw.randint(1, 4), []
    while len(row) < n:
        if draw.random() < 0.5:
            row += [draw.randint(0, k) for _ in range(draw.randint(1, 5))] * draw.randint(1, 7)
        else:
            row.append(draw.randint(0, k + 3))
    return row


def test_runs_of_small_rows():
    draw = random.Random(1)
    for _ in range(1500):
        row = made(draw)
        assert [tuple(r) for r in runs.find_runs(list(map(str, row))).tolist()] == plain_runs(row)
        every = runs.runs_of(np.array(row, np.int64), 1, 2)
        assert [tuple(r) for r in every.tolist()] == plain_runs(row, 1, 2)


def test_stretches_hold_all_runs_and_little_else():
    draw = random.Random(2)
    row = [draw.randint(0, 10**6) for _ in range(3000)]
    assert runs.stretches(np.unique(np.array(row), return_inverse=True)[1]) == []
    line = [f"l{k}" for k in range(12)]
    apart = [*map(str, row[:50]), *line, *map(str, row[50:100]), *line, *map(str, row[100:150])]
    assert len(runs.find_runs(apart)) == 0  # a line that comes twice is no run
    words = [*map(str, row[:500]), *[str(k) for k in row[500:900]] * 5, *map(str, row[900:])]
    assert runs.find_runs(words).tolist() == [[500, 2000, 400]]


def test_longest_extensions():
    draw = random.Random(3)
    row = [draw.randint(0, 1) for _ in range(200)]
    found = runs.Extensions(runs.SuffixTree(row))
    for _ in range(500):
        a, b = draw.sample(range(201), 2)
        want = next((k for k in range(201) if a + k >= 200 or b + k >= 200 or row[a + k] != row[b + k]), 0)
        assert found.common(np.array([a]), np.array([b])).tolist() == [want]


def test_one_long_repetition():
    words = [f"w{k}" for k in range(9000)] * 5
    assert runs.find_runs(words).tolist() == [[0, 45000, 9000]]
    assert runs.find_runs(["a"] * 60000).tolist() == [[0, 60000, 1]]
    assert runs.kept_words(["a"] * 9 + ["b"], runs.find_runs(["a"] * 9 + ["b"])) == ["a", "b"]


def test_every_row_of_collapse_is_defined(spark):
    rows = [(1, None, 7), (1, "", 7), (None, " ", 7), (3, " a\tb\x0ba b a b a b c ", 7), (3, " a\tb\x0ba b a b a b c ", 7)]
    found = runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, n_words long"))
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in found.collect())
    run = [(0, 8, 2)]
    assert got == [(0, 1, " ", []), (1, 0, "", []), (1, 0, "", []), (3, 9, "a b c", run), (3, 9, "a b c", run)]
    assert runs.collapse(spark.createDataFrame([], "text string")).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    known = {}
    found = plain_runs([known.setdefault(w, len(known)) for w in words])
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (
        doc_id,
        len(found),
        *first,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_op13(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(d.doc_id, d.text) for d in docs)


# Whitening


def plain_whitening(rows, components=16):
    """From {vec_id: x}: the eigenvectors of the exact covariance."""
    fit = np.unique(np.array(list(rows.values())), axis=0)
    n, total = len(fit), [sum(int(v) for v in c) for c in fit.T]
    off = np.array([[float(Fraction(int(v) * n - s, n)) for v, s in zip(r, total, strict=True)] for r in fit])
    e, axes = np.linalg.eigh(off.T @ off / n)
    deviation = {k: sum((n * int(v) - s) ** 2 for v, s in zip(x, total, strict=True)) for k, x in rows.items()}
    centred = {k: np.array([float(Fraction(int(v) * n - s, n)) for v, s in zip(x, total, strict=True)]) for k, x in rows.items()}
    return n, deviation, centred, e[::-1][:components], axes[:, ::-1][:, :components], e.sum()


def check(found, rows, components=16, near=1e-7):
    n, deviation, centred, e, axes, trace = plain_whitening(rows, components)
    assert {r.n for r in found} <= {n} and {r.component for r in found} == set(range(1, len(e) + 1))
    assert all(r.deviation == deviation[r.vec_id] for r in found)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-6
    for c in range(len(e)):
        own = sorted((r.vec_id, r.whitened, r.explained) for r in found if r.component == c + 1)
        assert all(math.isclose(x[2], e[c] / trace, rel_tol=1e-6) for x in own)
        want = np.array([centred[k] @ axes[:, c] / math.sqrt(e[c]) for k, _, _ in own])
        got = np.array([x[1] for x in own])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) <= near * max(1, np.abs(want).max())


def test_op11(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = {v.vec_id: np.floor(64 * np.array(v.embedding, float)).astype(np.int64) + 1_000_000 for v in vectors}
    check(queries.QUERIES["op11_whitening"](spark, SF_DIR).collect(), rows)


def test_whitening_of_every_kind_of_row(spark):
    draw = np.random.default_rng(5)
    given = [(k, draw.normal(size=5).tolist(), k) for k in range(80)]
    rows = {k: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for k, v, _ in given}
    given += [(3, given[3][1], 0), (200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0], 0), (202, [float("nan")] * 5, 0)]
    given += [(203, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (204, [], 0), (205, [1e300] * 5, 0)]
    given += [(300 + k, [float(k % 2)], 0) for k in range(4)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>, n int")
    found = whitening.whiten(frame).collect()
    short = [r for r in found if r.vec_id >= 300]
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9))) for r in short) == [(300 + k, 1, 2, 4096, 1.0) for k in range(4)]
    check([r for r in found if r.vec_id < 300], rows, 5)
    assert len([r for r in found if r.vec_id == 3]) == 10
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.where("vec_id = 3")).collect() == []


@pytest.mark.parametrize("size", [1e-2, 1e-6])
def test_small_components_keep_their_digits(spark, size):
    """Three directions whose spreads are far apart, turned so that no number shows it."""
    draw = np.random.default_rng(6)
    turn = np.linalg.qr(draw.normal(size=(3, 3)))[0]
    x = (draw.normal(size=(400, 3)) * [1e9, 1e9 * size, 1e9 * size * size] @ turn).tolist()
    found = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    rows = np.floor(64 * np.array(x)).astype(np.int64)
    s = np.linalg.svd((rows - np.round(rows.mean(0)).astype(np.int64)) - (rows - np.round(rows.mean(0)).astype(np.int64)).mean(0), compute_uv=False)
    e = s * s
    got = {r.component: r.explained for r in found}
    assert all(math.isclose(got[k + 1], e[k] / e.sum(), rel_tol=1e-4) for k in range(3))
    assert found[0].identity_error <= 1e-4
    assert {r.deviation for r in found} == {None}  # beyond a long


def test_components_that_do_not_vary_are_left_out(spark):
    draw = np.random.default_rng(7)
    x = [[a, b, a + b, 5.0, a] for a, b in draw.integers(-9, 9, size=(200, 2)).astype(float).tolist()]
    found = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in found} == {1, 2}
    assert found[0].identity_error < 1e-9
    assert math.isclose(sum({r.component: r.explained for r in found}.values()), 1)
