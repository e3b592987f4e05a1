"""Joins of like with like, archives, conversations and the pipeline, against plain Python."""

import base64
import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidebook.llm import components, jaccard_join, multi_index, preference, queries, warc

SF_DIR = "/root/testdata/sf0.001"
DENSE_DIR = "/root/testdata/check_h"


class Classes(dict):
    """Union-find over whatever comes up."""

    def __missing__(self, x):
        self[x] = x
        return x

    def top(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.top(x), self.top(y)))
        self[y] = x


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)]
    edges += [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(300, 300), (None, 5), (1, 1)]
    want = Classes()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, want.top(x)) for x in want)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# Jaccard join


def plain_sets(docs):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain_clusters(docs):
    sets, classes = plain_sets(docs), Classes()
    flat = [(i, s) for i, own in sets.items() if i is not None for s in own]
    for x, (i, s) in enumerate(flat):
        for j, t in flat[:x]:
            if i != j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                classes.join(i, j)
    known = lambda x: -1 if x is None else x
    return sorted((known(i), len(s), -1 if i is None else classes.top(i)) for i, own in sets.items() for s in own)


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"w{draw.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(40)]
    docs, common = [], [f"c{k}" for k in range(30)]
    for _ in range(8):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 12, 60, 200]))]
        if draw.random() < 0.5:
            base = common + base
        docs += [" ".join(edited(draw, base, draw.choice([0, 0, 1, 2, len(base) // 25]))) for _ in range(12)]
    docs = [(1 + k, d) for k, d in enumerate(docs)]
    docs += [(500, None), (501, ""), (502, " \t"), (503, "Ä B"), (504, "ä b"), (505, "Ä b"), (None, docs[0][1]), (1, docs[0][1]), (7, "seven own words are in this one")]
    docs.append((600, "long " + " ".join(f"x{k % 977} y{k % 631}" for k in range(20000))))
    docs.append((601, docs[-1][1] + " end"))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3)
    found = jaccard_join.clusters(frame).fillna(-1).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)
    want = plain_clusters(docs)
    assert got == want


def test_an_id_with_a_copy_and_another_text_keeps_its_links(spark):
    draw = random.Random(9)
    a, b = ([f"v{draw.randint(0, 10**6)}" for _ in range(40)] for _ in range(2))
    docs = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b[:-1], "other"])), (8, " ".join(b[:20]))]
    got = jaccard_join.clusters(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]


def test_shingle_sets(monkeypatch):
    draw = random.Random(4)
    texts = ["", None, " \t", "a", "A b", "a  b", "a b c d e", "A B C D E f", "\ud800 x", "é É z"]
    texts += [" ".join(draw.choice("ab") for _ in range(draw.randint(1, 30))) for _ in range(200)]
    plain = [own[0] for own in plain_sets(list(enumerate(texts))).values()]
    for held in (jaccard_join.HASHED, 40, 3):
        monkeypatch.setattr(jaccard_join, "HASHED", held)
        got, seen = jaccard_join.shingle_sets(texts), {}
        assert [len(g) for g in got] == [len(p) for p in plain]
        assert all(seen.setdefault(p, g.tobytes()) == g.tobytes() for p, g in zip(plain, got, strict=True))
        assert len(set(seen.values())) == len(seen)


def test_clusters_of_nothing(spark):
    assert jaccard_join.clusters(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_never_lose_a_pair():
    """Any level finds every pair: the prefixes for its sizes share at least as many shingles as asked for."""
    draw = random.Random(2)
    for _ in range(300):
        n_r = draw.randint(1, 80)
        n_s = draw.randint(-(-75 * n_r // 100), n_r)
        overlap = -(-75 * (n_r + n_s) // 175)
        if overlap > n_s:
            continue
        shared = draw.randint(overlap, n_s)
        tokens = draw.sample(range(1000), n_r + n_s - shared)
        r, s = sorted(tokens[:n_r]), sorted(tokens[n_r - shared :])
        for level in range(1, 1 + min(6, jaccard_join.least(n_r))):
            stored_r, stored_s = (n - jaccard_join.least(n) + min(6, jaccard_join.least(n)) for n in (n_r, n_s))
            p_r, p_s = n_r - overlap + level, n_s - overlap + level
            assert len(set(r[: min(p_r, stored_r)]) & set(s[: min(p_s, stored_s)])) >= level


def test_op7(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op7_jaccard_join(spark, SF_DIR).collect())
    assert got == plain_clusters(docs)


# Multi-index


def plain_links(rows):
    """Every row is a vector; classes go by the least id that rows reach."""
    classes, count, good = Classes(), defaultdict(int), {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[(i, k)] = (np.array(v, float) / np.linalg.norm(np.array(v, float)), label)
    names = sorted(good)
    for x, i in enumerate(names):
        for j in names[:x]:
            if good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93:
                classes.join(i, j)
                count[i] += 1
                count[j] += 1
    return sorted((i, count[(i, k)], classes.top((i, k))[0]) for k, (i, _, _) in enumerate(rows) if i is not None)


def vectors(seed, n=500, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(k, (centres[k % 12] + rng.normal(size=dim) * 0.25).tolist(), int(k % 12) // 4) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] + [1.0] * (dim - 1), [inf] * dim, [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)]
    return rows + [(n + 20, rows[0][1], None), (None, rows[0][1], 0), (n + 30, rows[0][1], 0)]


@pytest.mark.parametrize(("seed", "block"), [(1, 2000), (2, 20)])
def test_near_duplicates(spark, monkeypatch, seed, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    got = multi_index.near_duplicates(frame, recall=1.0)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect() if r.vec_id is not None)
    want = plain_links(rows)
    links = sum(r[1] for r in want)
    assert [r[0] for r in found] == [r[0] for r in want] and links > 500
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    assert sum(r[1] for r in found) >= 0.97 * links
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect() if r.vec_id is not None)
    assert multi_index.near_duplicates(frame.limit(0)).collect() == []


def test_traversal_visits_the_nearest_cells_in_order():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(300, 6))
    grid = multi_index.Grid(multi_index.unit(sample), 4000)
    own = multi_index.unit(rng.normal(size=(20, 6)))
    a, b = grid.halves(own)
    cells, far = grid.traverse(own, 17)
    sums = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    assert np.allclose(np.sort(sums, 1)[:, :17], far)
    assert np.allclose(np.take_along_axis(sums, cells, 1), far)


def test_op5(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op5_multi_index(spark, SF_DIR).collect())
    assert got == plain_links(rows)


@pytest.mark.skipif(not os.path.isdir(DENSE_DIR), reason="the table with links is not here")
def test_recall_over_all_rows(spark):
    rows = spark.read.parquet(f"{DENSE_DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    own, label = multi_index.unit(np.stack(rows["embedding"].to_numpy())), rows["label"].to_numpy()
    n = np.zeros(len(rows), int)
    for k in range(0, len(rows), 1000):
        n[k : k + 1000] = ((own[k : k + 1000] @ own.T >= 0.93) & (label[k : k + 1000, None] == label)).sum(1) - 1
    got = queries.op5_multi_index(spark, DENSE_DIR).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got <= n).all() and got.sum() >= 0.9 * n.sum() > 0


def beside(n_hot, n_pairs, seed=5, n=6000, dim=64):
    """Vectors of one label; pairs of different ones at cosine 0.93 to 0.96, and one vector many times over."""
    rng = np.random.default_rng(seed)
    own = multi_index.unit(rng.normal(size=(n, dim)))
    x, way = own[:n_pairs], rng.normal(size=(n_pairs, dim))
    way = multi_index.unit(way - (way * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.931, 0.96, size=(n_pairs, 1))
    twins = cosine * x + np.sqrt(1 - cosine**2) * way
    return np.concatenate([own, twins, np.repeat(own[-1:], n_hot, 0)]).tolist()


@pytest.mark.parametrize(("n_hot", "n_pairs", "asked"), [(2000, 400, 400), (0, 400, 400), (0, 400, 1), (0, 12, 400)])
def test_recall_per_pair_of_different_vectors(spark, monkeypatch, n_hot, n_pairs, asked):
    """Neither a hot group of copies nor a lack of links among the queries makes pairs of different vectors go."""
    monkeypatch.setattr(multi_index, "QUERIES", asked)
    n = 6000
    rows = [(k, v, 0) for k, v in enumerate(beside(n_hot, n_pairs))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in multi_index.near_duplicates(frame).collect()}
    met = sum(got[k].component_id == got[n + k].component_id == k for k in range(n_pairs))
    assert met >= 0.9 * n_pairs
    assert sum(got[k].n_links for k in range(n_pairs)) >= met
    hot = [n - 1, *range(n + n_pairs, n + n_pairs + n_hot)]
    assert {(got[k].n_links, got[k].component_id) for k in hot} == {(n_hot, n - 1)}


def test_copies_count_as_links_of_others(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(5)] + [(9, [1.0, 0.1], 0), (3, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (7, [-0.0, 1.0], 1), (6, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted({(r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(frame, recall=1.0).collect()})
    assert got == sorted([*((k, 5, 0) for k in range(5)), (3, 0, 3), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 5, 0)])


def test_every_length_and_every_row_of_an_id_links(spark):
    rows = [(k, [1.0, float(k), 0.5], 0) for k in range(60)]
    rows += [(100, [1.0, 2.0, 3.0, 4.0], 0), (101, [2.0, 4.0, 6.0, 8.0], 0), (102, [5.0], 0), (103, [2.0], 0), (104, [-2.0], 0)]
    rows += [(200, [0.0, 0.0, 1.0], 1), (200, [1.0, 0.0, 0.0], 1), (201, [3.0, 0.0, 0.0], 1), (202, [0.0, 0.0, 7.0], 1), (200, [0.0, 0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(frame, recall=1.0).collect()]
    assert sorted(got) == plain_links(rows)


# WARC


def plain_pages(rows, least=0):
    top = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least:
            top[html or ""] = max(top.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = top.get(html or "", page)
        own = -1 if page is None else page
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = first == own or first is None
        out.append((page, len(body), digest, "response" if same else "revisit", None if same else first))
    return out


def captures(spark, frame, path, **options):
    found = warc.assemble(warc.read(warc.write(frame, f"file://{path}", **options))).collect()
    out = []
    for r in found:
        page, size = dict(r.metadata.fields).get("pageId"), dict(r.metadata.fields)["payloadBytes"]
        out.append((int(page) if page else None, int(size), r.payload_digest, r.record_type, r.refers_to and int(r.refers_to.split(":")[2])))
        assert r.request.record_id.startswith(r.record_id[:-1])
        if r.record_type == "response":
            assert len(r.payload) == int(size) == r.payload_bytes
    return out


PAGES = [(1, "http://a.example/ü b?q=1\n", None), (2, None, "x"), (3, "u", "x"), (4, "u", ""), (5, "v", "x"), (6, "é", "\r\n\r\nWARC/1.1\r\n"), (7, "w", "é" * 50000), (None, "n", "alone"), (None, "n", "x"), (5, "v", "x")]


@pytest.mark.parametrize("least", [0, 1, 100])
def test_captures(spark, tmp_path, least):
    frame = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    got = captures(spark, frame, tmp_path / "w", revisit_from=least, archive_bytes=700)
    assert sorted(got, key=str) == sorted(plain_pages(PAGES, least), key=str)
    assert len(os.listdir(tmp_path / "w" / "archives")) > 2
    assert captures(spark, frame.limit(0), tmp_path / "none") == []


def test_records_without_partners(spark, tmp_path):
    frame = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    records = warc.read(warc.write(frame, f"file://{tmp_path}/w"))
    alone = warc.assemble(records.where("record_type <> 'request'")).collect()
    assert len(alone) == 3 and all(r.request is None and r.metadata is not None for r in alone)
    assert warc.assemble(records.where("record_type = 'request'")).collect() == []


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("http://a.b/c?d#e", ("a.b", "/c?d")),
        ("http://a.b?d", ("a.b", "/?d")),
        ("https://a.b", ("a.b", "/")),
        ("//a/b", ("a", "/b")),
        ("http://[abc/", ("[abc", "/")),
        ("http://[x]/", ("[x]", "/")),
        ("http://a]b/", ("a]b", "/")),
        ("", ("", "/")),
        ("#", ("", "/")),
    ],
)
def test_request_of_any_uri(uri, want):
    assert warc.host_and_target(uri) == want


def test_captures_of_malformed_uris(spark, tmp_path):
    rows = [(k, u, f"<p>{k}</p>") for k, u in enumerate(["http://[abc/", "http://[x]/", "http://a]b/", "\r\n: x", "", None])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.assemble(warc.read(warc.write(frame, str(tmp_path / "odd")))).collect()
    assert len(found) == 6 and all(r.request and r.metadata and r.record_type == "response" for r in found)


def test_broken_archives_are_errors():
    import io

    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.records_in(io.BufferedReader(io.BytesIO(whole * 2)))] == [b"abcd"] * 2
    for broken in (whole[:-6], b"GET /\r\n" + whole):
        with pytest.raises(ValueError):
            list(warc.records_in(io.BufferedReader(io.BytesIO(broken))))


def test_op8(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op8_warc(spark, SF_DIR).collect())) == sorted((*p, True) for p in plain_pages(pages))


# Preferences


def turns(*texts):
    return [(role, text) for role, text in texts]


def test_format_pairs(spark):
    u, a = ("user", "hi"), ("assistant", "hello")
    rows = [
        (1, [u, a], [u, ("assistant", "bye")], "x"),
        (2, [u, a], [u, a], "x"),
        (3, [u], [u, a], "x"),
        (4, None, [u], "x"),
        (5, [], [], "x"),
        (6, [(None, None), a], [(None, None), ("assistant", None)], "x"),
        (7, [("user", "<|im_end|>"), a], [("assistant", "hi"), a], "x"),
    ]
    kind = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame(rows, f"pair long, chosen {kind}, rejected {kind}, prompt string")
    got = {r.pair: r for r in preference.format_pairs(frame).collect()}
    hi, hello = "<|im_start|>user\nhi<|im_end|>\n", [("<|im_start|>assistant\n", False), ("hello<|im_end|>\n", True)]
    pairs = lambda side: [tuple(x) for x in side]
    assert (got[1].n_shared, got[1].prompt, pairs(got[1].chosen_completion)) == (1, hi, hello)
    assert pairs(got[1].rejected_completion)[1] == ("bye<|im_end|>\n", True)
    assert (got[2].n_shared, got[2].chosen_completion, got[2].rejected_completion) == (2, [], [])
    assert (got[3].n_shared, got[3].chosen_completion, pairs(got[3].rejected_completion)) == (1, [], hello)
    assert (got[4].n_shared, got[4].prompt, got[4].chosen_completion) == (0, "", [])
    assert (got[5].n_shared, got[5].prompt, got[5].rejected_completion) == (0, "", [])
    assert got[6].n_shared == 1 and pairs(got[6].rejected_completion)[1] == ("<|im_end|>\n", True)
    assert got[7].n_shared == 0 and pairs(got[7].chosen_completion)[1] == ("< |im_end|><|im_end|>\n", False)
    assert preference.format_pairs(frame.limit(0)).collect() == []


def test_mismatched_replies(spark):
    rows = [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 1, "assistant", "x"), (3, 0, "user", "a"), (4, 0, "assistant", "only"), (6, 0, "user", "q"), (None, 0, "user", "lost"), (7, 0, "assistant", None), (7, None, "system", "s")]
    table = preference.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [[t.text for t in r.chosen], [t.text for t in r.rejected]] for r in preference.mismatched(table).collect()}
    assert got == {2: [["a", "b", "c"], ["a", "x", "c"]], 3: [["a", "x"], ["a", "b"]], 4: [["only"], []], 6: [["q"], ["q"]], 7: [["s", None], ["s"]]}


# Pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert 0 < len(got) < docs.count()
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.n_tokens == len(r.ids) and set(r.text.split("\n")) <= set(texts[i].split("\n")) for i, r in got.items())


def test_one_row_stays_of_an_id_with_several_texts(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "b " + long, "x"), (1, "a " + long, "z"), (1, "a " + long, "y"), (2, "c " + long, "x"), (None, long, "x"), (None, long, "x")]
    for shuffled in (rows, rows[::-1]):
        docs = spark.createDataFrame(shuffled, "doc_id long, text string, source string")
        got = corpus_pipeline.jaccard_stage(spark, docs, SF_DIR).collect()
        assert sorted((r.doc_id or 0, r.text[:1], r.source) for r in got) == [(0, "w", "x"), (0, "w", "x"), (1, "a", "y")]


def test_stages(spark):
    base = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, f"{base} one", "en", "s", 1),
        (2, f"{base} two", "en", "s", 1),
        (3, "1234 --", "en", "s", 1),
        (4, None, "en", "s", 1),
        (5, "a line\nof three\nlines", None, "s", 1),
        (6, "a line\nof three\nlines", "en", "s", 1),
        (6, "a line\nof three\nlines\nand its end", "en", "s", 1),
        (None, "no id at all", "en", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language_id"](spark, docs, SF_DIR)
    assert found.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in found.collect()) == [0, 1, 2, 5, 6, 6] and all(r.lang for r in found.collect())
    cut = stages["line_dedup"](spark, found, SF_DIR)
    assert sorted((r.doc_id or 0, r.n_chars) for r in cut.collect()) == sorted(
        [(0, 12), (1, len(base) + 4), (2, len(base) + 4), (5, 21), (6, 11)]
    )
    first = stages["jaccard_join"](spark, cut, SF_DIR)
    assert first.columns == docs.columns and sorted(r.doc_id or 0 for r in first.collect()) == [0, 1, 5, 6]
    assert stages["decontamination"](spark, first, SF_DIR).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).collect() == [], name
