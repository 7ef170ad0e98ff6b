"""Spelling variants, whitening and personal data against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import pii, spelling, whitening

DOCS = "doc_id bigint, text string, word string, n bigint, kind string, candidates int"


def made(spark, texts):
    rows = [(i, t, "x", 1, "k", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], None, None, None, None)], DOCS).repartition(4), [(r[0], r[1]) for r in rows] + [(None, texts[0])]


# ---- spelling variants


def vocabulary(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_brute_force(n):
    out = {}
    for w in n:
        near = [o for o in n if abs(len(o) - len(w)) <= 1 and o != w and one_edit(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        out[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(near))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(rows)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    stems = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["Éléphant", "straße", "ÿÀabcÖ"]
    words = []
    for s in stems:
        for _ in range(rng.randint(3, 14)):
            words.append(s)
        for _ in range(4):
            at, kind = rng.randrange(len(s)), rng.randrange(3)
            other = s[:at] + ("" if kind == 0 else rng.choice("aeinrst")) + s[at + (kind < 2) :]
            words += [other] * rng.randint(2, 5)
    words += ["m" * 300] * 4 + ["m" * 301] * 9 + ["m" * 150 + "n" + "m" * 149] * 3 + ["abcde", "abcdf"] * 3 + ["rosette"] * 40 + ["rosetta"] * 14 + ["rosettan"] * 5  # long words, a tie, a chain
    rng.shuffle(words)
    texts = [" ".join(words[i::12]).upper() if i % 3 == 0 else ", ".join(words[i::12]) for i in range(12)]
    return [*texts, "", None, "1234 !!", "x" * 30 + "7" + "y" * 5]


def test_variants_by_brute_force(spark, misspelt, monkeypatch):
    docs, rows = made(spark, misspelt)
    monkeypatch.setattr(spelling, "_PIECE", 50)  # runs that stand over the end of a piece
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    want = by_brute_force(vocabulary(rows))
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] != (r[1] or r[0]) for r in want)


def test_variants_over_many_cells_and_blocks(spark, misspelt, monkeypatch):
    docs, rows = made(spark, misspelt)
    want = by_brute_force(vocabulary(rows))
    monkeypatch.setattr(spelling, "CELL", 6)
    vocab = spark.createDataFrame([(r[0], r[3]) for r in want], "word string, n bigint").withColumn("length", F.length("word"))
    trees = spelling.cuts(vocab)
    assert sum(t.leaves for t in trees.values()) > 20
    near = lambda pairs: Counter(r.word for r in pairs.collect())
    assert near(spelling.near(vocab)) == Counter({r[0]: r[4] for r in want if r[4]})
    monkeypatch.setattr(spelling, "cuts", lambda rows: {})
    monkeypatch.setattr(spelling, "CELL", 1)  # every length is one cell of many blocks
    assert near(spelling.near(vocab)) == Counter({r[0]: r[4] for r in want if r[4]})


def test_box_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    counts = rng.multinomial(8, np.ones(5) / 5, 400).astype(np.int16)
    counts = np.hstack([counts, np.zeros((400, spelling.LETTERS - 5), np.int16)])
    tree, rows = spelling.Tree.of(counts, 8)
    reached = {(i, j) for leaf, ids in tree.reached(counts, 1, 1) for i in ids for j in rows[leaf]}
    apart = np.abs(counts[:, None] - counts).sum(axis=2)
    assert {(i, j) for i, j in zip(*np.nonzero(apart <= 2), strict=True)} <= reached and len(reached) < 400 * 400
    words = spelling.signatures(counts)
    assert (np.bitwise_count(words[:, None] ^ words).sum(axis=2) <= apart).all()


def test_variants_of_nothing(spark, misspelt):
    docs, _ = made(spark, misspelt)
    assert spelling.variants(docs.limit(0)).collect() == []
    assert spelling.variants(docs.where("text is null or text = ''")).collect() == []


# ---- whitening


def whitened(got, k):
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    return {i: [by[c] for c in range(1, k + 1)] for i, by in rows.items()}


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((200, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32)
    bad = [(500, None), (501, []), (502, [1.0] * 39 + [None]), (503, [float("nan")] + [0.0] * 39), (504, [float("inf")] * 40), (505, [1.0] * 7), (506, [1e30] * 40)]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(0, [float(x) for x in v[0]])] + bad  # a repeated row
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "n": F.lit(2), "component": F.lit("c")}).repartition(7)
    got = whitening.whiten(rows).collect()
    x = np.floor(64 * np.vstack([v, v[:1]]).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh((c := (n * x - s) / n).T @ c / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == 201 * 32 and {r.n for r in got} == {201} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    want = c @ u / np.sqrt(e)
    have = whitened(got, 32)
    assert set(have) == set(range(200))
    sign = np.sign([have[1][k].whitened * want[1, k] for k in range(32)])
    for i in range(200):
        assert np.allclose([r.whitened for r in have[i]], want[i] * sign, rtol=1e-7, atol=1e-9)
        assert {r.deviation for r in have[i]} == {int(((n * x[i] - s) ** 2).sum())}
    share = e / np.trace(c.T @ c / n)
    assert np.allclose([r.explained for r in have[0]], share, rtol=1e-10)


def test_triangles_are_merged_by_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 5))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(9)
    got = whitening.whiten(rows).collect()
    assert len(got) == 300 and got[0].identity_error < 1e-12


@pytest.mark.parametrize("rows, d", [([[1.0, 2.0]] * 5, 0), ([[0.0]], 0), ([[i / 8, 1.0, i / 8] for i in range(9)], 1), ([], 0)])
def test_whitening_without_variance(spark, rows, d):
    got = whitening.whiten(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == len(rows) * d


@pytest.mark.parametrize("name", ["gauss", "graded", "eye", "rank", "repeats", "tied"])
def test_qd_solver(name):
    rng = np.random.default_rng(4)
    x = {"gauss": lambda: rng.standard_normal((90, 30)), "graded": lambda: rng.standard_normal((90, 30)) * np.logspace(0, -7, 30), "eye": lambda: np.eye(30), "rank": lambda: rng.standard_normal((9, 30)), "repeats": lambda: np.tile(rng.standard_normal((3, 30)), (20, 1)), "tied": lambda: np.kron(np.eye(6), rng.standard_normal((20, 5)))}[name]()
    values, vectors = whitening.directions(whitening.triangle(x))
    want = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.allclose(values[: len(want)], want, rtol=1e-10 if name == "graded" else 1e-9, atol=1e-14 * want[0])
    k = int((values > 1e-12 * values[0]).sum())
    assert np.abs(vectors[:, :k].T @ vectors[:, :k] - np.eye(k)).max() < 1e-9
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max() < 1e-12 * values[0]


# ---- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_brute_force(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return [lambda: True, lambda: all(int(p) <= 255 for p in s.split(".")), lambda: 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, lambda: 9 <= len(digits) <= 15][kind]()

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m.group()))


CASES = ["", None, "mail a.b@c.de, @x.y@z.w and a@b.c@d.e; a@b @c.d", "x" * 200 + "@long.example.com", "1.2.3.4.5 and 256.1.1.1 and 001.002.003.0004 then 9.9.9.9", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4845168114407329", "call +1 (017) 555-7713 or +49 30 1234567. +1+2+3 +12 ) ( 9", "été é@é.de über+tag@mañana.example.org", "jane at example dot com, or bob [at] mail [dot] org", "tel (017) 555-7713, order 555 123 4567, page 12/34/567", "2001:0db8:0000:0000:0000:ff00:0042:8329", "Dear Dr. Ada Lovelace, from Herr Müller", "1" * 3000, "9" * 40 + "." + "1.2.3", "+" * 50 + "1", "7 " * 500]


def test_pii_base_by_brute_force(spark):
    rng = random.Random(9)
    alphabet = "ab1290..@@+-- ()%_é\n"
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    docs, rows = made(spark, texts)
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for key, text in rows:
        want, r = base_by_brute_force(text or ""), by_id[key]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(pii.joined(want).split(",")) - {""} <= set(spans) and len(spans) == len(want) + r.n_added
        at = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert at == sorted(at)


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    votes = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table, share = pii.reliabilities(np.zeros(len(patterns), int), patterns, n.astype(float))
    said = table[:, :, [0, 2]] / table[:, :, [0, 2]].sum(axis=2, keepdims=True)
    assert np.allclose(said[:, 1, 1], accuracy, atol=0.03) and abs(share[0] - 0.4) < 0.02
    right = lambda odds: ((odds > 0) == truth).mean()
    best = right(votes @ np.log(accuracy / (1 - accuracy)) + np.log(0.4 / 0.6))  # with the true accuracies
    assert right(p[where.ravel()] - 0.5) > best - 0.003 and best > right(votes.sum(axis=1)) + 0.01


def test_pii_adds_what_resembles_and_leaves_clean_documents(spark):
    rng = random.Random(6)
    number = lambda: f"({rng.randint(100, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"please call +1 {number()} today" for _ in range(150)] + [f"please call {number()} today" for _ in range(40)]
    texts += [f"invoice order {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}€ paid" for _ in range(100)] + ["no data here at all"] * 20
    docs, _ = made(spark, texts)
    got = sorted((r for r in pii.find(docs).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    assert all(r.n_phone == 1 for r in got[:150]) and sum(r.n_added for r in got[150:190]) >= 36
    assert sum(r.n_added for r in got[190:290]) <= 5 and all(r.spans == "" for r in got[290:])


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(7)
    x, p = rng.standard_normal((300, 6)), rng.random(300)
    w = pii.logistic(x, p)
    assert np.abs(x.T @ (p - 1 / (1 + np.exp(-x @ w))) - w).max() < 1e-6


def test_pii_of_nothing(spark):
    docs, _ = made(spark, CASES)
    assert pii.find(docs.limit(0)).collect() == []
    assert [r.spans for r in pii.find(docs.where("text = ''")).collect()] == ["", ""]  # with the row without an id
