"""Embedding near-dedup, lexical search and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from speechprep.llm import projections
from speechprep.llm.lexical_search import Best, Lists, lexical_search, search
from speechprep.llm.projections import least_count, near_vectors, tables_for
from speechprep.llm.spelling import letter_runs, spelling_groups

DOCS = "doc_id long, text string, n int, rank string, score double, word string, sig int, item int"
VECTORS = "vec_id long, embedding array<float>, label int, node string, t int, n_links double, cell string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0, "x", 0.5, "y", 1, 2) for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", 1, 0.5, "b") for i, v, k in rows], VECTORS)


# --- embeddings


def usable(v, label):
    return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def links_of(rows, least=0.98):
    """Links of each row and the component it is in, by comparing all pairs."""
    links = {k: set() for k in range(len(rows))}
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v, k) else None for _, v, k in rows]
    for a, x in enumerate(units):
        for b in range(a):
            if x is not None and units[b] is not None and len(x) == len(units[b]) and rows[a][2] == rows[b][2]:
                if x @ units[b] >= least:
                    links[a].add(b)
                    links[b].add(a)
    root = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        root[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return links, root


def wanted(rows):
    links, root = links_of(rows)
    return Counter((rows[k][0], len(links[k]), root[k], rows[k][0] == root[k]) for k in links)


def got_of(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def clustered(seed=3, size=24):
    draw = np.random.default_rng(seed)
    rows = []
    for group, label in ((90, 1), (40, 1), (30, 2), (6, 3)):
        centre = draw.standard_normal(size)
        centre /= np.linalg.norm(centre)
        for _ in range(group):
            noise = draw.standard_normal(size)
            rows.append((centre + noise / np.linalg.norm(noise) * draw.uniform(0, 0.25), label))
    rows += [(draw.standard_normal(size), int(draw.integers(1, 4))) for _ in range(150)]
    draw.shuffle(rows)
    return [(100 + k, [float(x) for x in v], label) for k, (v, label) in enumerate(rows)]


def test_vectors_equal_brute_force(spark):
    rows = clustered()
    assert got_of(near_vectors(vectors(spark, rows))) == wanted(rows)


def test_vectors_dealt_by_tables_and_blocks(spark):
    """Small cells and blocks: tables of leading projections, pairs of blocks; each link is still counted once."""
    rows = clustered(5)
    got = near_vectors(vectors(spark, rows), roomy=20, block=16).collect()
    links, root = links_of(rows)
    assert sum(r.n_links for r in got) >= 0.95 * sum(map(len, links.values()))
    most = {rows[k][0]: len(links[k]) for k in links}
    assert all(r.n_links <= most[r.vec_id] for r in got)
    assert sum(r.component_id == root[k] for k, r in enumerate(sorted(got, key=lambda r: r.vec_id))) >= 0.98 * len(rows)


def test_links_do_not_depend_on_the_size_of_a_label(spark, monkeypatch):
    """One cell, tables and small blocks find the same pairs, also with tables that lose many; as tables are, about none is lost."""
    assert projections.all_tables(0.2)[0] == projections.LEADS
    rows = clustered(7)
    links, _ = links_of(rows)
    for fixed in (None, (6, 2)):
        if fixed:
            monkeypatch.setattr(projections, "all_tables", lambda *_: fixed)
        found = [got_of(near_vectors(vectors(spark, rows), roomy=r, block=b)) for r, b in ((10**6, 2048), (60, 2048), (20, 16))]
        assert found[0] == found[1] == found[2]
        total = sum(n * times for (_, n, _, _), times in found[0].items())
        assert (total == sum(map(len, links.values()))) == (fixed is None)


def test_vectors_odd_cases(spark):
    one, near = [1.0, 0.0, 0.0, 0.0], [1.0, 0.05, 0.0, 0.0]
    rows = [
        (5, one, 1), (4, one, 1), (3, one, None), (2, None, 1), (1, [0.0] * 4, 1), (6, [1.0, None, 0.0, 0.0], 1),
        (7, [float("nan"), 1.0, 0.0, 0.0], 1), (8, [float("inf"), 0.0, 0.0, 0.0], 1), (9, near, 1), (9, near, 1),
        (None, one, 1), (10, one, 2), (None, [0.0, 1.0, 0.0, 0.0], 2), (11, [], 1), (12, [2.0, 0.0], 1), (13, [3e38, 0.0], 1),
        (14, [-0.0, 0.0, 1.0, 0.0], 3), (15, [0.0, 0.0, 1.0, -0.0], 3),
    ]
    assert got_of(near_vectors(vectors(spark, rows))) == wanted(rows)
    assert near_vectors(vectors(spark, [])).collect() == []


def test_hot_vector_of_copies(spark):
    one, other = [1.0, 0.5, 0.25], [0.1, -1.0, 0.4]
    rows = [(k, one, 0) for k in range(400)] + [(1000 + k, other, 0) for k in range(5)]
    got = near_vectors(vectors(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0), (4, 1000)}


def test_recall_is_calibrated():
    """Pairs exactly at the threshold pass the windows and the count about always."""
    draw = np.random.default_rng(1)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.standard_normal((4000, 64))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    apart = (2 - 2 * 0.98) ** 0.5
    p = projections.directions(64, projections.COUNTED + 1)
    differ = np.abs(x @ p - y @ p)
    found = (differ[:, 0] <= projections.WIDE * apart) & (
        (differ[:, 1:] <= projections.WINDOW * apart).sum(axis=1) >= least_count()
    )
    assert found.mean() >= 0.99
    leads, tables = tables_for(10**9, apart)
    assert leads > 10 and tables < 60 and tables_for(1000, apart) == (0, 1)
    a, b = projections.cells(x, 3, 9), projections.cells(y, 3, 9)
    assert (a == b).any(axis=1).mean() >= 0.98


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(rows, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for doc, counts in held:
            m = 100 - 25 + (25 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t, times in Counter(terms(text)).items():
                if tf := counts.get(t):
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else doc, -score] += 1
    return out


def corpus(seed=2, n=400):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "漢字", "a1b2", "The", "it's", "x-y"]
    weight = [1 / (k + 1) for k in range(len(words))]
    text = lambda: " ".join(draw.choices(words, weight, k=draw.choice([1, 3, 10, 60, 300])))
    rows = [(k, text()) for k in range(n)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(7, "w1 w2"), (None, "w1 w2 w50"), (None, "w1 w2 w50"), (2000, None), (2001, ""), (2002, "?! \n")]
    items = [(k, text()) for k in range(12)] + [(3, "W50 w50 ünder 漢字"), (3, "W50 w50 ünder 漢字"), (20, None), (21, "..."), (22, "nowhere"), (None, "w3 the")]
    return rows, items


@pytest.mark.parametrize("k", [1, 20])
def test_search_equals_brute_force(spark, k):
    rows, items = corpus()
    asked = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, rank int, score double")
    got = lexical_search(docs(spark, rows).repartition(5), asked, k=k).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == ranking(rows, items, k)


def test_search_in_passes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr("speechprep.llm.lexical_search.PASS_CHARS", 900)
    monkeypatch.setattr("speechprep.llm.lexical_search.BLOCK_DOCS", 16)
    monkeypatch.setattr("speechprep.llm.lexical_search.RUN", 8)
    rows, items = corpus(4, 200)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search(docs(spark, rows), asked).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == ranking(rows, items)


def test_search_skips_what_cannot_rank():
    """A long list whose bound is below the k-th best brings no candidates, and ties with smaller ids still win."""
    row = {
        "none": np.zeros(100, bool), "ids": np.arange(100) + 500, "sizes": np.full(100, 10),
        "terms": np.array([0, 1]), "dfs": np.array([2, 100]),
        "docs": np.concatenate([[3, 9], np.arange(100)]), "tfs": np.concatenate([[5, 5], np.ones(100)]),
    }
    lists = Lists({k: np.asarray(v) for k, v in row.items()}, np.array([3000, 10]), 100, 1000)
    best = Best(2)
    search(lists, [(0, 1), (1, 1)], best)
    assert best.rows[:, 2].tolist() == [503, 509]
    row["ids"] = np.arange(100)
    search(Lists(row, np.array([3000, 10]), 100, 1000), [(0, 1), (1, 1)], best)
    assert best.rows[:, 2].tolist() == [3, 9]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs(spark, []), some).collect() == []
    assert lexical_search(docs(spark, [(1, "a")]), none).collect() == []


# --- spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(rows, every=199, least_n=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def misspelt(seed=6):
    draw = random.Random(seed)
    letters = "abcdeéÀüß"
    base = ["".join(draw.choices(letters, k=draw.randint(5, 9))) for _ in range(25)]
    words = Counter()
    for k, w in enumerate(base):
        for far in range(3):
            words[w] += 700 // (5 ** (2 * far)) + k
            at, how = draw.randrange(len(w)), draw.randrange(3)
            w = w[:at] + (draw.choice(letters) if how else "") + w[at + (how < 2) :]
    words["x" * 500] = 30
    words["x" * 499 + "y"] = 6
    stream = [w.upper() if draw.random() < 0.1 and w.isascii() else w for w, c in words.items() for _ in range(c)]
    draw.shuffle(stream)
    rows = [(k, " ".join(stream[at : at + 40]) + draw.choice(["", ".", " 7漢", "\n"])) for k, at in enumerate(range(0, len(stream), 40))]
    return rows + [(3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (9000, None), (9001, ""), (9002, "- 12 ''")]


@pytest.mark.parametrize("every", [199, 7])
def test_variants_equal_brute_force(spark, every):
    rows = misspelt()
    got = spelling_groups(docs(spark, rows).repartition(4), every=every).collect()
    want = variants(rows, every)
    assert len(got) == len(want) and {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    assert any(r.form and r.root != r.form for r in got)


def test_variants_of_nothing(spark):
    assert spelling_groups(docs(spark, [])).collect() == []
    assert spelling_groups(docs(spark, [(1, None), (2, "abc")])).collect() == []


def test_runs_of_letters():
    assert letter_runs("Éa×÷b ÀZ’q٣x_yĀz") == [s.encode("latin-1") for s in ("Éa×÷b", "Àz", "q", "x", "y", "z")]
