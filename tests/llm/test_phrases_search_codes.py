"""Phrase mining, exact top-k search and vector codes: brute force and odd rows (test_native.py compares with SQL)."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import collocation, topk_search, vector_codes
from tessella.llm.queries import QUERIES


# Phrases


def brute_phrases(rows, least, longest, covered=80, keep=2000):
    counts, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in counts.items():
        found = {g: f for g, f in c.items() if len(g) > 1 and f >= least}
        scored = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * f >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, f in found.items()):
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:keep])}
    return out


PHRASES = [("a b c d e. A B c\td\ne", "x"), (None, "x"), ("", None), ("É é É é, É é", None), ("one two\x0bthree one two", "x"), ("a b c d", "y"), ("a b c d", "y"), ("z " * 3000, "x"), (".,;", "w"), ("B" * 40_000 + " c", "x")]


def phrase_docs(spark, rows, parts=3):
    df = spark.createDataFrame([(t, lang, 1, "n", "p") for t, lang in rows], "text string, lang string, f int, phrase string, rank string")
    return df.repartition(parts)


@pytest.mark.parametrize("bits", [64, 1 << 28])
def test_phrases_equal_brute_force(spark, monkeypatch, bits):
    """With a bitmap so small that it lets nearly all phrases through, too."""
    monkeypatch.setattr(collocation.level_bitmap, "__kwdefaults__", {"bits": 32, "most": bits})
    r = random.Random(4)
    rows = PHRASES + [(" ".join(r.choice(["a", "b", "ab", "C", "d.", "é", "the the"]) for _ in range(r.randint(0, 30))), r.choice(["x", "y", None])) for _ in range(150)]
    got = [tuple(x) for x in collocation.mine_phrases(phrase_docs(spark, rows), least=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, 5, 4)
    got = collocation.mine_phrases(phrase_docs(spark, rows), least=2, longest=3, keep=3).collect()
    assert {tuple(x) for x in got} == brute_phrases(rows, 2, 3, keep=3)


def test_phrases_of_empty_tables(spark):
    docs = phrase_docs(spark, PHRASES)
    assert collocation.mine_phrases(docs.where("false")).count() == 0
    assert collocation.mine_phrases(docs.where("text is null or lang = 'w'")).count() == 0


def test_steps_of_a_task_count_as_one(spark, monkeypatch):
    monkeypatch.setattr(collocation, "STEP", 10)
    got = {tuple(x) for x in collocation.mine_phrases(phrase_docs(spark, PHRASES), least=2).collect()}
    assert got == brute_phrases(PHRASES, 2, 4)


def test_a_language_is_ranked_in_parts(spark):
    rows = [(" ".join(f"w{i} w{i + 1} w{i}" for _ in range(2)), "x") for i in range(200)]
    df = collocation.mine_phrases(phrase_docs(spark, rows), least=2, keep=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lang, _part" in re.sub("#[0-9]+L?", "", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {tuple(x) for x in df.collect()} == brute_phrases(rows, 2, 4, keep=3)


# Search


def brute_topk(rows, k, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits)]
    return sorted(out)


def vectors(n, dim=6, seed=1, scale=1.0):
    r = np.random.RandomState(seed)
    return [(i, (r.standard_normal(dim) * scale).astype(np.float32).astype(float).tolist()) for i in range(n)]


ODD_VECTORS = [(1001, None), (1002, []), (1003, [None, 1.0]), (1004, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, [1.0] * 6), (1200, [0.0] * 6), (1300, [1.0, 2.0]), (1301, [3.0, -2.0]), (5, [0.5] * 6), (5, [0.5] * 6), (200, [1.0] * 6)]


def frame(spark, rows, parts=4):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<double>, score string, query int")
    return df.repartition(parts)


@pytest.mark.parametrize("tile, group", [(1024, 64 << 20), (7, 100)])
def test_topk_equals_brute_force(spark, monkeypatch, tile, group):
    """Ties over whole tiles, repeated queries, small tiles and several passes too."""
    monkeypatch.setattr(topk_search, "TILE", tile)
    hot = vectors(1)[0][1]
    rows = vectors(330) + [(2000 + i, hot) for i in range(300)] + ODD_VECTORS
    df = frame(spark, rows)
    got = topk_search.exact_topk(df, df.where("id % 100 = 0"), k=10, group_bytes=group)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 10)


def test_topk_of_few_large_and_no_rows(spark):
    for rows in (vectors(4), [(0, [1.0]), (100, [2.0])], [(0, [1.0])], vectors(250, scale=1e4)):
        df = frame(spark, rows)
        assert sorted(map(tuple, topk_search.exact_topk(df, df.where("id % 100 = 0")).collect())) == brute_topk(rows, 10)
    assert topk_search.exact_topk(df.where("false"), df.where("false")).count() == 0
    assert topk_search.exact_topk(df, df.where("false")).count() == 0


def test_exact_products_of_any_size():
    r = np.random.RandomState(2)
    for size in (1 << 10, 1 << 25, 1 << 28):
        q, x = r.randint(-size, size, (5, 8)), r.randint(-size, size, (9, 8))
        assert topk_search.scores(q.astype("<i4"), x.astype("<i4")).tolist() == [[sum(a * b for a, b in zip(u, v)) for v in x.tolist()] for u in q.tolist()]


# Codes


def brute_codes(rows, parts, entries, rounds, scale):
    """(rows by (id, v), codebooks) of plain Lloyd rounds in Python's whole numbers."""
    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    length = len(x[0]) // parts
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for v in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in one), sum(d for d, _ in one), sha) for (i, _), one in zip(rows, last)]


def clusters(n, dim, seed):
    """Vectors around centres, on a coarse grid so that distances tie, with many copies."""
    r = np.random.RandomState(seed)
    centres = r.randint(-6, 7, (12, dim))
    x = (centres[r.randint(0, 12, n)] + r.randint(-1, 2, (n, dim))) / 4.0
    x[n // 2 : n // 2 + n // 4] = x[3]
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("seed, n, dim, entries, tile", [(0, 400, 16, 16, 4096), (1, 300, 8, 5, 50), (2, 10, 24, 16, 4), (3, 500, 16, 40, 64)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, seed, n, dim, entries, tile):
    monkeypatch.setattr(vector_codes, "TILE", tile)
    rows = clusters(n, dim, seed)
    df = frame(spark, rows).withColumnsRenamed({"id": "vec_id", "v": "embedding", "score": "code"})
    got = vector_codes.compress(df, entries=entries, parts=8)
    assert got.columns == ["vec_id", "code", "query", "code_", "error", "codebooks_sha256"]
    got = sorted((r.vec_id, r.code_, r.error, r.codebooks_sha256) for r in got.collect())
    assert got == brute_codes(rows, 8, entries, 6, 4096)


def test_bounds_spare_distances():
    """Rounds of the operator's own assignment give Lloyd's result from a fraction of its distances."""
    r = np.random.RandomState(5)
    centres = r.randint(-4000, 4000, (16, 8))
    x = centres[r.randint(0, 16, 4000)] + r.randint(-200, 200, (4000, 8))
    entries = x[:16].copy()
    book = vector_codes.Codebook(entries, vector_codes.group_entries(entries, 4), np.zeros(16))
    at, upper, lower, taken = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, book.n_groups)), []
    for _ in range(7):
        taken.append(book.assign(x, at, upper, lower))
        d = ((x[:, None] - book.entries) ** 2).sum(2)
        assert (at == d.argmin(1)).all()
        n = np.bincount(at, minlength=16)[:, None]
        new = np.where(n > 0, np.array([x[at == k].sum(0) for k in range(16)]) // np.maximum(n, 1), book.entries)
        book = vector_codes.Codebook(new, book.groups, np.sqrt(((new - book.entries) ** 2).sum(1)))
    assert taken[0] == 17 * 4000 and sum(taken[2:]) < 0.5 * 5 * 17 * 4000, taken


def test_codes_of_odd_rows(spark):
    rows = clusters(60, 8, 7)
    odd = [(None, rows[3][1]), (1, rows[1][1]), (2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [math.inf] * 8), (2005, [1.0] * 16), (2006, [1.0] * 7), (2007, rows[5][1])]
    df = frame(spark, rows + odd).withColumnsRenamed({"id": "vec_id", "v": "embedding"})
    got = vector_codes.compress(df).collect()
    assert len(got) == 63 and Counter(r.vec_id for r in got)[1] == 2 and {len(r.code) for r in got} == {16}
    usable = sorted([(i, v) for i, v in rows + odd if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)], key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert sorted([tuple(r[c] for c in ("vec_id", "code", "error", "codebooks_sha256")) for r in got], key=repr) == sorted(brute_codes(usable, 8, 16, 6, 4096), key=repr)
    for none in (df.where("false"), df.where("embedding is null")):
        assert vector_codes.compress(none).count() == 0


def test_null_labels_sum_together(spark, tmp_path):
    rows = [(i, v, None if i % 3 == 0 else i % 2) for i, v in clusters(90, 16, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    label = {i: x for i, _, x in rows}
    total = Counter()
    for r in got:
        total[label[r.vec_id]] += r.error
    assert len(got) == 90 and all(r.label_error == total[label[r.vec_id]] for r in got)


def test_phrase_words_of_a_batch():
    w = collocation.Words(pa.array(["A b.c", None, "d"]), pa.array(["x", "x", None]))
    assert [w.distinct[i].as_py() for i in w.number] == [b"a", b"b", b"c", b"d"] and w.follows.tolist() == [True, False, False, False]
    assert [w.languages[i].as_py() for i in w.language] == ["x", "x", "x", "und"]
