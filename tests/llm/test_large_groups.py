"""The n-gram join on groups larger than a block, against brute force or a known answer."""

import random

import numpy as np
import pytest
from test_arrow import brute_components, near_copies

from tessella.llm import ngram_join


@pytest.mark.parametrize("percent, block", [(80, 6)])
def test_pivots_and_the_rest_find_every_link(make, monkeypatch, percent, block):
    """Blocks of a few rows and few pivots, so that groups have rows off their largest part."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    rows = near_copies(260)
    got = ngram_join.ngram_components(make(rows), n=3, percent=percent, block=block)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, 3, percent)


def test_products_bounded_in_bytes(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    rows = near_copies(200)
    got = ngram_join.ngram_components(make(rows), n=3, percent=90)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, 3, 90)


def test_many_near_copies_cost_rows_in_proportion(spark, make, monkeypatch):
    """20,000 different copies of one text of 120 words, one word changed in each: one component; what is dealt
    to products is a small multiple of the rows."""
    dealt = []
    run = ngram_join._run_products
    monkeypatch.setattr(ngram_join, "_run_products", lambda d, *a: dealt.append(d.count()) or run(d, *a))
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != i % 120 else f"new{i}" for k, w in enumerate(base)), "s") for i in range(20_000)]
    rows += [(30_000 + i, f"some other text of its own {i} " * 3, "s") for i in range(50)]
    got = ngram_join.ngram_components(make(rows).repartition(8), n=3, percent=90)
    of = {r.doc_id: r.component_id for r in got.collect()}
    assert {of[i] for i in range(20_000)} == {0} and all(of[30_000 + i] == 30_000 + i for i in range(50))
    assert sum(dealt) < 7 * len(rows), dealt  # a row is in a few blocks, and once in its component


def test_very_long_near_copies(make):
    r = np.random.RandomState(3)
    base = [f"w{x}" for x in r.randint(0, 50_000, 100_000)]
    rows = []
    for i in range(12):
        w = list(base)
        for k in r.randint(0, len(w), 300 if i < 8 else 9000):  # the last four are too far apart
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w), "s"))
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_components(make(rows), n=3, percent=90).collect()}
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t, _ in rows)]
    tree = {i: i for i in range(12)}
    for i in range(12):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                tree = {k: tree[j] if v == tree[i] else v for k, v in tree.items()}
    assert got == {i: min(k for k in tree if tree[k] == tree[i]) for i in tree} and got[7] == 0


def test_products_find_what_pairs_do():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 14)
        pool = [np.uint64(r.randrange(1 << 62)) for _ in range(40)]
        sets = [np.unique(np.array(r.sample(pool, r.randint(1, 40)), np.uint64)) for _ in range(n)]
        sets.sort(key=len)
        sizes, side = np.array([len(s) for s in sets]), np.array([r.choice([0, 1, 2]) for _ in range(n)])
        tree = list(range(n))
        for i in range(n):
            for j in range(i + 1, n):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (side[j] == 0 or side[i] != side[j]) and 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    tree = [tree[i] if x == tree[j] else x for x in tree]
        edges = ngram_join.linked_pairs(sizes, side, sets, 80).edges
        own = list(range(n))
        for i, j in edges:
            assert own[i] != own[j]
            own = [own[i] if x == own[j] else x for x in own]
        assert [own.index(x) for x in own] == [tree.index(x) for x in tree]
        bits = [np.frombuffer(ngram_join.bitmap(s), np.uint64) for s in sets]
        wide = list(range(n))
        for i, j in ngram_join.possible_links(sizes, side, bits, 80).edges:
            wide = [wide[i] if x == wide[j] else x for x in wide]
        assert all(wide[i] == wide[j] for i, j in edges)


def template_pages(m, changed, seed=1, words=400):
    """m pages of one template, `changed` words replaced at places of their own."""
    r = np.random.RandomState(seed)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(m):
        w = list(base)
        for k in r.choice(words, changed, replace=False):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w), "s"))
    return rows


def test_pages_of_one_template_part_ways(spark, make, monkeypatch):
    """Without links among them, what is dealt to products grows with the pages, not with their square."""
    dealt = []
    run = ngram_join._run_products
    monkeypatch.setattr(ngram_join, "_run_products", lambda d, *a: dealt.append(d.count()) or run(d, *a))
    total = []
    monkeypatch.setattr(ngram_join, "THIN", 2)
    for m in (1500, 3000):
        dealt.clear()
        got = ngram_join.ngram_components(make(template_pages(m, 20)).repartition(8), n=3, percent=90, block=96)
        assert all(r.component_id == r.doc_id for r in got.collect())
        total.append(sum(dealt))
    assert total[1] < 2.2 * total[0], total  # 33,402 and 66,917


def test_thinned_groups_equal_brute_force(make, monkeypatch):
    """Near copies, pages of one template and pages between them, in groups that are parted anew."""
    monkeypatch.setattr(ngram_join, "THIN", 2)
    rows = template_pages(60, 6, 2, 80) + [(100 + i, t, s) for i, t, s in template_pages(60, 2, 3, 80)] + [(200 + i, t, s) for i, t, s in template_pages(60, 12, 4, 80)]
    for percent in (80, 90):
        got = ngram_join.ngram_components(make(rows), n=3, percent=percent, block=8)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, 3, percent)
