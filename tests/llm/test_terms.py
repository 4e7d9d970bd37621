"""Disclosing terms are found in whole texts, by counts over whole documents."""

import math
import re
import time

import numpy as np
import pytest

from tessella.llm import sanitise


def test_disclosing_terms_stand_anywhere(make):
    far = " ".join(f"pad{i}" for i in range(30))
    rows = [(i, f"é mail bob@x.org zanzibar today {far} Zanzibar end", "s") for i in range(4)]
    rows += [(5, "the zanzibar alone, without its entity", "s"), (6, "once ann@y.org quagga here today", "s")]
    rows += [(10 + i, f"other text {i} common words once here today {far}", "s") for i in range(60)]
    docs = make(rows)
    found = sanitise.sanitise(docs)
    text = {d: t for d, t, _ in rows}
    named = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.terms] for r in found.collect()}
    assert [x for x in named[0] if x.lower() == "zanzibar"] == ["zanzibar", "Zanzibar"]
    assert named[5] == ["zanzibar"] and named[6] == ["quagga"] and named[10] == []
    out = {r.doc_id: r.text for r in sanitise.masked(docs, found).collect()}
    assert "anzibar" not in out[0] + out[5] and out[6] == "once [email] [word] here today"


def brute(rows, window=6, support=2, at=0.8, remove_at=0.95):
    """{doc_id: [(start, end, disclosure)]} by the definition, over lists of documents."""
    terms = [[(m.start(), m.end(), m[0].lower()) for m in sanitise._TERM.finditer(t or "")] for _, t, _ in rows]
    base = [sanitise.base_spans(t or "") for _, t, _ in rows]
    held = [{w for _, _, w in x} for x in terms]
    ents = [{(k, t[a:b].lower()) for k, a, b in s} for (_, t, _), s in zip(rows, base)]
    tried = set()
    for (_, t, _), own, spans in zip(rows, terms, base):
        for k, a, b in spans:
            near = [x for x in own if x[1] <= a][-window:] + [x for x in own if x[0] >= b][:window]
            tried |= {((k, t[a:b].lower()), w) for s, e, w in near if e - s >= 3 and not any(x < e and s < y for _, x, y in spans)}
    n, score = len(rows), {}
    for e, w in tried:
        de, dt, both = sum(e in x for x in ents), sum(w in x for x in held), sum(e in x and w in y for x, y in zip(ents, held))
        prior = 1.0 if de < support else 0.0
        if (both >= support or de < support) and de < n:
            d = math.log2((both + prior * de / n) * n / (de * (dt + prior))) / math.log2(n / de)
            if round(d, 9) >= at:
                score[w] = max(score.get(w, 0), round(d, 9))
    return {d: [(s, e, score[w]) for s, e, w in own if w in score and not any(x < e and s < y for _, x, y in spans)] for (d, _, _), own, spans in zip(rows, terms, base)}


def corpus():
    import random

    r = random.Random(6)
    words, people = [f"w{i}" for i in range(120)] + ["é1x", "ab"], [f"p{i}@q.org" for i in range(12)] + ["1.2.3.4", "+1 988 555 2485"]
    rows = []
    for i in range(300):
        t = [r.choice(words) for _ in range(r.randint(0, 25))]
        for _ in range(r.choice([0, 0, 1, 1, 3])):
            k = r.randrange(len(people))
            t[r.randint(0, len(t)) : 0] = [people[k]] if r.random() < 0.3 else [f"clue{k}", people[k], f"hint{k % 3}"]
        rows.append((i, " ".join(t), "s"))
    rows += [(400 + i, "p0@q.org", "s") for i in range(20)]  # an entity whose documents hold nothing else
    rows += [(500, "bare@x.org of one document and its quirk", "s"), (501, "", "s"), (502, "clue3", "s")]
    return rows


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_terms_equal_the_definition(make, monkeypatch, most):
    """Both with terms that travel with the tasks and, beyond MAX_CANDIDATES, with joined ones."""
    monkeypatch.setattr(sanitise, "MAX_CANDIDATES", most)
    rows = corpus()
    want, got = brute(rows), {}
    for r in sanitise.sanitise(make(rows)).collect():
        got[r.doc_id] = [(s.start, s.end, s.disclosure) for s in r.terms]
        text = next(t for d, t, _ in rows if d == r.doc_id)
        assert r.sanitised == sanitise.sanitised(text, sanitise.base_spans(text), want[r.doc_id], sanitise.REMOVE_AT)
    assert {d: [x[:2] for x in v] for d, v in got.items()} == {d: [x[:2] for x in v] for d, v in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-8 for d in want for a, b in zip(got[d], want[d])) and sum(map(len, want.values())) > 20


def test_bare_documents_of_an_entity_count(make):
    """22 documents hold the entity, 20 of them nothing else: a term in 3 documents, 2 of them the entity's, tells little."""
    rows = [(i, "a@b.org", "s") for i in range(20)] + [(20 + i, "a@b.org tamarind", "s") for i in range(2)] + [(30, "tamarind", "s")]
    rows += [(100 + i, f"filler text {i}", "s") for i in range(77)]
    got = {r.doc_id: r.terms for r in sanitise.sanitise(make(rows)).collect()}
    assert not any(got.values())


def test_time_is_linear_in_the_entities_of_a_text(make):
    began = time.time()
    rows = [(1, " ".join(f"name{i} user{i}@example.org note{i % 7}" for i in range(16000)), "s"), (2, "x", "s")]
    got = {r.doc_id: r for r in sanitise.sanitise(make(rows)).collect()}
    assert len(got[1].base) == 16000 and time.time() - began < 60


def test_nothing_personal_stays_on_storage(spark, make, monkeypatch):
    """Tables hold no personal data and no hash of it that can be found again without the job's key, and are empty
    at the end."""
    seen, rows = [], []
    write = sanitise.materialize

    def watched(df, name):
        seen.append(write(df, name))
        rows.extend(seen[-1].collect())
        return seen[-1]

    monkeypatch.setattr(sanitise, "materialize", watched)
    sanitise.sanitise(make(corpus())).count()
    assert rows and not any("string" in t.dtypes[i][1] for t in seen for i in range(len(t.columns)))
    assert not any("p0@q.org" in str(r) or "clue" in str(r) for r in rows)
    numbers = []

    def flat(v):
        for x in v if isinstance(v, (list, tuple)) else []:
            flat(x)
        if isinstance(v, int):
            numbers.append(v)

    flat([tuple(r) for r in rows])
    guessed = ["988", "555", "2485", "p0", "clue3", "hint1", "org"]
    for guess in guessed:
        raw = np.frombuffer(guess.encode(), np.uint8)
        assert int(sanitise.tc.span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0]) not in numbers
    assert all(spark.read.schema(t.schema).parquet(t._at).count() == 0 for t in seen)


def siphash(message: int, key: bytes) -> int:
    """SipHash-2-4 of 8 bytes, as published."""
    most, turn = (1 << 64) - 1, lambda x, k: ((x << k) | (x >> (64 - k))) & ((1 << 64) - 1)
    k = [int.from_bytes(key[i : i + 8], "little") for i in (0, 8)]
    a, b, c, d = 0x736F6D6570736575 ^ k[0], 0x646F72616E646F6D ^ k[1], 0x6C7967656E657261 ^ k[0], 0x7465646279746573 ^ k[1]

    def rounds(n):
        nonlocal a, b, c, d
        for _ in range(n):
            a, b = (a + b) & most, turn(b, 13)
            b, a = b ^ a, turn(a, 32)
            c, d = (c + d) & most, turn(d, 16)
            d ^= c
            a, d = (a + d) & most, turn(d, 21)
            d ^= a
            c, b = (c + b) & most, turn(b, 17)
            b, c = b ^ c, turn(c, 32)

    for m in (message, 8 << 56):
        d ^= m
        rounds(2)
        a ^= m
    c ^= 0xFF
    rounds(4)
    return a ^ b ^ c ^ d


def test_keyed_hash():
    key = bytes(range(16))
    some = [0, 1, (1 << 64) - 1, 0x0706050403020100]
    got = sanitise.keyed(np.array(some, np.uint64), key).view(np.uint64).tolist()
    assert got == [siphash(x, key) for x in some] and got[3] == 0x93F5F5799A932462  # the published vector of 8 bytes
    assert sanitise.keyed(np.zeros(0, np.uint64), key).tolist() == []


def test_masked_keeps_columns_that_clash(spark):
    from pyspark.sql import functions as F

    clash = ("_own", "_key", "_d", "_r", "_new", "base", "terms", "sanitised", "_row")
    df = spark.createDataFrame([(1, "to a@b.org"), (1, "to a@b.org"), (2, None), (None, "+1 988 555 2485")], "doc_id long, text string").withColumns({c: F.lit(c) for c in clash})
    got = sanitise.masked(df, sanitise.sanitise(df))
    assert got.columns == df.columns and sorted((str(r.doc_id), str(r.text), r["_new"]) for r in got.collect()) == [("1", "to [email]", "_new"), ("1", "to [email]", "_new"), ("2", "None", "_new"), ("None", "[phone]", "_new")]
