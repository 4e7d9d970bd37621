"""Operators that work on Arrow slices: brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import SF
from pyspark.sql import functions as F

from tessella.llm import bpe, language, media, ngram_join, passages, quality, sanitise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "\n", "a\n", "\n\na", "a b\na b", "é ñ\x0b\x1c ok\n"]


def noise(alphabet, n, size, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def brute_counts(t):
    t = t or ""
    w, seen, again = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_quality_counts(step):
    texts = TEXTS + noise(["a", "b", " ", "\n", "c ", "é", "#"], 300, 120)
    for at in range(0, len(texts), step):
        got = quality.base_counts(pa.array(texts[at : at + step], pa.string()))
        for i, t in enumerate(texts[at : at + step]):
            assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_rules_and_odd(spark, odd, empty):
    labels = read(spark, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train_quality(read(spark, "documents"), labels)
    got = quality.quality_rules(read(spark, "documents"), model).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.label == 1], [r.kept for r in got if r.label == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2
    got = quality.quality_rules(odd, model).collect()
    assert len(got) == 9 and all(r.base_failed and not r.kept for r in got)
    assert quality.quality_rules(empty, None).count() == 0
    assert quality.train_quality(empty, labels) is None


def test_attention_gradients():
    r = np.random.RandomState(0)
    x, first = r.standard_normal((11, 5)).astype(np.float32), np.array([0, 3, 4, 9, 11])
    y, each = np.array([1.0, 0, 1, 0]), np.full(4, 0.25)
    m = passages.AttentionModel.fresh(np.zeros(5, np.float32), np.ones(5, np.float32))
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    loss = lambda: -float((each * (y * np.log(p := m.forward(x, first)["p"]) + (1 - y) * np.log(1 - p))).sum())
    slopes = m.slopes(m.forward(x, first), y, each)
    for k, w in m.weights.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - slopes[k][at]) < 1e-3


def test_classifier_held_out_and_odd(spark, odd, empty):
    docs = read(spark, "documents")
    labels = read(spark, "labels").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = passages.train_passages(docs, labels.where(~held))
    got = passages.score_passages(docs, model, passages=True).join(labels.where(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in got]) > 0.85
    assert all(abs(sum(r.attention) - 1) < 1e-3 for r in got)
    got = passages.score_passages(odd, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    kept = passages.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= passages.PREDICT_AT for r in got)
    assert passages.keep_good(empty, model).count() == 0 and passages.train_passages(empty, labels) is None


def test_passages_are_whole_texts():
    text = " ".join(f"w{i}" for i in range(300))
    x, first = passages.encode_passages(pa.array([text, None, "one"], pa.string()))
    assert first.tolist() == [0, 5, 6, 7] and not x[5].any()


def test_language_held_out_and_odd(spark, odd, empty):
    docs = read(spark, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.learn_prototypes(docs.where(~held))
    got = language.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd_rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert odd_rows[1].lang_pred == odd_rows[2].lang_pred == odd_rows[3].lang_pred == "und" and odd_rows[6].score <= 1
    assert language.identify(empty, model).count() == 0
    assert language.learn_prototypes(empty.select("doc_id", "text", "lang"))[0] == []
    assert {r.lang_pred for r in language.identify(odd, ([], np.zeros((0, language.DIM)))).collect()} == {"und"}


def test_language_vectors_do_not_depend_on_company():
    texts = ["Abc déf", None, "zz", "", "Ñandú 12 abc"]
    together, has = language.text_vectors(texts)
    alone = np.vstack([language.text_vectors([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and has.tolist() == [True, False, True, False, True]


@pytest.fixture(scope="module")
def codec():
    ranks, pattern = bpe.default_vocabulary()
    return bpe.Codec(ranks, pattern)


@pytest.fixture(scope="module")
def tiktoken_codec(codec):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(codec, tiktoken_codec):
    texts = noise("abcdeéñ  \n12!\x1c\x85\xa0ƒɐ漢½² 'st", 300, 300) + ["a" * 3000, "ab" * 5000, "x" + " " * 400, "\U0001f600" * 40, "<|endoftext|>", ""]
    ids = codec.encode_batch(texts)
    for t, i in zip(texts, ids):
        assert np.frombuffer(i, "<u4").tolist() == tiktoken_codec.encode_ordinary(t)
        assert codec.decode(i) == t.encode()


def test_bulk_and_single_queues_agree(codec):
    pieces = [p.encode() for p in noise("abcthe in", 200, 30, 8) if p]
    assert codec.merge_many(pieces) == [np.array(codec.merge_one(p), "<u4").tobytes() for p in pieces]


def test_bpe_rows(spark, odd, empty):
    ranks, pattern = bpe.default_vocabulary()
    two = bpe.decode_documents(bpe.encode_documents(odd, ranks, pattern), ranks, pattern)
    one = bpe.recode_documents(odd, ranks, pattern, carry=("source",))
    key = lambda df: sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    assert key(two) == key(one)
    texts = sorted((t or "").encode() for _, t in ((r.doc_id, r.text) for r in odd.collect()))
    assert sorted(d for _, _, d in key(one)) == texts
    assert bpe.recode_documents(empty, ranks, pattern).count() == 0


def test_png_round_trip_and_damage():
    for n in (576, 1152, 576 * 40):
        data = random.Random(n).randbytes(n)
        stored = media.write_png(data)
        image = media.read_png(stored)
        assert image.tobytes() == data and len(media.cosine_hash(image)) == 16
    with pytest.raises(ValueError):
        media.read_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])
    for cut in (4, 20, len(stored) - 1):
        with pytest.raises(ValueError):
            media.read_png(stored[:cut])


def test_all_row_filters():
    r = np.random.RandomState(1)
    image = r.randint(0, 256, (7, 20)).astype(np.uint8)
    rows = np.zeros((7, 21), np.uint8)
    for i, kind in enumerate([0, 1, 2, 3, 4, 4, 3]):
        rows[i, 0] = kind
        for x in range(20):
            a = int(image[i, x - 1]) if x else 0
            b = int(image[i - 1, x]) if i else 0
            c = int(image[i - 1, x - 1]) if i and x else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[i, x + 1] = (int(image[i, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
    assert (media.unfilter_rows(rows) == image).all()


def test_media_rows(odd, empty):
    got = media.read_media(media.store_media(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(data) and bytes(r.payload) == data + b"\xff" * (-len(data) % 576 if data else 576)
    assert len(got) == 9 and media.read_media(media.store_media(empty)).count() == 0


def brute_pii(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d))))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base():
    r = random.Random(3)
    for i in range(6000):
        t = "".join(r.choice(r.choice(["ab@.-1 ", "01.25 ", "0123456789 -", "+1(). -23", "a1@.+- é"])) for _ in range(r.randint(0, 60)))
        if i % 7 == 0:
            t = " ".join(r.choice(["4041894974608795", "4041-8949-7460-8795", "+1 (988) 555-2485", "a.b@c.de", "1.2.3.4", "300.1.1.1"]) for _ in range(8))
        assert sanitise.base_spans(t) == brute_pii(t)


def test_disclosing_terms(make):
    rows = [(i, f"filler{i} words here mail bob@x.org zanzibar today common", "s") for i in range(4)]
    rows += [(10 + i, f"other text {i} common words here today", "s") for i in range(40)]
    docs = make(rows)
    found = sanitise.sanitise(docs)
    got = {r.doc_id: r for r in found.collect()}
    named = {rows[0][1][s.start : s.end] for s in got[0].terms}
    assert "zanzibar" in named and "common" not in named and "words" not in named and got[10].terms == []
    out = {r.doc_id: r.text for r in sanitise.masked(docs, found).collect()}
    assert out[0] == "filler0 words here  [email]  today common" and out[10] == rows[4][1]


def test_pii_odd(odd, empty):
    got = sanitise.sanitise(odd).collect()
    assert len(got) == 9 and all(r.base == [] for r in got)
    assert sanitise.sanitise(empty).count() == 0


def shingle_set(t, n):
    w = [x.lower() for x in WORD.findall(t or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t, _ in rows]
    tree = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(rows)):
            k = len(a & sets[j])
            if k and 100 * k >= percent * (len(a) + len(sets[j]) - k) and tree[i] != tree[j]:
                tree = [tree[i] if x == tree[j] else x for x in tree]
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[tree[i]] = min(d, least.get(tree[i], d))
    return sorted(((d, len(s), least.get(tree[i]) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(n):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(1, 80))) for _ in range(20)]
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice("abcxyz")
        rows.append((r.choice([None, i, i, i, max(i - 1, 0)]), " ".join(w) if r.random() > 0.05 else r.choice([None, "", " ", "a", "A b", "a b"]), "s"))
    return rows


@pytest.mark.parametrize("n, percent, block, small", [(3, 90, 4, 64), (3, 90, 384, 4), (5, 80, 384, 64)])
def test_ngram_components(make, n, percent, block, small):
    """Blocks of a few rows, sets with too few parts, and the pipeline's parameters."""
    rows = near_copies(250)
    got = ngram_join.ngram_components(make(rows), n=n, percent=percent, block=block, small=small)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows, n, percent)


def test_drop_near_duplicates(make, odd, empty):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(near_copies(120))]
    docs = make(rows + rows[:5])
    kept = ngram_join.drop_near_duplicates(docs)
    want = {d for d, n, c in brute_components(rows, 5, 80) if d == c}
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    blank = {d for d, t, _ in rows if not (t or "").strip()}
    assert set(ids) == want | blank and all(v == 1 for d, v in ids.items() if d not in blank)
    assert ngram_join.drop_near_duplicates(empty).count() == 0
    assert ngram_join.drop_near_duplicates(odd).count() == odd.count() - 1


def test_linked_sets_share_a_column():
    r, classes = np.random.RandomState(1), np.zeros(ngram_join.SKETCH, np.uint8)
    for percent in (90, 80):
        shift, links = ngram_join.part_shift(percent), 0
        for _ in range(600):
            u = np.unique(r.randint(0, 1 << 62, int(np.exp(r.uniform(1.7, 7)))).astype(np.uint64))
            change = r.randint(0, max(2, int(len(u) * (1 - percent / 100) * 1.1)))
            less = r.randint(0, change + 1)
            v = np.delete(u, r.permutation(len(u))[:less])
            v = np.unique(np.concatenate([v, r.randint(0, 1 << 62, change - less).astype(np.uint64)]))
            both = len(np.intersect1d(u, v))
            if both and 100 * both >= percent * (len(u) + len(v) - both):
                (a, few), (b, more) = (ngram_join.columns_of(s, percent, shift, classes) for s in (u, v))
                links += 1
                assert few or more or len(np.intersect1d(a, b))
        assert links > 400


def test_bitmaps_bound_the_difference():
    r = np.random.RandomState(2)
    for _ in range(50):
        a = np.unique(r.randint(0, 1 << 62, r.randint(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.randint(0, len(a) + 1)], r.randint(0, 1 << 62, r.randint(1, 60)).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.bitmap(v), np.uint64)[None] for v in (a, b))
        while x.shape != y.shape:
            x, y = (ngram_join._fold(v) if v.shape[1] > min(x.shape[1], y.shape[1]) else v for v in (x, y))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_crc_of_media_tail(odd):
    row = media.read_media(media.store_media(odd.where("doc_id = 6"))).select("payload", F.crc32(F.expr("substring(payload, -32, 32)")).alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.payload)[-32:])
