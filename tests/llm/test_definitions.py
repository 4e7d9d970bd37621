"""The cosine hash, the quality features and logit, and the passage vector, each recomputed from its definition."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import media, passages, quality
from tessella.llm import textcore as tc

SPACE = b" \t\n\x0b\x0c\r"


@pytest.mark.parametrize("h, w", [(32, 32), (7, 576), (64, 40), (1, 576), (100, 33)])
def test_cosine_hash_is_the_double_sum(h, w):
    image = np.random.RandomState(h * w).randint(0, 256, (h, w)).astype(np.uint8)
    side = 32
    small = [[0.0] * side for _ in range(side)]
    for a in range(side):
        for b in range(side):
            rows = range(a * h // side, max((a + 1) * h // side, a * h // side + 1))
            cols = range(b * w // side, max((b + 1) * w // side, b * w // side + 1))
            small[a][b] = sum(int(image[i, j]) for i in rows for j in cols) / (len(rows) * len(cols))
    low = []  # plain sums (DCT-II without weights)
    for u in range(8):
        for v in range(8):
            total = sum(small[a][b] * math.cos(math.pi * (2 * a + 1) * u / (2 * side)) * math.cos(math.pi * (2 * b + 1) * v / (2 * side)) for a in range(side) for b in range(side))
            low.append(total)
    middle = sorted(low[1:])[31]  # of 63
    bits = "".join("1" if round(x, 6) > round(middle, 6) else "0" for x in low)
    assert media.cosine_hash(image) == f"{int(bits, 2):016x}"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(bytes(32 if c in SPACE else c for c in range(256))).split(b" ")


def word_hash(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(tc.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


TEXTS = ["The the cat; SAT on the mat, the cat", "é 漢字 # $ %\nA-b  c", "", "one"]


def test_quality_features_and_logit():
    got = quality.features(pa.array(TEXTS))
    r = np.random.RandomState(0)
    model = r.standard_normal(got.shape[1])
    for i, text in enumerate(TEXTS):
        raw = text.encode()
        w = [x for x in words_of(raw) if x]
        by_word = Counter(word_hash(x) % quality.WORD_DIM for x in w)
        for a, b in zip(w, w[1:]):
            two = tc.window_hashes(np.array([word_hash(a), word_hash(b)], np.uint64), 2)[0]
            by_word[int(two) % quality.WORD_DIM] += 1
        by_char = Counter((((raw[j] << 16 | raw[j + 1] << 8 | raw[j + 2]) * 2654435761) % 2**32) >> 21 for j in range(len(raw) - 2))
        want = np.zeros(got.shape[1])
        for at, counts in ((0, by_word), (quality.WORD_DIM, by_char)):
            long = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
            for k, c in counts.items():
                want[at + k] = math.log1p(c) / long
        size, chars = max(len(w), 1), max(len(raw), 1)
        want[-6:] = [
            len(by_word) / min(2 * size, quality.WORD_DIM), max(by_word.values(), default=0) / size, sum(65 <= c <= 90 for c in raw) / chars,
            sum(chr(c) in "#*$%&|<>" for c in raw if c < 128) / chars, math.log1p(len(w)) / 8, 1.0,
        ]
        assert np.allclose(got[i], want, atol=1e-5), (text, np.flatnonzero(~np.isclose(got[i], want, atol=1e-5)))
        assert abs(float(got[i] @ model) - float(want @ model)) < 1e-3


def test_logistic_fit_is_at_the_optimum():
    """The penalised log loss has no slope where the fit ends."""
    r = np.random.RandomState(1)
    x = np.hstack([r.standard_normal((400, 5)), np.ones((400, 1))]).astype(np.float32)
    y = (x[:, 0] + 0.5 * r.standard_normal(400) > 0).astype(np.float64)
    at = quality.fit_logistic(x, y, rounds=2000)

    def loss(w):
        z = x.astype(np.float64) @ w
        return float(np.mean(np.logaddexp(0, z) - y * z))

    base = loss(np.asarray(at, np.float64))
    assert base < 0.45 and base < loss(np.zeros(6)) and np.corrcoef(x[:, 0], x @ at)[0, 1] > 0.9


def test_passage_vector_by_counts():
    text = " ".join(["ab", "Cd9", "x.", "ab", "ab"] * 30)  # 150 words
    x, first = passages.encode_passages(pa.array([text, "zz"]))
    assert first.tolist() == [0, -(-150 // passages.PASSAGE), -(-150 // passages.PASSAGE) + 1]
    w = text.encode().split(b" ")
    for p in range(first[1]):
        mine = w[p * passages.PASSAGE : (p + 1) * passages.PASSAGE]
        solid = b"".join(mine)
        classes = Counter(int(passages._CLASS[c]) for c in solid)
        assert np.allclose(x[p, : passages.N_CLASSES], [4 * classes[k] / len(solid) for k in range(passages.N_CLASSES)], atol=1e-5)
        mean = sum(map(len, mine)) / len(mine)
        spread = math.sqrt(sum(len(v) ** 2 for v in mine) / len(mine) - mean**2)
        before = w[p * passages.PASSAGE - 1] if p else None
        again = sum(a == b for a, b in zip([before, *mine], mine)) / len(mine)
        shades = len({word_hash(v) % passages.SHADES for v in mine}) / (passages.SHADES * (1 - (1 - 1 / passages.SHADES) ** len(mine)))
        ends = sum(passages._CLASS[v[-1]] > 1 for v in mine) / len(mine)
        assert np.allclose(x[p, -6:], [again, shades, min(mean, 40) / 10, min(spread, 40) / 10, len(mine) / passages.PASSAGE, ends], atol=1e-4)
        # pairs of bytes, a passage's last one with the first of the next passage of its text
        after = b"".join(w[(p + 1) * passages.PASSAGE :])[:1]
        pairs = Counter(((a << 8 | b) * 2654435761 % 2**32) >> 26 for a, b in zip(solid.lower(), (solid + after)[1:].lower()))
        assert np.allclose(x[p, passages.N_CLASSES : passages.N_CLASSES + passages.PAIRS], [8 * pairs[k] / len(solid) for k in range(passages.PAIRS)], atol=1e-4)
