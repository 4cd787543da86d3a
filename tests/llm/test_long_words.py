"""Every n-gram of a long word counts, in training and in scoring."""

import random
import zlib

import numpy as np
import pytest

from routewise.llm import quality_classifier as q


def plain(word):
    text = f"<{word.decode('utf-8', 'replace')}>"
    return sorted([1 + zlib.crc32(word) % (q.BUCKETS - 1)] + [
        1 + zlib.crc32(text[i:i + n].encode(), n) % (q.BUCKETS - 1) for n in q.NGRAMS for i in range(len(text) - n + 1)])


@pytest.mark.parametrize("block", [5, 64, 1 << 17])
def test_buckets_of_whole_words(monkeypatch, block):
    monkeypatch.setattr(q, "BLOCK", block)
    rng = random.Random(block)
    for k in range(60):
        w = "".join(rng.choice(["a", "é", "日", "😀", "z9", "ß"]) for _ in range(rng.randrange(1, 300))).encode()
        w += b"\xff\x80" + w if k % 3 == 0 else b""
        assert sorted(q.buckets(w)) == sorted(np.concatenate(list(q.long_buckets(w))).tolist()) == plain(w)
        ids, share = q.features(w + b" a " + w)
        assert sorted(set(plain(w) + plain(b"a"))) == ids.tolist() and abs(share.sum() - 1) < 1e-4


@pytest.mark.parametrize("size", [60, 3000])
def test_middles_decide_where_ends_are_equal(size):
    rng = random.Random(4)

    def text(y):
        return "あ" * 16 + "".join(rng.choice("日本語中文" if y else "漢字仮名交") for _ in range(size)) + "ん" * 16
    samples = [(k % 2, text(k % 2)) for k in range(120)]
    score = q.scorer(q.train(samples, 0.5))
    tests = [(k % 2, text(k % 2).encode()) for k in range(40)]
    found = score([t for _, t in tests])
    assert ((found >= 0.5) == np.array([y for y, _ in tests])).all() and np.abs(found - 0.5).min() > 0.2
    model = q.train(samples, 0.5)
    for p, (_, t) in zip(found, tests):  # scoring in blocks gives what the buckets of training give
        ids, share = q.features(t)
        assert abs(p - 1 / (1 + np.exp(-(model.bias + (model.weight[ids] * share).sum())))) < 1e-4
