"""Terms that each stand in few toxic documents are learned, however many toxic documents there are."""

import random

import pytest

from routewise.llm import toxicity


@pytest.mark.parametrize("n_terms, n_clean", [(20, 4000), (200, 4000), (600, 12000)])
def test_long_tail_of_terms(n_terms, n_clean):
    """Each term in 20 toxic documents: 0.17 % of them in the largest case, where there are more than 400 terms."""
    rng = random.Random(6)
    letters = "bcdfghjklmnpqrstvwxz"
    names = rng.sample([f"{a}{b}{c}u" for a in letters for b in letters for c in letters], n_terms + 500)
    bad, plain = names[:n_terms], names[n_terms:]

    def text(*more):
        words = rng.choices(plain, k=30)
        for w in more:
            words.insert(rng.randrange(1, 30), w)
        return " ".join(words)
    samples = [(1, text(b)) for b in bad for _ in range(20)] + [(0, text()) for _ in range(n_clean)]
    lexicon = toxicity.learn(samples)
    assert {t for t, *_ in lexicon.terms} == set(bad)
    matcher = toxicity.Matcher(lexicon.terms, lexicon.exceptions)
    a, b, bias = lexicon.curve

    def flagged(t):
        x, y = toxicity.measure(matcher, t)
        return a * x + b * min(y, 100.0) + bias >= 0
    assert all(flagged(text(w)) for w in bad) and not any(flagged(text()) for _ in range(200))


def test_chance_is_the_binomial_tail():
    assert toxicity.chance(5, 0, 0.5) == pytest.approx(1 / 32)
    assert toxicity.chance(0, 7, 0.3) == pytest.approx(1)
    assert toxicity.chance(2, 1, 0.25) == pytest.approx(10 / 64)
