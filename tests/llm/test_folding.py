"""Folding of a character does not depend on what else a text holds."""

import pytest

from routewise.llm import toxicity


@pytest.mark.parametrize("odd, plain", list(zip(*toxicity.LOOKS)))
def test_every_look_alike_alone(odd, plain):
    assert toxicity.fold(f"you x{odd}y there") == f"you x{plain}y there"
    word = f"wz{plain}zw"
    assert [h[:2] for h in toxicity.Matcher(((word, True, 1.0),), ()).hits(f"you wz{odd}zw there")] == [(4, 9)]


def test_neighbours_make_no_difference():
    for c in map(chr, (*range(0x80, 0x600), *range(0x2000, 0x2100))):
        assert toxicity.fold(f"a{c}b 😀")[:4] == toxicity.fold(f"a{c}b ")
