"""Spelled numbers are found whatever the other words of the text."""

import pytest

from webloom.llm import pii


@pytest.mark.parametrize(
    "found",
    ["+1 five 55 five 0100", "plus-four-four-two-zero-seven-nine-four-six-zero-nine-five-eight", "+five,five,five,zero,one,two,three,four", "+five-five-five-zero-one-two-three-four"],
)
def test_numbers_with_few_blank_separated_digit_words(found):
    text = f"call ({found}) today"
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)[1]] == [("phone", found)]
