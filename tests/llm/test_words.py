import re

import numpy as np
import pyarrow as pa

from riskledger.llm import words
from tests_llm_rows import ROWS


def test_words_are_those_of_the_pattern():
    texts = [t for _, t, _ in ROWS]
    seen = []
    for _, data, offsets in words.text_slices(pa.array(texts), 300):
        starts, ends, before = words.word_spans(data, offsets)
        for i in range(len(offsets) - 1):
            own = range(before[i], before[i + 1])
            seen.append([data[starts[k] : ends[k]].tobytes().decode() for k in own])
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_no_word_crosses_the_border_of_two_texts():
    _, data, offsets = next(words.text_slices(pa.array(["ab", "cd", "", "e"])))
    starts, _, before = words.word_spans(data, offsets)
    assert starts.tolist() == [0, 2, 4] and before.tolist() == [0, 1, 2, 2, 3]


def test_slices_of_sliced_columns():
    column = pa.array(["x", None, "yy", "zzz"]).slice(1)
    assert [(first, data.tobytes(), offsets.tolist()) for first, data, offsets in words.text_slices(column)] == [(0, b"yyzzz", [0, 0, 2, 5])]


def test_equal_windows_have_equal_values_and_others_not():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 8, 50):
        items = rng.integers(0, 3, 400).astype(np.uint64)
        values = words.window_hashes(words.mix(items), width)
        assert len(values) == 400 - width + 1
        by_value, by_window = {}, {}
        for i, v in enumerate(values.tolist()):
            window = tuple(items[i : i + width].tolist())
            assert by_value.setdefault(v, window) == window and by_window.setdefault(window, v) == v
    assert len(words.window_hashes(words.mix(items), 401)) == 0


def test_word_values_tell_words_apart():
    texts = ["a", "b", "aa", "ab", "ba", "a a", "é", "a" * 300, "a" * 301]
    _, data, offsets = next(words.text_slices(pa.array(texts)))
    starts, ends, _ = words.word_spans(data, offsets)
    values = words.word_hashes(data, starts, ends).tolist()
    tokens = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(values)) == len(set(tokens))
    assert all((values[i] == values[j]) == (tokens[i] == tokens[j]) for i in range(len(values)) for j in range(i))
