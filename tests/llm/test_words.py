import re
import unicodedata

import numpy as np

from sonde.llm import common as C


def of(text):
    code, start, end, bounds, base = C.words([text])
    raw = C.lowered(text)
    return [raw[a:b].decode() for a, b in zip(start, end, strict=True)], code.tolist()


def plain(text):
    """Words by one pass over the characters."""
    out, run = [], ""
    for ch in text:
        single = any(a <= ord(ch) <= b for a, b in C.UNSPACED)
        if unicodedata.category(ch)[0] in "LNM" and not single:
            run += ch
            continue
        out += [run] if run else []
        run = ""
        if unicodedata.category(ch)[0] in "LNM":
            out.append(ch)
    return [*out, run] if run else out


def test_words_equal_a_plain_pass():
    for t in ("", "abc", " a1 b_c-d ", "caf\u00e9 \u00d7 na\u00efve\u00f7x", "\u201cquoted\u201d \u2014 it\u2019s", "\u4e2d\u6587abc\u5b57\u3042\u30a2 x", "\u0440\u0443\u0441 \u03b5\u03bb \U0001f600\U00020000z", "a\u00a0b", "e\u0301a", "\u0e44\u0e17\u0e22"):
        assert of(t)[0] == plain(t), t


def test_both_ways_give_the_same():
    t = "the caf\u00e9 at 12 \u00fcber, x\u00d7y"
    assert of(t)[1] == of(f"{t} \u2026")[1]
    assert of("it\u2019s \u201cso\u201d")[1] == of("it's \"so\"")[1]


def test_texts_are_apart():
    code, _, _, bounds, _ = C.words(["a b", None, "\u4e2d\u6587", "", "a"])
    assert np.diff(bounds).tolist() == [2, 0, 2, 0, 1] and code[0] == code[-1]
    assert re.fullmatch("[0-9]+", str(code[0]))
