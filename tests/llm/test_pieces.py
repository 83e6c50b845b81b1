"""The pieces that token encoding keeps, against the library on letters of several scripts beside signs."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pytest

from quillon.llm import tokenfiles

P = pytest.importorskip("public_tokenizers")


def test_letters_of_other_scripts_are_not_cut():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), tokenfiles.PieceEncoder(path)
    parts = ["μ", "µ", "ª", "g", "ml", "Ж", "日本", "½", "²", "ⁿ", "5", "/", "—", "“", "'", "'s", ".", "é", "é", "​", "！", "Ａ", "々", "Ⅷ", "\x1c", "　"]
    texts = ["5 μg/ml", "μg/ml", " μg.", *(f"{s}{a}{b}{c}" for s in ("", "x ") for a, b, c in itertools.product(parts, repeat=3))]
    wrong = [s for s in texts if np.frombuffer(own.encode(s), own.type).tolist() != t.encode(s, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:5])


def test_signs_hold_no_letter_or_space():
    sign, space = re.compile(f"[{tokenfiles._SIGN}]"), re.compile(f"[{tokenfiles._S}]")
    held = [c for c in map(chr, range(0x110000)) if sign.match(c)]
    assert not [c for c in held if unicodedata.category(c)[0] == "L" or space.match(c) or c == "'"]
