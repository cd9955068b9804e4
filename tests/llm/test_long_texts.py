import time

import numpy as np
import pytest

from docweave.llm import lookalikes, pairs, splitting, stuffing, tokenizer

ODD = ["<!--", "![", "[a](", "<a ", '"', "`", "- ", "\n", "a.b ", "www.", "*", "__", "\u200b", "\u0430", "e\u0301", "\u65e5", "| ", "x", "1. ", "[[", "#", "tag:a "]


@pytest.mark.parametrize("p", ODD)
def test_long_odd_texts_take_linear_time(p):
    text = p * (40000 // len(p))
    reader, cost, normal = stuffing.Reader(), stuffing.Model(np.ones((len(stuffing.LANGUAGES), stuffing.N**3))), lookalikes.Normalizer({})
    for run in (lambda: pairs.defect("why is it so", text), lambda: pairs.defect(text[:3000], text), lambda: stuffing.judge(text, cost, reader), lambda: splitting.split_text(text, 200, 24), lambda: normal(text), lambda: tokenizer.load().packed(text)):
        began = time.time()
        run()
        assert time.time() - began < 5, p
