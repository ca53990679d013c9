"""Marks that end a word are set apart where a letter a-z precedes and a space or line end follows, nowhere else."""

import random
import re

from quadrille.llm import packing as P


def test_endings():
    assert P._ENDING.pattern.startswith(b"[.,]")  # searches by the mark
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"az.,1 \n'?AZ\xc3\xa9\t\r") for _ in range(n)) for n in (0, 1, 2, 3, 2000, 2000)]
    texts += [b". ", b"a.", b"a. ", b"a.\n", b"a,. ", b"a., ", b"1. ", b"\xc3\xa9, ", b"a.\tb"]
    for text in texts:
        assert P._ENDING.sub(rb" \g<0>", text) == re.sub(rb"(?<=[a-z])([.,])(?=[ \n])", rb" \1", text)
