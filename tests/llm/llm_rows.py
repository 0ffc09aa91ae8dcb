"""Texts for the tests."""

import random

WORDS = ["the", "of", "alpha", "Beta", "gamma.", "delta,", "été", "zürich", "foo", "bar.", "Baz", "qux", "lorem.", "x1", "y-2", "o'clock"]


def prose(seed, n, line=9):
    r = random.Random(seed)
    words = [r.choice(WORDS) + (str(r.randint(0, 400)) if r.random() < .6 else "") for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) + "." for i in range(0, n, line))
