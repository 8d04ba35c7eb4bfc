"""Runs of words that a filter lets through, against a test of every distinct run."""

import random

import numpy as np

from marklake.functions import runs as R


def test_a_filter_sorts_only_what_it_lets_through_and_leaves_the_same():
    draw = random.Random(31)
    for words in (0, 2, 300, 30_000):  # the last text is longer than the kept powers
        hashes = R.word_hashes(" ".join(f"w{draw.randrange(400)}" for _ in range(words)))
        assert len(hashes) == words
        for n in (1, 2, 3):
            every = R.run_hashes(hashes, n)
            size = 2 * R._PAGE
            held = np.zeros(size, np.uint8)
            held[R._probed(every[::7], size).ravel().astype(np.int64)] = 1
            bits = np.packbits(held, bitorder="little")
            want = every[held[R._probed(every, size).astype(np.int64)].all(0)]
            assert (R.run_hashes(hashes, n, bits) == want).all() and set(every[::7].tolist()) <= set(want.tolist())
