"""No window that reaches the threshold is lost to its fingerprint."""

from __future__ import annotations

import numpy as np

from dubsar.llm import decontaminate as dc


def test_window_at_the_threshold_with_a_far_fingerprint():
    def far_pair():
        for k in range(60_000):  # six words replaced: 180 of 210 shingles stay, the similarity is 0.75
            words = [f"w{k}x{i}".encode() for i in range(214)]
            own = np.array([dc._hash(s) for s in dc.shingles(words)], np.uint64)
            changed = [b"edit%d" % i if i in range(20, 200, 30) else w for i, w in enumerate(words)]
            new = own.copy()
            for i in range(20, 200, 30):
                new[i - 4 : i + 1] = [dc._hash(tuple(changed[p : p + 5])) for p in range(i - 4, i + 1)]
            a, b = (int(dc.simhashes(x, len(x))[0]) for x in (own, new))
            if (a ^ b).bit_count() > 22:
                return b" ".join(words), b" ".join(changed)
        raise AssertionError("no such pair")

    item, text = far_pair()
    search = dc.Items([(7, item.decode())])
    assert search.search(b"before it " + text + b" after") == [(7, 0.75, 2, 214)]
