"""Recall at the largest distance does not depend on a number of repetitions."""

import random

from harrier.llm import decontamination as m


def test_no_repetitions_and_every_item_found_at_the_largest_distance():

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [" ".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(100)]
    texts = []
    for t in items:
        c = list(t)
        for i in rnd.sample(range(len(c)), int(m.EDIT_RATE * len(c))):
            c[i] = "z"
        texts.append(m.normal("".join(c)))
    got = {(d, i) for d, i, *_ in m.Index(list(range(100)), items, m.EDIT_RATE).search(texts)}
    assert {(i, i) for i in range(100)} <= got
