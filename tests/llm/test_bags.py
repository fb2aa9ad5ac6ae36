import tracemalloc

import numpy as np

from harrier.llm import quality, subwords


def test_bags_are_not_held_in_memory():
    """Less than a byte for a feature; in a list of arrays a feature takes six."""
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(x) for x in rng.choice(list("abcdefghij"), (600, 6))) for _ in range(60)]
    quality._Bags(texts[:2])  # fills the caches of powers
    tracemalloc.start()
    bags = quality._Bags(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert bags.n.min() > 4000 and held < bags.n.sum()
    f, c = np.unique(subwords.Words([texts[7]], False).features(True)[0], return_counts=True)
    flat, often, n = bags(np.array([7]))
    assert flat.tolist() == f.tolist() and often.tolist() == c.tolist() and n.tolist() == [len(f)]


def test_bags_of_texts_without_words():
    bags = quality._Bags(["", "  ", ""])
    assert bags.n.tolist() == [0, 0, 0] and [len(x) for x in bags(np.array([0, 2]))] == [0, 0, 2]
