from harrier.llm.hashing import Bag


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_long_words_that_polynomials_confuse():
    for n in (64, 512, 1024, 2048, 4096):
        one, two = (f"{thue_morse(n, *ab)} b c d e f g h i j k l m" for ab in ("ab", "ba"))
        bag = Bag([one.encode(), two.encode()], seeds=(0, 1))
        for seed in (0, 1):
            h = bag.windows(13, seed)[2]
            assert len(h) == 2 and h[0] != h[1]
            assert Bag([one.encode()], seeds=(0, 1)).windows(13, seed)[2] == h[0]
