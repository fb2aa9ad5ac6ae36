"""CGK random-walk embeddings and bit-sampling keys of texts, to measure what a search by them would take."""

from collections import defaultdict

import numpy as np

from harrier.llm.hashing import mix

#: Steps sampled of an embedding.
SAMPLED = 3


def embed(texts: list[str], walks: int, steps: np.ndarray, seed: int = 7) -> np.ndarray:
    """CGK embeddings at the sampled steps only: (walks, texts, samples); steps: (walks, samples), per walk.

    A text of n characters is walked through in 3 n steps; past its end it gives 0."""
    last = int(steps.max()) + 1 if steps.size else 0
    longest = max((len(t) for t in texts), default=0)
    codes = np.zeros((len(texts), longest + 1), np.int64)
    for k, t in enumerate(texts):
        codes[k, : len(t)] = mix(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64), 4) % np.uint64(255) + np.uint64(1)
    at = np.zeros((walks, len(texts)), np.int32)
    out = np.zeros((walks, len(texts), steps.shape[1]), np.uint8)
    wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for w in range(walks):
        for j, s in enumerate(steps[w].tolist()):
            wanted[s].append((w, j))
    rows, rng = np.arange(len(texts))[None, :], np.random.default_rng(seed)
    which = np.arange(walks)[:, None]
    for s in range(last):
        bits = rng.integers(0, 2, (walks, 256), dtype=np.int32)
        c = codes[rows, np.minimum(at, longest)]
        for w, j in wanted.get(s, ()):
            out[w, :, j] = c[w]
        at += bits[which, c]
    return out


def sampled_steps(length: int, walks: int, samples: int = SAMPLED, seed: int = 3) -> np.ndarray:
    """Steps at which items of about that length are sampled, within three steps a character."""
    return np.random.default_rng(seed + length).integers(0, max(1, 2 * length), (walks, samples))


def keys_of(texts: list[str], length: int, walks: int) -> np.ndarray:
    """(texts, walks): one LSH key for each repetition."""
    e = embed(texts, walks, sampled_steps(length, walks), length).astype(np.uint64)
    with np.errstate(over="ignore"):
        k = np.full(e.shape[:2], 1, np.uint64)
        for j in range(e.shape[2]):
            k = mix(k * np.uint64(257) + e[:, :, j], j)
        return (k + np.arange(e.shape[0], dtype=np.uint64)[:, None]).T
