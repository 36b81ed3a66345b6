"""Made-up prose for tests."""

import random


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def vary(text, edits, rng):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)
