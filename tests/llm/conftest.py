import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sa", "no", "li") for b in ("n", "r", "st", "la", "vi", "do")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def messy():
    """Null ids and texts, blank texts, one word, a long text, exact and near copies, repeated rows, one id with two texts."""
    rng = random.Random(3)
    base, passage = prose(rng, 60), prose(rng, 20)
    pairs = [(i, prose(rng, rng.randint(1, 80)) + "\n" + prose(rng, rng.randint(1, 30))) for i in range(10, 60)]
    pairs += [(i, near(rng, base, 0.02 * (i % 8))) for i in range(60, 90)] + [(90, base), (5, base), (91, base)]
    pairs += [(i, prose(rng, 15) + " " + passage + " " + prose(rng, 15)) for i in range(100, 112)]
    pairs += [(120, None), (121, ""), (122, " \n\t "), (123, "one"), (2, "one"), (124, "Zwei Wörter 中文"), (None, base), (None, None)]
    pairs += [(130, prose(rng, 5000) + "\n" + passage), (10, pairs[0][1]), (131, "tie tie"), (131, base), (132, "A b\nA b\nb A\nA")]
    return pairs
