import random

import pytest


@pytest.fixture
def words():
    """A maker of invented words: the same on every run."""
    rng = random.Random(11)
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "to", "vi", "zu"]

    def make(n):
        return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]

    return make
