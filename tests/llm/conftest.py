from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.fixture
def prose():
    """A maker of random texts, the same in every run."""
    random_ = random.Random(11)

    def make(n):
        return " ".join(random_.choice(VOCABULARY) for _ in range(n))

    make.random = random_
    return make
