import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from docketlake.session import local_session

    session = local_session(4, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


class LetterCounts:
    """Vectors without a model: how often each of some letters stands in a text."""

    def __init__(self, letters: str = "aeosrndt"):
        self.letters, self.dimension = letters, len(letters)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(text.count(c)) for c in self.letters] for text in texts]
