import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    import corpus

    return corpus.table(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    import corpus

    return corpus.table(spark, [])
