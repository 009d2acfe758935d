import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    from helpers import DOCS, awkward

    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    from helpers import DOCS

    return spark.createDataFrame([], DOCS)
