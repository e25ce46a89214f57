import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for p in (os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))):
    sys.path.insert(0, p)

SF = "/root/testdata/sf0.001"
TOK = "/opt/tokenizers"


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(id, text), ...]) with the other columns of documents and clashing extras."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, None, None, None, "x", 1.5, 7) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, "
            "n_words string, score double, __h int")
    return make
