import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest_llm import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, `Spans` string, fp string, KEPT int, score string, piece string, n_lines string, word string"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: prose, shared passages, near copies, nulls, blanks, a very long text, odd characters."""
    rnd = random.Random(11)
    shared = prose(rnd, 45)
    out = {k: prose(rnd, rnd.randint(30, 160)) for k in range(10, 30)}
    out[30] = out[10]
    out[31] = out[11].upper()
    out[32] = prose(rnd, 20) + "\n" + shared + " " + prose(rnd, 5)
    out[33] = prose(rnd, 7) + "\t" + shared.replace(" ", "\n", 3)
    out[34] = " ".join([prose(rnd, 25)] * 3)
    out[35] = ""
    out[36] = " \n\t \r\n"
    out[37] = None
    out[38] = "word"
    out[39] = prose(rnd, 20000) + " " + shared
    out[40] = "Straße é́  x y 日本語 😀 \x00\x1f a.b@c.example 10.0.0.255 +49 (030) 123-456 4539578763621486"
    out[41] = out[12] + " tail"
    return out


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """All texts, with a repeated row, rows without an id, null columns, and columns named like new ones."""
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, None, 7, "x", "y", 1, "z", "p", "q", "w") for k, t in texts.items()]
    rows += [rows[3], (None, texts[14], None, "s1", 3, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
