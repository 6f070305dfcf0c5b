import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# Python workers import what the tests pass to them.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)),
                                                         os.environ.get("PYTHONPATH")]))

EDGES = [None, "", " ", "a b c", "A  b\nc", "x　y z  \n", "\U0001f600 café é 漢字", "a" * 700, "<|endoftext|>  <|endoftext|> b",
         "one two three four five six seven", "one two three four five six seven"]


@pytest.fixture(scope="session")
def texts():
    """Invented prose with copies, near copies, a shared passage and edge cases."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["The", "café", "don't", "42"]
    base = [[rnd.choice(words) for _ in range(rnd.randint(8, 120))] for _ in range(12)]
    passage = [rnd.choice(words) for _ in range(90)]
    out = list(EDGES)
    for _ in range(220):
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        if rnd.random() < 0.3:
            own[len(own) // 2:len(own) // 2] = passage
        out.append(" ".join(own))
    return out + [" ".join(base[0])] * 15


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Columns of documents and two with names that the operators use inside."""
    rows = [(k, t, "en", "src0", len(t or ""), "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "row string, length long").repartition(5)
