import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, key string, "
          "row string, start string, score string, words string, bin string, draw int, label int")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    word = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    prose = [" ".join(rng.choice(word) for _ in range(200)) for _ in range(6)]
    passage = " ".join(rng.choice(word) for _ in range(60))
    texts = [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one two"), (5, "One  two"), (5, "One  two"),
        (5, "another text under one id"), (None, "a text without an id " + passage), (None, None),
        (7, "word " * 30000), (8, "word " * 30000), (9, "x" * 120000), (10, "y" * 49), (11, "y" * 50),
        (12, "y" * 50), (13, prose[0]), (14, prose[0]), (15, prose[0] + " tail"),
        (16, prose[1] + "\n" + passage + "\n" + prose[2]), (17, passage), (18, prose[3] + passage),
        (19, "\n".join([prose[4][:80]] * 30)), (20, "éàü ñ 漢字 😀 " * 40), (21, "éàü ñ 漢字 😀 " * 40),
        (22, "### $$$ %%% " * 60), (23, prose[5]), (23, prose[5]), (-4, prose[5] + " " + passage),
        (2**62, "big id " + passage),
    ]
    extra = ("clash",) * 7
    return [(i, t, None if k % 3 == 0 else ["en", "de"][k % 2], None if k % 4 == 0 else "src0",
             None if k % 5 == 0 else k, 7, *extra[:6], 1, 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
