import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    """Documents with copies, near copies, shared passages, junk, and odd rows: nulls, blanks, repeats, one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ".", ".\n"]) for _ in range(k))
    passage, out = text(70), []
    for i in range(n):
        kind = i % 8
        t = text(rng.randint(1, 200))
        if kind == 1 and i > 8:
            t = out[i - 8]
        elif kind == 2 and i > 8:
            w = out[i - 1 - rng.randint(0, 6)].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = text(30) + " " + passage + " " + text(20)
        elif kind == 4 and i > 20:
            t = text(10) + " " + " ".join(out[i - 20].split(" ")[:90])
        out.append(t)
    out[5], out[6], out[7], out[13] = "", " \n\t ", "Ab", text(9000)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]
    return [*rows, (500, None, None, None, None), (501, "the\x00nul  \x1c and spaces <|endoftext|> it's  ", "en", "s", 1)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, equal ids with other texts, and columns whose names clash with inner ones."""
    rows = [(None, "one two three " * 40), (None, None), (1, "one two three four five"), (1, "one two three four five"), (2, ""), (2, "x"), (3, "one two three four five")]
    return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], "doc_id long, text string, id string, doc string, row string, n long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
