import random

import pytest

from rankfield.llm.stage import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def session(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def docs(session):
    """Copies, near copies, shared passages, odd texts, a null id and clashing columns, in a few hundred rows."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, rows = text(120), []
    for i in range(120):
        rows.append((i, text(draw.randint(0, 150)), "en", f"s{draw.randint(0, 4)}", 0))
    base = text(200)
    for i in range(120, 150):  # near copies: one word in a hundred differs
        own = base.split()
        own[draw.randrange(len(own))] = f"w{i}"
        rows.append((i, " ".join(own), "en", "s0", 0))
    for i in range(150, 165):
        rows.append((i, rows[3][1], "de", "s1", 0))  # exact copies
    for i in range(165, 180):
        rows.append((i, f"{text(30)} {passage} {text(20)}", "en", "s2", 0))
    long = text(9000)
    odd = [None, "", "   ", "one", "one", "a b c d", "aaaa " * 300, "\n\n\t", long, "x" * 5000, "Großé " * 90, "<|endoftext|> it's 1,000 x  y", "zwei drei"]
    for i, value in enumerate(odd):
        rows.append((180 + i, value, None, None if i % 2 else "s9", 0))
    rows += [(0, rows[0][1], "en", rows[0][3], 0), (None, "no id here at all", "en", "s1", 0), (None, None, None, None, None)]
    return session.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "label").repartition(5)


@pytest.fixture(scope="session")
def local(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(session):
    return session.createDataFrame([], DOCS)
