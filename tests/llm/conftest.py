import random

import pytest

WORDS = "the of and river stone cloud window paper garden silver morning table winter yellow forest music letter bridge".split()
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, component string, u int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names operators use too."""

    def docs(rows):
        return spark.createDataFrame([(i, t, x[0] if x else "en", x[1] if len(x) > 1 else "s", 0, None, 7, "c", 1) for i, t, *x in rows], FIELDS)

    return docs


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, nulls and empties."""
    r = random.Random(7)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    passage = say(30)
    rows = [(i, say(r.randint(1, 120))) for i in range(60)]
    for i in range(60, 90):
        words = rows[i % 20][1].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed" + str(r.randint(0, 3))
        rows.append((i, " ".join(words)))
    rows += [(90 + i, f"{say(8)} {passage} {say(i)}") for i in range(8)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, None), (104, "ünï çödé " * 30), (105, "ünï çödé " * 29 + "x"), (106, "a" * 400), (107, "a" * 300), (108, say(3000))]
    rows += [(110 + i, rows[3][1].replace(" ", "  ")) for i in range(3)] + [(120, "two words"), (121, "Two  words"), (122, "A\nb\nA")]
    return rows
