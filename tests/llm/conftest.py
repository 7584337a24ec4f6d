import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "id long, fp long, n long, token string, score double, start long, bin long, epoch long, shard string, __n long"


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows, near
    copies, shared passages and odd characters."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(80), text(60)
    rows = [(1, base, "en", "src0", 1), (2, base, "en", "src0", None), (3, base + " tail", "en", None, 3), (4, None, "en", "src0", 0), (5, "", None, "src1", 0)]
    rows += [(6, " \n\t ", "de", "src1", 3), (7, text(30_000), "de", "src2", 9), (None, text(70), None, None, None), (8, "one two", "en", "src0", 7), (9, "ONE two", "en", "src0", 7)]
    rows += [(10, f"{text(40)}\n{passage}\n{text(40)}", "fr", "src3", 5), (11, f"{text(30)}\n{passage}\n{text(50)}", "fr", "src3", 5), (12, "a" * 5000 + " é 中文   <|endoftext|> " + "x\n" * 60, "es", "src4", 1)]
    rows += [(13, text(90), "en", "src0", 1)] * 2
    near = base.split()
    for i in range(14, 40):
        w = list(near)
        w[rnd.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), rnd.choice(["en", "fr"]), "src0", i))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.selectExpr("*", *[f"CAST(1 AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASH.split(", ")]).cache()


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
