import random

import pytest

from gaugeworks.llm.shared import reach_workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ten", "Ou", "é") for b in ("ra", "st", "ing", "#", "da.", "ß", "x9")]


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    reach_workers(spark)


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", "  ", "\n", "\t", ".\n"]) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with nulls, empties, blanks, copies, near copies, shared passages, repeated
    lines, a long text, a hot source, repeated rows, and ids that are null or shared."""
    rng = random.Random(7)
    passage, line = prose(rng, 60), prose(rng, 9).replace("\n", " ")
    texts = [None, "", " \n\t", "one", "one two three", prose(rng, 34), prose(rng, 35), prose(rng, 36)]
    texts += [prose(rng, rng.randint(5, 150)) for _ in range(30)]
    base = prose(rng, 200)
    texts += [base] * 6 + [base + " tail", base.replace("ka", "ko", 1), "head " + base]
    texts += [prose(rng, 20) + passage + prose(rng, 20) for _ in range(8)]
    texts += ["\n".join([line] * 12), prose(rng, 10) + "\n".join([line] * 5), " ".join(["same"] * 90), prose(rng, 4000)]
    texts += ["nbsp here   and\x1c there  ", "password = 'abcdef123456XYZ' token: short", "a <|endoftext|> b"]
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (21, "another text under an id in use", "en", "hot", 5), (None, base, "en", None, 0), (None, "no id here", None, None, 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names clash with those that operators use."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "1 AS words", "'x' AS spans", "2 AS row", "3 AS h", "4 AS fp", "5 AS component_id", "6 AS stratum", "true AS kept")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
