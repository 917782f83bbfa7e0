import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, shared ids, near copies, a hot source, clashing columns."""
    rng = random.Random(7)
    passage = " ".join(sentence(rng, 12) for _ in range(6))
    rows = []
    for i in range(60):
        body = "\n".join(" ".join(sentence(rng, rng.randrange(3, 18)) for _ in range(rng.randrange(1, 8))) for _ in range(3))
        if i % 5 == 0:
            body = body[:len(body) // 2] + " " + passage + " " + body[len(body) // 2:]
        rows.append((i, body, "en", "src0" if i % 3 else f"src{i % 7}"))
    base = rows[4][1]
    for i in range(60, 80):  # near copies and exact copies of one document
        words = base.split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "src0"))
    rows += [(80, None, None, None), (81, "", "en", "src1"), (82, "  \n\t ", "en", None), (83, "one", "en", "src2"), (84, "one", "en", "src2"),
             (85, "It IS four words", "en", "src2"), (86, "it is FOUR words", "en", "src2"), (87, "é" * 90 + " ü", "de", "src2"),
             (88, "same " * 400, "en", "src3"), (89, "zero\x00byte " * 30, "en", "src3"), (90, "x" * 5000, "en", "src3"),
             (91, " ".join(sentence(rng, 10) for _ in range(3000)), "en", "src3"), (None, passage, "en", "src4"), (None, passage, "en", "src4"),
             (5, rows[5][1], "en", "src0"), (6, "another text under a shared id " + passage, "en", "src0")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    # columns that the operators use inside
    return df.selectExpr("*", "cast(length(text) as bigint) as n_chars", "1 as id", "'t' as tie", "2 as row", "true as kept", "3 as score",
                         "4 as node", "5 as size", "6 as target", "7 as words").cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("1 = 0")
