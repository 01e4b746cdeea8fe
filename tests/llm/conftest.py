import random

import pytest

#: A text of each awkward kind, by doc_id; ids 20 and 21 repeat rows, 22 repeats a text.
WORDS = "the of and in to a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(5)
    body = "\n".join(sentence(rng, 30) for _ in range(4))
    return [
        (0, None, "en", "a.example.com"),
        (1, "", None, None),
        (2, " \n\t\x0b\f\r ", "", ""),
        (3, "one", "en-GB", "a.example.com"),
        (4, "naïve “quotes” 日本語 🙂 ß İ Σς", "xx", "b.example.org"),
        (5, "\n\n" + body + "\n\n", "en", "a.example.com"),
        (6, body, "en", "a.example.com"),
        (7, sentence(rng, 30_000), "en", "b.example.org"),
        (8, "x" * 50_000, "en", "b.example.org"),
        (9, "same same same " * 40, "en", None),
        (10, "<|endoftext|> in <|ENDOFTEXT|> text\x00\x1c\x85\xa0", "en", "a.example.com"),
        (20, body + "\nthe end", "en", "c.example.net"),
        (20, body + "\nthe end", "en", "c.example.net"),
        (22, body, None, "c.example.net"),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The awkward rows with columns whose names operators use inside."""
    clash = ["n", "key", "host", "kept", "spans", "rest", "th", "ids", "component_id", "n_lines", "declared", "media", "node"]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([r + ("?",) * len(clash) for r in awkward_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
