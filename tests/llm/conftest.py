import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, _row int"


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, names that clash with internal ones."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "of", "thing", "erea", "Ontion,", "whole.", "ünder", "x"]) + str(rng.randrange(9)) * (rng.random() < 0.1) for _ in range(n))
    base = prose(300)
    rows = [(i, prose(rng.randrange(1, 200)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base + " more", "de", "s1"), (100, base, "en", "s0"), (103, base.upper(), None, None)]
    rows += [(200, None, None, "s9"), (201, "", "fr", None), (202, " \n\t ", "fr", "s9"), (None, "lost text of nobody", "en", "s2"), (None, None, None, None)]
    rows += [(300, "a a a a a a\na a a a a a\n" * 900, "en", "s0"), (301, "z" * 5000, "en", "s0"), (302, "x y", "en", "s1"), (303, "wordé \U0001f600 ▁ end", "es", "s2")]
    rows += [(400, 'token = "' + "0a1b2c3d4e" * 4 + '" mail me.34@mail7.example.com or +1 (487) 555-7209 at 97.51.17.173 and 4952935900253052', "en", "s1"), (401, "key qZ8pW3vX9mK2rT7yL4nB ok AKIA" + "Q7" * 10, "en", "s1")]
    return [(*r, len(r[1]) if r[1] else None, "clash", 7) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
