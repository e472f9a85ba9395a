import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, g int, _uid int"


def prose(seed: int, n: int) -> str:
    """Words by a fixed rule, different for each seed."""
    return " ".join(WORDS[(seed * 7 + i * i + i * (seed % 5 + 3)) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Near and exact copies, shared passages, nulls, empty and long texts, repeated rows."""
    passage = prose(99, 40)
    texts = [prose(s, 60 + 13 * s) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, texts[1]), (21, texts[1]), (22, texts[2] + " and more"), (23, "start " + texts[2]), (24, texts[3].upper())]
    rows += [(30 + i, prose(40 + i, 30) + "\n" + passage + "\n" + prose(60 + i, 30)) for i in range(4)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "one two three"), (55, "one two three"), (56, "One TWO three")]
    rows += [(60, prose(5, 4000)), (61, "x" * 20000), (62, "same line\nsame line\nsame line"), (62, "same line\nsame line\nsame line")]
    rows += [(None, texts[4]), (None, None), (70, texts[4]), (71, "naïve café 日本語 " * 30), (72, "a\x0bb\x0cc\rd")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, "u", 1, 2) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
