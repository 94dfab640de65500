import pytest

WORDS = "the of and river stone walks under bright lamps while seven old clocks ring across a narrow street".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 4) % 9 else str(x % 977)))
        if i % 23 == 22:
            out[-1] += ".\n"
    return " ".join(out)


ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\x0b\f ", None, None, 7),
    (4, prose(4, 120), "en", "a", 1),
    (5, prose(4, 120), "en", "b", 1),
    (6, prose(4, 120).replace(" ", "  "), "en", "a", 1),
    (None, prose(9, 80), "de", "a", 1),
    (7, "É\U0001F600 Ünïcode <|endoftext|> token: secret='Abcdefgh1' A\n\n  B   c\t d", "fr", "b", 3),
    (7, "É\U0001F600 Ünïcode <|endoftext|> token: secret='Abcdefgh1' A\n\n  B   c\t d", "fr", "b", 3),
    (8, prose(8, 30000), "en", "a", 5),
    (9, "Same Line\n" + prose(10, 60), "en", "a", 5),
    *[(20 + i, f"  same line \t\n{prose(50 + i, 70)}\nSAME LINE", "en", f"s{i % 3}", 2) for i in range(12)],
    (40, "\n".join(["a a a a a a"] * 40), "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(odd):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["name", "at", "names", "copies", "block", "bucket", "score", "predicted", "n_lines", "fp", "key", "line", "copy", "kept", "host", "slice", "words", "__key", "shuffle_key", "path_x", "__draws", "__cdf", "__frequent", "__kept", "__root", "__component", "__pool", "__id", "__rid", "__fp", "row", "group", "pool", "draws", "cdf", "rate", "from", "root", "component_id", "rid", "p", "hash", "trains", "terms", "lines", "part", "width", "c0", "_", "sequence_id", "n.x"]
    return odd.select("*", *[F.lit(1).alias(n) for n in names])
