import pytest

#: Documents with every awkward case: nulls, empties, blanks, repeats, odd characters, a long text.
WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing near old stone walls".split()


def prose(seed: int, n: int = 60) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("ly" if x & 64 else ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    base = prose(1)
    texts = {
        1: base, 2: base, 3: base.upper(), 4: base.replace("the", "teh", 1), 5: prose(5), 6: "", 7: None, 8: " \t\n", 9: "one two", 10: "ONE two", 11: prose(11) + " " + prose(12, 40),
        12: prose(13, 12_000), 13: "token = \"0123456789abcdef0123456789abcdef01234567\" end", 14: "é ñ ß İ ΣΑΣ 日本 😀 a\u0301 <|endoftext|> \x1c x", 15: "x" * 3000, 16: base + " tail",
    }
    rows = [(k, t, "en", "s", 0, "clash", 1.0) for k, t in texts.items()]
    return rows + [(None, prose(99), "en", "s", 0, "clash", 1.0), (5, prose(5), "en", "s", 0, "clash", 1.0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, score double"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
