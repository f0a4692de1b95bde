import random

import pytest

WORDS = [a + b for a in ("ta", "re", "mi", "so", "lo", "vu", "ka") for b in ("n", "st", "ring", "do", "pe", "x")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", i, i, "x", "y", 1.0, [1], "z") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n bigint, node bigint, words string, row string, score double, spans array<int>, k_id string"
        )

    return make


@pytest.fixture(scope="session")
def odd():
    """Texts that are empty, missing, blank, long, equal, or of odd characters."""
    return [
        (1, None), (2, ""), (3, " "), (4, "\n"), (5, "\n\n a  b \n"), (6, "one"), (7, "One two"), (7, "One two"), (8, "é́ ñ İ Σας ß\t\x1c\x85\r\n"),
        (9, "<|startoftext|> hi<|endoftext|>x <s> <0x0A>"), (10, "▁a ▁▁ b 😀 漢字 a\x00b"), (11, "it's I'LL 12 3.4e5 a,b Stop,now A.B."), (None, "no id"),
        (12, "a" * 3000), (13, prose(1, 20_000)), (14, prose(2, 300)), (15, prose(2, 300)), (16, " leading and trailing "),
    ]
