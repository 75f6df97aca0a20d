"""Documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pytest

LANGS = ["en", "de", None]
VOCABULARY = [a + b for a in "ba ke li mo nu ter schön grün Über Ça".split() for b in ["", "n", "ra", "sto", "##", "é"]]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, n_words string, fp int, row_key string, w int, g int, kept int, base string, status int"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents() -> list[tuple]:
    texts = {
        0: passage(0, 120), 1: passage(0, 120), 2: passage(1, 40) + "\n" + passage(0, 80), 3: None, 4: "", 5: " \n\t ", 6: passage(2, 34), 7: passage(3, 35), 8: passage(3, 35),
        9: "one", 10: "one", 11: passage(4, 20000), 12: "x" * 150_000, 13: "+1 (555) 555-0100 " * 30, 14: passage(5, 60) + " " + passage(5, 60), 15: "é" * 99 + "ß" * 200, 16: "a b c d e f g h i j k l", 17: "A B C D E F G H I J K L",
        18: passage(0, 119) + " changed", 19: "mail a.b@x.example.com and 10.0.0.1, 300.1.1.1, card 4539 1488 0343 6467!", 20: "\n".join(["same line here"] * 30), 21: "日本語 テキスト " * 20, 22: passage(1, 40),
    }
    rows = [(i, t, LANGS[i % 3], None if i % 4 == 0 else f"s{i % 2}") for i, t in texts.items()]
    rows += [rows[0], rows[19], (None, passage(7, 50), None, None), (None, None, None, None), (None, passage(0, 120), "en", "s1")]
    return [(*r, len(r[1] or ""), "c", 1, "n", 2, "k", 3, 4, 5, "b", 6) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def key(x):
    return tuple((v is None, str(v)) for v in x)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=key)
