import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cut string, found string, row_key long, measures int"


def texts():
    """Texts with copies, near copies, shared passages, odd bytes and all the defined cases."""
    rng = random.Random(5)
    syllables = ["ba", "ko", "mi", "tré", "zu", "né", "lo", "ß", "pi", "sha"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    rows = [None, "", " \n\t ", "one", "a b c", "日本語 のテキスト", "tab\tand\x00zero", "²"]
    for _ in range(8):
        rows.append(" ".join(word() for _ in range(rng.randint(5, 200))))
    for k in range(6):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    for _ in range(5):
        rows.append(" ".join(word() for _ in range(30)) + "\n" + passage + "\n" + " ".join(word() for _ in range(30)))
    rows += [passage, passage, "again and again " * 40, "x" * 3000, "ab" * 700, "\n".join(["same line here"] * 30)]
    rows.append(" ".join(word() for _ in range(20_000)))  # very long
    rows += [rows[9], rows[10].upper(), rows[9]]
    return rows


def documents(spark, rows):
    """Rows with ids 0, 1, ..., a repeated row, a row without an id, and columns with clashing names."""
    data = [(i, t, "en", None, None, "c", "f", 1, 2) for i, t in enumerate(rows)]
    if rows:
        data += [(9, rows[9], None, "s", 1, None, None, None, None), (None, rows[8], None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="session")
def rows_of_text():
    return texts()


@pytest.fixture
def docs(spark, rows_of_text):
    return documents(spark, rows_of_text)


@pytest.fixture
def no_docs(spark):
    return documents(spark, [])
