import pytest

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega").split()


def prose(seed, n):
    """n words, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 5 else WORDS[(x >> 13) % len(WORDS)]))
    return " ".join(out)


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_text = "\n".join(prose(s, 400) for s in range(40))
    return [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 79) + " omega"), (4, None), (5, ""), (6, " \n\t\n "),
        (7, long_text), (8, "a"), (8, "a"), (None, prose(2, 60)), (None, None),
        (9, "naïve Ünïcode   words and 漢字 emoji 😀 <|im_end|> 123 4567"),
        (10, "same line of more than twenty chars\nsame line of more than twenty chars\nother line of more than that"),
        (11, "same line of more than twenty chars\nsame line of more then twenty char\nwholly different content here"),
        (12, "x" * 5000), (13, (prose(3, 12) + "\n") * 30),
    ]


@pytest.fixture()
def edge_docs(spark):
    """The edge rows with further columns, one of them named like an output."""
    rows = [(i, t, None if i == 3 else "en", f"src{(i or 0) % 2}", None if t is None else len(t), "x", 0.5)
            for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "words string, score double")


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (5, 0, 1), (None, 1, 1), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")
