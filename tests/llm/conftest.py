import zlib

import pytest

DOCS = [
    # (doc_id, text): nulls, empties, ties, repeats, long and odd texts
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "a b c d"), (6, "a b c d e"), (7, "A B C D E"),
    (8, "the quick brown fox jumps over the lazy dog and runs away from it all\n" * 4), (9, "été déjà çà ñandú straße über 北京 \U0001f600 ok"),
    (10, "x" * 70_000), (11, "word " * 30_000), (12, "12345 !!! ??? ###"), (None, "no id here but five words"), (13, "  \x85 odd blanks"),
    (14, "Released under the MIT License.\nplain line"), (15, "Licensed under the Apache License, Version 2.0\nCC BY-NC twice cc by nc"),
]


@pytest.fixture
def odd_docs(spark):
    """Awkward rows, with extra columns whose names clash with results."""
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}", 1.5, "mine", 7) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, labels string, n_words int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


def crc(value) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())
