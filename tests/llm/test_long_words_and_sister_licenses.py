"""Words made to agree in a polynomial hash, and notices of licenses that no template knows."""

import numpy as np

from frayline.llm import jaccard_join, license_scan
from frayline.llm.textblocks import hash_word


def thue_morse(n: int, one: str, two: str) -> str:
    return "".join(one if bin(i).count("1") % 2 == 0 else two for i in range(1 << n))


def test_words_of_a_structure_do_not_agree(spark):
    for n in (10, 11, 12):
        a, b = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        assert hash_word(a) != hash_word(b) and hash_word(a.upper()) == hash_word(a)
    docs = spark.createDataFrame([(1, thue_morse(11, "a", "b")), (2, thue_morse(11, "b", "a")), (3, thue_morse(11, "a", "b"))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_words_around_the_limit_are_told_apart():
    rng = np.random.default_rng(0)
    words = {"".join(rng.choice(list("abc"), n)) for n in (126, 127, 128, 129, 130) for _ in range(200)}
    assert len({int(hash_word(w)) for w in words}) == len(words)


NOTICES = {
    "This program is licensed under the GNU Lesser General Public License version 2.1": "",
    "This program is licensed under the GNU Lesser General Public License, version 3": "lgpl-3",
    "This program is licensed under the GNU Affero General Public License version 2": "",
    "This work is licensed under the GNU Library General Public License, version 2": "",
    "This library is licensed under the GNU General Public License, version 2": "gpl-2",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This work is licensed under the GNU General Public License, version 7": "",
    "One part of it is covered by the GNU Lesser General Public License version 3, as its own file says in full.\nThis work is licensed under the GNU General Public License, version 2": "gpl-2",
}


def test_sister_licenses_take_no_other_label(spark):
    rows = list(enumerate(NOTICES))
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices=True)
    got = {r["doc_id"]: r["labels"] for r in found.collect()}
    for i, text in rows:
        assert NOTICES[text] in got[i].split(",") if NOTICES[text] else got[i] == "", (text, got[i])
