"""Very long entities, and samples of repeated rows: cost in proportion, nothing ends the session."""

import random
import re
import time

from docweave.llm.language_id import labelled_sample
from docweave.llm.pii import PATTERNS, replace_entities


def test_addresses_are_found_as_by_their_labels():
    """The pattern against one that names the labels, on random texts."""
    plain = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b", "Z", "1", "-", ".", ".", "@", " ", "_"]) for _ in range(rng.randrange(4, 30)))
        assert [m.span() for m in re.finditer(PATTERNS["email"], text)] == [m.span() for m in re.finditer(plain, text)]


def test_very_long_entities(spark):
    """An address of 100,000 labels and a secret of a megabyte."""
    secret = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1 << 20))
    rows = [(1, "to a@b" + ".cc" * 100_000 + " now"), (2, f'token = "{secret}" end'), (3, "to x@y.example.com now")]
    began = time.time()
    got = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert got[2].startswith('token = "') and got[2].endswith('" end') and len(got[2]) == len(rows[1][1]) and secret[:50] not in got[2]
    assert "a@b.cc" not in got[1] and got[1].startswith("to ") and got[1].endswith(" now") and "x@y.example.com" not in got[3]


def test_a_sample_of_repeated_rows_is_bounded(spark):
    """However many equal rows there are, one of them is drawn."""
    df = spark.range(200_000).selectExpr("cast(7 as long) doc_id", "'gleicher Text' text", "'de' lang").unionByName(spark.createDataFrame([(i, f"other text {i}", "en") for i in range(300)], "doc_id long, text string, lang string"))
    for seed in range(3):
        langs, stretches, labels = labelled_sample(df.selectExpr(f"doc_id + {seed} doc_id", "text", "lang"), "doc_id", "text", "lang", sample_docs=100)
        assert langs == ["de", "en"] and len(stretches) == len(labels) <= 200 * 8
