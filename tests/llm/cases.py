"""Small documents with the awkward cases every operator has to define."""

from __future__ import annotations

import random
import re

#: Values of the columns that operators do not ask for.
MORE = (7, "k", 1, 2, "b", None, 99, 98, "m", 97, 96, "c", 95)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int, id long, key string, task long, size int, block string, word string, "
DOCS += "m_words int, m_epoch int, m_id string, gone_id long, cut_doc long, cut_spans string, M_Size int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "sur", "vel", "o", "dra"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(texts, lang="en", source="s"):
    """Rows of DOCS; further columns clash with names that operators use inside."""
    return [(i, t, lang, source, len(t) if t is not None else None, *MORE) for i, t in texts]


def awkward():
    base = prose(1, 120)
    swapped = base.split()
    swapped[60] = "changed"
    return (
        rows([(1, base), (2, base), (3, " ".join(swapped)), (4, prose(2, 80)), (5, ""), (6, None), (7, " \t\n"), (8, "one two"), (9, "one two"),
              (10, prose(3, 20_000)), (11, base.upper() + "\n\t"), (12, "é中 \U0001f600 ́x"), (13, "ab " * 300)])
        + rows([(4, prose(2, 80))])  # a repeated row
        + rows([(None, base), (None, None)], lang=None, source=None)
    )


def frame(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
