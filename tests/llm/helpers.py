"""Small inputs for the operators' tests."""

import random

import pandas

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside or return.
CLASHING = ", kept string, n_words string, score string, component_id int, key int, rank int, dst int, label string, copies string, host string, tokens string, repeats string, h int, `a.b` string, host_rejected string, __row int, rest string, id int, `tick``ed` string, domain string, number int, `__of` string, repeats_x int"


def frame(spark, rows, clashing=False):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(i, t, *(rest or ("en", "s1")), None if t is None else len(t)) for i, t, *rest in rows]
    if not clashing:
        return spark.createDataFrame(full, DOCS)
    extra = ("x", "x", "x", 1, 1, 1, 1, "x", "x", "x", "x", "x", 1, "x", "x", 1, "x", 1, "x", "x", 1, "x", 1)
    return spark.createDataFrame([(*r, *extra) for r in full], DOCS + CLASHING)


def prose(n, seed, vocabulary=400):
    chance = random.Random(seed)
    return " ".join(f"w{chance.randrange(vocabulary)}" for _ in range(n))


def edited(text, share, seed):
    chance = random.Random(seed)
    return " ".join(f"e{chance.randrange(10**6)}" if chance.random() < share else w for w in text.split())


#: Null, empty, blank, one word, repeated rows, a null id, other scripts, one very long text.
ODD = [(None, "a text without an id, of ten words and some more"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same row"), (5, "same row"), (6, "日本語 テキスト 😀\u00a0x"), (7, prose(30_000, 1)), (-3, "negative id")]

#: The smallest tables at hand, and larger ones.
TINY = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"


def table(folder, name):
    return pandas.read_parquet(f"{folder}/{name}.parquet")
