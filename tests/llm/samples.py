"""Small tables with every awkward case, shared by the tests of this folder."""

import random

from pyspark.sql import types as T

# Names that the operators use inside; the tables carry them as extra columns.
CLASHING = ["doc", "body", "norm", "part", "bundle", "key", "row", "length", "node", "spans", "c0", "margin", "n"]


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(
        rng.choice("abcdefgh") + format(rng.randrange(vocabulary), "x") + rng.choice(["", "", "", ".", ","]) for _ in range(n)
    )


def awkward_rows() -> list[tuple]:
    long_text = words(1, 20_000)
    base = words(2, 300)
    near = base.split()
    near[150] = "changed"
    passage = words(3, 70).replace(",", "") + "."
    rows = [
        (1, "Hello world, it's 9 o'clock"),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (5, "HELLO  world, it's\n9 o'clock"),
        (5, "HELLO  world, it's\n9 o'clock"),
        (None, "a row without an id"),
        (None, None),
        (6, long_text),
        (7, long_text),
        (8, base),
        (9, " ".join(near)),
        (10, base.upper()),
        (11, "One two."),
        (12, "one two."),
        (13, f"Before it. {passage} After it."),
        (14, f"Something else stands here. {passage} And more."),
        (15, "éàü ñ ß İ Σς   　 x́ <|endoftext|> <|startoftext|> 日本語 \x1c \x85 end"),
        (16, "word " * 3000),
        (17, "x" * 30_000),
        (18, "..."),
    ]
    return rows


def documents(spark, rows=None):
    rows = awkward_rows() if rows is None else rows
    names = ["doc_id", "text", *CLASHING]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHING]
    filled = [(i, t, *(f"{c}{i}" for c in CLASHING)) for i, t in rows]
    return spark.createDataFrame(filled, T.StructType(fields)).select(*names)
