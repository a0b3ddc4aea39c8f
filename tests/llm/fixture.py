"""A small corpus with every awkward case, and the operators' inputs made of it."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("th", "fp", "key", "ctx", "lo", "n", "done", "open", "hit", "low", "component", "todo", "ranges", "sequence_id", "score", "keep_text", "_doc_id", "label", "cid")


def words(rng, n):
    return [rng.choice(["lor", "em", "ips", "um", "do", "lo", "rs", "it", "ä", "né"]) + rng.choice(["a", "e", "tur", "que", "ß", "x9"]) * rng.randrange(1, 3) for _ in range(n)]


def rows(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(words(rng, n))
    shared, long = text(90), text(9000)
    a, b = text(300), text(120)
    near = a.split(" ")
    near[150] = "changed"
    out = [
        (1, None), (2, ""), (3, " \n\t \r"), (4, a), (5, a), (6, " ".join(near)), (7, b), (7, b), (7, text(60)),
        (8, text(40) + "\n" + shared + "\n" + text(30)), (9, shared + " " + text(45)), (10, text(10) + "\x0b" + shared), (11, long), (12, long[1000:30000]),
        (13, "ab" * 700), (14, "ab" * 700 + "c"), (15, "  a  b\n\n'll it's 'S don''t 日本語 한국  x\x1cy 1२3 ..."), (16, "mail x.y+z@ab-c.de.fr, 10.0.0.255 and 1.2.3.456 +1 (017) 555-7713; 4539 1488 0343 6467"),
        (17, "@a.b c@d e@@f.g h@i.j@k.l token = \"abc123def456\" https://ex.org/p?q=1."), (18, "x\n" * 50 + "one two three\n" * 30), (None, text(80)), (None, None), (-3, b),
    ]
    return [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in out]


def documents(spark, clash=False):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def values(df, *columns):
    """Rows as a sorted list, whatever their order."""
    return sorted(map(repr, map(tuple, df.select(*columns).collect() if columns else df.collect())))
