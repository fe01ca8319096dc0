"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tree river house stone light water green small large walk speak think north south early late hand glass paper winter summer garden window letter number garden's café naïve über straße".split()


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "!"]) for _ in range(rng.randrange(1, 120))))
    return out


def balanced(seed=9):
    """Pairs of words made of the same stretches of 64 bytes, each stretch as often and, over all places, as late."""
    rng = random.Random(seed)
    out = []
    for orders in (("xyyx", "yxxy"), ("xyyxyxxy", "yxxyxyyx"), ("xxyy", "yyxx"), ("xy", "yx")):
        x, y = ("".join(rng.choice("abcdefghij0123456789") for _ in range(64)) for _ in "xy")
        out.append(tuple("".join({"x": x, "y": y}[k] for k in o) for o in orders))
    return out


def rows(seed=1, n=40):
    """Documents, some of them null, empty, copied, nearly copied, or very long."""
    base = texts(seed, n)
    rng = random.Random(seed)
    out = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), len(t)) for k, t in enumerate(base)]
    k = len(out)
    long = " ".join(base) * 12
    for t in (None, "", " \n\t ", "one", "one two", base[0], base[0], base[1] + " more", base[2] + "\n\n" + base[2], "x" * 5000, long, long + " end", "line a b\nline a b\nline a b", "  lead and trail  ", "　wide space", "漢字 かな 😀", "<|endoftext|> in a text"):
        out.append((k, t, "en", "c", None if t is None else len(t)))
        k += 1
    for a, b in balanced():
        for t in (f"{a} one two three", f"{b} one two three", f"{a}\n{b}\n{a} and ten more words that follow on a line"):
            out.append((k, t, "en", "d", len(t)))
            k += 1
    out.append(out[3])
    out.append((None, "no id at all, but a text with words", "en", "a", 1))
    out.append((None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def with_clashes(df, *names):
    """More columns, of the names that operators use for results."""
    from pyspark.sql import functions as F

    for x in names:
        df = df.withColumn(x, F.lit("clash"))
    return df
