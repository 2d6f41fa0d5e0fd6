"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows,
empty tables, and extra columns whose names the operators use themselves."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ran sel tim vor wux".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        line = [rng.choice(WORDS) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randrange(5, 12))]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
    return " ".join(out[:n])


def documents(spark, extra: bool = True):
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        base, base, near, prose(2, 90), prose(3, 400), None, None, "", " \t\n ", "one", "two words", "A b c", prose(4, 30000), ("same line here\n" * 40), "### $$$ && %% " * 30,
        "<|endoftext|> in text", "tab\x0bvt\x0cff\x1cfs nbsp em", "naïve café ÉCOLE Straße ẞ İi ﬁ é", "x" * 5000, base.upper(), "日本語のテキスト です", "a\u0000b",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None), (None, "no id", None, "s0", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "size", "shard", "rid", "n_words", "cluster", "label", "sig", "component", "_w", "k1", "tie"):
            df = df.withColumn(name, F.lit("mine"))
    return df


def labels(spark):
    rows = [(i, int(i not in (13, 14, 19)), int(i in (3, 4))) for i in range(22)] + [(2, 1, 0), (None, 1, 1), (500, None, None), (4, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)
