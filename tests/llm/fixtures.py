"""Small inputs with every awkward case: nulls, empties, long texts, ties, repeats, clashing columns."""

import numpy as np

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dawn "
TEXTS = {
    0: BASE * 3,
    1: BASE * 3,
    2: BASE * 3 + "and one more word",
    3: "",
    4: None,
    5: "short",
    6: "short",
    7: "Größe und Maß, çela été où — naïve 漢字 テスト 😀 don't we'll  two  spaces\t\ttabs\n\n",
    8: "x" * 5000,
    9: "prefix " + BASE + " suffix " + BASE,
    10: " ".join(f"word{i}" for i in range(3000)),
    11: " ".join(f"word{i}" for i in range(3000)) + " tail",
    12: "<|endoftext|> in a text <|endoftext|>",
    13: "12 34 !?",
    14: "\x00\x1f\x85\xa0 odd  spaces \x1c\u2003and more\u3000",
}


def documents(spark, more=()):
    """Documents with a null id, a repeated id, and columns whose names the operators use inside."""
    rows = [(i, t, "de" if i == 7 else "en", "s", 7, 1, "g") for i, t in TEXTS.items()]
    rows += [(None, BASE * 2, "en", None, None, None, None), (5, "short", None, "s", 0, 0, "x"), *more]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, group string").repartition(3)


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


def vectors(spark, n=300, dim=16, labels=3, seed=1):
    """Random directions in few clusters with near copies, exact copies and unusable vectors."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[n // 2 :] = v[: n - n // 2] + r.normal(size=(n - n // 2, dim)) * np.repeat([0.02, 0.05, 0.3], -(-(n - n // 2) // 3))[: n - n // 2, None]
    rows = [(i, [float(np.float32(x)) for x in v[i]], int(i % (n // 2)) % labels) for i in range(n)]
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * dim, 0), (n + 4, [float("nan")] * dim, 0)]
    rows += [(n + 5, [None, *rows[1][1][1:]], 0), (n + 6, rows[0][1], None), (n + 7, rows[0][1][:5], 0), (n + 8, [], 0), (None, rows[0][1], 0), (50, rows[3][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", __import__("pyspark.sql.functions").sql.functions.lit(1))
