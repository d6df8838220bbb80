"""Small tables with every awkward case, and union-find for the brute-force versions."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; as extra columns they must do no harm.
CLASHES = ("id", "h", "h2", "key", "at", "n", "k", "fp", "row", "norm", "sha", "node", "band", "label", "part", "queue", "ids", "cell", "start", "tie", "size", "shard")
EDGE = [None, "", " \n\t", "a", "ab cd", "Zoë saß 漢字 🙂 in İstanbul", "word " * 3, "x" * 5000, "one two three four five " * 400]


def frame(spark, texts, ids=None, sources=None, langs=None, clashes=True):
    """Documents with given texts, and columns whose names clash with those inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})
    return df


def components(n: int, linked) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
