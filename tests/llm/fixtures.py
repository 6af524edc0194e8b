"""Small tables with the cases that every operator has a defined result for."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SHORT = [None, "", "   \n", "one", "A b\tC d", "Ünïcödé ﬀ 中文 😀", "x" * 300]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def rows() -> list[tuple]:
    """Nulls in every column, short and long texts, ties, repeated rows, exact and near copies."""
    base = prose(1, 120)
    texts = [*SHORT, base, base, base.replace(" ", "  "), base.upper(), *(edited(base, s, 2) for s in range(5)), *(edited(base, s, 9) for s in range(5)), prose(2, 60), prose(3, 6000), prose(3, 6000) + " end"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[7], (None, base, None, None, None), (None, None, None, None, None), (5, "another text of the same id here", "en", "s", 3)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """The table with columns named as the operators name their own."""
    names = ["id", "node", "key", "name", "kept", "uid", "k", "e", "root", "a", "b", "n", "sig", "ids", "length", "piece", "rules", "text_sha256", "lang_pred", "part", "own"]
    for name in names:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df
