"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, root string, digest string, found string"


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré", "ing", "ou", "é", "ß", "stion"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.choice([3, 4, 5, 40, 90, 200]))) for _ in range(n // 3)]
    out: list[str | None] = list(base)
    for t in base[: n // 3]:
        w = t.split(" ")
        for _ in range(2):
            v = list(w)
            for _ in range(max(1, len(v) // 100)):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    passage = " ".join(word() for _ in range(30))
    out += [f"{base[3]} {passage} {base[4]}", f"{passage}", f"x {passage.upper()}", f"{passage}. {passage}"]
    out += [None, "", " ", "...", "a", "A", "a b", "12345", "ab " * 4000, "z" * 300, "\x00\n\t", base[0], base[0].upper(), "日本語 テキスト", "😀" * 50]
    return out


def documents(spark, seed: int = 7):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "fr", None]), None, None, "n", "k", "r", "d", "f") for i, t in enumerate(texts(seed))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
