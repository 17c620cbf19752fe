"""A small table with awkward rows, and its empty twin."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, row string, mark string, slot string"


def texts(seed=0, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "üb", "日本", "Don't", "x,y", "#$%"]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = "\n".join(sentence(12) for _ in range(6))
    out = []
    for i in range(n):
        lines = [sentence(r.randint(0, 14)) for _ in range(r.randint(1, 9))]
        if i % 5 == 0:
            lines.insert(r.randint(0, len(lines)), shared)
        out.append("\n".join(lines))
    return [*out, None, "", "   \n\t", "one", "a b", *out[:4], out[5] + " tail", "long " * 30000, "x" * 100000, "\n\n\n", "dup\ndup\n" * 60]


def rows(seed=0):
    made = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None, "é"][i % 5], None if t is None else len(t), "a", "b", "c", "d", "e") for i, t in enumerate(texts(seed))]
    return [*made, made[3], made[3], (None, "no id here", "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def documents(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
