import math
import random

import pytest

WORDS = "the of and to in river stone light green paper window garden summer letter bridge silver mountain corner market village".split()
BAD = "idiot scum moron trash".split()
FR = "le la de et un une dans pour avec sur école été fenêtre jardin pierre lumière".split()


def text(rng, n, bank=WORDS):
    return " ".join(rng.choice(bank) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars) with edge cases of all kinds."""
    rng = random.Random(11)
    passage = "a quite particular sentence about seven wandering herons crossing the old harbour at dawn"
    line = "Licensed under the Example License, version 9."
    rows = []
    for i in range(120):
        t = text(rng, rng.choice([3, 30, 80, 200]))
        if i % 9 == 0:
            t += "\n" + (" " * (i % 3)) + (line.upper() if i % 2 else line) + "\t"
        if i % 17 == 0:
            t += " " + passage
        if i % 10 == 3:
            t = text(rng, 60, FR)
        if i % 7 == 1:
            t = t + " " + rng.choice(BAD) + " " + text(rng, 5) + " " + rng.choice(BAD)
        rows.append([i, t, "fr" if i % 10 == 3 else "en", "s", 0])
    base = text(rng, 100)
    for k in range(6):  # near copies
        w = base.split()
        w[k * 7] = "changed"
        rows.append([200 + k, " ".join(w), "en", "s", 0])
    rows += [[210, base, "en", "s", 0], [211, base, "en", "s", 0], [211, base, "en", "s", 0], [212, base.upper(), "en", "s", 0]]  # exact copies and a repeated row
    rows += [[220, None, "en", "s", 0], [221, "", "en", "s", 0], [222, " \n\t ", None, "s", 0], [223, "lone", "en", None, None], [224, "12 34 ;;", "en", "s", 0], [225, "日本語 \U0001f600 text's 'll", "en", "s", 0]]
    rows += [[None, base, "en", "s", 0], [None, "without an id", "en", "s", 0], [230, "x" * 30_000 + " " + text(rng, 8000), "en", "s", 0], [231, (line + "\n") * 50, "en", "s", 0]]
    return [tuple(r[:4] + [len(r[1]) if r[1] is not None else None]) for r in rows]


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    """A folder of small tables with nulls, empties, ties, repeated rows and extra columns."""
    folder = str(tmp_path_factory.mktemp("tiny"))
    docs = documents()
    extra = ["'x' AS component_id", "1 AS score", "2 AS ids", "3 AS cls", "4 AS n_words"]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra).write.parquet(f"{folder}/documents.parquet")
    items = [(0, "Seven wandering herons crossing the OLD harbour, at dawn"), (0, "Seven wandering herons crossing the OLD harbour, at dawn"), (1, None), (2, " ;; "), (3, "lone"), (None, "of the and to in"), (10, "a quite particular sentence about seven wandering herons crossing the old harbour")]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d[0], int(d[1] is not None and any(b in d[1] for b in BAD)), 1) for d in docs if d[0] is not None and d[0] < 200] + [(None, 1, 1), (220, None, 0), (221, 0, 0), (0, 7, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    turns = [(1, 0, "user", "hi <|im_end|> and <\\| or <\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (2, 0, "system", None), (2, 1, None, "x"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, None, "assistant", ""), (None, 4, "user\nx", "lost"), (4, 2, "assistant", "日本 \U0001f600")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "5 AS piece").write.parquet(f"{folder}/conversations.parquet")
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    vectors += [(1000 + i, [1.0] * 8) for i in range(45)] + [(20, vectors[20][1]), (2000, None), (2020, [0.0] * 8), (2040, [1.0, None] * 4), (2060, [float("nan")] * 8), (2080, [math.inf] * 8), (None, [1.0] * 8), (2100, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "9 AS score").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tiny, tmp_path_factory):
    """The same tables without a row."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{tiny}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder
