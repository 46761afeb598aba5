import random

import pytest

WORDS = ["the", "of", "and", "to"] + [a + b + c for a in ("ba", "ko", "ri", "tu", "me") for b in ("lan", "sor", "pi", "dek") for c in ("", "s", "ing", "ed")]
BAD = ["scumbag", "moronic", "pathetic", "worthless"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS[:4] if rng.random() < 0.2 else WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(rows of documents, labels): prose, junk, toxic texts, exact and near copies, odd rows."""
    rng = random.Random(5)
    docs, labels = [], []

    def add(text, quality=1, toxic=0, source=None):
        i = len(docs)
        docs.append((i, text, "en", source or f"s{rng.randrange(4)}", len(text or "")))
        labels.append((i, quality, toxic))
        return i

    for _ in range(260):
        kind = rng.random()
        text = prose(rng, rng.randrange(20, 120))
        if kind < 0.12:
            add(" ".join([rng.choice(WORDS).upper() + "!!" for _ in range(40)]), 0)
        elif kind < 0.22:
            add(" ".join([rng.choice(WORDS)] * 50), 0)
        elif kind < 0.36:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(BAD))
            add(" ".join(parts), 1, 1)
        else:
            add(text)
    base = [d[1] for d, l in zip(docs, labels) if d[4] > 300 and l[1:] == (1, 0)][:12]
    for text in base:
        add(text)
        words = text.split()
        words[len(words) // 2] = "changed"
        add(" ".join(words))
        add(" ".join(words[3:]))
    hub = prose(rng, 100).split()
    for i in range(40):
        own = list(hub)
        own[rng.randrange(100)] = f"w{i}"
        add(" ".join(own), source="s0")
    passage = prose(rng, 60)
    for _ in range(30):
        add(prose(rng, 50) + " " + passage + " " + prose(rng, 50))
    for odd in ("", None, " \n\t ", "one", "one two three four", "One two three FOUR", "é x y", "x" * 5000, "word " * 3000):
        add(odd)
    return docs, labels


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus[0], DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def label_table(spark, corpus):
    return spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int").cache()


@pytest.fixture(scope="session")
def sf_dir(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus[0], DOC_SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)
