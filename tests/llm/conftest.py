import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, shard int, pos int, key string, part int, n_words int"


def rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies, ties, repeated rows and clashing columns."""
    g = random.Random(3)
    vocab = ["".join(g.choice("abcdefghijklmnoprst") for _ in range(g.randint(2, 8))) for _ in range(400)] + ["Über", "naïve", "déjà", "ß", "日本"]
    text = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    lines = lambda n: "\n".join(text(g.randint(3, 14)) for _ in range(n))
    passage = text(40)
    shared = "A line That many documents Share verbatim"
    out = []
    for i in range(60):
        t = lines(g.randint(1, 12))
        if i % 5 == 0:
            t += "\n  " + (shared if i % 2 else shared.lower()) + "\t\n" + text(6)
        if i % 7 == 0:
            t += " " + passage + " " + text(3)
        out.append(t)
    base = lines(12)
    words = base.split(" ")
    for i in range(12):     # near copies, at different distances
        w = list(words)
        for j in range(i % 6):
            w[(j * 17 + i) % len(w)] = f"new{i}x{j}"
        out.append(" ".join(w))
    out += [base] * 5 + [out[0]] * 3 + ["", None, " \t\n ", "one two three", "one  two three", "One two three", "x", "\n\n\n", "ab" * 300, "a" * 450, passage, passage.upper()]
    out += ["### " * 30 + text(20), "in " * 300, lines(900)]
    rows = []
    for i, t in enumerate(out):
        rows.append((100 - i if i % 2 else i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"src{i % 4}" if i % 3 else "host/path/x", None, 1, "k", 2, None, "z", 5, 7))
    rows += [(None, base, "en", "src1", 3, 1, "k", 2, None, "z", 5, 7), (None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[60], rows[60]]
    # one doc_id with other texts: new, a copy of another document's, none
    rows += [rows[5][:1] + (t,) + rows[5][2:] for t in (base + " and more", rows[8][1], None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 100, 2)] + [(1, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables(spark, docs, labels, tmp_path_factory):
    """A folder of the fixture tables, and DuckDB over it."""
    import duckdb

    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return d, c


def same_rows(df, relation):
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    want = sorted(relation.select(*names).fetchall(), key=repr)
    assert got == want
