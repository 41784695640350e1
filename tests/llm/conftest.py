"""Small tables with every odd case: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SYLLABLES = {
    "en": "th er in on re ti nd ing ed ou the an at es or ha".split(),
    "de": "sch ung ein ver ich eit zu ge be keit er en st ü ä".split(),
    "fr": "eau é è ai eux tion men le que oi an en ou aux".split(),
}
ROWS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, kept string, id int, size string"


def prose(rng, lang="en", words=60):
    made = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in made)


def odd_rows():
    """Rows (doc_id, text, lang, source) with the cases that every operator has to survive."""
    rng = random.Random(7)
    texts = [prose(rng, lang) for lang in ("en", "de", "fr") for _ in range(12)]
    rows = [(i, t, ("en", "de", "fr")[i // 12], f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [
        (100, None, "en", "src0"),
        (101, "", None, None),
        (102, " \t\n", "de", "src1"),
        (None, texts[0], "en", "src0"),
        (103, texts[0], "en", "src9"),
        (104, texts[0] + "!", "en", "src9"),
        (105, texts[0].upper(), "en", "src9"),
        (106, texts[1], "en", None),
        (106, texts[1], "en", None),
        (106, texts[2], "fr", None),
        (107, " ".join(prose(rng, "en", 4000).split()), "en", "src0"),
        (108, "x" * 40_000, "en", "src0"),
        (109, "12345 67890 !!! ???", None, "src2"),
        (110, "Ünïcödé 漢字 текст \U0001f600 a b", "de", "src2"),
        (111, "one", "en", "src3"),
        (112, "one two", "en", "src3"),
        (113, "", "en", "src3"),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


def written(spark, rows, path):
    full = [(*r, len(r[1] or ""), "clash", "clash", 1, "clash") for r in rows]
    spark.createDataFrame(full, ROWS).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    return written(spark, rows, tmp_path_factory.mktemp("docs") / "documents.parquet")


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    return written(spark, [], tmp_path_factory.mktemp("none") / "documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, i % 2, (i // 2) % 2) for i in range(36)] + [(None, 0, 1), (100, None, None), (999, 1, 0), (3, 1, 1)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.where("false")
