import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, part int, y int, stats string, chunk long, owner int, topic string, features string, component_id string, h string"


def rows():
    """Documents with nulls everywhere, empty and long texts, ties, copies, repeated ids and odd characters."""
    draw = random.Random(3)
    words = "the of and to river stone light winter garden copper window silver maple harbor idiot scum worthless quiet lantern meadow Über naïve 日本 😀".split()
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 80))) for _ in range(60)]
    texts[10] = texts[11] = texts[12]
    texts[13] = texts[12] + " end"
    texts += [None, "", " \n\t ", "word", "x" * 50_000, "lorem ipsum " * 20_000, "cc by", "CC-BY. All rights reserved; the gnu general publik license", "\x00\x01", "  two  spaces ", "▁ mark"]
    found = [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    found += [(None, "no id at all here", "en", "a", 1), (None, None, None, None, None), (5, texts[5], "en", "a", 1), (7, "another text of the same id", "en", "a", None), (2**60, "far away", "en", "b", 8), (-4, "before all", "en", "b", 10)]
    return [(*r, 0.5, 1, 1, 1, "s", 1, 1, "t", "f", "c", "h") for r in found]


def label_rows():
    return [(r[0], 0 if r[1] and len(r[1]) < 60 else 1, int(bool(r[1]) and "idiot" in r[1])) for r in rows()[:60]] + [(3, None, 1), (3, 1, None), (None, 1, 1), (10**9, 1, 0)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory, docs):
    """A folder of tables as the queries read them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(*r, "label text", 1, 7, "en", 0.5, "f") for r in label_rows()]  # names that clash with those of documents and operators
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string, y int, n_chars long, lang string, score double, features string").write.parquet(f"{folder}/labels.parquet")
    draw = random.Random(5)
    base = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [(i, v, 0) for i, v in enumerate(base)] + [(100 + i, [x + draw.gauss(0, 0.02) for x in v], 1) for i, v in enumerate(base[:15])] + [(200 + i, v, 2) for i, v in enumerate(base[:5])]
    vectors += [(300, [2 * x for x in base[0]], 1), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [1.0, 2.0], 1), (None, base[0], 1), (308, [float("inf")] * 16, 1), (309, [1e-30 * x for x in base[1]], 1)]
    vectors = [(*r, 3, 5, "x", 2, 9, "h", 1) for r in vectors]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, rep long, copies long, v string, a long, b long, h string, component_id long").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, sf_dir):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
