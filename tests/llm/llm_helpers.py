"""Fixtures and helpers of the tests in this folder; test modules import the fixtures they use."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
VOCABULARY = {
    "en": "the and of thing onward there their other bright river stone letter under over winter summer".split(),
    "de": "der die das und nicht schön über für Straße Wörter gehen machen heute gestern Winter größer".split(),
    "fr": "le la les été être où déjà garçon maison toujours peut-être voilà hiver élève château rivière".split(),
}


def prose(rng: random.Random, words: int, lang: str = "en") -> str:
    out, vocabulary = [], VOCABULARY[lang]
    for i in range(words):
        out.append(rng.choice(vocabulary) + rng.choice(["", "", "", "ing", "en", str(rng.randint(0, 40))]))
        if i % 12 == 11:
            out[-1] += "." + ("\n" if rng.random() < 0.4 else "")
    return " ".join(out) + "."


def frame(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def rows():
    """Prose in three languages with copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(4)
    out = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, prose(rng, rng.randint(20, 200), lang), lang))
    out += [(100 + i, out[i][1], out[i][2]) for i in range(4)]
    for i in range(6):
        words = out[6][1].split(" ")
        if len(words) > i * 7:
            words[i * 7] = f"changed{i}"
        out.append((120 + i, " ".join(words), "en"))
    passage = prose(rng, 60)
    out += [(140 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30), "en") for i in range(5)]
    out += [(200, None, "en"), (201, "", None), (202, " \t\n", "en"), (203, "one two", "en"), (204, "one two", "en")]
    out += [(205, prose(rng, 4000), "en"), (206, "x" * 40_000, None), (207, "12 34 !!", "de")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


def empty(spark):
    return frame(spark, [])


def clashing(df):
    """Extra columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = "n_words n_tokens score lang_pred kept clean_text kept_text row h part ids a b root rep digest class_id count".split()
    return df.select("*", *[F.lit(1).alias(n) for n in names])


def rows_of(df):
    return [tuple(r) for r in df.collect()]
