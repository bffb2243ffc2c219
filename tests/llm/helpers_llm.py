import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
