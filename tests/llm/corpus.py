"""Small awkward tables for the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, level string, name string"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delté", "ß", "x", "日本", "end.", "the", "of"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, long = text(150), text(6000)
    out = [(i, text(rnd.randint(1, 120)), rnd.choice(["en", "de", None]), f"s{i % 12}") for i in range(n)]
    out += [(1000 + i, f"{text(30)} {passage} {text(20)}", "en", "s1") for i in range(5)]
    out += [(2000, "", "en", "s1"), (2001, None, "en", None), (2002, None, None, None), (2003, " \n\t ", "fr", "s2"), (2004, "a", "fr", "s2"), (2005, "!!! 123", "fr", "s2")]
    out += [(3000, long, "en", "s3"), (3001, long, "en", "s3"), (3002, long[:20000] + "Z" + long[20001:], "en", "s3"), (3003, "ab" * 700, "en", "s4"), (3004, "a" * 1000, "en", "s4")]
    out += [out[3], out[3], (None, text(20), "en", "s5"), (None, out[3][1], "en", "s5")]
    return [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in out]


def documents(spark, **more):
    return spark.createDataFrame(rows(**more), SCHEMA)


def table(spark, path, **more):
    """The same as a table on disk, in several files."""
    documents(spark, **more).repartition(3, "doc_id").write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
