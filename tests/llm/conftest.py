import random

import pytest
from pyspark.sql import functions as F


def odd_rows(texts):
    """(doc_id, text, source) rows that cover nulls, empties, repeats, ties and a very long text."""
    rng = random.Random(5)
    long = " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()) + str(rng.randrange(300)) for _ in range(30_000))
    base = texts[0]
    words = base.split(" ")
    return [
        (900_001, None, "src0"), (900_002, "", "src0"), (900_003, " \n\t ", None), (None, texts[1], "src1"), (None, None, None),
        (900_004, base, "src2"), (900_004, base, "src2"), (900_005, base, None), (900_004, texts[2], "src9"),
        (900_006, " ".join(words[:40]) + " other words here " + " ".join(words[10:60]), "src0"), (900_007, long, "src0"), (900_008, long + " end", "src1"),
        (900_009, "one two", "src1"), (900_010, "One two", "src1"), (900_011, "été naïve Kſ İstanbul \U0001f600 a<|endoftext|>b don't IT'S x́y 12a \x1c\x85z", "src1"),
    ]


@pytest.fixture(scope="session")
def small(spark, folder):
    """The smallest documents table with the odd rows and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    texts = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    odd = spark.createDataFrame(odd_rows(texts), "doc_id long, text string, source string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    for name in ("_id", "_batch", "_shard", "_row", "size", "key", "score", "item_id"):
        both = both.withColumn(name, F.lit("x"))
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/docs"
    both.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(small):
    return small.filter("false")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text, r.source) for r in small.collect()]
