import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(c, T.StringType()) for c in ("block", "carried", "node", "size", "_part", "gone_id", "slot")],
    ]
)


def make_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(150)
    rows = [(i, prose(rng.randint(1, 120))) for i in range(1, 25)]
    rows += [(30 + i, base) for i in range(4)]
    for i in range(6):  # near copies
        w = base.split()
        w[10 + 3 * i] = word()
        rows.append((40 + i, " ".join(w)))
    rows += [(50 + i, f"{prose(20)} {passage} {prose(15)}") for i in range(5)]
    rows += [(60, None), (61, ""), (62, "   \n\t"), (63, "a"), (64, "Äpfel und Öl — ß 漢字 🙂 " * 30), (65, "x" * 3000), (66, "ab " * 2000), (67, prose(4)), (68, "\x00 nul \x00"), (69, "<|endoftext|> it's 'll 12 345   end  \n\n")]
    rows += [(70, prose(6000)), (1, rows[0][1]), (1, rows[0][1]), (2, prose(50)), (None, base), (None, None), (None, prose(40))]
    return rows


def frame(spark, rows):
    langs = ["en", "de", None]
    return spark.createDataFrame([(i, t, langs[k % 3], f"src{k % 2}", len(t) if t is not None else None, *["clash"] * 7) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
