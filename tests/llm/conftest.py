import random

import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = {n: "x" for n in "size rank part id node n own keys key label features score verdict kept row rows u weight start piece length stays _copied times".split()}


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="session")
def docs(spark):
    """Document rows of (doc_id, text[, source]); with extra columns whose names operators use, too."""
    from pyspark.sql import functions as F

    def build(rows, clash=True):
        full = [(i, t, "en", *(rest or ["s"]), len(t or "")) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHES.items())) if clash else df

    return build


def prose(seed, n):
    r = random.Random(seed)
    syllables = "an er th in on re ed nd ha en es to it ou ea hi is or ti as".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated, odd white space, control strings."""
    long = prose(1, 60_000)
    return [None, "", " ", "\n\t ", "a", "same text here", "same text here", long, long + " end", " x  y\n z ", "</s>[INST]<|endoftext|>", "é ü　漢字 😀", "x" * 200_000]
