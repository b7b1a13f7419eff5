"""Statistics of whole texts, as numbers in numpy rows.

Words are runs of anything but ASCII white space; lines are separated by newlines.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.checkpoints import materialize
from logloom.llm import texts
from logloom.workers import ship_package

#: Exact counts of a text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model inputs; all are bounded or logarithmic.
FEATURES = [
    "log_words",
    "word_length",
    "symbols_per_word",
    "upper_share",
    "exclaims_per_word",
    "digit_share",
    "dup_line_share",
    "repeat_share",
    "diversity",
    "stutter_share",
    "bars_per_word",
    "stops_per_word",
    "commas_per_word",
    "lines_per_word",
    "top_word_share",
    "other_script_share",
    "longest_word",
]
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"


def _without(data: bytes, chars: bytes) -> int:
    """How many bytes are in ``chars``."""
    return len(data) - len(data.translate(None, chars))


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words covered by windows of three words that occur at least twice."""
    if len(ids) < 4:
        return 0
    if kinds < 2_000_000:
        keys = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
        keys = pairs[:-1] * kinds + ids[2:]
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = (counts >= 2)[which]
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    letters_space = _without(data, _SPACE)
    chars = len(text) - letters_space
    symbols = _without(data, _SYMBOLS)
    seen_lines, dup_lines, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen_lines:
                dup_lines += 1
            seen_lines.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    repeats = repeated_words(ids, len(numbers))
    counts = [n, chars, symbols, dup_lines, repeats]
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    per = max(n, 1)
    features = [
        np.log1p(n) / 10,
        min(chars / per, 30) / 10,
        min(symbols / per, 4.0),
        upper / max(upper + lower, 1),
        min(data.count(b"!") / per, 4.0),
        _without(data, _DIGITS) / max(chars, 1),
        dup_lines / max(lines, 1),
        repeats / per,
        np.log1p(len(numbers)) / max(np.log1p(n), 1),
        int(np.count_nonzero(ids[1:] == ids[:-1])) / per,
        min(data.count(b"|") / per, 2.0),
        min(data.count(b".") / per, 2.0),
        min(data.count(b",") / per, 2.0),
        min(lines / per, 1.0),
        (int(np.bincount(ids).max()) if n else 0) / per,
        1 - len(data.decode("ascii", "ignore")) / max(len(text), 1),
        np.log1p(max(map(len, words), default=0)) / 5,
    ]
    return counts, features


def measure_all(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [measure(t) for t in rows]
    counts = np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([b[1] for b in both], np.float64).reshape(-1, len(FEATURES))


def text_series(batches: Iterator[pd.Series]) -> Iterator[list[str]]:
    for series in batches:
        yield [t if isinstance(t, str) else "" for t in series]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``features, label`` of at most ``max_labelled`` documents to learn from; written once.

    Labels are the rows of ``labels`` whose crc32(id as text) mod 3 is not 1 and whose label is not null; several of one id count as the
    lowest. The ids with the smallest hashes are taken, so the choice depends on neither order nor partitions. The label
    table's sample is broadcast, at most ``max_labelled`` rows; a repeated document counts once.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & (texts.thirds(F.col(id_column)) != 1))
    chosen = (
        known.groupBy(F.col(id_column).alias("id"))
        .agg(F.min(F.col(label).cast("double")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )

    def features(batches):
        for batch in texts.slices(batches, "text"):
            _, x = measure_all(texts.texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "features"]
            )

    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    measured = found.select("id", "label", "text").mapInArrow(features, "id long, label double, features array<double>")
    one_each = measured.groupBy("id").agg(F.min(F.struct("features", "label")).alias("row"))
    return materialize(one_each.select("row.*"), "labelled-sample")


def scored(column: Column, score: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A column of scores of whole texts; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in text_series(batches):
            yield pd.Series(score(measure_all(rows)[1]), dtype="float64")

    return run(column)
