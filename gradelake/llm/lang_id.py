"""Language identification by rank-order profiles of letter n-grams and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
_AT_ONCE = 200_000
_BITS = 21  # of a code point; three fit one integer
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def ngram_codes(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of the lower-cased words; words are padded by one blank.

    Code points are packed into one integer; a word is a run of letters.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_is_letter(points), points, 32).astype(np.int64)
    points = np.concatenate([[32], points, [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    if len(points) < 3:
        return np.empty(0, np.int64)
    one = points[points != 32]
    two = points[:-1] << _BITS | points[1:]
    three = (points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])[points[1:-1] != 32]
    return np.concatenate([one, two, three])


def _ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > 4 * size:  # ties at the cut stay in
        cut = np.partition(counts, -size)[-size]
        found, counts = found[counts >= cut], counts[counts >= cut]
    return found[np.lexsort((found, -counts))[:size]]


def language_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """(lang, rank, code): the ``size`` most frequent n-grams of each non-null language, over all rows.

    Tasks count their own rows and pass on distinct n-grams only (pre-aggregated), so a
    language that holds most rows does not meet in one task as texts. Rows without a text or
    language teach nothing, repeated rows count each, and an empty table gives no profiles.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                share = np.cumsum(texts.map(len)) // _AT_ONCE  # so much text is sorted at a time
                for _, some in texts.groupby(share):
                    codes, counts = np.unique(np.concatenate([ngram_codes(t) for t in some]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    totals = rows.mapInPandas(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "rank", "code")


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1 for the profile's own order, 0 for nothing in common) to each row.

    The distance of a text to a language is the mean over the text's ``size`` most frequent
    n-grams of how far each is out of its place in the profile, an absent one counting
    ``size`` places; the score is 1 less that over ``size``. Ties go to the first language by
    name. A null text or one without a letter is ``und`` with score 0, and so is every text if
    no language was learned. Texts of any length are read whole; among n-grams of a text that are
    equally frequent, the smaller code goes first. Repeated rows repeat their result and an empty
    table gives none. Other columns pass through; columns named as a result are replaced.

    The profiles are ``size`` rows a language, however long its texts are, and go to the tasks
    with the function; texts are not shuffled.
    """
    learned: dict[str, list[int]] = {}
    for r in profiles.orderBy("lang", "rank").toLocalIterator():
        learned.setdefault(r["lang"], []).append(r["code"])
    names = sorted(learned)
    tables = []
    for name in names:
        codes = np.array(learned[name], np.int64)
        order = np.argsort(codes)
        tables.append((codes[order], order))

    def one(text: str | None) -> tuple[str, float]:
        if text is None or not names:
            return UNKNOWN, 0.0
        codes = ngram_codes(text)
        if not len(codes):
            return UNKNOWN, 0.0
        mine = _ranked(codes, size)
        places, scores = np.arange(len(mine)), []
        for codes, ranks in tables:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            away = np.where(codes[at] == mine, np.minimum(np.abs(ranks[at] - places), size), size)
            scores.append(1 - float(away.mean()) / size)
        best = int(np.argmax(scores))
        return names[best], min(1.0, max(0.0, scores[best]))

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    # Marked so that the plan runs it once a row, also where a filter asks for the language.
    out = docs.withColumn("_judged", judged.asNondeterministic()(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")
