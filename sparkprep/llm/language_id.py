"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import fresh, saved

# N-grams in a profile, of a language as of a document.
PROFILE = 300
# More values than there are language codes: such a column holds something else.
MAX_LANGUAGES = 10_000
UNDETERMINED = "und"
# Distinct n-grams that a learning task gathers before it adds them up.
PENDING = 1 << 20

_SPACE = 32
_BITS = 21


def letters(text: str) -> np.ndarray:
    """Code points of the words: lower-cased letters, one space around each word."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.unique(points)
    letter = kinds[[chr(k).isalpha() for k in kinds.tolist()]]
    if not len(letter):
        return np.zeros(0, np.int64)
    is_letter = np.isin(points, letter)
    points = np.where(is_letter, points, _SPACE).astype(np.int64)
    first = is_letter | np.concatenate(([False], is_letter[:-1]))
    points = points[first]
    points = np.concatenate(([_SPACE], points, [_SPACE]))
    # A text that starts with no letter or ends with none has its space already.
    doubled = (points[1:] == _SPACE) & (points[:-1] == _SPACE)
    return points[np.concatenate(([True], ~doubled))]


def grams(points: np.ndarray) -> np.ndarray:
    """Every n-gram of one to three letters of a word, its edges included, as a number."""
    space = points == _SPACE
    single = points[~space]
    pairs = (points[:-1] << _BITS) | points[1:]
    triples = (pairs[:-1] << _BITS) | points[2:]
    return np.concatenate((single, pairs, triples[~space[1:-1]]))


def gram_text(code: int) -> str:
    """The n-gram a number stands for."""
    parts = [code >> (_BITS * i) & ((1 << _BITS) - 1) for i in (2, 1, 0)]
    return "".join(chr(p) for p in parts if p)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, smaller ones first on a tie."""
    return codes[np.argsort(-counts, kind="stable")][:most]


def profiles(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    size: int = PROFILE,
) -> DataFrame:
    """(lang, code, rank): the most frequent n-grams of each language, from all rows.

    Null languages and texts teach nothing. Tasks add up their counts first, so
    what is shuffled grows with the n-grams that there are and not with the text,
    whatever share of the rows one language has.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                waiting, held = [], 0
                for text in rows["text"]:
                    waiting.append(grams(letters(text)))
                    held += len(waiting[-1])
                    if held > PENDING:
                        sums[lang] = _added(sums.get(lang), waiting)
                        waiting, held = [], 0
                sums[lang] = _added(sums.get(lang), waiting)
                if len(sums[lang][0]) > PENDING:
                    yield _counted(lang, sums.pop(lang))
        for lang, both in sums.items():
            yield _counted(lang, both)

    rows = docs.select(
        qcol(lang_column).cast("string").alias("lang"),
        qcol(text_column).cast("string").alias("text"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInPandas(count, "lang string, code bigint, n bigint")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        totals.withColumn("rank", F.row_number().over(order) - 1)
        .where(F.col("rank") < size)
        .select("lang", "code", "rank")
    )


def _added(before, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.unique(
        np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True
    )
    if before is None:
        return codes, counts
    both = np.concatenate((before[0], codes))
    values, where = np.unique(both, return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, where, np.concatenate((before[1], counts)))
    return values, sums


def _counted(lang: str, both: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "code": both[0], "n": both[1]})


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows}, key=lambda lang: lang.encode())
        self.codes = np.unique(np.array([code for _, code, _ in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), size, np.int32)
        place = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[place[lang], np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and one less the share of the greatest distance."""
        points = letters(text or "")
        if not len(points) or not self.langs:
            return UNDETERMINED, 0.0
        codes, counts = np.unique(grams(points), return_counts=True)
        codes = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == codes
        theirs = self.ranks[:, at[known]]
        # Out of place: how far the ranks are apart, or the most if the
        # language's profile has no such n-gram.
        apart = np.abs(theirs - np.flatnonzero(known))
        apart = np.where(theirs == self.size, self.size, apart)
        distance = apart.sum(axis=1) + self.size * int((~known).sum())
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(codes)))


def language_of(
    docs: DataFrame,
    learn: Column,
    text_column: str = "text",
    lang_column: str = "lang",
    size: int = PROFILE,
) -> Column:
    """A struct (lang_pred, score) for each row, by profiles of the rows to learn from.

    Profiles hold the ``size`` most frequent n-grams of one to three letters of
    the rows for which ``learn`` holds, from their whole texts. A document gets
    the language whose profile is nearest by out-of-place distance to that of
    its own whole text; the first by code point on a tie. ``score`` is 1 for an
    equal profile and 0 for one without a common n-gram. A text that is null or
    has no letter is 'und' with score 0, and so is all if nothing was learned.

    Learning runs at once; the profiles go to every task, ``size`` numbers per
    language.
    """
    learn = F.coalesce(learn, F.lit(False))
    known = saved(profiles(docs.where(learn), text_column, lang_column, size), "profiles")
    if known.agg(F.countDistinct("lang")).first()[0] > MAX_LANGUAGES:
        raise ValueError(f"{lang_column} has more than {MAX_LANGUAGES} values")
    rows = [tuple(r) for r in known.select("lang", "code", "rank").toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))

    @F.pandas_udf("lang_pred string, score double")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            found = [shared.value.predict(t) for t in part]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return nearest(qcol(text_column).cast("string"))


def identify(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    size: int = PROFILE,
) -> DataFrame:
    """(doc_id, learned, lang_pred, score) for every document; see ``language_of``.

    Ids may be null or repeat; empty tables give no rows.
    """
    judged = docs.select(
        qcol(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(learn, F.lit(False)).alias("learned"),
        language_of(docs, learn, text_column, lang_column, size).alias("found"),
    )
    return judged.select("doc_id", "learned", "found.lang_pred", "found.score")


def determined(
    docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """The rows, all columns kept, whose text has a language."""
    (found,) = fresh(docs, "found")
    marked = docs.withColumn(found, language_of(docs, learn, text_column, lang_column))
    return marked.where(F.col(found)["lang_pred"] != UNDETERMINED).drop(found)
