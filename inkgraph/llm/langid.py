"""Operator 3, language identification by rank-order profiles (out-of-place distance).

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words edged by blanks). A document's
own list is compared to each: every n-gram counts how many places it stands away, absent ones the most."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, check_columns, read

by_value(__name__)
TOP, MAX_PER_LANG = 300, 2_000


def grams(text: str | None):
    """(codes, counts) of all n-grams of the whole text, as numpy arrays; None if it has no letter.

    A code holds up to three code points of 21 bits; runs of non-letters are one blank, and no n-gram is blanks alone or
    spans two words."""
    import numpy as np

    if not text:
        return None
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, back = np.unique(points, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds.tolist()])[back]
    if not letter.any():
        return None
    p = np.concatenate([[32], np.where(letter, points, 32), [32]])
    p = p[np.concatenate([[True], (p[1:] != 32) | (p[:-1] != 32)])]
    is_letter = p != 32
    a, b, c = p[:-2], p[1:-1], p[2:]
    one = p[is_letter]
    two = (p[:-1] << 21 | p[1:]) | (1 << 62)
    middle = is_letter[1:-1]
    three = (a[middle] << 42 | b[middle] << 21 | c[middle])
    # the third code point of a long run may collide with the mark of two-letter grams only above U+100000, no letters
    codes = np.concatenate([one, two, three])
    return np.unique(codes, return_counts=True)


def ranked(codes, counts, top: int = TOP):
    """The most frequent codes, most frequent first; equal counts by code."""
    import numpy as np

    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """Ranked n-grams by language, arranged for looking up all languages at once."""

    def __init__(self, lists: dict[str, list[int]], top: int = TOP):
        import numpy as np

        self.langs, self.top = sorted(lists), top
        self.codes = np.unique(np.concatenate([np.asarray(lists[k], np.int64) for k in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.asarray(lists[k], np.int64))] = np.arange(len(lists[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name of equals) and 1 - its share of the greatest distance."""
        import numpy as np

        found = grams(text)
        if found is None or not self.langs:
            return "und", 0.0
        own = ranked(*found, self.top)
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.top, np.minimum(self.top, np.abs(ranks - np.arange(len(own))))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.top * len(own)))


def profiles(docs: DataFrame, top: int = TOP, max_per_lang: int = MAX_PER_LANG) -> dict[str, list[int]]:
    """Ranked n-gram codes by language from docs (doc_id, text, lang) with a lang.

    Every language is learned, each from about max_per_lang of its documents, chosen by a hash of doc_id; the bound is on the
    profiles only. Counts are summed per task and then per language and n-gram; a size and top codes a language reach the
    driver. Rows without a lang or a text teach nothing, null doc_ids are chosen or left together, repeated rows count each,
    and an empty table gives no profile."""
    rows = docs.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.map_from_arrays(F.lit(list(sizes)), F.lit([int((1 << 20) * min(1.0, max_per_lang / n)) for n in sizes.values()]))
    limit = F.element_at(share, F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        sums: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                if (found := grams(text.as_py())) is not None:
                    sums.setdefault(lang.as_py(), Counter()).update(dict(zip(found[0].tolist(), found[1].tolist(), strict=True)))
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["lang", "code", "n"])

    counts = chosen.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {k: [] for k in sizes}
    for r in counts.withColumn("place", place).filter(F.col("place") <= top).orderBy("lang", "place").collect():
        out[r["lang"]].append(r["code"])
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, lists: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text), read whole.

    Null text and text without a letter give `und` with score 0; without profiles all are `und`. Equal texts get equal
    results, null and repeated doc_ids are predicted row by row, an empty table gives no rows; other columns are not read."""
    check_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value, top)
        for b in batches:
            found = [known.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, profiles(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
