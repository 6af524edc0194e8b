"""Language identification by bit-sliced Bloom filters of character n-grams (operator 9).

Each language has a Bloom filter of the n-grams that occur in most of its documents. The
filters share their hash functions and lie side by side: each position of the table is a
mask with one bit a language, and the AND of an n-gram's positions is the set of all
languages that contain it. Per language the hits of a text are counted (popcounts of the
masks) and corrected for the filter's share of false positives; the highest coverage decides.

The filters are fitted on a bounded sample: for each of the LANGUAGES commonest languages about PER_LANGUAGE documents,
chosen by the hash of their id, and the GRAMS n-grams that most of them contain; everything
else reads all rows and whole texts. Ties go to the language with most documents to learn from.

Long texts are read in whole. Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text where nothing could be learned; a row without id is never learned from and not held out.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chosen, map_rows, slices, small_batches, table, threshold
from .shingles import mixed

SIZES = (2, 3, 4)
PER_LANGUAGE = 4000
#: The values of ``lang`` that are learned, those of most documents: a bound on what is fitted, as PER_LANGUAGE is; ``fitted`` takes another.
LANGUAGES = 1000
GRAMS = 8000
POSITIONS = 1 << 17
HASHES = 3
#: Letters of a long text that are looked at together.
PIECE = 1 << 16
#: The pipeline rejects texts of which the best language covers less.
LEAST = 0.2
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def pieces(text: str) -> Iterator[str]:
    """A text cut at spaces, PIECE letters or just more at a time: no n-gram crosses them, and arrays stay small."""
    begin = 0
    while begin < len(text):
        end = text.find(" ", begin + PIECE) if len(text) - begin > PIECE else -1
        yield text[begin : end if end >= 0 else len(text)]
        begin = end if end >= 0 else len(text)


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of the words of a text, a space at each end; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    points = np.where(letters()[points], points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    if len(points) < 3:
        return np.empty(0, dtype=np.uint64)
    out = []
    for n in SIZES:
        runs = len(points) - n + 1
        if runs <= 0:
            continue
        h = np.full(runs, n, dtype=np.uint64)
        inner = np.zeros(runs, dtype=bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + runs]
            if 0 < k < n - 1:
                inner |= points[k : k + runs] == 32  # no n-gram crosses words
        out.append(mixed(h[~inner]))
    return np.concatenate(out)


def positions(hashes: np.ndarray) -> list[np.ndarray]:
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(POSITIONS)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    planes: np.ndarray  # a row for each 64 languages
    wrong: np.ndarray  # each filter's share of false positives

    @classmethod
    def of(cls, known: dict[str, np.ndarray]) -> LanguageFilters:
        """Of texts that several languages cover alike, the first of ``known`` is chosen."""
        languages = list(known)
        planes = np.zeros((-(-len(languages) // 64), POSITIONS), dtype=np.uint64)
        wrong = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            for at in positions(known[lang]):
                planes[i // 64, at] |= np.uint64(1 << (i % 64))
            wrong[i] = ((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** HASHES
        return cls(languages, planes, wrong)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        at = positions(hashes)
        hits = np.zeros(len(self.languages))
        for p, plane in enumerate(self.planes):
            masks = plane[at[0]]
            for x in at[1:]:
                masks = masks & plane[x]
            each, count = np.unique(masks, return_counts=True)
            for i in range(p * 64, min(len(self.languages), p * 64 + 64)):
                hits[i] = count[(each >> np.uint64(i % 64)) & np.uint64(1) == 1].sum()
        return hits

    def coverage(self, hashes: np.ndarray) -> np.ndarray:
        """The corrected share of the n-grams that each language contains."""
        return self.corrected(self.hits(hashes), len(hashes))

    def corrected(self, hits: np.ndarray, n: int) -> np.ndarray:
        return np.clip((hits - n * self.wrong) / (n * (1 - self.wrong)), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for piece in pieces(text or "") if self.languages else ():
            hashes = grams(piece)
            n += len(hashes)
            if len(hashes):
                total += self.hits(hashes)
        if not n:
            return UNKNOWN, 0.0
        cover = self.corrected(total, n)
        best = int(cover.argmax())
        return self.languages[best], float(cover[best])


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = LANGUAGES) -> LanguageFilters:
    """Filters from rows with an id, a text and a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return LanguageFilters.of({})
    shares = docs.sparkSession.createDataFrame([(lang, threshold(per_language, n)) for lang, n in counts.items()], "lang string, share bigint")
    sample = rows.join(F.broadcast(shares), "lang").where(chosen(F.col("id"), F.col("share")))  # ``most`` rows at most

    def step(langs, texts):
        seen: dict[str, Counter] = {}
        for lang, text in zip(langs, texts, strict=True):
            seen.setdefault(lang, Counter()).update(set().union(*(np.unique(grams(p)).view(np.int64).tolist() for p in pieces(text))))
        for lang, c in seen.items():
            yield {"lang": [lang] * len(c), "gram": list(c), "docs": list(c.values())}

    each = map_rows(sample, ["lang", "text"], step, "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    order = Window.partitionBy("lang").orderBy(F.desc("docs"), "gram")
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= GRAMS)
    known: dict[str, list[int]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in best.select("lang", "gram").collect():  # GRAMS a language at most
        known[r.lang].append(r.gram)
    return LanguageFilters.of({lang: np.array(g, dtype=np.int64).view(np.uint64) for lang, g in known.items() if g})


def identify(docs: DataFrame, filters: LanguageFilters, columns: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """``columns`` (typed as in ``schema``) with lang_pred and score."""
    names = [c.split()[0] for c in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def step(texts, *rest):
        for a, b in slices(len(texts), [len(t or "") for t in texts], 8 << 20):
            found = [shared.value.predict(t) for t in texts[a:b]]
            yield {n: c[a:b] for n, c in zip(names, rest, strict=True)} | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_rows(docs, [F.col(text_col).cast("string").alias("__text"), *columns], step, f"{schema}, lang_pred string, score double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, by filters fitted on the same table."""
    filters = fitted(docs, id_col, text_col, lang_col)
    out = identify(docs, filters, [F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out")], "doc_id bigint, held_out boolean", text_col)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """``docs`` without texts that are ``und`` or that no learned language covers by ``least``."""
    filters = fitted(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        found = (shared.value.predict(t.as_py()) for t in texts)  # one text at a time is a Python object
        return pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_())

    return docs.where(clear(F.col(text_col).cast("string")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
