"""Language of texts by rank-order profiles of their letter triples.

A profile is the commonest triples of a language's words (with a space at each
end), by rank, counted over all labelled documents. A text's own commonest
triples are ranked alike, and the language whose ranks lie nearest is told: each
triple adds the distance of its two ranks, or the profile's size if the language
does not have it. Only languages written in the text's script compete.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import trimmed
from tidemark.sources.slices import dealt

#: Texts shorter than this, trimmed, are not told (fixed value).
LEAST_CHARS = 40

#: Triples of a profile, and the most languages.
SIZE = 300
MOST = 1_000

#: Scripts that are told apart; letters of any other count as "Other".
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai")

#: ISO 639-3 codes of two-letter ones (fixed values).
ISO_639_3 = {
    "ar": "ara", "bg": "bul", "ca": "cat", "cs": "ces", "da": "dan", "de": "deu", "el": "ell", "en": "eng", "es": "spa", "et": "est", "fa": "fas", "fi": "fin",
    "fr": "fra", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun", "id": "ind", "it": "ita", "ja": "jpn", "ko": "kor", "lt": "lit", "lv": "lav", "nl": "nld",
    "no": "nor", "pl": "pol", "pt": "por", "ro": "ron", "ru": "rus", "sk": "slk", "sl": "slv", "sr": "srp", "sv": "swe", "th": "tha", "tr": "tur", "uk": "ukr",
    "vi": "vie", "zh": "zho",
}


def iso_639_3(code: Column) -> Column:
    """The three-letter code of a two-letter one; other codes stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in ISO_639_3.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), code)


def script(text: Column) -> Column:
    """The script of most of a text's letters; null without a letter.

    Only a text with letters beyond Latin is counted script by script.
    """
    count = lambda name: F.regexp_count(text, F.lit(rf"\p{{Is{name}}}"))
    counts = F.array(*[F.struct(count(s).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SCRIPTS)])
    best = F.array_max(counts)
    mixed = F.when(best["n"] > 0, best["s"]).otherwise("Other")
    return F.when(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), mixed).when(text.rlike(r"\p{L}"), "Latin")


def _words(text: Column) -> Column:
    """Lower-cased words of a text: runs of letters."""
    return F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w != "")


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank) of every language of ``docs``, counted over all its texts; of equal counts the lesser triple first.

    Words are counted first, so only a language's distinct words are cut into
    triples. Rows without a language or text teach nothing.
    """
    texts = dealt(docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col))
    words = texts.select(F.col(lang_col).alias("lang"), F.explode(_words(F.col(text_col))).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    spaced = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    triples = F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(spaced, k, F.lit(3)))
    grams = counted.select("lang", "n", F.explode(triples).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).drop("n")


#: Other characters than letters, in a text's letters; it sorts before all of them.
SPACE = 32
#: Letters of a text that are counted at once.
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Each code point, or a space for one that is no letter."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(sys.maxunicode + 1)], np.uint32)


def key_of(gram: str) -> int:
    """A triple as a number; numbers sort like triples."""
    first, second, third = map(ord, gram)
    return first << 42 | second << 21 | third


def ranked(text: str, size: int) -> np.ndarray:
    """A text's commonest triples, the commonest first; of equal counts the lesser first.

    Each letter is the middle of one triple.
    """
    letters = np.pad(_letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)], 1, constant_values=SPACE)
    found = counts = np.empty(0, np.int64)
    for start in range(0, len(letters) - 2, PIECE):
        part = letters[start : start + PIECE + 2].astype(np.int64)
        keys = (part[:-2] << 42 | part[1:-1] << 21 | part[2:])[part[1:-1] != SPACE]
        keys.sort()
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(begins, append=len(keys))
        if len(found):
            found, of = np.unique(np.concatenate((found, keys[begins])), return_inverse=True)
            counts = np.bincount(of, np.concatenate((counts, n)), len(found)).astype(np.int64)
        else:
            found, counts = keys[begins], n
    return found[np.argsort(-counts, kind="stable")[:size]]


class Known:
    """Profiles of one script, by triple: the languages that have it, and its ranks there."""

    def __init__(self, profiles: dict[str, dict[str, int]]):
        self.codes = sorted(profiles)
        rows = sorted((key_of(gram), k, rank) for k, code in enumerate(self.codes) for gram, rank in profiles[code].items() if len(gram) == 3)
        keys, self.langs, self.ranks = np.array(rows, np.int64).reshape(-1, 3).T.copy()
        self.grams, self.begins, self.counts = np.unique(keys, return_index=True, return_counts=True)

    def nearest(self, grams: np.ndarray, size: int) -> str | None:
        """The code of the profile whose ranks lie nearest; none if no profile has any of the triples."""
        at = np.searchsorted(self.grams, grams)
        hit = np.flatnonzero(at < len(self.grams))
        hit = hit[self.grams[at[hit]] == grams[hit]]
        if not len(hit):
            return None
        n = self.counts[at[hit]]
        rows = np.repeat(self.begins[at[hit]] - n.cumsum() + n, n) + np.arange(n.sum())
        langs = self.langs[rows]
        less = np.bincount(langs, np.abs(np.repeat(hit + 1, n) - self.ranks[rows]) - size, len(self.codes))
        less[np.bincount(langs, minlength=len(self.codes)) == 0] = np.inf
        return self.codes[less.argmin()]


def detected(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, language) of each row of ``docs`` by the profiles ``known``; ISO 639-3 codes.

    Null for texts of fewer than 40 characters when trimmed, without a letter, or
    in a script that no profile is written in; of equal distances the lesser code.
    Profiles are broadcast, at most ``MOST`` languages of ``size`` rows; texts are
    dealt to the tasks once and ranked there, one at a time.
    """
    scripts = F.mode(script(F.col("gram"))).over(Window.partitionBy("lang"))
    rows = known.select(scripts.alias("script"), iso_639_3(F.col("lang")).alias("code"), "gram", "rank").limit(MOST * size + 1).collect()
    if len(rows) > MOST * size:
        raise ValueError(f"more than {MOST} languages")
    by_script: dict = {}
    for row in rows:
        by_script.setdefault(row["script"], {}).setdefault(row["code"], {})[row["gram"]] = row["rank"]
    shared = docs.sparkSession.sparkContext.broadcast({s: Known(of) for s, of in by_script.items()})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [shared.value.get(kind) for kind in batch.column(2).to_pylist()]
            codes = [k.nearest(ranked(text.as_py(), size), size) if k and text.is_valid else None for text, k in zip(batch.column(1), known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], names=[id_col, "language"])

    told = F.when(F.length(trimmed(F.col(text_col))) >= LEAST_CHARS, F.col(text_col))
    given = dealt(docs.select(id_col, text_col)).select(F.col(id_col), told.alias("text")).withColumn("script", script(F.col("text")))
    return given.mapInArrow(tell, T.StructType([given.schema[id_col], T.StructField("language", T.StringType())]))
