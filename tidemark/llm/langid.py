"""Language identification by string kernels.

The kernel of two texts is the share of byte n-grams (n = 1 to 3, blended) that
occur in both, among those that some landmark has: the number of common n-grams
over the root of the product of their numbers. Landmark texts span a Nyström feature space in which one ridge
regression per language is fitted against the rest; texts are scored by batched
matrix products.

The model is fitted on a bounded sample of labelled rows (``per_language``
rows a language, those with the least hash of their text), so what is sent to
the driver and broadcast has a fixed bound. Every text is read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import clashing, least_rows, text_chunks

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_LETTER_BYTES = bytes(range(65, 91)) + bytes(range(97, 123))
#: Upper-case ASCII to lower case, digits and signs to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bounds of the fitted model (parameters): texts a language and together, and
#: landmarks, of which each language has one at least.
PER_LANGUAGE = 300
SAMPLE_ROWS = 4_000
LANDMARKS = 96
RIDGE = 1e-2
#: Lengths of n-grams.
LENGTHS = (1, 2, 3)


def grams(folded: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n-grams of a byte array (folded, of at least n bytes)."""
    code = folded[: len(folded) - n + 1].astype(np.int32)
    for k in range(1, n):
        code = (code << 8) | folded[k : len(folded) - n + 1 + k]
    return code


def fold(raw: bytes) -> np.ndarray:
    """Folded bytes with runs of spaces made one and one at each end."""
    return np.frombuffer(b" " + b" ".join(raw.translate(FOLD).split()) + b" ", np.uint8)


def distinct_grams(raw: bytes) -> list[np.ndarray]:
    """Codes of the n-grams of a whole text, by length; at most 2^24 whatever the text."""
    folded = fold(raw)
    return [np.unique(grams(folded, n)) if len(folded) >= n else np.zeros(0, np.int32) for n in LENGTHS]


_lookups: dict = {}


@dataclass
class Model:
    """Landmark n-grams, their presence in the landmarks, and the languages' weights."""

    known: list[np.ndarray]  # per n: sorted codes of the landmarks' n-grams
    landmarks: np.ndarray  # n-grams x landmarks, presence
    sizes: np.ndarray  # root of the number of n-grams of each landmark
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    languages: list[str]

    def lookups(self) -> list[np.ndarray]:
        """Per n: n-gram code to column number; the column behind all is for others."""
        key = (len(self.landmarks), int(self.known[-1].sum(dtype=np.int64)))
        if _lookups.get("key") != key:
            tables, offset, other = [], 0, len(self.landmarks)
            for n, codes in enumerate(self.known, 1):
                table = np.full(1 << (8 * n), other, np.uint16 if other < 65_535 else np.int32)
                table[codes] = np.arange(offset, offset + len(codes))
                tables.append(table)
                offset += len(codes)
            _lookups.clear()
            _lookups.update(key=key, tables=tables)
        return _lookups["tables"]

    def presence(self, raws: list[bytes]) -> np.ndarray:
        """Presence of the landmarks' n-grams in each text."""
        out = np.zeros((len(raws), self.landmarks.shape[0] + 1), np.float32)
        for i, raw in enumerate(raws):
            folded = fold(raw)
            for n, lookup in enumerate(self.lookups(), 1):
                if len(folded) >= n:
                    out[i, lookup[grams(folded, n)]] = 1
        return out[:, :-1]

    def kernel(self, raws: list[bytes]) -> np.ndarray:
        return self.kernel_of(self.presence(raws))

    def kernel_of(self, present: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(present.sum(axis=1), 1))
        return present @ self.landmarks / (own[:, None] * self.sizes[None, :])

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """Margins of each text (rows) for each language."""
        return self.kernel(raws) @ self.weights + self.bias


def fit(texts: list[list[np.ndarray]], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on the n-grams of labelled texts (a bounded sample). Landmarks go round the languages."""
    languages = sorted(set(langs))
    by_lang = {la: [i for i, x in enumerate(langs) if x == la] for la in languages}
    chosen = [ids[k] for k in range(max(map(len, by_lang.values()))) for ids in by_lang.values() if k < len(ids)][: max(landmarks, len(languages))]
    known = [np.unique(np.concatenate([texts[i][n] for i in chosen])) for n in range(len(LENGTHS))]
    first = np.cumsum([0] + [len(k) for k in known])
    marks = np.zeros((first[-1], len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        for n in range(len(LENGTHS)):
            marks[first[n] + np.searchsorted(known[n], texts[i][n]), j] = 1
    sizes = np.sqrt(np.maximum(marks.sum(axis=0), 1))
    model = Model(known, marks, sizes, np.zeros((len(chosen), len(languages)), np.float32), np.zeros(len(languages), np.float32), languages)
    between = (marks.T @ marks) / (sizes[:, None] * sizes[None, :])
    values, vectors = np.linalg.eigh(between.astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    lookups = model.lookups()
    features = np.empty((len(texts), int(good.sum())))
    for at in range(0, len(texts), 256):
        present = np.zeros((len(texts[at : at + 256]), len(marks) + 1), np.float32)
        for row, codes in zip(present, texts[at : at + 256]):
            for lookup, part in zip(lookups, codes):
                row[lookup[part]] = 1
        features[at : at + 256] = model.kernel_of(present[:, :-1]).astype(np.float64) @ whiten
    targets = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([len(by_lang[x]) for x in langs])
    weight *= len(langs) / weight.sum()
    mean = (features * weight[:, None]).mean(axis=0)
    mean_target = (targets * weight[:, None]).mean(axis=0)
    centred = features - mean
    gram = (centred * weight[:, None]).T @ centred + ridge * len(langs) * np.eye(features.shape[1]) * 1e-2
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (targets - mean_target))
    model.weights = (whiten @ beta).astype(np.float32)
    model.bias = (mean_target - mean @ beta).astype(np.float32)
    return model


def has_letter(text: str | None, raw: bytes) -> bool:
    if len(raw.translate(None, _LETTER_BYTES)) < len(raw):
        return True
    return bool(text) and LETTER.search(text) is not None


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, draw, codes of the n-grams by length, as bytes) of each row (lang, draw, text)."""
    for batch in batches:
        found = [distinct_grams(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        codes = pa.array([[c.astype(np.int32).tobytes() for c in f] for f in found], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], names=["lang", "draw", "codes"])


def sample(docs: DataFrame, text_col: str, lang_col: str, learn, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> list:
    """(lang, n-grams) of at most ``per_language`` texts a language, and ``sample_rows`` together, of least hash.

    Each language has one text at least. The tasks read whole texts and send
    their distinct n-grams. Hashes are chosen first, so that no task gathers
    the texts of others.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("draw"), F.col(text_col).alias("text"))
    languages = rows.select("lang").distinct().count()
    each = max(1, min(per_language, sample_rows // max(languages, 1)))
    chosen = least_rows(rows.select("lang", "draw"), each, "lang")
    found = rows.join(F.broadcast(chosen), ["lang", "draw"]).select("lang", "draw", "text").mapInArrow(_grams, "lang string, draw long, codes array<binary>")
    found = found.groupBy("lang", "draw").agg(F.min("codes").alias("codes")).orderBy("lang", "draw").collect()
    return [(r["lang"], [np.frombuffer(bytes(c), np.int32) for c in r["codes"]]) for r in found]


def _predict(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text_col)).to_pylist()
        langs, scores = [], []
        for start, raws in text_chunks(texts, 1 << 20):
            for at in range(0, len(raws), 256):
                part = raws[at : at + 256]
                margins = model.scores(part) if model else np.zeros((len(part), 1))
                best = margins.argmax(axis=1)
                top = 1 / (1 + np.exp(-4 * margins[np.arange(len(part)), best].astype(np.float64)))
                for k, raw in enumerate(part):
                    known = model is not None and has_letter(texts[start + at + k], raw)
                    langs.append(model.languages[best[k]] if known else UNKNOWN)
                    scores.append(float(top[k]) if known else 0.0)
        done = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        yield pa.RecordBatch.from_arrays([done[n] if n in done else batch.column(i) for i, n in enumerate(names)], names=names)


def identify(docs: DataFrame, train: DataFrame, learn, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) of every whole text.

    ``train`` has the text and language columns, ``learn`` is a condition on its
    rows. Rows without a language or text teach nothing. A text that is null or
    has no letter is ``und`` with score 0, as is every text if there is nothing
    to learn from. With one language to learn, that is the answer. Repeated rows
    get equal answers. Columns lang_pred and score of ``docs`` are replaced.
    """
    rows = sample(train, text_col, lang_col, learn, per_language)
    model = fit([codes for _, codes in rows], [lang for lang, _ in rows], landmarks) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = clashing(docs, ["lang_pred", "score"]).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    return out.mapInArrow(lambda batches: _predict(batches, shared, text_col), schema)
