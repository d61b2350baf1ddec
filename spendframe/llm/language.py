"""Language identification by compression: the language whose dictionary shortens a text most.

Every language gets a zstandard raw-content dictionary from a bounded sample of labelled rows. A text is
cut into blocks, each block is compressed once per language, and the smallest total wins. When the
runner-up is nearly as small the prediction is marked rejected.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import annotate, encoded, flat, fresh

#: The fit reads at most SAMPLE_ROWS distinct texts a language and SAMPLE_BYTES bytes of each;
#: a dictionary holds at most DICTIONARY_BYTES. All three are parameters of `fit`.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 128, 2048, 64 * 1024
LEVEL, BLOCK, MARGIN = 6, 2048, 0.005
UNDETERMINED = "und"

FIELDS = "lang_pred string, score double, rejected boolean"
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """A character of the Unicode letter categories; fractions, superscripts and number signs are none."""
    return _LETTER.search(text) is not None or any(map(str.isalpha, text))


def held_out(doc_id: Column | str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Rows that are never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def normalised(text: str) -> bytes:
    """Lower-case words of letters with single spaces."""
    return b" ".join(encoded(text.lower()).translate(_LETTERS).split())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, row_bytes: int = SAMPLE_BYTES,
        size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, from `rows` distinct texts of it in hash order.

    Null texts and null languages teach nothing; copies count once. The sample is the only thing that
    reaches the driver, and it is bounded by languages x rows x row_bytes.
    """
    known = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # The smallest hashes of each part of a language first, so that no task gathers all texts of one language.
    part = F.pmod(F.shiftright("h", 8), F.lit(256))
    for keys in (["lang", part], ["lang"]):
        first = Window.partitionBy(*keys).orderBy("h")
        base = known.groupBy("lang", "h").count() if len(keys) > 1 else chosen
        chosen = base.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows).select("lang", "h")
    sample = (known.join(F.broadcast(chosen), ["lang", "h"], "left_semi")  # languages x rows at most
              .groupBy("lang", "h").agg(F.min(F.substring("text", 1, row_bytes)).alias("text")))
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.h)):
        words = normalised(row.text)
        if words:
            found.setdefault(row.lang, []).append(words[:row_bytes])
    return {k: b" ".join(v)[:size] for k, v in found.items()}


class Classifier:
    """Compressed sizes of a text under each dictionary. Built once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK, margin: float = MARGIN):
        self.block, self.margin, self.coders = block, margin, {}
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.coders[lang] = zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False,
                                                         write_checksum=False, write_dict_id=False)

    def sizes(self, words: bytes) -> list[tuple[int, str]]:
        blocks = [words[i:i + self.block] for i in range(0, len(words), self.block)]
        return sorted((sum(len(coder.compress(b)) for b in blocks), lang) for lang, coder in self.coders.items())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.coders or not has_letter(text):
            return UNDETERMINED, 0.0, True
        ranked = self.sizes(normalised(text))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        score = (ranked[1][0] - ranked[0][0]) / max(ranked[1][0], 1)
        return ranked[0][1], score, score < self.margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", name: str = "language",
             level: int = LEVEL, block: int = BLOCK, margin: float = MARGIN) -> DataFrame:
    """All of `docs` with a struct `name` of (lang_pred, score, rejected); whole texts, one pass, no shuffle.

    `score` is the runner-up's surplus over the best size as a share of the runner-up (0 to 1; 1 with a single
    language). Null, empty and letterless texts are `und`, score 0, rejected; so is everything when no
    language could be learned. Equal sizes go to the first language by name, with score 0, rejected.
    Repeated rows get equal results, and other columns pass through untouched.
    """
    made: dict[str, Classifier] = {}

    def compute(texts):
        if not made:
            made["it"] = Classifier(dictionaries, level, block, margin)
        return map(made["it"].predict, texts)

    return annotate(docs, [text], compute, FIELDS, name)


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with the columns they came with."""
    name = fresh(docs, "language")
    return classify(docs, dictionaries, text, name).filter(~F.col(f"{name}.rejected")).drop(name)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from the rows that are not held out."""
    dictionaries = fit(docs.filter(~held_out()))
    slim = docs.select("doc_id", "text")
    return flat(classify(slim, dictionaries), "language", "doc_id", held_out().alias("held_out"))
