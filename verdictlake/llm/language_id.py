"""Language identification by compression.

Each language has one raw-content zstandard dictionary made of sampled texts. A text is compressed once with each
dictionary; the language whose dictionary makes it smallest is the prediction. Texts are compressed in blocks, so that
a long text cannot feed on itself and the dictionary counts everywhere in it; all blocks of the whole text count.
Texts and dictionaries are in lower case.
zstandard stores short blocks as they are, whatever the dictionary, and its sizes are whole bytes; so a short text has the
size that an ideal coder would give it which has counted the characters of the same dictionary after up to two others.
The distance between the two best sizes, relative to the second, is the margin; a narrow margin is a rejection.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, text_buffers, whole_text

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """sample_texts: labelled texts for a language at most, spread by hash; sample_chars: of each, a passage at a hashed
    place; dictionary_bytes: of a language, less if all together would pass total_bytes. level, block_bytes: of the
    compressor; min_match: its shortest match. min_margin: below it a prediction is a rejection. temperature: of the score,
    in bytes for each compressed byte. short_bytes: texts up to so many are sized by counts."""

    sample_texts: int = 64
    sample_chars: int = 4096
    dictionary_bytes: int = 48 << 10
    total_bytes: int = 64 << 20
    level: int = 6
    min_match: int = 3
    block_bytes: int = 4096
    min_margin: float = 0.004
    temperature: float = 0.01
    short_bytes: int = 256


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: raw content by language, in the order of the language codes."""

    dictionaries: dict[str, bytes]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_languages(labelled: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Dictionaries from labelled(doc_id, text, lang); rows without id, text or lang are not used.

    For a language and each of sample_texts hash buckets the row with the smallest hash is taken, so that the sample
    is the same on every run and is found with one pre-aggregated row for each bucket.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashed = rows.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    chosen = hashed.groupBy("lang", F.pmod("h", F.lit(config.sample_texts)).alias("bucket")).agg(F.min("h").alias("h"))
    texts = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.lower("text").alias("text"))
    at = F.pmod(F.col("h"), F.greatest(F.char_length("text") - config.sample_chars, F.lit(0)) + 1) + 1
    passages = texts.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).select("lang", "h", F.substring("text", at, F.lit(config.sample_chars)).alias("passage"))
    # bounded: sample_texts passages of sample_chars for each language (repeated rows once)
    found: dict[str, list[str]] = {}
    for row in passages.distinct().orderBy("lang", "h", "passage").collect():
        found.setdefault(row["lang"], []).append(row["passage"])
    each = min(config.dictionary_bytes, config.total_bytes // max(1, len(found)))
    model = {}
    for lang in sorted(found):
        share = max(16, each // len(found[lang]))
        data = b"\n".join(p.encode()[:share] for p in found[lang])
        if len(data) >= 8:
            model[lang] = data[-each:]
    return LanguageModel(model)


def block_sizes(data: memoryview, compressors: list, block_bytes: int) -> list[int]:
    """Compressed bytes of all blocks under each compressor."""
    sizes = [0] * len(compressors)
    for at in range(0, len(data), block_bytes):
        block = data[at : at + block_bytes]
        for k, compressor in enumerate(compressors):
            sizes[k] += len(compressor.compress(block))
    return sizes


class CodeLengths:
    """Fractional bytes of texts under each dictionary: of a character after two, one and no others, what was counted after
    more is weighed against what follows from fewer. A character that no dictionary has costs the same under all."""

    def __init__(self, dictionaries: Iterable[bytes]):
        texts = [d.decode(errors="ignore") for d in dictionaries]
        self.grams = [Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)) for t in texts]
        self.totals = [len(t) for t in texts]
        self.alphabet = set().union(*texts)
        self.costs = Remembered(self._costs, 1 << 16)

    def _costs(self, gram: str) -> tuple[float, ...]:
        if gram[-1] not in self.alphabet:
            return (2.0,) * len(self.grams)
        found = []
        for counts, total in zip(self.grams, self.totals):
            p = 1 / len(self.alphabet)
            for n in range(1, len(gram) + 1):
                own = gram[-n:]
                p = (counts[own] + 4 * p) / ((counts[own[:-1]] if n > 1 else total) + 4)
            found.append(-math.log2(p) / 8)
        return tuple(found)

    def sizes(self, text: str) -> list[float]:
        text = " " + text
        return [sum(c) for c in zip(*(self.costs[text[max(0, i - 2) : i + 1]] for i in range(1, len(text))))]


def decide(sizes: list[float], temperature: float) -> tuple[int, float, float]:
    """Index of the smallest size (the first of equals), a score of 0 to 1, and the relative margin."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for k, s in enumerate(sizes) if k != best]
    if not rest:
        return best, 1.0, 1.0
    scale = 1.0 + temperature * sizes[best]
    score = 1.0 / (1.0 + sum(math.exp(-(s - sizes[best]) / scale) for s in rest))
    second = min(rest)
    return best, score, (second - sizes[best]) / second


def _classifier(model: LanguageModel, config: LanguageConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(model.dictionaries)
        compressors = []
        for lang in langs:
            content = model.dictionaries[lang]
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                config.level, source_size=config.block_bytes, dict_size=len(content), min_match=config.min_match, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            compressors.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings))
        lengths = CodeLengths(model.dictionaries.values())
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            letters = batch.column("has_letter").to_pylist()
            view = memoryview(data)
            out_lang, out_score, out_margin, out_rejected = [], [], [], []
            for i, has_letter in enumerate(letters):
                if has_letter and langs:
                    own = view[offsets[i] : offsets[i + 1]]
                    sizes = lengths.sizes(bytes(own).decode()) if len(own) <= config.short_bytes else block_sizes(own, compressors, config.block_bytes)
                    best, score, margin = decide(sizes, config.temperature)
                    found = langs[best], score, margin, margin < config.min_margin
                else:
                    found = UNDETERMINED, 0.0, 0.0, True
                for column, value in zip((out_lang, out_score, out_margin, out_rejected), found):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("text", "has_letter")), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64()), pa.array(out_margin, pa.float64()), pa.array(out_rejected, pa.bool_())],
                names=[*(c for c in batch.schema.names if c not in ("text", "has_letter")), "lang_pred", "score", "margin", "rejected"],
            )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for each row of docs(doc_id, text).

    A null text and one without a letter are `und` with score 0 and rejected; so is every text if no language was
    learned. Equal sizes go to the first language code, with margin 0. Repeated rows give repeated results; further
    columns are ignored; no shuffle.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text()).alias("text"))
    given = given.withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    return given.mapInArrow(_classifier(model, config), "doc_id long, lang_pred string, score double, margin double, rejected boolean")
