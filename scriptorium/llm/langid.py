"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of its documents. A text is cut into
blocks, so that the dictionary, not the text's own history, decides; every block of the whole text is compressed
with every dictionary and the sizes are summed. The smallest sum wins; the margin is the relative gap to the next.
The operator marks a text `rejected` when the margin is under `min_margin`; `label` then is null.

Null text, or text without a letter (as str.isalpha has it): `und`, score 0. Ties go to the alphabetically first language. No training
rows: every text is `und`. Repeated rows are answered one by one; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import smallest_hashes
from .shared import by_text

UNDETERMINED = "und"
#: Bounds of the training sample: documents per language, bytes taken of each, bytes of a piece.
SAMPLE_DOCS, SAMPLE_BYTES, PIECE_BYTES = 128, 512, 128
BLOCK_BYTES = 2_048
#: One set of compression parameters for texts of every length.
PARAMETERS = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=16, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
MIN_MARGIN = 0.01
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-cased letters of a text, whatever lies between them as one blank: case, digits and marks say little of a language."""
    return b" ".join(text.lower().encode("utf-8").translate(_LETTERS_ONLY).split())


def spread(raw: bytes, total: int, piece: int) -> bytes:
    """Evenly spaced pieces of a text, `total` bytes of it at most; the whole of a shorter one."""
    if len(raw) <= total:
        return raw
    n = max(1, total // piece)
    step = (len(raw) - piece) / max(1, n - 1)
    return b"\n".join(raw[(at := int(i * step)) : at + piece] for i in range(n))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, piece_bytes: int = PIECE_BYTES) -> dict[str, bytes]:
    """Raw dictionaries by language from rows of (doc_id, text, lang): `sample_bytes` of each of `sample_docs` documents.

    Executors cut the pieces, from all over each text; the driver receives at most languages x documents x bytes.
    """

    @F.pandas_udf("binary")
    def taken(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spread(plain(t), sample_bytes, piece_bytes))

    rows = labelled.where("text is not null and lang is not null").select("doc_id", "lang", "text", F.xxhash64("text").alias("tag"))
    chosen = smallest_hashes(rows, "lang", ["doc_id", "tag"], sample_docs)
    parts: dict[str, list[tuple[str, bytes]]] = {}
    for r in chosen.select("lang", F.col("doc_id").cast("string").alias("k"), taken("text").alias("t")).collect():
        parts.setdefault(r.lang, []).append((r.k or "", bytes(r.t)))
    return {lang: b"\n".join(t for _, t in sorted(rows)) for lang, rows in sorted(parts.items())}


def blocks(raw: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    """Blocks of about equal length, none longer than `size`."""
    n = max(1, -(-len(raw) // size))
    step = max(1, -(-len(raw) // n))
    return [raw[i : i + step] for i in range(0, len(raw), step)]


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors = [self._compressor(dictionaries[lang]) for lang in self.languages]

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=PARAMETERS)
        return zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=d)

    def scores(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin): scores fall off exponentially with the relative size above the best."""
        raw = plain(text)
        parts = blocks(raw)
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.compressors]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.languages[i]))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        weights = [math.exp(-(s - sizes[best]) / max(1, sizes[best]) * 20) for s in sizes]
        return self.languages[best], 1 / sum(weights), (second - sizes[best]) / max(1, second)


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_()), ("label", pa.string())])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row: doc_id, lang_pred, score, margin, rejected, label (null where rejected). Map-only.

    The dictionaries are a broadcast of at most languages x SAMPLE_DOCS x SAMPLE_BYTES.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    held: list[Model] = []

    def rows(texts: list[str | None]) -> tuple[None, list]:
        if not held:
            held.append(Model(shared.value))
        out = []
        for text in texts:
            if not text or not held[0].languages or not any(map(str.isalpha, text)):
                out.append((UNDETERMINED, 0.0, 0.0, True, None))
            else:
                lang, score, margin = held[0].scores(text)
                out.append((lang, score, margin, margin < min_margin, None if margin < min_margin else lang))
        return None, list(zip(*out, strict=True))

    return by_text(docs, rows, "lang_pred string, score double, margin double, rejected boolean, label string", PREDICTED)
