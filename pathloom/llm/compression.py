"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathloom.llm.frames import check_free, map_texts
from pathloom.llm.textbatch import Texts


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes: `whole` by the length in bytes from which a row holds, `chunk` for chunks.

    Ordinary prose compresses better the longer it is, so the limits rise with the length. A very short text says nothing:
    the frame around the data outweighs it.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (64, 0.70, 1.90),
        (128, 0.85, 2.10),
        (256, 1.00, 2.40),
        (512, 1.15, 2.70),
        (1024, 1.25, 2.90),
        (2048, 1.35, 3.10),
        (8192, 1.40, 3.40),
        (32768, 1.40, 3.80),
        (262144, 1.40, 4.50),
    )
    chunk_bytes: int = 2048
    chunk_low: float = 1.25
    chunk_high: float = 3.10
    chunk_share: float = 0.5  # reject if more than this share of the chunks is outside
    level: int = 3


def ratios(data: np.ndarray, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside the limits; a text shorter than a chunk has none and gives 0.

    Chunks follow each other; where bytes are left over, a last one ends at the end of the text.
    """
    n, size = len(data), bands.chunk_bytes
    if not n:
        return 0.0, 0.0
    raw = data.tobytes()
    whole = n / len(packer.compress(raw))
    if n < size:
        return whole, 0.0
    starts = [*range(0, n - size + 1, size), *([n - size] if n % size else [])]
    outside = sum(not bands.chunk_low <= size / len(packer.compress(raw[i : i + size])) <= bands.chunk_high for i in starts)
    return whole, outside / len(starts)


def keeps(length: int, whole: float, outside: float, bands: Bands) -> bool:
    """Whether a text of so many bytes stays."""
    _, low, high = next(b for b in reversed(bands.whole) if length >= b[0])
    return length > 0 and low <= whole <= high and outside <= bands.chunk_share


def compression_rules(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text", columns: list[str] | None = None, ratio_col: str | None = None, outside_col: str | None = None) -> DataFrame:
    """The rows whose text lies within the bands, with `columns` (all by default), and the figures if they get names.

    Every byte of a text counts, none is sampled. A null or empty text is rejected; one below 64 bytes stays. Rows decide
    alone, so equal rows fare alike and all of them stay or go; an empty table stays empty. Columns pass through whatever
    their names; ValueError if one of them has a name given for the figures.
    """
    keep = list(docs.columns if columns is None else columns)
    names = [n for n in (ratio_col, outside_col) if n]
    check_free(keep, names)
    wanted = [i for i, n in enumerate((ratio_col, outside_col)) if n]

    def start():
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)

        def work(texts: Texts) -> list:
            n = len(texts)
            figures, stays = np.zeros((2, n)), np.zeros(n, bool)
            for i in range(n):
                low, high = int(texts.offsets[i]), int(texts.offsets[i + 1])
                a, b = ratios(texts.data[low:high], bands, packer)
                figures[:, i] = a, b
                stays[i] = keeps(high - low, a, b, bands)
            return [*(figures[i] for i in wanted), stays]

        return work

    return map_texts(docs, keep, text_col, start, T.StructType([T.StructField(n, T.DoubleType()) for n in names]), filtered=True)
