"""Image decoding and embedding as plug-ins: nothing here is needed unless pixels are read.

``decode`` and a model adapter run in Arrow batches on the executors; the libraries they need are optional.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.functions.text import suffix
from photoloom.operators.dedupe import RAW
from photoloom.sources.files import capture_time

Decoder = Callable[[bytes], "np.ndarray | None"]
Encoder = Callable[[list], np.ndarray]


def pillow_decoder() -> Decoder:
    """Decodes to RGB with Pillow; null for what can't be read."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images needs Pillow; pass another decoder or use stored vectors") from e
    import io

    def decode(content: bytes) -> np.ndarray | None:
        try:
            return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
        except Exception:
            return None

    return decode


def raw_preview(content: bytes) -> bytes | None:
    """The largest JPEG picture inside a camera's raw file."""
    best, at = None, 0
    while (start := content.find(b"\xff\xd8\xff", at)) >= 0:
        end = content.find(b"\xff\xd9", start)
        if end < 0:
            break
        # A preview may hold a thumbnail of its own, whose end is not the preview's.
        inner = content.count(b"\xff\xd8\xff", start + 2, end)
        while inner:
            nxt = content.find(b"\xff\xd9", end + 2)
            if nxt < 0:
                break
            inner += content.count(b"\xff\xd8\xff", end, nxt) - 1
            end = nxt
        if best is None or end + 2 - start > len(best):
            best = content[start : end + 2]
        at = end + 2
    return best


def raw_decoder(plain: Callable[[], Decoder] = pillow_decoder) -> Decoder:
    """Decodes raw files by their preview, or in half size where rawpy is installed and there is none; others by ``plain``."""
    decode = plain()

    def run(content: bytes) -> np.ndarray | None:
        pixels = decode(content)
        if pixels is None and (inner := raw_preview(content)) is not None:
            pixels = decode(inner)
        if pixels is None:
            try:
                import io

                import rawpy

                with rawpy.imread(io.BytesIO(content)) as raw:
                    pixels = raw.postprocess(half_size=True)
            except Exception:
                return None
        return pixels

    return run


#: EXIF tags of the times taken, digitised and changed, by order of trust. Fixed values.
EXIF_TIMES = (0x9003, 0x9004, 0x0132)
_EXIF_FOLDER = 0x8769


def exif_times(content: bytes | None) -> list[str | None]:
    """The three times as a JPEG file's EXIF block writes them; nulls where there is none."""
    found: dict[int, str] = {}
    try:
        at = content.index(b"Exif\x00\x00") + 6
        block = content[at : at + 65536]
        order = {b"II": "<", b"MM": ">"}[block[:2]]
        number = lambda at, kind: struct.unpack_from(order + kind, block, at)[0]
        todo, seen = [number(4, "I")], set()
        while todo:
            folder = todo.pop()
            if folder in seen:
                continue
            seen.add(folder)
            for k in range(number(folder, "H")):
                entry = folder + 2 + 12 * k
                tag, count = number(entry, "H"), number(entry + 4, "I")
                if tag == _EXIF_FOLDER:
                    todo.append(number(entry + 8, "I"))
                elif tag in EXIF_TIMES:
                    start = number(entry + 8, "I") if count > 4 else entry + 8
                    found[tag] = block[start : start + count].split(b"\x00")[0].decode("ascii", "replace")
    except (AttributeError, ValueError, KeyError, struct.error):
        pass
    return [found.get(t) for t in EXIF_TIMES]


def with_exif(files: DataFrame) -> DataFrame:
    """``files`` with ``taken``: the first of the three times in their ``content`` that parses, else ``mtime``; of raw files always ``mtime``."""
    read = F.pandas_udf(lambda batch: pd.Series([exif_times(c) for c in batch]), "array<string>")
    times = read(F.when(~suffix(F.col("path")).isin(*RAW), F.col("content")))
    rows = files.withColumn("__times", times).withColumns({f"__t{i}": F.col("__times")[i] for i in range(len(EXIF_TIMES))})
    return rows.withColumn("taken", capture_time(*[f"__t{i}" for i in range(len(EXIF_TIMES))])).drop("__times", *[f"__t{i}" for i in range(len(EXIF_TIMES))])


def dct_hash(pixels: np.ndarray, side: int = 16, over: int = 4) -> list[int]:
    """Perceptual hash of ``side * side`` bits: low frequencies of the grey picture against their median."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(float)
    n = side * over
    rows = np.linspace(0, grey.shape[0] - 1, n).round().astype(int)
    cols = np.linspace(0, grey.shape[1] - 1, n).round().astype(int)
    small = grey[np.ix_(rows, cols)]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:side, :side]
    bits = np.packbits((low > np.median(low)).ravel())
    return [int(x) for x in bits.view(">i8")]


def embed(files: DataFrame, make_decoder: Callable[[], Decoder], make_encoder: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """``path, width, height, phash, embedding`` of files with ``content``; nulls where a file can't be decoded.

    The model is made once per task and sees ``batch`` pictures at a time. If it fails on a batch, the vectors of
    that batch alone are null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, encode = make_decoder(), make_encoder()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                pixels = [decode(bytes(c)) for c in part["content"]]
                good = [k for k, p in enumerate(pixels) if p is not None]
                vectors: list = [None] * len(part)
                try:
                    for k, v in zip(good, encode([pixels[k] for k in good]) if good else [], strict=True):
                        vectors[k] = (np.asarray(v, np.float32) / max(float(np.linalg.norm(v)), 1e-8)).tolist()
                except Exception:
                    vectors = [None] * len(part)
                yield pd.DataFrame({
                    "path": part["path"].to_numpy(), "width": [0 if p is None else p.shape[1] for p in pixels], "height": [0 if p is None else p.shape[0] for p in pixels],
                    "phash": [None if p is None else dct_hash(p) for p in pixels], "embedding": vectors,
                })

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, phash array<long>, embedding array<float>")
