"""Embedding extraction by a model provider, in batches, one model for each Python worker.

A provider is any object with ``rate`` (samples a second that it takes), ``embed_audio`` (waveforms to a matrix) and,
if it can, ``embed_text`` (texts to a matrix). Operators take a factory, which runs where the rows are, so a model is
loaded once by a worker and never shipped. ``LetterShares`` and ``SignalShape`` are small deterministic providers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.operators.audio import decode_pcm, resample
from vectorscape.sources.config import ModelSpec

BATCH = 8
#: Number formats that providers may ask for; any other counts as float32.
DTYPES = {"float16": np.float16, "float32": np.float32, "float64": np.float64}
_LOADED: dict[str, Any] = {}


class Provider(Protocol):
    rate: int

    def embed_audio(self, waves: Sequence[np.ndarray]) -> np.ndarray: ...

    def embed_text(self, texts: Sequence[str]) -> np.ndarray: ...


class LetterShares:
    """Texts as shares of the vowels a, e, i, o, u and of blanks among their code points."""

    rate = 0
    letters = "aeiou "

    def embed_text(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([[t.count(c) / max(1, len(t)) for c in self.letters] for t in texts]).reshape(len(texts), len(self.letters))


class SignalShape:
    """Waveforms as their root mean square, mean, peak and mean absolute value."""

    def __init__(self, rate: int = 44_100):
        self.rate = rate

    def embed_audio(self, waves: Sequence[np.ndarray]) -> np.ndarray:
        wide = [w.astype(np.float64) for w in waves]
        return np.array([[np.sqrt((w**2).mean()), w.mean(), np.abs(w).max(), np.abs(w).mean()] for w in wide]).reshape(len(waves), 4)


def provider_for(spec: ModelSpec, factories: Mapping[str, Callable[[ModelSpec, type], Any]]) -> Callable[[], Any]:
    """The factory of a configured model; an unknown provider raises, an unknown dtype is float32."""
    if spec.provider not in factories:
        raise ValueError(f"unknown provider {spec.provider!r}; there are {', '.join(sorted(factories))}")
    make, dtype = factories[spec.provider], DTYPES.get(spec.dtype, np.float32)
    return lambda: make(spec, dtype)


def _embedded(rows: DataFrame, key: str, factory: Callable[[], Any], read: Callable[[Any, list], np.ndarray], batch_size: int) -> DataFrame:
    """(key, embedding array<float>) of rows (key, inputs ...), ``batch_size`` at a time."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _LOADED.get(name)
        if model is None:
            model = _LOADED[name] = factory()
        for b in batches:
            for k in range(0, b.num_rows, batch_size):
                part = b.slice(k, batch_size)
                out = np.asarray(read(model, part.to_pylist()), np.float32)
                if out.ndim != 2 or len(out) != part.num_rows or not np.isfinite(out).all():
                    raise RuntimeError(f"the provider gave {out.shape} for {part.num_rows} inputs, or values that aren't finite")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(out), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def extract_audio(tracks: DataFrame, factory: Callable[[], Any], batch_size: int = BATCH, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_pcm) -> DataFrame:
    """(track_id, embedding) from (track_id, content), files that ``decode`` reads, or (track_id, samples, rate).

    Waves are resampled to the provider's rate. Repeated ids raise; a track that can't be read fails the job.
    """
    if again := tracks.groupBy("track_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"track_id {again[0].track_id!r} is repeated")

    def wave_of(model, row: dict) -> np.ndarray:
        try:
            y, rate = (np.asarray(row["samples"], np.float32), row["rate"]) if "samples" in row else decode(row["content"])
            if len(y) == 0:
                raise ValueError("the audio is empty")
            return resample(y, rate, model.rate)
        except Exception as e:
            raise RuntimeError(f"track {row['track_id']!r} can't be read: {e}") from e

    columns = ("track_id", "samples", "rate") if "samples" in tracks.columns else ("track_id", "content")
    return _embedded(tracks.select(*columns), "track_id", factory, lambda model, rows: model.embed_audio([wave_of(model, r) for r in rows]), batch_size)


def extract_text(docs: DataFrame, factory: Callable[[], Any], key: str = "doc_id", text: str = "text", batch_size: int = BATCH) -> DataFrame:
    """(key, embedding) of texts; a null text is empty."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return _embedded(rows, key, factory, lambda model, of: model.embed_text([r["_text"] for r in of]), batch_size)


def audio_files(spark: SparkSession, paths: str | Sequence[str], ids: Sequence[str] | None = None) -> DataFrame:
    """(track_id, content) of a list of files; ids are the files' stems unless given, one for each path."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if ids is not None and len(ids) != len(paths):
        raise ValueError(f"{len(ids)} ids for {len(paths)} paths")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    if ids is None:
        return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("track_id"), "content")
    named = spark.createDataFrame([(i, p) for i, p in zip(ids, paths)], "track_id string, path string")
    return files.join(F.broadcast(named), "path").select("track_id", "content")  # the list that was passed in


def embed_query_audio(factory: Callable[[], Any], content: bytes, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_pcm) -> list[float]:
    """The vector of one query file, mono, at the provider's rate."""
    model = factory()
    y, rate = decode(content)
    return np.asarray(model.embed_audio([resample(y, rate, model.rate)]), np.float32)[0].tolist()


def embed_query_text(factory: Callable[[], Any], text: str) -> list[float]:
    return np.asarray(factory().embed_text([text]), np.float32)[0].tolist()
