"""56 features of a waveform, in NumPy inside one Arrow map over tracks.

Waveforms are never shuffled: a row's samples are decoded and described in the task that
reads them. Silent or very short signals give 0 in the fields that can't be computed.
Pitch, beats and key are this module's own estimators; other libraries' figures for them
differ in detail.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.functions.tonal import KEYS, MAJOR, MINOR

RATE = 44_100
# Names of the features, in order.
RHYTHM = (
    "tempo_bpm", "onset_strength_mean", "onset_strength_std", "beat_interval_mean", "beat_interval_std", "beat_interval_cv",
    "bpm_first_peak", "bpm_first_weight", "bpm_first_spread", "bpm_second_peak", "bpm_second_weight", "bpm_second_spread", "bpm_peak_ratio", "bpm_histogram_entropy",
    "rhythm_transform_mean", "rhythm_transform_std", "rhythm_transform_max", "rhythm_transform_entropy",
    "beats_loudness_mean", "beats_loudness_std", "beats_low_ratio", "beats_mid_ratio", "beats_high_ratio",
)
SPECTRAL = ("mfcc_1_mean", "mfcc_2_mean", "mfcc_3_mean", "mfcc_4_mean", "mfcc_5_mean", "spectral_centroid_mean", "spectral_centroid_std", "spectral_contrast_mean", "inharmonicity_mean", "inharmonicity_std")
TONAL = (
    "chroma_entropy", "major_alignment", "minor_alignment", *(f"hpcp_{i}" for i in range(12)), "hpcp_entropy", "hpcp_std", "hpcp_max", "hpcp_temporal_std",
    "key_strength", "is_minor", "key_cos", "key_sin",
)
FEATURES = RHYTHM + SPECTRAL + TONAL
#: Loudness bands in Hz; the first two are low, the next two middle, the last high.
BANDS = (20, 150, 400, 3200, 7000, 22050)
# Key profiles of Krumhansl and Kessler (1982).
MAJOR_PROFILE = np.array([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88])
MINOR_PROFILE = np.array([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])
EPS = 1e-12


def mono(raw: bytes, width: int, channels: int, big: bool = False, signed_bytes: bool = False) -> np.ndarray:
    """The mean of all channels of linear PCM, in [-1, 1]; ValueError if there are no samples."""
    frame = width * channels
    raw = raw[: len(raw) // frame * frame] if frame else b""
    if not raw:
        raise ValueError("the audio is empty")
    if width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, :: -1 if big else 1].astype(np.int32)
        x = (x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8
    elif width == 1:
        x = np.frombuffer(raw, np.int8).astype(np.float64) if signed_bytes else np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"{'>' if big else '<'}i{width}").astype(np.float64)
    else:
        raise ValueError(f"samples of {width} bytes")
    return (x.reshape(-1, channels).mean(1) / float(1 << (8 * width - 1))).astype(np.float32)


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate, from 8 to 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        return mono(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()


def decode_aiff(content: bytes) -> tuple[np.ndarray, int]:
    """The same from AIFF: a COMM chunk that describes the samples, whose rate is an 80-bit float, and an SSND chunk."""
    found, at = {}, 12
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "big")
        found[content[at : at + 4]] = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if content[8:12] != b"AIFF" or b"COMM" not in found or b"SSND" not in found:
        raise ValueError("not an AIFF file of linear PCM")
    head = found[b"COMM"]
    channels, bits = int.from_bytes(head[:2], "big"), int.from_bytes(head[6:8], "big")
    exponent, mantissa = int.from_bytes(head[8:10], "big") & 0x7FFF, int.from_bytes(head[10:18], "big")
    return mono(found[b"SSND"][8 + int.from_bytes(found[b"SSND"][:4], "big") :], (bits + 7) // 8, channels, big=True, signed_bytes=True), round(mantissa * 2.0 ** (exponent - 16383 - 63))


def decode_au(content: bytes) -> tuple[np.ndarray, int]:
    """The same from AU files of linear PCM: encodings 2 to 5 have 1 to 4 bytes a sample."""
    start, size, encoding, rate, channels = (int.from_bytes(content[k : k + 4], "big") for k in range(4, 24, 4))
    if not 2 <= encoding <= 5:
        raise ValueError("not an AU file of linear PCM")
    raw = content[start:] if size == 0xFFFFFFFF else content[start : start + size]
    return mono(raw, encoding - 1, channels, big=True, signed_bytes=True), rate


def decode_pcm(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate from WAV, AIFF or AU, told by their first bytes. Compressed formats need a decoder of the caller's."""
    for magic, decode in ((b"RIFF", decode_wav), (b"FORM", decode_aiff), (b".snd", decode_au)):
        if content[:4] == magic:
            return decode(content)
    raise ValueError("neither WAV nor AIFF nor AU")


def resample(y: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    if rate == to or len(y) == 0:
        return y
    n = max(1, round(len(y) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(y)), y).astype(np.float32)


def frames(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames from range(0, len - size, hop): one that ends exactly at the end is left out."""
    starts = np.arange(0, len(y) - size, hop)
    return y[starts[:, None] + np.arange(size)] if len(starts) else np.zeros((0, size), y.dtype)


def spectrum(y: np.ndarray, size: int = 2048, hop: int = 512, padded: bool = True, window: Callable = np.hanning) -> np.ndarray:
    """Magnitudes, a row for each frame."""
    if padded:
        y = np.pad(y, (size // 2, size // 2 + 1))
    return np.abs(np.fft.rfft(frames(y, size, hop) * window(size), axis=1))


def mel_filters(rate: int, size: int, bands: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None], (hz[2:, None] - f) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def entropy(p: np.ndarray) -> float:
    total = float(np.sum(p))
    if total <= 0:
        return 0.0
    q = np.clip(np.asarray(p, float) / total, EPS, 1)
    return float(-(q * np.log2(q)).sum())


def onset_envelope(y: np.ndarray, rate: int) -> np.ndarray:
    mel = spectrum(y) ** 2 @ mel_filters(rate, 2048, 128).T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max(initial=-100.0) - 80)
    return np.concatenate([[0.0], np.maximum(0, np.diff(db, axis=0)).mean(1)]) if len(db) else np.zeros(0)


def tempo(onset: np.ndarray, rate: int) -> float:
    """The lag of the greatest autocorrelation under a log-normal weight around 120 bpm."""
    if len(onset) < 4 or onset.std() == 0:
        return 0.0
    x = onset - onset.mean()
    auto = np.correlate(x, x, "full")[len(x) - 1 :]
    lags = np.arange(1, len(auto))
    bpm = 60 * rate / 512 / lags
    on = (bpm >= 30) & (bpm <= 300)
    if not on.any():
        return 0.0
    return float(bpm[on][np.argmax(auto[1:][on] * np.exp(-0.5 * np.log2(bpm[on] / 120) ** 2))])


def beat_times(onset: np.ndarray, bpm: float, rate: int) -> np.ndarray:
    """Peaks of the onset envelope along the best grid of the tempo."""
    if bpm <= 0:
        return np.zeros(0)
    step = 60 / bpm * rate / 512
    offsets = np.arange(0, step)
    grids = [g[g < len(onset)] for g in (np.round(np.arange(o, len(onset), step)).astype(int) for o in offsets)]
    grid = max(grids, key=lambda g: onset[g].sum())
    reach = max(1, int(step / 8))
    at = [max(range(max(0, g - reach), min(len(onset), g + reach + 1)), key=onset.__getitem__) for g in grid]
    return np.unique(at) * 512 / rate


def bpm_histogram(intervals: np.ndarray) -> dict[str, float]:
    bpm = 60 / intervals[intervals > 0]
    h = np.bincount(np.clip(np.round(bpm), 0, 249).astype(int), minlength=250) / max(1, len(bpm))
    out = {"bpm_histogram_entropy": entropy(h)}
    left = h.copy()
    for name in ("first", "second"):
        peak = int(left.argmax())
        low, high = max(0, peak - 4), peak + 5
        weight = float(left[low:high].sum())
        out |= {f"bpm_{name}_peak": float(peak) if weight > 0 else 0.0, f"bpm_{name}_weight": weight, f"bpm_{name}_spread": 1 - float(left[peak]) / weight if weight > 0 else 0.0}
        left[low:high] = 0
    out["bpm_peak_ratio"] = out["bpm_second_weight"] / out["bpm_first_weight"] if out["bpm_first_weight"] > 0 else 0.0
    return out


def rhythm(y: np.ndarray, rate: int) -> dict[str, float]:
    out = dict.fromkeys(RHYTHM, 0.0)
    onset = onset_envelope(y, rate)
    if len(onset) == 0:
        return out
    out |= {"tempo_bpm": tempo(onset, rate), "onset_strength_mean": float(onset.mean()), "onset_strength_std": float(onset.std())}
    beats = beat_times(onset, out["tempo_bpm"], rate)
    if len(beats) > 2:
        gaps = np.diff(beats)
        mean, std = float(gaps.mean()), float(gaps.std())
        out |= {"beat_interval_mean": mean, "beat_interval_std": std, "beat_interval_cv": std / mean if mean > 0 else 0.0} | bpm_histogram(gaps)
    mel = spectrum(y, 2048, 1024, padded=False) @ mel_filters(rate, 2048, 40).T
    if len(mel) >= 8:
        at = np.arange(0, len(mel) - 7, 4)
        rt = np.abs(np.fft.rfft(np.diff(mel, axis=0, prepend=mel[:1])[at[:, None] + np.arange(8)], axis=1)).sum(2).ravel()
        out |= {"rhythm_transform_mean": float(rt.mean()), "rhythm_transform_std": float(rt.std()), "rhythm_transform_max": float(rt.max()), "rhythm_transform_entropy": entropy(rt)}
    if len(beats) >= 2:
        half = int(0.05 * rate)
        parts = [y[max(0, int(b * rate) - half) : int(b * rate) + half] for b in beats]
        power = [(np.abs(np.fft.rfft(p)) ** 2, np.fft.rfftfreq(len(p), 1 / rate)) for p in parts if len(p) > 1]
        energy = np.array([p.sum() / len(p) for p, _ in power])
        ratio = np.array([[p[(f >= a) & (f < b)].sum() for a, b in zip(BANDS, BANDS[1:])] / max(p.sum(), EPS) for p, f in power])
        if len(energy):
            out |= {"beats_loudness_mean": float(energy.mean()), "beats_loudness_std": float(energy.std()), "beats_low_ratio": float(ratio[:, :2].sum(1).mean()), "beats_mid_ratio": float(ratio[:, 2:4].sum(1).mean()), "beats_high_ratio": float(ratio[:, 4].mean())}
    return out


def peaks(row: np.ndarray, f: np.ndarray, low: float, high: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and magnitudes of the greatest local maxima."""
    at = np.flatnonzero((row[1:-1] > row[:-2]) & (row[1:-1] >= row[2:]) & (row[1:-1] > 1e-5)) + 1
    at = at[(f[at] >= low) & (f[at] <= high)]
    at = at[np.argsort(-row[at], kind="stable")[:most]]
    return f[at], row[at]


def inharmonicity(y: np.ndarray, rate: int) -> tuple[float, float]:
    """How far peaks lie from the multiples of the lowest strong one, weighted by energy."""
    s, f = spectrum(y, 2048, 512, padded=False), np.fft.rfftfreq(2048, 1 / rate)
    values = []
    for row in s:
        freq, mag = peaks(row, f, 20, rate / 2, 50)
        if len(freq) > 1:
            base = freq[mag >= 0.1 * mag.max()].min()
            off = np.abs(freq - base * np.maximum(1, np.round(freq / base)))
            values.append(2 * (off * mag**2).sum() / (base * (mag**2).sum()))
    return (float(np.mean(values)), float(np.std(values))) if values else (0.0, 0.0)


def spectral(y: np.ndarray, rate: int) -> dict[str, float]:
    out = dict.fromkeys(SPECTRAL, 0.0)
    s, f = spectrum(y), np.fft.rfftfreq(2048, 1 / rate)
    if len(s) == 0:
        return out
    db = 10 * np.log10(np.maximum(s**2 @ mel_filters(rate, 2048, 128).T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    n = db.shape[1]
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(5)[:, None]) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    for i, v in enumerate((db @ basis.T).mean(0)):
        out[f"mfcc_{i + 1}_mean"] = float(v)
    total = s.sum(1)
    centroid = np.where(total > 0, s @ f / np.maximum(total, EPS), 0)
    edges = [0, *(200 * 2.0**k for k in range(6)), rate / 2]
    contrast = []
    for a, b in zip(edges, edges[1:]):
        band = np.sort(s[:, (f >= a) & (f <= b)], axis=1)
        k = max(1, round(0.02 * band.shape[1]))
        contrast.append(10 * np.log10(np.maximum(band[:, -k:].mean(1), 1e-10)) - 10 * np.log10(np.maximum(band[:, :k].mean(1), 1e-10)))
    out |= {"spectral_centroid_mean": float(centroid.mean()), "spectral_centroid_std": float(centroid.std()), "spectral_contrast_mean": float(np.mean(contrast))}
    out["inharmonicity_mean"], out["inharmonicity_std"] = inharmonicity(y, rate)
    return out


def chroma(y: np.ndarray, rate: int) -> np.ndarray:
    """Mean energy by pitch class from C, each frame scaled to a greatest of 1."""
    s, f = spectrum(y, 4096, 1024) ** 2, np.fft.rfftfreq(4096, 1 / rate)
    on = f > 25
    steps = 12 * np.log2(f[on] / 440) + 9
    fold = np.exp(-0.5 * (((steps[:, None] - np.arange(12) + 6) % 12 - 6) / 0.5) ** 2)
    c = s[:, on] @ fold
    return (c / np.maximum(c.max(1, keepdims=True), EPS)).mean(0) if len(c) else np.zeros(12)


def pitch_profiles(y: np.ndarray, rate: int) -> np.ndarray:
    """Energy of spectral peaks from 20 to 5000 Hz by pitch class from A, of sum 1, a row for each frame."""

    def window(n: int) -> np.ndarray:
        t = 2 * np.pi * np.arange(n) / n
        return 0.44959 - 0.49364 * np.cos(t) + 0.05677 * np.cos(2 * t)

    s, f = spectrum(y, 4096, 2048, padded=False, window=window), np.fft.rfftfreq(4096, 1 / rate)
    out = []
    for row in s:
        freq, mag = peaks(row, f, 20, 5000, 100)
        h = np.zeros(12)
        np.add.at(h, np.round(12 * np.log2(freq / 440)).astype(int) % 12, mag**2)
        out.append(h / h.sum() if h.sum() > 0 else h)
    return np.array(out).reshape(-1, 12)


def key(c: np.ndarray) -> dict[str, float]:
    """The best correlation of a pitch profile from C with the 24 turned key profiles."""
    if c.std() == 0:
        return {"key_strength": 0.0, "is_minor": 0.0, "key_cos": 0.0, "key_sin": 0.0}
    fits = [(float(np.corrcoef(c, np.roll(p, k))[0, 1]), k, minor) for minor, p in enumerate((MAJOR_PROFILE, MINOR_PROFILE)) for k in range(len(KEYS))]
    strength, k, minor = max(fits, key=lambda x: x[0])
    return {"key_strength": strength, "is_minor": float(minor), "key_cos": float(np.cos(2 * np.pi * k / 12)), "key_sin": float(np.sin(2 * np.pi * k / 12))}


def tonal(y: np.ndarray, rate: int) -> dict[str, float]:
    out = dict.fromkeys(TONAL, 0.0)
    c = chroma(y, rate)
    total = c.sum()
    if total > 0:
        out |= {"chroma_entropy": entropy(c), "major_alignment": float(c[list(MAJOR)].sum() / total), "minor_alignment": float(c[list(MINOR)].sum() / total)}
    h = pitch_profiles(y, rate)
    if len(h):
        mean = h.mean(0)
        out |= {f"hpcp_{i}": float(v) for i, v in enumerate(mean)}
        out |= {"hpcp_entropy": entropy(mean), "hpcp_std": float(mean.std()), "hpcp_max": float(mean.max()), "hpcp_temporal_std": float(h.std(0).mean())}
        out |= key(np.roll(mean, -3))
    return out


def describe(y: np.ndarray, rate: int) -> dict[str, float]:
    """All 56 features of a mono waveform."""
    y = resample(np.asarray(y, np.float32), rate)
    if len(y) == 0:
        raise ValueError("the audio is empty")
    return rhythm(y, RATE) | spectral(y, RATE) | tonal(y, RATE)


def extract_features(tracks: DataFrame, names: tuple[str, ...] = FEATURES, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_pcm) -> DataFrame:
    """(song_id, features): from (song_id, samples, rate), or (song_id, content) with files of a format that ``decode`` reads.

    Repeated ids raise, as their rows couldn't be told apart; a file that can't be decoded fails the job.
    """
    again = tracks.groupBy("song_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"song_id {again[0].song_id!r} is repeated")
    samples = "samples" in tracks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                y, rate = (np.array(b.column(1)[i].as_py(), np.float32), b.column(2)[i].as_py()) if samples else decode(b.column(1)[i].as_py())
                values = describe(y, rate)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([float(values[n])]) for n in names)], ["song_id", *names])

    schema = "song_id string, " + ", ".join(f"{n} double" for n in names)
    return tracks.select(*(("song_id", "samples", "rate") if samples else ("song_id", "content"))).mapInArrow(run, schema)


def header_duration(content: bytes) -> float:
    """Seconds by the header, without decoding."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes() / w.getframerate()


def decoded_duration(content: bytes) -> float:
    """Seconds by the samples that are there, at the rate that the file names."""
    y, rate = decode_pcm(content)
    return len(y) / rate


def durations(files: DataFrame, readers: Sequence[Callable[[bytes], float]] = (header_duration, decoded_duration)) -> DataFrame:
    """(track_id, duration_s) from (track_id, content): the first reader that gives more than 0; 0 where none does."""

    def seconds(content: bytes) -> float:
        for read in readers:
            try:
                if np.isfinite(x := float(read(content))) and x > 0:
                    return x
            except Exception:  # a reader of another format may raise anything; the next one is asked
                continue
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seconds(x) for x in b.column(1).to_pylist()], pa.float64())], ["track_id", "duration_s"])

    return files.select("track_id", "content").mapInArrow(run, "track_id string, duration_s double")


def extract_rhythm(tracks: DataFrame, **how) -> DataFrame:
    """``extract_features`` of the rhythm columns."""
    return extract_features(tracks, RHYTHM, **how)


def extract_spectral(tracks: DataFrame, **how) -> DataFrame:
    """``extract_features`` of the spectral columns."""
    return extract_features(tracks, SPECTRAL, **how)


def extract_tonal(tracks: DataFrame, **how) -> DataFrame:
    """``extract_features`` of the tonal columns."""
    return extract_features(tracks, TONAL, **how)


def synthetic_tracks(spark: SparkSession, tones: dict[str, list[float]], seconds: float = 2.0) -> DataFrame:
    """(song_id, samples, rate) of sums of sines, made in expressions."""
    rows = spark.createDataFrame(list(tones.items()), "song_id string, tones array<double>")
    time = F.transform(F.sequence(F.lit(0), F.lit(int(seconds * RATE) - 1)), lambda i: i / float(RATE))

    def sample(x):
        return F.aggregate("tones", F.lit(0.0), lambda a, f: a + F.sin(2 * np.pi * f * x)) / F.size("tones")

    return rows.select("song_id", F.transform(time, sample).cast("array<float>").alias("samples"), F.lit(RATE).alias("rate"))
