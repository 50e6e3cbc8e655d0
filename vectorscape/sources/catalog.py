"""Catalogue loading in two modes, which differ on purpose.

``load_catalog`` joins metadata and affect values, as a table: incomplete rows go, rows
with repeated ids multiply. ``load_split`` follows a split file: the last row of an id
wins, missing metadata raises, missing affect rows are skipped and bad cells raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorscape.functions.text import assign_labels, consolidate, has_valid_category, is_blank, optional, parse_float, parse_tags, required
from vectorscape.sources.schemas import AV_COLUMNS, METADATA_COLUMNS, SPLIT_COLUMNS, TAG_GROUPS, rename

__all__ = ["assign_labels", "complete_rows", "files_below", "filter_tracks", "has_tags_in", "last_wins", "load_catalog", "load_split", "read_csv", "sample_uniform", "tags_of", "to_tracks"]

# What pandas takes for a missing value.
NULL_WORDS = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "<NA>", "#N/A", "-nan", "-NaN", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """All cells as text, quoted and multi-line ones included, columns checked and renamed."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="utf-8")
    return rename(df, columns, path)


def nulls_by_word(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.col(c).isin(*NULL_WORDS), F.col(c)).alias(c) for c in df.columns))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows whose four tag columns are neither null nor blank, with both affect values."""
    keep = ~is_blank(F.col("mood_all")) & ~is_blank(F.col("genre")) & ~is_blank(F.col("theme")) & ~is_blank(F.col("style"))
    for c in ("arousal", "valence"):
        keep &= F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return df.filter(keep)


def to_tracks(df: DataFrame, audio_root: str, quadrant: str = "quadrant", legacy_nan_strings: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """One select from catalogue columns to track columns; ``also`` are kept as they are."""

    def name(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("nan")) if legacy_nan_strings else F.col(c)

    genres = parse_tags(F.col("genre"))
    return df.select(
        F.col("song_id").alias("track_id"), F.concat_ws("/", F.lit(audio_root.rstrip("/")), F.col(quadrant), F.concat("song_id", F.lit(".mp3"))).alias("audio_path"),
        F.col(quadrant).alias("quadrant"), parse_float(F.col("duration"), 0.0).alias("duration_s"), name("artist").alias("artist"), name("title").alias("title"),
        "arousal", "valence", parse_tags(F.col("mood_all")).alias("mood_tags"), genres.alias("genre_tags"), consolidate(genres).alias("genre_tags_consolidated"),
        parse_tags(F.col("theme")).alias("theme_tags"), parse_tags(F.col("style")).alias("style_tags"), *also,
    )


def files_below(spark: SparkSession, root: str, pattern: str = "*.mp3") -> DataFrame:
    """(path) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def with_audio(tracks: DataFrame, files: DataFrame) -> DataFrame:
    return tracks.join(files.select(F.col("path").alias("audio_path")), "audio_path", "left_semi")


def load_catalog(metadata: DataFrame, affect: DataFrame, audio_root: str = "audio", files: DataFrame | None = None, require_valid_genre: bool = True, **how) -> DataFrame:
    """Tracks from renamed metadata and affect tables, both as text."""
    av = nulls_by_word(affect).select("song_id", parse_float(F.col("arousal")).alias("arousal"), parse_float(F.col("valence")).alias("valence"))
    df = complete_rows(nulls_by_word(metadata).join(av, "song_id"))
    if require_valid_genre:
        df = df.filter(has_valid_category(parse_tags(F.col("genre"))))
    tracks = to_tracks(df, audio_root, **how)
    return tracks if files is None else with_audio(tracks, files)


def last_wins(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key, by ``order`` or by the order of reading."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    w = Window.partitionBy(key).orderBy(F.desc("_at"))
    return df.withColumn("_at", at).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_at")


def load_split(metadata: DataFrame, affect: DataFrame, split: DataFrame, audio_root: str = "audio", files: DataFrame | None = None, durations: DataFrame | None = None, split_name: str = "train") -> DataFrame:
    """Tracks of a split file, with their ``position`` in it. ``durations`` (track_id, duration_s) stand in where metadata has none."""
    meta = last_wins(metadata, "song_id").drop("quadrant").withColumn("_known", F.lit(True))
    av = last_wins(affect, "song_id").select("song_id", required(F.col("arousal"), "arousal").cast("double").alias("arousal"), required(F.col("valence"), "valence").cast("double").alias("valence"))
    rows = split.select(required(F.col("song_id"), "split").alias("song_id"), required(F.col("quadrant"), "split").alias("quadrant"), F.monotonically_increasing_id().alias("position"))
    df = rows.join(meta, "song_id", "left")
    df = df.filter(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("no metadata for "), F.col("song_id"))).cast("boolean")))
    df = df.drop("_known").join(av, "song_id")
    duration = optional(F.col("duration")).try_cast("double")
    df = df.withColumns({"artist": F.coalesce(optional(F.col("artist")), F.lit("")), "title": F.coalesce(optional(F.col("title")), F.lit(""))})
    tracks = to_tracks(df.withColumn("duration", duration.cast("string")), audio_root, also=("position",)).withColumn("split", F.lit(split_name))
    if durations is not None:
        other = durations.select("track_id", F.when(F.col("duration_s") > 0, F.col("duration_s")).alias("_d"))
        tracks = tracks.join(other, "track_id", "left").withColumn("duration_s", F.when(F.isnan("duration_s") | (F.col("duration_s") > 0), F.col("duration_s")).otherwise(F.coalesce("_d", F.lit(0.0)))).drop("_d")
    return tracks if files is None else with_audio(tracks, files)


def tags_of(group: str) -> Column:
    """The tags of a group; genres are the consolidated ones, any other name means styles."""
    return F.col({"mood": "mood_tags", "genre": "genre_tags_consolidated", "theme": "theme_tags"}.get(group, "style_tags"))


def has_tags_in(groups: list[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out &= F.size(tags_of(g)) > 0
    return out


def sample_uniform(df: DataFrame, n: int, key: str, seed: int = 7, order: str | None = None) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same for a seed: those with the smallest hashes, sorted by ``order`` if given."""
    if n < 1:
        raise ValueError("n must be positive")
    out = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return out.orderBy(order) if order else out


def filter_tracks(tracks: DataFrame, groups: list[str] = (), sampling: str = "none", sample_size: int | None = None, seed: int = 7) -> DataFrame:
    """Tracks with tags in all groups, then sampled if asked."""
    if sampling not in ("none", "uniform"):
        raise ValueError(f"unknown sampling strategy {sampling!r}")
    if sampling != "none" and (sample_size is None or sample_size <= 0):
        raise ValueError("sampling needs a positive sample_size")
    out = tracks.filter(has_tags_in(list(groups)))
    return out if sampling == "none" else sample_uniform(out, sample_size, "track_id", seed, "position" if "position" in out.columns else None)


METADATA, AFFECT, SPLIT, GROUPS = METADATA_COLUMNS, AV_COLUMNS, SPLIT_COLUMNS, TAG_GROUPS
