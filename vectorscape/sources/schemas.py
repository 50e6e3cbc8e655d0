"""Schemas of the inputs, and the checks of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Headers of the input files, and the names that the engine uses.
METADATA_COLUMNS = {
    "Song": "song_id", "Quadrant": "quadrant", "Artist": "artist", "Title": "title", "Duration": "duration", "Moods": "mood", "MoodsAll": "mood_all",
    "MoodsAllWeights": "mood_all_weights", "Genres": "genre", "GenreWeights": "genre_weights", "Themes": "theme", "ThemeWeights": "theme_weights", "Styles": "style", "StyleWeights": "style_weights",
}
AV_COLUMNS = {"Song": "song_id", "Arousal": "arousal", "Valence": "valence"}
SPLIT_COLUMNS = {"Song": "song_id", "Quadrant": "quadrant"}
TAG_GROUPS = ("mood", "genre", "theme", "style")


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def require_columns(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """``df``, or ValueError that names the source and the columns it lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{source} lacks columns: {', '.join(missing)}")
    return df


def rename(df: DataFrame, columns: dict[str, str], source: str) -> DataFrame:
    """Only the named columns, renamed."""
    return require_columns(df, list(columns), source).select(*(df[a].alias(b) for a, b in columns.items()))
