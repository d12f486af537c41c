"""Tables whose files were written under several schema versions.

Every version has a folder ``schema_version=N`` of its own below the table.
A read names all versions, so no file footer is looked into: one scan over
the merged schema, in which a column that a file lacks is null, and per
column one expression that takes it from where its row's version kept it.
A filter on ``schema_version`` prunes folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "schema_version"


@dataclass(frozen=True)
class Version:
    """``columns``: name -> type in the files. Against the version before:
    ``renamed``: new name -> old name; ``added``: new name -> SQL of its value
    for older rows. A column named in neither keeps its name; one that is no
    longer in ``columns`` was dropped."""

    number: int
    columns: dict[str, str]
    renamed: dict[str, str] = field(default_factory=dict)
    added: dict[str, str] = field(default_factory=dict)


# The columns of a listening history by schema version.
HISTORY_VERSIONS = (
    Version(1, {"track_key": "string", "artist": "string", "title": "string", "played_at": "timestamp_ntz",
                "genres": "array<string>", "popularity": "int", "audio_features": "string"}),
    Version(2, {"track_key": "string", "artist": "string", "title": "string", "played_at": "timestamp_ntz",
                "genres": "array<string>", "artist_popularity": "int", "track_popularity": "int",
                "pending_enrichment": "boolean"},
            renamed={"artist_popularity": "popularity"},
            added={"track_popularity": "null", "pending_enrichment": "false"}),
    Version(3, {"track_key": "string", "artist": "string", "title": "string", "played_at": "timestamp_ntz",
                "genres": "array<string>", "artist_popularity": "int", "track_popularity": "int",
                "pending_enrichment": "boolean", "sources": "array<string>"},
            added={"sources": "array()"}),
)


def merged_columns(versions: Sequence[Version]) -> dict[str, str]:
    """All columns of all versions; a name may not change its type."""
    out: dict[str, str] = {}
    for v in versions:
        for name, kind in v.columns.items():
            if out.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is {out[name]} in one version and {kind} in version {v.number}")
    return out


def value_in(versions: Sequence[Version], nth: int, column: str) -> Column:
    """The newest version's ``column`` as rows of ``versions[nth]`` have it."""
    for later in reversed(versions[nth + 1:]):
        if column in later.added:
            return F.expr(later.added[column])
        column = later.renamed.get(column, column)
    if column not in versions[nth].columns:
        raise ValueError(f"version {versions[nth].number} has no {column}, and no later version adds it")
    return F.col(column)


def write_version(df: DataFrame, path: str, version: Version, mode: str = "overwrite") -> None:
    """Write rows as files of ``version``; other versions' files stay as they are."""
    df.select(*[F.col(c).cast(t).alias(c) for c, t in version.columns.items()]) \
        .write.mode(mode).parquet(f"{path}/{TAG}={version.number}")


def read_versions(spark: SparkSession, path: str, versions: Sequence[Version]) -> DataFrame:
    """All rows in the columns of the newest version, with ``schema_version``.
    Rows of a version that is not among ``versions`` fail the read."""
    fields = ", ".join(f"`{c}` {t}" for c, t in {**merged_columns(versions), TAG: "int"}.items())
    rows = spark.read.schema(fields).parquet(path)
    unknown = F.raise_error(F.concat(F.lit("unknown schema version "), F.col(TAG).cast("string")))

    def value(column: str, kind: str) -> Column:
        cases = F
        for nth, v in enumerate(versions):
            cases = cases.when(F.col(TAG) == v.number, value_in(versions, nth, column).cast(kind))
        return cases.otherwise(unknown.cast(kind)).alias(column)

    return rows.select(*[value(c, t) for c, t in versions[-1].columns.items()], TAG)
