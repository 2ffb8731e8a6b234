"""Text functions: links, paths, clock and percent readings, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The link pattern and the video extensions that are taken in.
LINK = r"""https?://[^\s"'<>]+"""
EXTENSIONS = ("mp4", "mkv", "avi", "mov", "flv", "wmv")
# Names of the detectors.
ENGINES = {"content": "ContentDetector 内容变化", "adaptive": "AdaptiveDetector 自适应智能", "precise": "HighPrecision 高精度模型"}


def links(text: Column) -> Column:
    """All links of a text in order, trimmed, commas and semicolons at their ends gone."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(F.trim(u), "[,;]+$", ""))


def distinct_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, url: each document's links, the first of those that differ in case only.

    Folded inside each row: no shuffle, since a text's links are already together.
    """
    found = links(F.col(text_col))
    folded = F.aggregate(
        found,
        F.array().cast("array<string>"),
        lambda acc, u: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(u)), acc).otherwise(F.array_append(acc, u)),
    )
    return df.select(F.col(id_col), F.posexplode(folded).alias("pos", "url"))


def has_link(text: Column) -> Column:
    return F.lower(text).contains("http")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def directory(path: Column) -> Column:
    """The folder of a path: empty for a bare name, the separator itself for a file right under the root."""
    return F.when(path.rlike(r"^[/\\][^/\\]*$"), F.substring(path, 1, 1)).otherwise(F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """In capitals, without the dot; empty if there is none."""
    return F.upper(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def is_video(path: Column) -> Column:
    return F.lower(extension(path)).isin(*EXTENSIONS)


def clock_seconds(text: Column) -> Column:
    """Seconds of the first ``Duration: h:m:s`` in a text, else null."""
    pattern = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    h, m, s = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2, 3))
    return h * 3600 + m * 60 + s


def percent(line: Column) -> Column:
    """Percentage of a download line, if it has decimals; 0 to 100."""
    x = F.when(line.contains("[download]"), F.regexp_extract(line, r"(\d+\.\d+)%", 1)).try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def positive(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(x > 0, x)


def duration(probe: Column, log: Column) -> Column:
    """Probed seconds if positive, else those a log states, else an error."""
    return F.coalesce(positive(probe), clock_seconds(log), F.raise_error(F.lit("no duration")).cast("double"))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")


def error_text(lines: Column, most: int = 20) -> Column:
    """The first non-blank lines, joined."""
    return F.array_join(F.slice(F.filter(lines, lambda x: ~is_blank(x)), 1, most), "\n")


def engine_name(engine: Column) -> Column:
    out = F.lit(ENGINES["content"])
    for key in ("adaptive", "precise"):
        out = F.when(engine == key, ENGINES[key]).otherwise(out)
    return out


def language(preference: Column, system: Column) -> Column:
    """An explicit preference, else Chinese on a Chinese system, else English."""
    return F.when(preference.isin("zh", "en"), preference).when(F.lower(system) == "zh", "zh").otherwise("en")


def localised(keys: DataFrame, catalog: DataFrame, key_col: str, lang: Column) -> DataFrame:
    """``keys`` with their text in a language; an unknown key is its own text.  Catalog columns: key, zh, en.

    A left join that Spark broadcasts if the catalog's statistics allow it.
    """
    text = catalog.select(F.col("key").alias(key_col), F.when(lang == "zh", F.col("zh")).otherwise(F.col("en")).alias("text"))
    return keys.join(text, key_col, "left").withColumn("text", F.coalesce("text", F.col(key_col)))


def formatted(text: Column, *values: Column) -> Column:
    """Puts values in place of {0}, {1}, ..."""
    for k, v in enumerate(values):
        text = F.replace(text, F.lit("{%d}" % k), v.cast("string"))
    return text
