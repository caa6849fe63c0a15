"""Names and labels of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_label(seconds: Column) -> Column:
    """10m42s; minutes go on counting past an hour."""
    return F.format_string("%dm%02ds", F.floor(seconds / 60).cast("bigint"), F.floor(seconds % 60).cast("int"))


def clip_name(number: Column, start: Column) -> Column:
    return F.format_string("clip_%03d_%s.mp4", number, time_label(start))


def vertical_name(number: Column, start: Column) -> Column:
    return F.format_string("tiktok_%03d_%s.mp4", number, time_label(start))


def folder_of(path: Column) -> Column:
    """What stands before the file name, with one slash at its end; the root's slashes stay as they are."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)[^/]*$", 1), r"(?<=[^/])/+$", "/")


def stem_of(path: Column) -> Column:
    """File name without folder and last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def beside(path: Column, suffix: str) -> Column:
    """The folder of ``path`` with its stem and a suffix."""
    return F.concat(folder_of(path), stem_of(path), F.lit(suffix))


def default_output(path: Column) -> Column:
    return beside(path, "_highlight.mp4")


def clips_folder(path: Column) -> Column:
    return beside(path, "_clips")


def vertical_folder(path: Column) -> Column:
    return beside(path, "_tiktoks")


def concat_line(path: Column) -> Column:
    """One line of a concatenation list; quotes in a path are escaped."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))
