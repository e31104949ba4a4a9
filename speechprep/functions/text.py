"""Text expressions: stripping, prefixes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AUDIO_EXTENSION, COVERAGE_THRESHOLD, VOICE_REFERENCE_PREFIX

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def words(text: Column) -> Column:
    """Whitespace-separated words of the whole text."""
    return F.array_remove(F.split(strip(text), r"(?U)[\s\x1c-\x1f]+"), "")


def is_audio_name(name: Column) -> Column:
    return F.lower(name).endswith(AUDIO_EXTENSION)


def join_path(folder: Column | str, name: Column) -> Column:
    """Folder and name joined; an absolute name stands alone."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    base = F.when(folder.endswith("/") | (folder == ""), folder).otherwise(
        F.concat(folder, F.lit("/"))
    )
    return F.when(name.startswith("/"), name).otherwise(F.concat(base, name))


def plain_path(path: Column) -> Column:
    """A local path without ``file:``; any other path as it is."""
    return F.regexp_replace(path, "^file:/*", "/")


def speaker_prefix(speaker: Column, text: Column) -> Column:
    return F.concat(F.coalesce(speaker, F.lit("None")), F.lit(": "), text)


def voice_prefix(voice: Column, text: Column) -> Column:
    """``voice: text`` when a voice is named, else the text."""
    named = voice.isNotNull() & (voice != "")
    return F.when(named, F.concat(voice, F.lit(": "), text)).otherwise(text)


def reference_prefix(text: Column) -> Column:
    return F.concat(F.lit(VOICE_REFERENCE_PREFIX), text)


def preview(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 50), F.lit("..."))


def output_name(index: Column, prefix: str = "generated_audio") -> Column:
    """1-based, at least three digits: ``lpad`` would cut a fourth digit off."""
    return F.concat(F.lit(prefix), F.format_string("_%03d.wav", index + 1))


def batch_name(index: Column, text: Column) -> Column:
    stem = F.replace(F.substring(text, 1, 20), F.lit(" "), F.lit("_"))
    return F.format_string("batch_%03d_%s.wav", index + 1, stem)


def coverage_flag(rate: Column) -> Column:
    return F.when(rate < COVERAGE_THRESHOLD, "low").otherwise("good")
