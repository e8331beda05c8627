"""Column functions on texts, names, paths and command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARCHIVE_NAMES = r"\.(jar|war|ear|aar|zip)$"


def fold(text: Column) -> Column:
    """Lower-case A-Z alone; unlike lower(), no other letter becomes an ASCII one."""
    return F.translate(text, UPPER, LOWER)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def simple_name(internal: Column) -> Column:
    return F.substring_index(internal, "/", -1)


def human_size(size: Column) -> Column:
    """Bytes as B, then KB, MB, GB and TB with one decimal."""
    size = size.cast("double")
    out = F.format_string("%.1f TB", size / 2.0**40)
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(size < 2.0 ** (power + 10), F.format_string(f"%.1f {unit}", size / 2.0**power)).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def tail(text: Column, size: int) -> Column:
    """The end of a long text, behind an ellipsis."""
    return F.when(F.length(text) > size, F.concat(F.lit("…"), F.right(text, F.lit(size - 1)))).otherwise(text)


def manifest_value(text: Column, key: str) -> Column:
    """The value of the first line ``key: value``, whatever the key's case; null if missing or empty."""
    return F.nullif(F.regexp_extract(text, rf"(?im)^[ \t]*{key}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))


def command_words(command: Column) -> Column:
    """A command line split at blanks outside double quotes, without the quotes."""
    return F.transform(F.regexp_extract_all(command, F.lit(r'(?:[^ "]|"[^"]*")+'), F.lit(0)), lambda w: F.replace(w, F.lit('"'), F.lit("")))


def agent_paths(arguments: Column) -> Column:
    """Paths of -javaagent:, -agentpath: and -agentlib: arguments in any case, without their options."""
    agents = F.filter(arguments, lambda a: fold(a).rlike("^-(javaagent|agentpath|agentlib):"))
    return F.transform(agents, lambda a: F.regexp_extract(a, "^-[A-Za-z]+:([^=]*)", 1))


def path_list(paths: Column, separator: str = ";") -> Column:
    """The non-empty, trimmed items of a path list."""
    return F.filter(F.transform(F.split(paths, separator), F.trim), lambda p: p != "")


def unprintable(text: Column, first: int | None = None) -> Column:
    """How many of a text's (first) characters are not printable ASCII or a line break, return or tab."""
    text = F.left(text, F.lit(first)) if first else text
    return F.length(F.regexp_replace(text, r"[ -~\n\r\t]", ""))


def mostly_printable(text: Column) -> Column:
    """Over 85 % printable; null for a text without characters, of which no share can be told."""
    return F.try_divide(F.length(text) - unprintable(text), F.length(text)) > 0.85


def is_readable(text: Column) -> Column:
    """Over 85 % printable; a text without characters is not readable."""
    return F.coalesce(mostly_printable(text), F.lit(False))


def printable_runs(content: Column) -> Column:
    """Runs of at least four printable ASCII characters in binary content."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit("[ -~]{4,}"), F.lit(0))


def find_all(text: Column, needle: str, most: int = 5000) -> Column:
    """(begin, end) of the non-overlapping places of a needle, whatever its case, at most ``most``; offsets from 0."""
    parts = F.split(F.lower(text), r"\Q" + needle.lower().replace(r"\E", r"\E\\E\Q") + r"\E")
    lengths = F.transform(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(most))), F.length)
    n = len(needle)
    begins = F.aggregate(lengths, F.array().cast("array<int>"), lambda got, size: F.concat(got, F.array(F.coalesce(F.try_element_at(got, F.lit(-1)) + n, F.lit(0)) + size)))
    # try_element_at on an empty array is null, so the first place is the first length.
    return F.transform(begins, lambda b: F.struct(b.alias("begin"), (b + n).alias("end")))


def context_window(text: Column, position: Column, size: Column, around: int = 80, longest: int = 200) -> Column:
    """The printable line around a hit at ``position`` (from 1); a long one is cut to ``around`` characters on each side."""
    before = F.regexp_extract(F.left(text, position - 1), r"[^\x00-\x1F]*$", 0)
    hit = F.substr(text, position, size)
    after = F.regexp_extract(F.substr(text, position + size), r"^[^\x00-\x1F]*", 0)
    whole = F.concat(before, hit, after)
    left = F.when(F.length(before) > around, F.concat(F.lit("..."), F.right(before, F.lit(around)))).otherwise(before)
    right = F.when(F.length(after) > around, F.concat(F.left(after, F.lit(around)), F.lit("..."))).otherwise(after)
    return F.when(F.length(whole) > longest, F.concat(left, hit, right)).otherwise(whole)
