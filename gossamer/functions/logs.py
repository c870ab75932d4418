"""Log lines: layout, level tags, colours, highlighting and ANSI escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and colours of the log levels, and the ANSI codes of the colours.
TAGS = {"Trace": "trce", "Debug": "dbug", "Information": "info", "Warning": "warn", "Error": "fail", "Critical": "crit"}
FOREGROUND = {
    "Black": "\x1b[30m", "DarkGray": "\x1b[1m\x1b[30m", "DarkRed": "\x1b[31m", "DarkGreen": "\x1b[32m", "DarkYellow": "\x1b[33m", "DarkBlue": "\x1b[34m", "DarkMagenta": "\x1b[35m", "DarkCyan": "\x1b[36m", "Gray": "\x1b[37m",
    "Red": "\x1b[1m\x1b[31m", "Green": "\x1b[1m\x1b[32m", "Yellow": "\x1b[1m\x1b[33m", "Blue": "\x1b[1m\x1b[34m", "Magenta": "\x1b[1m\x1b[35m", "Cyan": "\x1b[1m\x1b[36m", "White": "\x1b[1m\x1b[37m",
}
BACKGROUND = {"Black": "\x1b[40m", "DarkRed": "\x1b[41m", "DarkGreen": "\x1b[42m", "DarkYellow": "\x1b[43m", "DarkBlue": "\x1b[44m", "DarkMagenta": "\x1b[45m", "DarkCyan": "\x1b[46m", "Gray": "\x1b[47m"}
#: level -> (tag foreground, tag background, message, highlight)
COLOURS = {
    "Trace": ("Blue", "Black", "Blue", "DarkCyan"),
    "Debug": ("Blue", "Black", "Blue", "DarkCyan"),
    "Information": ("DarkGreen", "Black", "DarkGray", "Gray"),
    "Warning": ("Yellow", "Black", "DarkGray", "Gray"),
    "Error": ("Black", "DarkRed", "DarkGray", "Gray"),
    "Critical": ("White", "DarkRed", "DarkGray", "Gray"),
}
RESET_FOREGROUND, RESET_BACKGROUND = "\x1b[39m\x1b[22m", "\x1b[49m"


def _choose(value: Column, table: dict[str, str], otherwise: Column | str | None) -> Column:
    out = None
    for key, result in table.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out.otherwise(otherwise)


def tag(level: Column) -> Column:
    return _choose(level, TAGS, F.raise_error(F.concat(F.lit("unknown log level "), level)).cast("string"))


def line(ts: Column, level: Column, message: Column, exception: Column) -> Column:
    """`HH:mm:ss.fff tag: message exception`, null where message and exception are both null."""
    text = F.concat(F.date_format(ts, "HH:mm:ss.SSS"), F.lit(" "), tag(level), F.lit(": "), F.coalesce(message, F.lit("")), F.coalesce(exception, F.lit("")))
    return F.when(message.isNotNull() | exception.isNotNull(), text)


def foreground(colour: Column) -> Column:
    return _choose(colour, FOREGROUND, RESET_FOREGROUND)


def background(colour: Column) -> Column:
    return _choose(colour, BACKGROUND, RESET_BACKGROUND)


def highlighted(message: Column, normal: str, strong: str) -> Column:
    """Every second piece between quotes in the strong colour."""
    pieces = F.split(message, "'", -1)
    return F.array_join(F.transform(pieces, lambda s, i: F.concat(F.when(i % 2 == 0, FOREGROUND[normal]).otherwise(FOREGROUND[strong]), s, F.lit(RESET_FOREGROUND))), "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9]{1,2}m", "")


def colour(level: Column, part: int) -> Column:
    return _choose(level, {k: v[part] for k, v in COLOURS.items()}, None)


def coloured(text: Column, fore: Column, back: Column) -> Column:
    """`text` between the escapes of its colours and those that reset them."""
    return F.concat(background(back), foreground(fore), text, F.lit(RESET_FOREGROUND), F.lit(RESET_BACKGROUND))


def segments(text: Column) -> Column:
    """The pieces of a text with ANSI escapes: array of struct(codes, text), codes being the numbers in force before it."""
    pieces = F.split(text, "\x1b\\[", -1)
    found = F.transform(
        pieces,
        lambda p, i: F.struct(
            F.when(i > 0, F.regexp_extract(p, "^([0-9]{1,2})m", 1)).otherwise("").alias("code"),
            F.when(i > 0, F.regexp_replace(p, "^[0-9]{1,2}m", "")).otherwise(p).alias("text"),
        ),
    )
    return F.filter(found, lambda s: (s["code"] != "") | (s["text"] != ""))
