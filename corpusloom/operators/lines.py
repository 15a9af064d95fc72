"""Line joins as regular expressions in the JVM, linear in the text: a match is one line break that goes.

Lines end at a newline only. White space at their ends goes first, so a line is blank or ends in another character.
"""

from __future__ import annotations

from pyspark.sql import Column

from corpusloom.functions.text import sub

#: White space inside a line.
BLANK = r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\p{Z}]"
#: What ends a sentence, so that the next line starts anew.
ENDINGS = ".!?;—–…"
SHORT_LINE = 80

#: A line that is joined with the next one: no sentence or section number ends it, and the next one is not blank.
_OPEN = rf"(?![^\n]*\p{{Nd}}\.\p{{Nd}}++\n)([^\n]+)(?<![{ENDINGS}])\n(?=[^\n])"
#: A group of lines starts at a line that the last match did not join; going on from there, lines need no such look.
_STARTS, _GOES_ON = r"(?:\A|^(?!\G))", r"\G(?!\A)"
#: An indented heading in front of its group is one as soon as a line is joined with it: that line is the last.
_INDENTED = rf"{_STARTS}{BLANK}++(?=#){_OPEN}([^\n]+)"
_FIRST = rf"{_STARTS}(?!{BLANK}*+#){BLANK}*+{_OPEN}"


def without_trailing_space(c: Column) -> Column:
    return sub(c, rf"(?<!{BLANK}){BLANK}++(?=\n|\z)")


def normalize_line_breaks(column: Column | str) -> Column:
    """Join a line with the one before it, unless that one ended a sentence, is a heading or ends in a section number.

    A text line after a blank one takes the blank one's place and loses its indent, as does the first of joined lines.
    """
    c = without_trailing_space(column)
    c = sub(c, rf"(?dm)^\n{BLANK}++", "\n")
    c = _joined(c)
    return sub(c, r"(?dm)^\n(?=[^\n])")


def _joined(c: Column) -> Column:
    # the groups of alternatives that did not match are empty
    return sub(c, rf"(?dm){_INDENTED}|{_FIRST}|{_GOES_ON}{_OPEN}", "$1$3$4 $2")


def join_short_lines(column: Column | str) -> Column:
    """Join a line of under 80 characters with its next one, in pairs, unless that one begins a new part.

    Of a run of lines that could each take the next one, every second does: a match takes both.
    """
    short = rf"^(?=[^\n]{{1,{SHORT_LINE - 1}}}\n){BLANK}*+([^\n]*)\n{BLANK}*+(?![#\p{{Nd}}]|PDF PAGE)([^\n]+)"
    return sub(without_trailing_space(column), rf"(?dm){short}", "$1 $2")
