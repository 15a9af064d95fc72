"""Character classes shared by Spark regular expressions, DuckDB oracles and Python code."""

from __future__ import annotations

# White space of the trimming operators (tab to carriage return, next line, and the separator classes).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: The same as a regular-expression class for Java and RE2.
SPACE = r"[\t-\r \x{85}\p{Z}]"
#: White space of the cleaning operators, which also counts the four information separators.
WIDE_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
#: What ends a word of a query: anything but letters, marks, digits and connectors.
NOT_WORD = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
