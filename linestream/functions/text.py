"""Text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode separators (categories Zs, Zl, Zp).
SEPARATORS = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The control characters that count as white space or a new line.
CONTROLS = "\t\n\x0b\f\r"
WHITESPACE = SEPARATORS + CONTROLS + "\x85"
# White space as the browser sees it: no next-line character, but the byte order mark.
SCRIPT_WHITESPACE = SEPARATORS + CONTROLS + "\ufeff"
SCRIPT_SPACE = r"[\p{Z}\t\n\x0B\f\r\x{FEFF}]"


def trim_unicode(c: Column) -> Column:
    """Strip Unicode white space and new lines at both ends (``F.trim`` alone strips only 0x20)."""
    return F.trim(c, F.lit(WHITESPACE))


def trim_script_space(c: Column) -> Column:
    return F.trim(c, F.lit(SCRIPT_WHITESPACE))


def slug(c: Column) -> Column:
    """Anchor name of a heading, before repeats are numbered."""
    s = trim_script_space(F.lower(c))
    s = F.regexp_replace(s, r"[^A-Za-z0-9_\p{Z}\t\n\x0B\f\r\x{FEFF}-]", "")
    s = F.regexp_replace(s, SCRIPT_SPACE + "+", "-")
    s = F.regexp_replace(s, "-+", "-")
    return F.when(s == "", "section").otherwise(s)
