"""White space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, and the separators U+001C to U+001F.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def is_blank(c: Column) -> Column:
    return F.call_function("translate", c, F.lit(BLANKS), F.lit("")) == ""
