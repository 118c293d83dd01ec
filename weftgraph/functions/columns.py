"""Scalar column functions: ids, scores, vectors and sequences. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.text import BLANKS

#: Texts that count as true.
TRUTHY = ("1", "true", "t", "yes", "y", "high", "hc", "hit")
#: A decimal number, as strict parsers read it.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def normalize_id(c: Column | str, uppercase: bool = False) -> Column:
    """Stripped id, NULL if empty, in upper case on demand."""
    out = F.nullif(strip(c), F.lit(""))
    return F.upper(out) if uppercase else out


def number(c: Column | str) -> Column:
    """Double from text; NULL if it isn't a number. NaN stays NaN."""
    return _col(c).cast("string").try_cast("double")


def split_multi(c: Column | str) -> Column:
    """Parts of a field with several values: the first of ; | , that it holds separates; blank parts are left out."""
    c = _col(c)
    parts = F.when(F.contains(c, F.lit(";")), F.split(c, ";", -1)).when(F.contains(c, F.lit("|")), F.split(c, r"\|", -1)).otherwise(F.split(c, ",", -1))
    return F.coalesce(F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def is_truthy(c: Column | str, words: tuple[str, ...] = TRUTHY) -> Column:
    """Whether a text means yes: one of ``words``, or a number other than 0 (NaN too). NULL and blank mean no."""
    t = F.lower(strip(c))
    n = number(strip(c))
    return F.coalesce(t.isin(*words), F.lit(False)) | F.coalesce((n != 0) | F.isnan(n), F.lit(False))


def clamp01(c: Column | str) -> Column:
    """Between 0 and 1; NULL stays NULL."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def smaller(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def larger(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


def normalize_score(raw: Column | str, low: Column | str, high: Column | str) -> Column:
    """Score to [0, 1] by its range: as is, a thousandth, min-max, or 1 for all that are positive."""
    raw, low, high = _col(raw), _col(low), _col(high)
    out = F.when((low >= 0) & (high <= 1), raw).when((low >= 0) & (high <= 1000), raw / 1000.0).when(high > low, (raw - low) / (high - low)).otherwise(F.when(raw > 0, 1.0).otherwise(0.0))
    return clamp01(out)


def minmax01(c: Column | str, low: Column | str, high: Column | str) -> Column:
    """Min-max to [0, 1]; 0 if the range is empty."""
    c, low, high = _col(c), _col(low), _col(high)
    return F.when(high > low + 1e-12, (c - low) / (high - low)).otherwise(0.0)


def gate(p: Column | str, beta: float = 1.0, kind: str = "exp") -> Column:
    """Weight multiplier from a second score."""
    p = _col(p)
    return F.exp(p * beta) if kind == "exp" else p * beta + 1.0


def sigmoid(c: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(c)))


# Vectors are arrays of numbers; sums run in double.


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column | str) -> Column:
    """Vector over its length plus 1e-12."""
    a = _col(a)
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-12))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def all_finite(a: Column | str) -> Column:
    return F.forall(_col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def pair_features(a: Column | str, b: Column | str) -> Column:
    """Both vectors, their absolute difference and their product, one after another."""
    a, b = F.transform(_col(a), lambda x: x.cast("double")), F.transform(_col(b), lambda x: x.cast("double"))
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


# Sequences are strings.


def window_starts(length: Column | str, win: int, stride: int) -> Column:
    """Starts, from 0, of overlapping windows: one if the sequence fits, else every ``stride`` until its end is reached."""
    n = _col(length)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(win)) / F.lit(float(stride)))).cast("int")
    return F.sequence(F.lit(0), last * F.lit(stride), F.lit(stride))


def windows(seq: Column | str, win: int, stride: int) -> Column:
    """Array of (start, window) structs; the last window may be short."""
    s = _col(seq)
    return F.transform(window_starts(F.length(s), win, stride), lambda i: F.struct(i.alias("start"), F.substring(s, i + 1, F.lit(win)).alias("window")))


def length_bucket(seq: Column | str, width: int) -> Column:
    return (F.floor(F.length(_col(seq)) / F.lit(width)) * F.lit(width)).cast("long")


def spaced(seq: Column | str) -> Column:
    """Characters with a space between each two."""
    return F.array_join(F.split(_col(seq), ""), " ")


def linked(a: Column | str, b: Column | str, linker: int = 10, mark: str = "X") -> Column:
    """Two sequences joined by a stretch of masked residues."""
    return F.concat(_col(a), F.lit(mark * linker), _col(b))


def wrapped(seq: Column | str, width: int = 60) -> Column:
    """Lines of at most ``width`` characters."""
    s = _col(seq)
    return F.array_join(F.transform(window_starts(F.length(s), width, width), lambda i: F.substring(s, i + 1, F.lit(width))), "\n")


def kmers(seq: Column | str, k: int) -> Column:
    """All stretches of ``k`` characters, in order, repeats kept."""
    s = _col(seq)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def sampled_positions(seq: Column | str, k: int, seed: int) -> Column:
    """``k`` positions, from 1, of a sequence in the order of the md5 of its md5 and the position, all if k is 0 or too large; the same for the same sequence."""
    s = _col(seq)
    n = F.length(s)
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    if k <= 0:
        return every
    own = F.array_repeat(F.md5(s), n)  # so that the sequence is hashed once
    keyed = F.array_sort(F.zip_with(own, every, lambda h, i: F.struct(F.md5(F.concat(h, F.lit(":"), i.cast("string"), F.lit(f":{seed}"))).alias("h"), i.alias("i"))))
    return F.when(n <= k, every).otherwise(F.array_sort(F.transform(F.slice(keyed, 1, k), lambda x: x["i"])))


def significant(c: Column | str, digits: int = 6) -> Column:
    """Text of a number with so many significant digits, trailing zeros dropped; for sinks only."""
    c = _col(c)
    text = F.format_string(f"%.{digits - 1}e", c)
    power = F.substring_index(text, "e", -1).cast("int")
    strip0 = lambda t: F.when(F.contains(t, F.lit(".")), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
    plain = F.lit("0")
    for p in range(-5, digits + 1):
        plain = F.when(power == p, strip0(F.format_string(f"%.{max(0, digits - 1 - p)}f", c))).otherwise(plain)
    sign = F.when(power < 0, "-").otherwise("+")
    sci = F.concat(strip0(F.substring_index(text, "e", 1)), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(c == 0, "0").when(F.isnan(c), "nan").when((power < -4) | (power >= digits), sci).otherwise(plain)


def ordered_hash(*cols: Column | str, seed: int = 0) -> Column:
    """md5 of columns and a seed: a repeatable random order, the same in other SQL engines."""
    return F.md5(F.concat_ws(":", *[_col(c).cast("string") for c in cols], F.lit(str(seed))))


def mapped(c: Column | str, names: dict[str, str]) -> Column:
    """A label by a small table of names; what isn't in it stays."""
    c = _col(c)
    if not names:
        return c
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def k_list(text: str) -> list[int]:
    """Distinct positive numbers of a comma-separated list, sorted; an error if there is none or one isn't positive."""
    ks = [int(x) for x in text.split(",") if x.strip()]
    if not ks or min(ks) <= 0:
        raise ValueError("positive numbers are needed")
    return sorted(set(ks))
