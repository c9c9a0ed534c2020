"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


#: White space of any script.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Parts between white space of any script, no empty ones, case kept."""
    return F.filter(split_words(text), lambda x: x != "")


def split_words(text: Column) -> Column:
    """What ``words`` gives, with an empty part at an end that is white space."""
    return F.split(text, SPACES)


def readable_size(n: Column) -> Column:
    """Bytes with a binary unit and one digit."""
    out = F.format_string("%.1f%s", n.cast("double") / 1024.0**8, F.lit("YiB"))
    for k, unit in reversed(list(enumerate(["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]))):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string("%.1f%s", n.cast("double") / 1024.0**k, F.lit(unit + "B"))).otherwise(out)
    return out


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero, with its sign even where nothing else is left: Spark's ``round`` makes -0.0 a 0.0."""
    return F.signum(x) * F.round(F.abs(x), digits)


def to_base64(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def from_base64(x: Column) -> Column:
    return F.unbase64(x).cast("string")


def log_normal_path(start: float, drift: float, deviation: Column, by: list[str], along: str) -> Column:
    """start * exp of the sums of drift plus deviations so far."""
    w = Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    return F.lit(start) * F.exp(F.sum(F.lit(drift) + deviation).over(w))


def draw(*key: Column | str) -> Column:
    """A number in [0, 1), always the same for a key."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal_draw(*key: Column | str) -> Column:
    """A standard normal number, always the same for a key."""
    return F.sqrt(-2 * F.log(1 - draw("a", *key))) * F.cos(F.lit(2 * math.pi) * draw("b", *key))


def typed(x: Column, to: str) -> Column:
    """Cast to a type, null where the value doesn't fit."""
    return x.try_cast(to)
