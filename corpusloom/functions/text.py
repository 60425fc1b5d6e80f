"""Text and hashing expressions shared by the operators. All are built-in functions, so they stay in compiled stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that both engines agree on.
WS = "[ \\t\\n\\r\\f]+"
SQL_WS = r"[ \t\n\r\f]+"
SEPARATOR = "<sep>"
_UNIT = 16**15


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")


def non_blank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def words(text: Column) -> Column:
    """White-space tokens of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def draw(*parts: Column | str | int) -> Column:
    """A 60-bit integer from a hash of the parts: the same in any engine and on any partitioning."""
    cols = [F.lit(str(p)) if isinstance(p, int) else p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return draw(*parts) / F.lit(float(_UNIT))


def hashed_ids(tokens: Column, size: int = 65535) -> Column:
    """Ids from 1 to ``size`` by a hash of each token; 0 is left for the separator. No vocabulary is built or kept."""
    return F.transform(tokens, lambda w: (F.pmod(draw(w), F.lit(size)) + 1).cast("int"))


def sql_draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def sql_uniform(*parts: str) -> str:
    return f"({sql_draw(*parts)} / {float(_UNIT)!r}::DOUBLE)"


def grams(rows: DataFrame, tokens: str, n: int, keep: list[str], text: bool = True) -> DataFrame:
    """Every window of n tokens with its start: ``keep``, at, h (64-bit hash) and gram, or its parts t if not ``text``.

    Shifted copies of the array are zipped and generated, which stays in one compiled stage. Arrays shorter than n give
    no rows. Outer generators keep the optimiser from evaluating the tokens a second time.
    """
    shifted = [F.slice(tokens, F.lit(i + 1), F.greatest(F.size(tokens) - i, F.lit(0))).alias(f"t{i}") for i in range(n)]
    at = rows.select(*keep, F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "t")).filter(F.col(f"t.t{n - 1}").isNotNull())
    h = F.xxhash64(*[F.col(f"t.t{i}") for i in range(n)]).alias("h")
    return at.select(*keep, F.col("at").cast("long").alias("at"), h, gram_text("t", n).alias("gram") if text else F.col("t"))


def gram_text(parts: str, n: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"{parts}.t{i}") for i in range(n)])
