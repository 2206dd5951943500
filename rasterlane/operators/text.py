"""Word-level changes of overlay texts, all with array functions; and the boxes that they go to.

A text that a change leaves as it was gives the empty string, which means: draw nothing new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .base import OPERATORS, Operator

STOPWORDS = ("the", "is", "in", "at", "of")


#: Expressions over prepared columns: __w (words), __n (their number), __c (how many change) and
#: __o (places in a seeded order). Each is linear or a sort: places are never looked up one by one.
ALL = "sequence(0, __n - 1)"
IN_ORDER = "array_join(transform(array_sort({}), s -> s.w), ' ')"


def prepared(rows: DataFrame, d: Draws, share: float) -> DataFrame:
    """rows (with text) and the columns that the changes need."""
    rows = rows.withColumn("__w", F.expr("filter(split(text, '\\\\s+'), w -> w <> '')")).withColumn("__n", F.size("__w"))
    rows = rows.withColumn("__c", F.expr(f"greatest(1, cast(floor({num(share)} * __n) as int))"))
    key = d.unit("word", "i")
    order = f"transform(array_sort(transform(slice(sequence(0, __n), 1, __n), i -> named_struct('k', {key}, 'i', i))), s -> s.i)"
    return rows.withColumn("__o", F.expr(order))


def deleted(d: Draws) -> str:
    """Without the first __c places; all words gone gives the empty string."""
    kept = f"array_except({ALL}, slice(__o, 1, __c))"
    return f"case when __c >= __n then '' else {IN_ORDER.format(f'transform({kept}, i -> named_struct({chr(39)}i{chr(39)}, i, {chr(39)}w{chr(39)}, __w[i]))')} end"


def swapped(d: Draws) -> str:
    """Drawn places trade words in pairs."""
    m = "(2 * cast(floor(least(__c + 1, __n) / 2) as int))"
    traded = f"transform(slice(sequence(0, __n), 1, {m}), j -> named_struct('i', __o[j], 'w', __w[__o[case when j % 2 = 0 then j + 1 else j - 1 end]]))"
    kept = f"transform(array_except({ALL}, slice(__o, 1, {m})), i -> named_struct('i', i, 'w', __w[i]))"
    return f"case when __n < 2 then text else {IN_ORDER.format(f'concat({traded}, {kept})')} end"


def inserted(d: Draws, stopwords: tuple = STOPWORDS) -> str:
    """A stop word after each of the first __c places."""
    pick = d.integer("stop", 0, len(stopwords) - 1, "i")
    stops = "array(" + ", ".join(f"'{s}'" for s in stopwords) + ")"
    own = f"transform({ALL}, i -> named_struct('i', 2 * i, 'w', __w[i]))"
    new = f"transform(slice(__o, 1, __c), i -> named_struct('i', 2 * i + 1, 'w', {stops}[{pick}]))"
    return f"case when __n = 0 then '' else {IN_ORDER.format(f'concat({own}, {new})')} end"


CHANGES = {"deletion": deleted, "swap": swapped, "insertion": inserted}


@dataclass(frozen=True)
class TextImage(Operator):
    """Draws a share of each sample's boxes and changes their texts; rows to be drawn come out.

    texts: sample_id, box_ix, text. augmentations: names of CHANGES or None. Fonts and rasterising
    are left to the caller.
    """

    stopwords: tuple = STOPWORDS
    augmentations: tuple = (None,)
    fraction_range: tuple = (1.0, 1.0)
    share: float = 0.5
    p: float = 0.5
    name = "text_image"

    def texts(self, rows: DataFrame, seed: int = 0, path: str = "0") -> DataFrame:
        """sample_id, box_ix, change, text, new_text for the boxes that are drawn."""
        d = Draws(seed, f"{path}.{self.name}")
        order = Window.partitionBy("sample_id").orderBy(F.expr(d.unit("box", "box_ix")), "box_ix")
        rows = rows.withColumns({"__n": F.row_number().over(order), "__all": F.count("*").over(Window.partitionBy("sample_id"))})
        rows = rows.where(F.expr(f"__n <= cast(floor(__all * {d.between('fraction', *self.fraction_range)} + 0.5e0) as int) and {d.unit('gate')} < {num(self.p)}"))
        names = list(self.augmentations)
        pick = d.integer("change", 0, len(names) - 1, "box_ix")
        new = "case " + " ".join(f"when {pick} = {i} then {self.changed(n, d)}" for i, n in enumerate(names)) + " end"
        what = "case " + " ".join(f"when {pick} = {i} then '{n or 'none'}'" for i, n in enumerate(names)) + " end"
        rows = prepared(rows, d, self.share)
        return rows.select("sample_id", "box_ix", F.expr(what).alias("change"), "text", F.expr(new).alias("new_text"))

    def changed(self, name: str | None, d: Draws) -> str:
        if name is None:
            return "text"
        return inserted(d, self.stopwords) if name == "insertion" else CHANGES[name](d)


OPERATORS["text_image"] = TextImage
