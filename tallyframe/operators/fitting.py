"""Fitting text into boxes: tokens with CJK characters apart, greedy lines, the largest size by bisection.

Glyph widths come from a declared table of classes, in parts of the font size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths by class of character; anything else is OTHER wide.
WIDE, NARROW, SPACE, UPPER, OTHER = 1.0, 0.28, 0.26, 0.66, 0.52
_CJK = re.compile(r"[　-〿㐀-鿿豈-﫿＀-￯]")
_TOKEN = re.compile(r"[　-〿㐀-鿿豈-﫿＀-￯]|[^\s　-〿㐀-鿿豈-﫿＀-￯]+|\s+")
LINE_HEIGHT, STEPS = 1.2, 18


def width(text: str) -> float:
    """In parts of the font size."""
    return sum(WIDE if _CJK.match(c) else SPACE if c.isspace() else NARROW if c in "ijl.,;:'|!" else UPPER if c.isupper() else OTHER for c in text)


def wrapped(text: str, room: float) -> list[str]:
    """Greedy lines of at most `room`; a token wider than that is cut."""
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for token in _TOKEN.findall(paragraph):
            if width(line + token) <= room or token.isspace() and not line:
                line = line + token if line or not token.isspace() else line
                continue
            if line.strip():
                lines.append(line.rstrip())
            line = ""
            if token.isspace():
                continue
            while width(token) > room and len(token) > 1:
                k = max(1, next((i for i in range(len(token), 0, -1) if width(token[:i]) <= room), 1))
                lines.append(token[:k])
                token = token[k:]
            line = token
        lines.append(line.rstrip())
    return lines


def fits(text: str, size: float, box_w: float, box_h: float) -> bool:
    lines = wrapped(text, box_w / size)
    return len(lines) * size * LINE_HEIGHT <= box_h and all(width(s) * size <= box_w + 1e-9 for s in lines)


def best_size(text: str, box_w: float, box_h: float, low: float = 5.0, high: float = 60.0) -> tuple[float, int]:
    """The largest size that fits, by STEPS bisections, and the lines it takes; the least size if none fits."""
    for _ in range(STEPS):
        middle = (low + high) / 2
        if fits(text, middle, box_w, box_h):
            low = middle
        else:
            high = middle
    return round(low, 2), len(wrapped(text, box_w / low))


def fitted(df: DataFrame, text: str, box_w: float, box_h: float) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([best_size(t or "", box_w, box_h) for t in s], columns=["size", "lines"])

    return df.withColumn("_fit", F.pandas_udf(run, "size double, lines long")(text)).select(*[c for c in df.columns if c != text], "_fit.size", "_fit.lines")
