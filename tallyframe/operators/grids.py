"""Assets dealt to the cards of numbered grids, for pages that come in pieces: one shuffle and one sort of the pieces, nothing is joined.

The same rows as `synthesis.numbered_cards` and `cards.dealt_assets` give together; each step runs over the arrays of many pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from re import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.cards import RELATED
from tallyframe.operators.synthesis import GUTTER, HEIGHT, INSET, LEAST_CARDS, LOW, ROW_REACH, TOP, WIDTH, WIDTHS

#: Pieces worked on at once, and a number's text; what may follow it is what Java's $ lets pass.
PIECES, NUMBER = 40_000, r"^[0-9][0-9](?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
FAR = np.iinfo(np.int64).max


def _along(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of the sorted keys changes."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys[0])), bool), np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _met(page: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row of the first with each row of the second (sorted) on its page."""
    counts = np.bincount(of, minlength=n)
    times = counts[page]
    return np.repeat(np.arange(len(page)), times), np.repeat((np.cumsum(counts) - counts)[page], times) + _along(times)


def _half_up(v: np.ndarray) -> np.ndarray:
    return np.floor(v + 0.5).astype(np.int64)


def _often(page: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(page, minlength=n)[page] >= LEAST_CARDS


def _rows(page: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The row on its page of each number in the order of y: a row reaches ROW_REACH below its first number."""
    counts = np.bincount(page, minlength=n)
    place = _along(counts[counts > 0])
    order, first, row, out = np.argsort(place, kind="stable"), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(page), np.int64)
    ends = np.cumsum(np.bincount(place)) if len(place) else []
    for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
        at = order[lo:hi]
        fresh = at[(y[at] - first[page[at]] > ROW_REACH) | (k == 0)]
        first[page[fresh]] = y[fresh]
        row[page[fresh]] += 1
        out[at] = row[page[at]]
    return out


def _cards(t: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Of texts sorted by page the cards: page, at (their number's text), cluster, x, h, the title's y and h, where the body begins."""
    at = np.flatnonzero(t["number"] & (t["y"] > TOP) & (t["y"] < LOW))
    at = at[_often(t["page"][at], n)]
    at = at[np.lexsort((t["id"][at], t["y"][at], t["page"][at]))]
    page, y = t["page"][at], t["y"][at]
    cluster = _rows(page, y, n)
    starts = _starts(page, cluster)
    in_row = np.diff(np.append(starts, len(at)))
    top = np.repeat(_half_up(np.add.reduceat(y.astype(float), starts) / in_row) if len(starts) else in_row, in_row)
    first, size = np.repeat(y[starts], in_row), np.repeat(in_row, in_row)
    kept = np.flatnonzero(size >= 2)
    kept = kept[_often(page[kept], n)]
    kept = kept[np.lexsort((t["id"][at[kept]], t["x"][at[kept]], cluster[kept], page[kept]))]
    at, page, cluster, top, first = (v[kept] for v in (at, page, cluster, top, first))
    if not len(at):
        return {}
    x, starts = t["x"][at], _starts(page, cluster)
    in_row = np.diff(np.append(starts, len(at)))
    last = np.zeros(len(at), bool)
    last[starts + in_row - 1] = True
    following = np.append(x[1:], 0)
    gap = following - x - GUTTER
    usual = ~last & (gap >= WIDTHS[0]) & (gap <= WIDTHS[1])
    some, total = np.add.reduceat(usual.astype(np.int64), starts), np.add.reduceat(np.where(usual, gap, 0).astype(float), starts)
    alone = np.where(some > 0, _half_up(total / np.maximum(some, 1)), WIDTH)
    left = np.maximum(0, x - INSET)
    right = left + np.where(last, np.repeat(alone, in_row), following - INSET - left - GUTTER)
    # the next row begins more than 40 below this one's top
    a, b = _met(page[starts], page[starts], n)
    below = np.where(first[starts][b] > top[starts][a] + 40, first[starts][b], FAR)
    below = np.minimum.reduceat(below, _starts(a))
    low = np.repeat(np.where(below < FAR, below - 20, np.minimum(780, top[starts] + 190)), in_row)

    other = np.bincount(page, minlength=n)[t["page"]] > 0
    other[at] = False
    other = np.flatnonzero(other)
    a, b = _met(page, t["page"][other], n)
    b = other[b]
    ty, tx = t["y"][b], t["x"][b]
    beside = np.flatnonzero((ty >= top[a] - 8) & (ty <= top[a] + 25) & (tx > x[a] + 60) & (tx < right[a]))
    beside = beside[np.lexsort((t["id"][b[beside]], tx[beside], a[beside]))]
    beside = beside[_starts(a[beside])]
    title = np.full(len(at), -1)
    title[a[beside]] = b[beside]
    title_y = t["y"][title]
    under = np.flatnonzero((title[a] >= 0) & (ty > title_y[a] + 30) & (ty < low[a]) & (tx > left[a] + 105) & (tx < right[a] - 10))
    a, b = a[under], b[under]
    starts = _starts(a)
    if not len(starts):
        return {}
    card, bottom = a[starts], np.maximum.reduceat(t["y"][b] + t["h"][b], starts)
    found = {"page": page[card], "at": at[card], "cluster": cluster[card], "number_x": x[card], "x": left[card], "h": np.maximum(HEIGHT, bottom - (top[card] - 12) + 16),
             "title_y": title_y[card], "title_h": t["h"][title[card]], "body_left": np.minimum.reduceat(t["x"][b], starts), "body_top": np.minimum.reduceat(t["y"][b], starts)}
    often = _often(found["page"], n)
    return {k: v[often] for k, v in found.items()}


def _is(names: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(names, pattern), False).to_numpy(zero_copy_only=False)


def _dealt(c: dict[str, np.ndarray], numbers: pa.Array, icons: dict[str, np.ndarray], names: pa.Array, n: int) -> np.ndarray:
    """The icon of each card, -1 where none is left. Cards are in the order in which they choose, icons in that of page and id."""
    of_card, of_icon = numbers.dictionary_encode(), names.dictionary_encode()
    words = of_icon.dictionary
    related = _is(names, RELATED)
    may = np.flatnonzero(_is(words, r"(?i)(?:card|icon)[-_]?[0-9][0-9]|[0-9][0-9][-_](?:icon|asset)"))
    called = np.zeros((len(of_card.dictionary), len(words)), bool)
    for k, number in enumerate(of_card.dictionary.to_pylist()):
        number = escape(number)
        called[k, may] = _is(words.take(pa.array(may)), f"(?i)(?:card|icon)[-_]?{number}|{number}[-_](?:icon|asset)")
    number, word = of_card.indices.to_numpy(), of_icon.indices.to_numpy(zero_copy_only=False)
    nameless = np.isnan(word) if word.dtype.kind == "f" else np.zeros(len(word), bool)
    word = np.where(nameless, 0, word).astype(np.int64)
    counts = np.bincount(c["page"], minlength=n)
    place = _along(counts[counts > 0])
    free, chosen = np.ones(len(word), bool), np.full(len(place), -1)
    for k in range(place.max(initial=-1) + 1):
        card = np.flatnonzero(place == k)
        a, b = _met(c["page"][card], icons["page"], n)
        a, b = a[free[b]], b[free[b]]
        if not len(words):
            break
        a_card = card[a]
        distance = np.abs(icons["x"][b] - (c["x"][a_card] + 60)) + np.abs(icons["y"][b] - (c["title_y"][a_card] + c["title_h"][a_card] + 58))
        by_name = called[number[a_card], word[b]] & ~nameless[b]
        can = np.flatnonzero(by_name | related[b])
        can = can[np.lexsort((b[can], np.where(by_name[can], 0, distance[can]), ~by_name[can], a[can]))]
        can = can[_starts(a[can])]
        chosen[card[a[can]]] = b[can]
        free[b[can]] = False
    return chosen


def _flat(lists: pa.Array, page: np.ndarray, wanted: tuple[str, ...]) -> tuple[np.ndarray, pa.StructArray]:
    """The page of each struct in the lists, and the structs, without those that lack a number."""
    on, of = np.repeat(page, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()
    whole = np.all([pc.is_valid(pc.struct_field(of, c)).to_numpy(zero_copy_only=False) for c in wanted], axis=0)
    return on[whole], of.filter(pa.array(whole))


def _columns(on: np.ndarray, of: pa.StructArray, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {"page": on} | {c: pc.struct_field(of, c).to_numpy(zero_copy_only=False) for c in wanted}


def _worked(pieces: pa.Table) -> dict[str, pa.Array | np.ndarray]:
    """What `dealt_on_pages` gives, of whole pages."""
    keys = pieces.column(0).combine_chunks()
    new = np.concatenate(([True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)))
    page = np.cumsum(new) - 1
    n, firsts = int(page[-1]) + 1, np.flatnonzero(new)
    on, texts = _flat(pieces["texts"].combine_chunks(), page, ("id", "x", "y", "h"))
    words = pc.utf8_trim(pc.struct_field(texts, "text"), " ")
    t = _columns(on, texts, ("id", "x", "y", "h")) | {"number": _is(words, NUMBER)}
    c = _cards(t, n)
    if not c or not len(c["at"]):
        return {}
    order = np.lexsort((t["id"][c["at"]], c["number_x"], c["cluster"], c["page"]))
    c = {k: v[order] for k, v in c.items()}
    on, icons = _flat(pieces["icons"].combine_chunks(), page, ("id", "x", "y"))
    i, names = _columns(on, icons, ("id", "x", "y")), pc.struct_field(icons, "name")
    near = np.flatnonzero(np.bincount(c["page"], minlength=n)[i["page"]])
    near = near[np.lexsort((i["id"][near], i["page"][near]))]
    i, names = {k: v[near] for k, v in i.items()}, names.take(pa.array(near))
    chosen = _dealt(c, words.take(pa.array(c["at"])), i, names, n)
    some = chosen >= 0
    c, chosen = {k: v[some] for k, v in c.items()}, chosen[some]
    return {
        "page": keys.take(pa.array(firsts[c["page"]])), "number_id": t["id"][c["at"]], "id": i["id"][chosen], "x": c["x"] + 26, "y": c["body_top"] + 4,
        "w": np.maximum(56, np.minimum(112, c["body_left"] - c["x"] - 52)), "h": np.maximum(58, np.minimum(c["h"] - 86, 105)),
    }


def _by_pages(at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces in the order of their pages, some at once, a page never divided."""

    def out(pieces: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _worked(pieces) if pieces.num_rows else {}
        if found:
            yield pa.RecordBatch.from_arrays([found["page"], *(pa.array(v, pa.int64()) for k, v in found.items() if k != "page")], [pieces.column_names[0], *list(found)[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, at_once
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < least:
                continue
            t = pa.Table.from_batches(held)
            keys = t.column(0).combine_chunks()
            changes = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
            whole = int(changes[-1]) + 1 if len(changes) else 0
            yield from out(t.slice(0, whole))
            held = t.slice(whole).to_batches()
            n -= whole
            least = max(at_once, 2 * n)  # a page that is not whole yet is looked at again when it has doubled
        if n:
            yield from out(pa.Table.from_batches(held))

    return run


def dealt_on_pages(pieces: DataFrame, page: str, at_once: int = PIECES) -> DataFrame:
    """`cards.dealt_assets` over the cards of `synthesis.numbered_cards`: page, number_id, id, x, y, w, h.

    pieces: any number of rows a page with what stands on it, in any order: texts, an array of (id, text, x, y, h), and icons, an
    array of (id, name, x, y). Texts without id, x, y or h and icons without id, x or y are left out. A page has to fit into a
    task. Pieces that are dealt and sorted by page already are neither shuffled nor sorted again."""

    def structs(column: str, fields: dict[str, str]) -> Column:
        kind = ",".join(f"{c}:{k}" for c, k in fields.items())
        return F.transform(column, lambda v: F.struct(*(v[c].alias(c) for c in fields))).cast(f"array<struct<{kind}>>").alias(column)

    numbers = dict.fromkeys("xy", "bigint")
    whole = pieces.where(F.col(page).isNotNull()).withColumn("_pieces", F.count("*").over(W.partitionBy(page)))  # brings a page's rows together
    kind = dict(pieces.dtypes)[page]
    return whole.select(page, structs("texts", {"id": "bigint", "text": "string", **numbers, "h": "bigint"}), structs("icons", {"id": "bigint", "name": "string", **numbers}), "_pieces").mapInArrow(
        _by_pages(at_once), f"{page} {kind}, number_id bigint, id bigint, x bigint, y bigint, w bigint, h bigint"
    )
