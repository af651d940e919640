"""Column expressions over strings: normal forms, tokens, names, integrity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and marks that do not count in comparisons, and decoding damage.
IGNORED = " \t\n\x0b\f\r，。、,.：:；;（）()“”\"'`·"
DAMAGE = "(?:Ã.|Â.|â.|ï¿½|锟斤拷)"
#: Fixed value: what stands between tokens.
BETWEEN_TOKENS = r"[^a-z0-9一-鿿]+"


def clamp_number(c: Column, default, low=0, high=5000) -> Column:
    """A number rounded half up into [low, high]; the default where it is none."""
    n = c.try_cast("double")
    rounded = F.floor(n + 0.5)
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.least(F.greatest(rounded, F.lit(low)), F.lit(high))).otherwise(F.lit(default)).cast("long")


def hex_color(c: Column, default: str) -> Column:
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), F.upper(c)).otherwise(F.lit(default))


def normalized(c: Column) -> Column:
    return F.lower(F.translate(c, IGNORED, ""))


def tokens(c: Column) -> Column:
    """The distinct tokens of more than one character, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(c), BETWEEN_TOKENS), lambda t: F.length(t) > 1))


def keywords(*fields: Column, most: int = 20) -> Column:
    """Distinct lower-case words of the fields, in order, `most` at most."""
    joined = F.translate(F.concat_ws(" ", *fields), "_-", "  ")
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(joined), r"\s+"), lambda t: t != "")), 1, most)


def labelled(c: Column, table: dict[str, str]) -> Column:
    """A label by key, the key itself where there is none."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.element_at(pairs, c), c)


def sequence_id(kind: Column, number: Column, prefixes: dict[str, str], digits: int = 4) -> Column:
    return F.concat(labelled(kind, prefixes), F.lit("-"), F.lpad(number.cast("string"), digits, "0"))


def stable_role(kind: Column, name: Column, number: Column) -> Column:
    seed = F.substring(F.regexp_replace(F.regexp_replace(name, r"\s+", "_"), r"[^\p{L}\p{N}_-]", ""), 1, 38)
    seed = F.coalesce(F.when(seed != "", seed), number.cast("string"))
    return F.concat_ws("_", kind, seed, F.lpad(number.cast("string"), 3, "0"))


def safe_filename(path: Column, fallback: str = "file", most: int = 140) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    safe = F.substring(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), 1, most)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def damage_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(DAMAGE))


def corrupt(c: Column) -> Column:
    """A replacement character, or decoding damage in two places and eight per cent of the code points at least."""
    enough = F.greatest(F.lit(2), F.ceil(F.length(c) * 0.08))
    return F.coalesce((c != "") & ((F.regexp_count(c, F.lit("�")) > 0) | (damage_count(c) >= enough)), F.lit(False))


def json_object(c: Column) -> Column:
    """The text from the first { to the last }, inside of a code fence where there is one; null without."""
    fence = F.regexp_extract(c, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    text = F.when(fence != "", fence).otherwise(c)
    found = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    return F.when(found != "", found)


def separators_repaired(c: Column) -> Column:
    """Trailing commas dropped, missing ones between objects and arrays put in."""
    c = F.regexp_replace(c, r",\s*([}\]])", "$1")
    c = F.regexp_replace(c, r"\}\s*\{", "},{")
    return F.regexp_replace(c, r"\]\s*\[", "],[")


def line_breaks_escaped(c: Column) -> Column:
    """Raw line breaks and tabs inside of JSON strings escaped, by a fold over the characters."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"))
    raw = F.create_map(F.lit("\n"), F.lit("\\n"), F.lit("\r"), F.lit("\\r"), F.lit("\t"), F.lit("\\t"))

    def step(s: Column, ch: Column) -> Column:
        put = F.when(s["inside"] & ~s["escaped"], F.coalesce(F.element_at(raw, ch), ch)).otherwise(ch)
        inside = F.when(~s["inside"], ch == '"').when(s["escaped"], F.lit(True)).otherwise(ch != '"')
        escaped = s["inside"] & ~s["escaped"] & (ch == "\\")
        return F.struct(F.concat(s["out"], put).alias("out"), inside.alias("inside"), escaped.alias("escaped"))

    return F.aggregate(F.split(c, ""), start, step)["out"]


def keyword_score(haystack: Column, needles: list[str], each: int = 2, rules: dict[str, str] | None = None, bonus: int = 12) -> Column:
    """`each` for every needle in the text, `bonus` for every rule (name to pattern) that matches."""
    total = F.lit(0)
    for n in needles:
        total = total + F.when(haystack.contains(n), each).otherwise(0)
    for pattern in (rules or {}).values():
        total = total + F.when(haystack.rlike(pattern), bonus).otherwise(0)
    return total


def searched(category: Column, text: Column, wanted: str | None, query: str) -> Column:
    """A catalogue search: the category equal (any, if none is given) and the text holding the query."""
    match = F.lower(text).contains(query.lower())
    return match if wanted is None else (category == wanted) & match


def channel(c: Column, k: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("int")


def luminance(c: Column) -> Column:
    return 0.2126 * channel(c, 0) + 0.7152 * channel(c, 1) + 0.0722 * channel(c, 2)


def saturation(c: Column) -> Column:
    rgb = [channel(c, k) for k in range(3)]
    return F.greatest(*rgb) - F.least(*rgb)


def needs_white_text(fill: Column) -> Column:
    return (fill != "#FFFFFF") & (luminance(fill) < 175) & (saturation(fill) > 35)


def font_weight(height: Column) -> Column:
    return F.when(height >= 31, 700).when(height >= 23, 600).otherwise(400)


def duration_label(ms: Column) -> Column:
    s = ms / 1000
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).when(s < 60, F.concat(F.floor(s).cast("string"), F.lit(" s"))).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), F.floor(s % 60).cast("string"), F.lit(" s"))
    )


def score_label(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 85, "good").when(score >= 70, "fair").otherwise("poor")


def data_url(mime: str, data: Column) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(data))


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.substring_index(url, ",", -1))


def model_allowed(name: Column, allowed: list[str], denied: str) -> Column:
    return F.coalesce(~name.rlike(denied) & name.isin(allowed), F.lit(False))
