"""Ordered classification rules as one CASE expression each; the first that holds counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape type codes and name patterns of the classifier.
CANDIDATE_TYPES = [1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 13, 14, 19, 20, 21, 24, 28, 29, 30, 31]
EXCLUDED_TYPES = [4, 15, 18]
PICTURE_TYPES = [11, 13, 28, 29]
DECORATIVE_TYPES = [5, 20, 21, 24, 30, 31]
LOGO = "logo|emblem|brand|avic|aviation|徽标|标志|品牌"
ICON = "icon|pictogram|target|pie|car|chart|bank|people|crosshair|lightbulb|head|arrow|house|shield|book|star|checklist|鸟|徽章|图标"
ARROW = "arrow|chevron|箭头|流程"
BADGE = "badge|pill|tag|number|tab|标签|角标|编号"
CARD = "card|panel|container|banner|label|header|background|surface|box|卡片|面板|标题栏|底板|框"
NATIVE_KINDS = ["rectangle", "ellipse", "arrow", "line", "connector", "table", "freeform"]


def is_candidate(visible: Column, kind: Column, text_length: Column, fill: Column, line: Column) -> Column:
    """Whether a shape takes part: visible, of a listed type, not a bare text."""
    bare = ~fill & ~line
    text_only = bare & (kind.isin(14, 17) | ((kind == 1) & (text_length > 0)))
    return visible & ~kind.isin(EXCLUDED_TYPES) & ~text_only & kind.isin(CANDIDATE_TYPES)


def shape_category(kind: Column, auto: Column, key: Column, w: Column, h: Column, page_w: Column, page_h: Column, chart: Column, grid: Column, connector: Column) -> Column:
    w, h = F.greatest(F.lit(0.1), w), F.greatest(F.lit(0.1), h)
    share, aspect = w * h / F.greatest(F.lit(1.0), page_w * page_h), w / h
    picture = kind.isin(PICTURE_TYPES)
    small = (share <= 0.055) & (w <= page_w * 0.30) & (h <= page_h * 0.30)
    plain = (kind == 1) & F.coalesce(auto.isin(1, 5), F.lit(False))
    return (
        F.when(chart, "charts").when(grid, "tables").when(share >= 0.58, "backgrounds")
        .when(picture & key.rlike(LOGO), "logos").when(picture & key.rlike(ICON), "icons").when(picture & small, "icons").when(picture, "decorative_visuals")
        .when((kind == 9) & connector, "connectors").when(kind == 9, "lines")
        .when(key.rlike(ARROW) | F.coalesce(auto.between(33, 63), F.lit(False)), "arrows").when(key.rlike(BADGE), "badges").when(key.rlike(CARD), "cards")
        .when(plain & ((share >= 0.012) | (aspect >= 1.7)), "cards").when(plain, "badges")
        .when(kind == 6, "components").when(kind.isin(DECORATIVE_TYPES), "decorative_shapes")
        .otherwise("basic_shapes")
    )


def category_overrides(category: Column, kind: Column, left: Column, top: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Thin shapes are lines; small pictures in the top right are logos."""
    picture = kind.isin(PICTURE_TYPES)
    thin = (category != "connectors") & ~picture & (F.least(w, h) <= 5) & (F.greatest(w, h) >= 20)
    pw, ph = F.greatest(page_w, F.lit(1.0)), F.greatest(page_h, F.lit(1.0))
    branded = (category == "icons") & picture & (top <= ph * 0.14) & (left + w >= pw * 0.74)
    return F.when(thin, "lines").when(branded, "logos").otherwise(category)


def element_class(kind: Column, role: Column, declared: Column | None = None, impact: Column | None = None) -> Column:
    """The family of a canvas element; a fixed decoration must be declared and without impact."""
    fixed = F.lit(False) if declared is None else F.coalesce((declared == "decorative_fixed") & (impact == F.lit(False)), F.lit(False))
    decor = F.coalesce(role == "decoration", F.lit(False))
    return (
        F.when(kind == "text", "ocr_text").when(decor & fixed, "decorative_fixed").when(decor, "decorative_movable")
        .when(kind.isin(NATIVE_KINDS), "native_editable").when(role == "brand", "exact_brand_asset").otherwise("library_png")
    )


def protocol_class(kind: Column, role: Column) -> Column:
    """As element_class, but native kinds come before decorations."""
    return F.when(kind == "text", "ocr_text").when(kind.isin(NATIVE_KINDS), "native_editable").when(role == "decoration", "decorative_movable").when(role == "brand", "exact_brand_asset").otherwise("library_png")


def asset_kind(cls: Column) -> Column:
    return F.when(cls == "native_editable", "native_editable").when(cls.isin("exact_brand_asset", "library_png", "decorative_movable"), "png")


# Fills that count as white, and names that are never foreground.
WHITES = ["#FFFFFF", "#FAFAFA", "#F8F8F8", "#F5F5F5"]
BARS = "title-bar|subtitle-bar|footer-note|footer-right-label"
HEADERS = "header-banner|header-title|header-subtitle|title-bar|title-bg|subtitle-bg|footer-note|footer-right-label"
SCENERY = r"background|page-deco|city|skyline|sun(?:-|_)icon|corner|abstract-wave|ribbon|birds?|wave-deco"


def is_foreground(name: Column, role: Column, fill: Column, stroke: Column, stroke_width: Column, owned: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Ordered keep and drop rules."""
    name, near = F.lower(name), fill.isin(WHITES)
    return (
        F.when(near & stroke.isin(WHITES) & (stroke_width == 0) & name.rlike(BARS), False)
        .when(near & (role == "container") & (y < 210) & (owned <= 2), False)
        .when((fill == "#FFFFFF") & name.rlike(HEADERS), False).when(name.rlike(SCENERY), False)
        .when((role != "decoration") | (owned > 0), True)
        .when(name.rlike("divider") & ((w > 600) | (h > 150)), False)
        .when((w >= 1200) & (h >= 50) & ((y < 220) | (y + h > 835)), False)
        .otherwise(True)
    )


def approved_decoration(cls: Column, text: Column, approved: list[str], forbidden: list[str]) -> Column:
    def has(tokens: list[str]) -> Column:
        return F.lower(text).rlike("|".join(tokens))

    return (cls == "decorative_fixed") & ~has(forbidden) & has(approved)
