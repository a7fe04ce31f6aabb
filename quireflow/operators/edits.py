"""Planning of edits: minimal changes, replacement layout, style resolution, device budgets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions import text as tx

#: Pixels and bytes of a device tier (fixed values): page image, recognition image, page cache.
BUDGETS = {"high": (40_000_000, 40_000_000, 600 << 20), "mid": (16_000_000, 20_000_000, 250 << 20), "low": (9_000_000, 10_000_000, 100 << 20)}
SMALL_TEXT, WANTED_TEXT, MOST_SCALE = 12, 30, 4
SAME_PLACE = 0.6


def device_tier(memory: Column, cores: Column) -> Column:
    m, c = F.coalesce(memory, F.lit(4)), F.coalesce(cores, F.lit(4))
    return F.when((m <= 2) | (c <= 2), "low").when((m < 8) | (c < 4), "mid").otherwise("high")


def device_budget(tier: Column, which: int) -> Column:
    return F.when(tier == "high", F.lit(BUDGETS["high"][which])).when(tier == "mid", F.lit(BUDGETS["mid"][which])).otherwise(F.lit(BUDGETS["low"][which]))


def recognition_scale(text_height: Column, width: Column, height: Column, budget: Column) -> Column:
    """Whole enlargement for small text: towards 30 px, at most 4, the largest that the pixel budget holds."""
    wanted = F.when((text_height > 0) & (text_height < SMALL_TEXT), F.least(F.lit(MOST_SCALE), F.floor(F.lit(float(WANTED_TEXT)) / text_height + 0.5).cast("int"))).otherwise(1)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))), lambda s: (s == 1) | (width * height * s * s <= budget))
    return F.array_max(fits)


def confidence_band(c: Column) -> Column:
    return F.when(c < 60, "low").when(c < 85, "mid").otherwise("high")


def fit_confidence(score: Column, ocr: Column) -> Column:
    """Trust in a fitted style: its score weighed by the words' confidence, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * (ocr / 100 * 0.4 + 0.6)))


def style_label(family: Column, weight: Column, size: Column) -> Column:
    return F.concat_ws(" ", family, F.when(weight >= 700, "Bold").otherwise("Regular"), F.concat(F.floor(size + 0.5).cast("int"), F.lit("px")))


def inferred_alignment(left: Column, right: Column, height: Column) -> Column:
    """Alignment by the free space to either side of a text in its slot."""
    near = height * 0.6
    return F.when((left > near) & (F.abs(left - right) <= F.greatest(near, F.greatest(left, right) * 0.2)), "center").when((right < near) & (left > near * 2), "right").otherwise("left")


def joined(left: Column, right: Column) -> Column:
    """Whether a cut between two clusters would part joined letters."""
    letter = lambda c: c.rlike(r"[\p{L}\p{M}]") & tx.has_connected(c)
    return F.coalesce(letter(left) & letter(right), F.lit(False))


def common_ends(a: Column, b: Column) -> Column:
    """struct(p, s): lengths of the common prefix and suffix of two cluster arrays, moved back to where letters aren't joined."""
    least = F.least(F.size(a), F.size(b))
    different = lambda x, y: F.array_position(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"])), True)

    def prefix(x: Column, y: Column) -> Column:
        at = different(x, y)
        return F.when(at > 0, F.least(at - 1, least.cast("long"))).otherwise(least.cast("long")).cast("int")

    p0 = prefix(a, b)
    s0 = F.least(prefix(F.reverse(a), F.reverse(b)), least - p0)

    def prefix_ok(k: Column) -> Column:
        in_a = joined(F.get(a, k - 1), F.get(a, k))
        return (k == 0) | (k >= F.size(a)) | ~(in_a | ((k < F.size(b)) & joined(F.get(b, k - 1), F.get(b, k))))

    def suffix_ok(k: Column) -> Column:
        in_a = joined(F.get(a, F.size(a) - k - 1), F.get(a, F.size(a) - k))
        return (k == 0) | (k >= F.size(a)) | ~(in_a | ((k < F.size(b)) & joined(F.get(b, F.size(b) - k - 1), F.get(b, F.size(b) - k))))

    back = lambda most, ok: F.array_max(F.filter(F.sequence(F.lit(0), most), ok))
    return F.struct(back(p0, prefix_ok).alias("p"), back(s0, suffix_ok).alias("s"))


def edit_plan(source: Column, new: Column, advance: Column, old_origin: Column, new_origin: Column) -> Column:
    """struct(text, from_x, full): what has to be drawn to turn one text into another, each cluster ``advance`` px wide.

    Beginning and end that stay in place within SAME_PLACE keep their scanned ink; right-to-left text is drawn anew.
    """
    a, b = tx.clusters(source), tx.clusters(new)

    def plan(k: Column) -> Column:
        ends = k["ends"]
        keep_p = (ends["p"] > 0) & (F.abs(new_origin - old_origin) < SAME_PLACE)
        moved = (new_origin + advance * (F.size(k["b"]) - ends["s"])) - (old_origin + advance * (F.size(k["a"]) - ends["s"]))
        keep_s = (ends["s"] > 0) & (F.abs(moved) < SAME_PLACE)
        full = tx.has_rtl(source) | tx.has_rtl(new) | ~(keep_p | keep_s)
        start = F.when(keep_p, ends["p"]).otherwise(0)
        stop = F.when(keep_s, F.size(k["b"]) - ends["s"]).otherwise(F.size(k["b"]))
        part = F.array_join(F.slice(k["b"], start + 1, F.greatest(stop - start, F.lit(0))), "")
        return F.struct(F.when(full, new).otherwise(part).alias("text"), F.when(full, new_origin).otherwise(new_origin + advance * start).alias("from_x"), full.alias("full"))

    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), common_ends(z["a"], z["b"]).alias("ends")))
    return F.transform(bound, plan)[0]


def replacement_layout(available: Column, glyphs: Column, per_glyph: Column, spacing: Column, scale_x: Column, size: Column, connected: Column) -> Column:
    """struct(spacing, scale_x, size, advance, overflow) of a text fitted into the room that it has.

    The text's width is linear in its parameters: (glyphs * per_glyph * size + (glyphs - 1) * spacing) * scale_x. First
    tracking gives up to 3 % of the size (not in connected scripts), then width up to 12 %, then size up to 20 %.
    """
    gaps = F.greatest(F.lit(1), glyphs - 1)
    advance = lambda sp, sx, sz: (glyphs * per_glyph * sz + (glyphs - 1) * sp) * sx
    sp = F.when((advance(spacing, scale_x, size) > available) & ~connected, F.greatest(spacing - size * 0.03, spacing + (available - advance(spacing, scale_x, size)) / gaps)).otherwise(spacing)
    a1 = advance(sp, scale_x, size)
    sx = F.when(a1 > available, F.greatest(scale_x * 0.88, scale_x * (available - sp * gaps) / F.greatest(F.lit(1), a1 - sp * gaps))).otherwise(scale_x)
    a2 = advance(sp, sx, size)
    sz = F.when(a2 > available, F.greatest(size * 0.8, size * (available / a2))).otherwise(size)
    a3 = advance(sp, sx, sz)
    return F.struct(sp.alias("spacing"), sx.alias("scale_x"), sz.alias("size"), a3.alias("advance"), (a3 > available + 0.5).alias("overflow"))


def available_width(alignment: Column, slot_left: Column, slot_right: Column, origin: Column, source_advance: Column, ink_height: Column) -> Column:
    margin = F.greatest(F.lit(2), ink_height * 0.3)
    centre, right = origin + source_advance / 2, origin + source_advance
    room = F.when(alignment == "center", F.least(centre - slot_left, slot_right - centre) * 2 - margin * 2).when(alignment == "right", right - slot_left - margin).otherwise(slot_right - origin - margin)
    return F.greatest(room, source_advance)


STYLE_KEYS = ("fontId", "weight", "fontSize", "scaleX", "skewX", "letterSpacing", "wordSpacing", "color", "opacity", "blur", "weightOffset", "glyphFonts", "jitter", "glyphSamples", "inkTexture")


def resolved_style(base: Column, overrides: Column) -> Column:
    """Style map after overrides: what is set wins; a key without a value falls back to the base."""
    own = F.map_filter(F.coalesce(overrides, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def active_substitutions(glyph_fonts: Column, font_id: Column, known: Column) -> Column:
    """Glyph substitutions that change anything: to another font than the text's own, and to one that exists."""
    return F.map_filter(glyph_fonts, lambda ch, f: (f != font_id) & F.array_contains(known, f))
