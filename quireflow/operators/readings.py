"""Handwriting readings: plausibility, acceptance, and their merge into a page's elements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT, SHORT, NUMERIC, KEEP_PRINT = 0.45, 0.6, 0.25, 85
_NUMBER = r"^[\d\s/\-.,:]+$"


def plausible(text: Column, width: Column, height: Column) -> Column:
    """No token three times, not one letter repeated, and no more characters than a line of this shape can hold."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    often = F.exists(F.array_distinct(tokens), lambda w: F.size(F.filter(tokens, lambda v: v == w)) >= 3)
    letters = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    one = (F.length(letters) >= 2) & (F.length(F.replace(letters, F.substring(letters, 1, 1))) == 0)
    return ~often & ~one & (F.length(F.regexp_replace(text, r"\s", "")) <= F.greatest(F.lit(3.0), width / F.greatest(F.lit(1), height) * 2.5))


def accepted(text: Column, confidence: Column, width: Column, height: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(~plausible(text, width, height) | (n == 0), False)
        .when(text.rlike(_NUMBER), (confidence >= NUMERIC) & ((n >= 2) | (confidence >= 0.8)))
        .when(n < 3, False)
        .when(n < 5, confidence >= SHORT)
        .otherwise(confidence >= ACCEPT)
    )


def numeric_wins(free_confidence: Column, numeric_text: Column, numeric_confidence: Column) -> Column:
    """Whether the digit-constrained reading stands instead of the free one."""
    return numeric_text.rlike("[0-9]") & (numeric_confidence >= F.greatest(F.lit(0.2), free_confidence / 2))


def capped_confidence(c: Column) -> Column:
    return F.least(F.lit(75), F.floor(c * 100 + 0.5))


ELEMENTS = "doc_id long, id string, text string, x double, y double, width double, height double, confidence double, line_id string, reading_order int, origin string"


def apply_page(elements: list[dict], groups: list[dict], accepted_groups: list[bool], page_id: str) -> list[dict]:
    """Elements of a page after its groups have been read, in order; the first rule that rejects a group decides."""
    from quireflow.operators.layout import script_of_char

    out = [dict(e) for e in elements]

    def shared(a: dict, b: dict) -> float:
        w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
        h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
        return w * h if w > 0 and h > 0 else 0.0

    squash = lambda s: "".join(s.split()).lower()
    by_id = {e["id"]: e for e in elements}
    for k, (g, good) in enumerate(zip(groups, accepted_groups, strict=True)):
        mine = [by_id[i] for i in g["element_ids"] if i in by_id]
        if not good or any((s := script_of_char(c)) and s != "latin" for e in mine for c in e["text"]):
            continue
        tall = g["height"] / 1.3
        box = {"x": g["x"] + 0.15 * tall, "y": g["y"] + (g["height"] - tall) / 2, "width": g["width"] - 0.3 * tall, "height": tall}
        if not mine and sum(shared(e, box) for e in elements) > 0.3 * box["width"] * box["height"]:
            continue
        if any(e["confidence"] >= KEEP_PRINT and sum(c.isalnum() for c in e["text"]) >= 3 for e in mine):
            continue
        if mine and squash("".join(e["text"] for e in mine)) == squash(g["text"]):
            continue
        confidence = min(75, int(100 * g["confidence"] + 0.5))
        if mine:
            x, y = min(e["x"] for e in [*mine, box]), min(e["y"] for e in [*mine, box])
            new = mine[0] | {"text": g["text"], "x": x, "y": y, "width": max(e["x"] + e["width"] for e in [*mine, box]) - x, "height": max(e["y"] + e["height"] for e in [*mine, box]) - y, "confidence": confidence, "origin": "handwriting"}
            drop = {e["id"] for e in mine[1:]}
            out = [new if e["id"] == new["id"] else e for e in out if e["id"] not in drop]
        else:
            new_id = f"{page_id}-hw{int(g['x'] + 0.5)}-{int(g['y'] + 0.5)}"
            out.append({"doc_id": g["doc_id"], "id": new_id, "text": g["text"], **box, "confidence": confidence, "line_id": f"{new_id}-line", "reading_order": len(elements) + k, "origin": "handwriting"})
    return out


def apply_readings(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """Pages with their handwriting read: groups (doc_id, ord, element_ids, x, y, width, height, text, confidence)."""
    judged = groups.withColumn("good", F.coalesce(accepted(F.col("text"), F.col("confidence"), F.col("width"), F.col("height")), F.lit(False)))

    def page(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine, own = left.sort_values("reading_order").to_dict("records"), right.sort_values("ord").to_dict("records")
        return pd.DataFrame(apply_page(mine, own, [bool(g["good"]) for g in own], "p0"), columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    return elements.groupBy("doc_id").cogroup(judged.groupBy("doc_id")).applyInPandas(page, ELEMENTS)
