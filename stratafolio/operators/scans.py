"""Two readings of a scan compared, and selected headings held against expected ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafolio.operators.diff import EQUAL, edit_script
from stratafolio.operators.headings import per_row

#: The least similarity of titles, the least length of a part of a heading and of a title's first line, and the share of a
#: page that an image covers in either direction to be the page; below so many characters a page image its file is images alone.
TITLE, PART, FIRST_LINE, COVERS, FEW_CHARS = 0.8, 6, 12, 0.6, 200
LABEL = re.compile(r"^\s*(chương|mục|điều|phần)\s+([ivxlcdm]+|\d+)(?!\w)", re.I)


def source_kind(covering: Column, chars: Column) -> Column:
    """What a document is made of, by its images that cover a page and its characters: native, image_only or mixed."""
    return F.when(F.coalesce(covering, F.lit(0)) == 0, "native").when(F.coalesce(chars, F.lit(0)) < FEW_CHARS * covering, "image_only").otherwise("mixed")


def covers_page(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return (width >= COVERS * page_width) & (height >= COVERS * page_height)


def view_differences(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Stretches of words in which two readings differ, between the words they share in order; neither is taken for right."""
    out, a, b = [], [], []
    for kind, i, j in [*edit_script(left, right)[0], (EQUAL, None, None)]:
        if kind == EQUAL:
            if a or b:
                out.append((" ".join(a), " ".join(b)))
            a, b = [], []
        elif i is not None:
            a.append(left[i])
        else:
            b.append(right[j])
    return out


def differing_views(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, left, right) of words: their differing stretches."""
    return per_row(pairs, "pair_id", ["left", "right"], view_differences, "pair_id long, left string, right string")


def _skeleton(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def _label(text: str | None) -> str | None:
    m = LABEL.match(text or "")
    return f"{m[1]} {m[2]}".lower() if m else None


def _similar(a: str, b: str) -> float:
    """1 - edit distance / the longer length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1.0 if not a and not b else 1 - row[-1] / max(len(a), len(b))


def scored_headings(expected: Sequence[dict], selected: Sequence[dict]) -> list[tuple[int, int | None, str, bool]]:
    """(selected, expected, kind, text exact) of selected headings (page, text) in order against expected ones (page, text, label), at
    most a page apart; an expected one is used once.

    A labelled heading takes the first free one with its label: heading; duplicate where all are taken. Another takes the first free
    unlabelled one with a similar skeleton (``TITLE``), else one that it is the first line of: heading; else split-part, if a labelled
    one has it in its text; extra otherwise."""
    used: set[int] = set()
    bare = [_skeleton(g["text"]) for g in expected]
    out: list[tuple[int, int | None, str, bool]] = []
    for n, r in enumerate(selected):
        near = [i for i, g in enumerate(expected) if abs(g["page"] - r["page"]) <= 1]
        label, own = _label(r["text"]), _skeleton(r["text"])
        if label:
            alike = [i for i in near if expected[i]["label"] and _label(expected[i]["label"]) == label]
            hit = next((i for i in alike if i not in used), None)
            kind = "heading" if hit is not None else "duplicate" if alike else "extra"
        else:
            free = [i for i in near if not expected[i]["label"] and i not in used] if own else []
            hit = next((i for i in free if _similar(bare[i], own) >= TITLE), None)
            if hit is None:
                hit = next((i for i in free if max(FIRST_LINE, len(bare[i]) // 2) <= len(own) < len(bare[i]) and _similar(bare[i][: len(own)], own) >= TITLE), None)
            kind = "heading" if hit is not None else "extra"
            if hit is None and len(own) >= PART:
                hit = next((i for i in near if expected[i]["label"] and own in bare[i]), None)
                kind = "split-part" if hit is not None else kind
        if kind == "heading":
            used.add(hit)
        out.append((n, hit, kind, kind == "heading" and " ".join(r["text"].split()) == " ".join(expected[hit]["text"].split())))
    return out


def scores(documents: DataFrame) -> DataFrame:
    """Rows (pair_id, expected, selected): a row per selected heading."""
    return per_row(documents, "pair_id", ["expected", "selected"], scored_headings, "pair_id long, selected int, expected int, kind string, exact boolean")
