"""Binding quotes to the source text: an exact place, the context of a heading, a neighbour, another case, or a few edits away.

Every quote is bound by itself, from its own unit and the ``REACH`` units on either side, which a window gathers once per unit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]
#: Fixed values of the rule, none of them a limit of the search (texts have any length): units on either side that count as near; the quote
#: in which an edit may be at all, as one in less makes another word; edits allowed, one for so many characters.
REACH, SHORTEST_QUOTE, MOST_EDITS, PER_EDIT = 3, 8, 6, 30
BOUND = "bound_unit long, start int, end int, status string"


def places(text: str, part: str) -> Iterator[int]:
    """All places of a part, overlapping ones too."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def context_key(text: str) -> str:
    return "".join(text.split()).rstrip(":.;").upper()


def is_context(quote: str, path: str | None, labels: list[str | None]) -> bool:
    """Whether a label is what stands over its unit: its heading path, a run of the path's segments, or one of its labels."""
    key, segments = context_key(quote), [s for s in (path or "").split(" > ") if s]
    runs = (" > ".join(segments[i:j]) for i in range(len(segments)) for j in range(i + 1, len(segments) + 1))
    return bool(key) and any(context_key(x) == key for x in (*runs, *filter(None, labels)))


def lower(text: str) -> str:
    """Lower case letter by letter, as SQL's is: none becomes two or depends on its neighbours, so places stay."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def distances(part: str, text: str, anywhere: bool = False) -> Iterator[int]:
    """Edits between a part and the text up to each of its characters, from its beginning or, with ``anywhere``, from the best place before.
    A column of the table of distances is two numbers of a bit per character of the part: where it rises and where it falls (Myers)."""
    full, top, rises, falls, d = (1 << len(part)) - 1, 1 << len(part) - 1, (1 << len(part)) - 1, 0, len(part)
    at: dict[str, int] = {}
    for i, c in enumerate(part):
        at[c] = at.get(c, 0) | 1 << i
    for c in text:
        same = at.get(c, 0)
        kept = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (full ^ full & (kept | rises)), rises & kept
        d += bool(up & top) - bool(down & top)
        up, same = up << 1 | (not anywhere), same | falls
        rises, falls = full & down << 1 | (full ^ full & (same | up)), up & same
        yield d


def within_edits(text: str, quote: str) -> tuple[int, int] | None:
    """The one place with the fewest edits from the quote, case aside, if few enough; None for none or for two apart from each other.

    Edits of k leave one of k + 1 pieces of the quote whole, k places from where it should be at most, so nothing is lost by searching only
    around the pieces' places. One pass from behind gives each start's fewest edits; ends are worked out for the best starts."""
    if len(quote) < SHORTEST_QUOTE:
        return None
    t, q = lower(text), lower(quote)
    n, m, best = len(t), len(q), min(MOST_EDITS, max(1, len(q) // PER_EDIT))
    cut, spans, starts = [m * k // (best + 1) for k in range(best + 2)], [], []
    for at in heapq.merge(*(map((-a).__add__, places(t, q[a:b])) for a, b in zip(cut, cut[1:], strict=False))):
        if -best <= at <= n - m + best:
            a, b = max(0, at - best), min(n, at + m + best)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    for a, b in spans:
        for start, d in zip(range(b - 1, a - 1, -1), distances(q[::-1], t[a:b][::-1], anywhere=True), strict=True):
            if d < best:
                best, starts = d, []
            if d == best:
                starts.append(start)
    starts.sort()
    windows = ((s, s + i) for s in starts for i, d in enumerate(distances(q, t[s : s + m + best]), 1) if d == best)
    found = next(windows, None)
    if found is None or starts[-1] >= found[1]:
        return None
    for x in windows:
        if found[1] - found[0] == m:
            break
        found = min(found, x, key=lambda x: abs(x[1] - x[0] - m))
    return found


def bind(quote: str | None, role: str | None, unit: int, units: dict[int, str], path: str | None, labels: list[str | None]) -> tuple[int | None, int | None, int | None, str]:
    """(unit, start, end, status) of a quote that names ``unit``; ``units`` holds it and its neighbours. Each step needs one place only:
    EXACT, AMBIGUOUS (several in its unit), CONTEXT (a label that stands over the unit: nothing to bind), NEIGHBOUR, CASE, EDITED,
    MISSING; EMPTY and UNKNOWN_UNIT for a quote or a unit that isn't there."""
    if unit not in units:
        return None, None, None, "UNKNOWN_UNIT"
    if quote is None or not quote.strip():
        return None, None, None, "EMPTY"
    own = list(places(units[unit], quote))
    if own:
        return (unit, own[0], own[0] + len(quote), "EXACT") if len(own) == 1 else (None, None, None, "AMBIGUOUS")
    if role == "label" and is_context(quote, path, labels):
        return None, None, None, "CONTEXT"
    near = [(u, p[0]) for u, t in sorted(units.items()) if u != unit and len(p := list(places(t, quote))) == 1]
    if len(near) == 1:
        return near[0][0], near[0][1], near[0][1] + len(quote), "NEIGHBOUR"
    folded = list(places(lower(units[unit]), lower(quote)))
    if len(folded) == 1:
        return unit, folded[0], folded[0] + len(quote), "CASE"
    close = None if folded else within_edits(units[unit], quote)  # several places without an edit, which may overlap, aren't one
    return (unit, *close, "EDITED") if close else (None, None, None, "MISSING")


def bound(quotes: DataFrame, units: DataFrame, source: Names) -> DataFrame:
    """Adds bound_unit, start, end and status to quotes (unit, quote, role); ``units`` has (ord, text, path, labels) per source. A null
    text is empty. A quote whose unit isn't known stays, as UNKNOWN_UNIT.

    Quotes stand among the units in one window, so texts are shuffled once, and only rows of quotes leave it with the texts around."""
    unit = F.struct(F.coalesce("text", F.lit("")).alias("text"), "path", "labels")
    placed = units.dropna(subset=[*source, "ord"]).select(*source, F.col("ord").cast("long").alias("ord_"), unit.alias("unit_"))
    both = placed.unionByName(quotes.select(*source, F.col("unit").cast("long").alias("ord_"), F.struct(*quotes.columns).alias("quote_")), allowMissingColumns=True)
    w = Window.partitionBy(*source).orderBy("ord_")
    near = F.collect_list(F.when(F.col("unit_").isNotNull(), F.struct(F.col("ord_").alias("ord"), F.col("unit_.text").alias("text")))).over(w.rangeBetween(-REACH, REACH))
    own = F.first(F.when(F.col("unit_").isNotNull(), F.struct("unit_.path", "unit_.labels")), ignorenulls=True).over(w.rangeBetween(0, 0))
    met = both.withColumns({"near_": near, "own_": own}).filter("quote_ IS NOT NULL")
    met = met.select("quote_.*", "near_", F.col("own_.path").alias("path_"), F.col("own_.labels").alias("labels_"))
    kept = quotes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
            rows = zip(column("quote"), column("role"), column("unit"), column("near_"), column("path_"), column("labels_"), strict=True)
            found = [bind(q, r, u, {x["ord"]: x["text"] for x in near or []}, p, labels or []) for q, r, u, near, p, labels in rows]
            out = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, "bound_unit", "start", "end", "status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name in kept)
    return met.mapInArrow(run, f"{fields}, {BOUND}")
