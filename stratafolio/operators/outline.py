"""A model-free outline: candidate headings, format scores, levels from ranks, sequence and sibling checks, kinds of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.functions.text import marker
from stratafolio.operators.aggregates import upper_middle
from stratafolio.operators.folds import folded

Names = list[str]
#: What each sign of a heading adds, and the sum from which a line is a candidate.
WEIGHTS = {"larger": 0.45, "bold": 0.35, "numbered": 0.45, "short": 0.12, "open_end": 0.12, "capitals": 0.15, "long_next": 0.15}
CANDIDATE = 0.62
#: What captions, headings without a number, and names of heading styles look like.
CAPTION = r"(?iu)^\s*(Bảng|Hình|Biểu\s*đồ|Sơ\s*đồ|Table|Figure)\s*[\dIVX]"
KEYWORD = (
    r"(?iu)^\s*(MỤC LỤC|DANH MỤC[^\n]{0,40}|LỜI (CAM ĐOAN|CẢM ƠN|MỞ ĐẦU|NÓI ĐẦU)|MỞ ĐẦU|ĐẶT VẤN ĐỀ|TỔNG QUAN|KẾT LUẬN|KIẾN NGHỊ|TÀI LIỆU THAM KHẢO"
    r"|PHỤ LỤC|TÓM TẮT|ABSTRACT|NHẬN XÉT CHUNG)\s*$"
)
HEADING_STYLE = r"(?i)^(heading|title|tiêu đề)"


def candidate(text: Column, *, style: Column, bold: Column, centred: Column, body_bold: Column) -> Column:
    """Why a line may be a heading: the first of MARKER, KEYWORD, STYLE, CENTRED (and bold), BOLD (where the body isn't); null where
    nothing speaks for it, and for captions and blank lines."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    why = (
        F.when(marker(text).isNotNull(), "MARKER").when(text.rlike(KEYWORD), "KEYWORD").when(yes(style.rlike(HEADING_STYLE)), "STYLE")
        .when(yes(centred) & yes(bold), "CENTRED").when(yes(bold) & ~yes(body_bold), "BOLD")
    )
    return F.when(~text.rlike(CAPTION) & (F.trim(text) != ""), why)


def format_score(rows: DataFrame, doc: Names, order: str, text: str, size: str, bold: str, body_size: Column, body_bold: Column) -> DataFrame:
    """Adds score, the summed weights of the signs that a line shows, and whether it reaches ``CANDIDATE``."""
    t = F.trim(text)
    after = F.coalesce(F.lead(F.length(text)).over(Window.partitionBy(*doc).orderBy(order)), F.lit(0))
    signs = {
        "larger": F.col(size) > body_size, "bold": F.col(bold) & ~body_bold, "numbered": t.rlike(r"^\d+(\.\d+)+"), "short": F.length(t) <= 90,
        "open_end": ~t.rlike(r"[.!?;,]$"), "capitals": (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 6), "long_next": (after > 200) & (F.length(t) < 90),
    }
    total = sum((F.when(F.coalesce(c, F.lit(False)), WEIGHTS[n]).otherwise(0.0) for n, c in signs.items()), F.lit(0.0))
    return rows.withColumn("score", F.round(total, 2)).withColumn("candidate", F.col("score") >= CANDIDATE)


def body_baseline(rows: DataFrame, doc: Names, order: str, value: str, long: Column) -> DataFrame:
    """The commonest value among long paragraphs; of equal ones that seen first."""
    groups = rows.filter(long).groupBy(*doc, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return groups.groupBy(*doc).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("body"))


def format_rank(rows: DataFrame, doc: Names, size: str, bold: str) -> DataFrame:
    """Adds rank: 20 and the dense rank of (size descending, bold first)."""
    return rows.withColumn("rank", 20 + F.dense_rank().over(Window.partitionBy(*doc).orderBy(F.desc_nulls_last(size), F.desc(bold))))


def levels_of_ranks(rows: DataFrame, doc: Names, order: str, rank: str, deepest: int = 9) -> DataFrame:
    """Adds level: one more than that of the nearest earlier row with a smaller rank, at most ``deepest``. Ranks may be any numbers; a
    null rank begins anew at level 1, and what follows stands below it.

    What is still open is a stack, which a window can't hold, so the outline is folded in order."""

    def fold(stack: list[float], r: float | None) -> int:
        while stack and (r is None or stack[-1] >= r):
            stack.pop()
        stack.append(-math.inf if r is None else r)
        return min(len(stack), deepest)

    return folded(rows, doc, [order], [rank], list, fold, "level", "int")


def sequence_gaps(rows: DataFrame, group: Names, order: str, value: str) -> DataFrame:
    """Siblings whose number isn't the one before plus one, in groups of two or more."""
    w = Window.partitionBy(*group).orderBy(order)
    seen = rows.filter(F.col(value).isNotNull()).withColumn("expected", F.lag(value).over(w) + 1)
    return seen.filter(F.col("expected").isNotNull() & (F.col(value) != F.col("expected")))


def asymmetry(rows: DataFrame, group: Names, length: str, least: int = 3) -> DataFrame:
    """Siblings more than three times as long as the upper middle of their group of at least ``least``."""
    middle = rows.groupBy(*group).agg(upper_middle(length).alias("middle"), F.count(F.lit(1)).alias("n_")).filter(F.col("n_") >= least).drop("n_")
    return rows.join(middle, group).filter(F.col(length) > 3 * F.greatest("middle", F.lit(1)))


def document_kind(lines: DataFrame, doc: Names, text: str) -> DataFrame:
    """Counts of a document's lines by their look, and a kind decided by the first rule that holds."""
    t = F.col(text)
    counts = lines.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(t.rlike(r"^\s*\d+[.)]\s")).alias("numbered"), F.count_if(F.length(t) > 200).alias("long"),
        F.count_if((F.length(t) > 0) & (F.length(t) <= 40)).alias("short"), F.count_if(t.rlike(r"[#*$%&|]{3,}")).alias("junk"), F.sum(F.length(t)).alias("chars"),
    )
    n = F.col("lines")
    kind = F.when(2 * F.col("junk") >= n, "damaged").when(3 * F.col("numbered") >= n, "numbered").when(2 * F.col("short") >= n, "list").when(2 * F.col("long") >= n, "prose").otherwise("mixed")
    return counts.withColumn("kind", kind)


def place_by_chain(sources: DataFrame, targets: DataFrame, by: Names, chain: str, id_: str) -> DataFrame:
    """Where a source's section goes: the target section with the same chain (EXACT), several (AMBIGUOUS) or none (NEW)."""
    found = targets.groupBy(*by, chain).agg(F.count(F.lit(1)).alias("n_"), F.min(id_).alias("target"))
    out = sources.join(found, [*by, chain], "left")
    status = F.when(F.col("n_").isNull(), "NEW").when(F.col("n_") > 1, "AMBIGUOUS").otherwise("EXACT")
    return out.withColumn("status", status).withColumn("target", F.when(F.col("n_") == 1, F.col("target"))).drop("n_")


#: Confidence of a heading with a marker and without, what lowers it and by how much, and the labels that open a paragraph.
CONFIDENCE, PENALTIES = (0.9, 0.7), {"needs_split": 0.1, "repeat": 0.2, "inline_label": 0.25, "in_table": 0.15}
LONGEST_HEADING, MOST_REPEATS = 120, 2
INLINE_LABEL = r"(?iu)^\s*(Nhận xét|Ghi chú|Lưu ý|Đánh giá|Thời gian|Địa điểm|Thành phần|Chủ trì|Thư ký|Căn cứ)\s*:"


def confidence(rows: DataFrame, doc: Names, text: str, heading: str, *, in_table: Column, style: Column) -> DataFrame:
    """Adds confidence (0.9 with a marker, else 0.7, less the penalties, 0 at least) and flags: needs_split for a heading of more than 120
    characters, repeat_xN for a text that stands more than twice in its document (case and spacing aside), inline_label, in_table, and
    marker_over_style where both a marker and a heading style speak for the line."""
    key = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    times = rows.groupBy(*doc, key.alias("key_")).agg(F.count(F.lit(1)).alias("times_"))
    met = rows.withColumn("key_", key).join(times, [*doc, "key_"]).withColumn("marked_", marker(F.col(text)).isNotNull())
    signs = {
        "needs_split": F.length(heading) > LONGEST_HEADING, "repeat": F.col("times_") > MOST_REPEATS, "inline_label": F.col(text).rlike(INLINE_LABEL), "in_table": in_table,
    }
    holds = {n: F.coalesce(c, F.lit(False)) for n, c in signs.items()}
    lost = sum((F.when(c, PENALTIES[n]).otherwise(0.0) for n, c in holds.items()), F.lit(0.0))
    name = lambda n: F.concat(F.lit("repeat_x"), F.col("times_").cast("string")) if n == "repeat" else F.lit(n)
    flags = [F.when(c, name(n)) for n, c in holds.items()] + [F.when(F.col("marked_") & F.coalesce(style, F.lit(False)), "marker_over_style")]
    base = F.when(F.col("marked_"), CONFIDENCE[0]).otherwise(CONFIDENCE[1])
    out = met.withColumn("confidence", F.greatest(F.round(base - lost, 2), F.lit(0.0))).withColumn("flags", F.array_compact(F.array(*flags)))
    return out.drop("key_", "times_", "marked_")
