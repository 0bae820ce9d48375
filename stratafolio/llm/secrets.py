"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the three base kinds, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the Markov models score: long runs of the characters that keys are written in.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
MARK = "[SECRET]"
#: Characters that lines of one repeated character are made of.
RULED = "-_=+/xX0123456789aeiouz"
SPANS = "array<struct<start:int,end:int,found:string>>"
#: Words that identifiers are made of, so that the model of ordinary strings never lacks samples.
IDENTIFIER_WORDS = (
    "access account action active address admin amount array backup batch block buffer build cache callback category channel check class client cluster "
    "code column command commit config connection container content context control count create current customer data database date default delete "
    "detail device document driver element email enabled engine entry error event example export feature field file filter folder format function global "
    "group handle header height history host image import index input instance item label language length level limit list local location logger "
    "manager message method model module name network node number object offset option order output package page parameter parent path pattern "
    "position primary process product profile project property query queue range record region release remote report request resource response "
    "result return sample schedule schema screen search section select server service session setting source stage state status storage string "
    "summary system table target template test text thread time title token total type update upload user value version view width window"
).split()


#: Every match of a base kind has one of these strings in its lower-cased text, so a text without them isn't searched.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "hex": ()}
#: A text is cut into blocks of so many code points before pieces are taken out of it by place, which takes steps from a block's start.
BLOCK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(values: Column, step: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """The running results of ``step`` (an associative one, ``nothing`` its neutral value) over an array, in rounds that double
    their reach: n log n steps, where a fold that appends to an array takes n * n."""
    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int") - 1)

    def double(a: Column, i: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), i).cast("int"), F.size(a))
        return F.zip_with(F.concat(F.array_repeat(nothing, shift), F.slice(a, F.lit(1), F.size(a) - shift)), a, step)

    return let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, double)).otherwise(v))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, found), in code points; the texts between matches give the places."""

    def placed(found: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        widths = F.zip_with(before, found, lambda b, m: F.length(b) + F.length(m))
        ends = scanned(widths, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))

    nothing = F.array().cast(SPANS)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(nothing))


def hinted(text: Column, kind: str, found: Column) -> Column:
    """``found``, worked out only where the text has a string that the kind can't do without."""
    some = [F.contains(F.lower(text), F.lit(x)) for x in HINTS[kind]]
    return F.when(reduce(or_, some), found).otherwise(F.array().cast(SPANS)) if some else found


def base_spans(text: Column) -> dict[str, Column]:
    """Per base kind its spans; a match that is too short is dropped, and the search has gone on after it."""
    long_value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6
    return {
        "assign": hinted(text, "assign", F.filter(spans(text, ASSIGN), long_value)),
        "access": hinted(text, "access", F.filter(spans(text, ACCESS), lambda s: F.length(s["found"]) >= 20)),
        # runs of hex digits are maximal, so asking for the length in the pattern finds the same ones
        "hex": spans(text, "[0-9a-f]{24,}"),
    }


# ---------------------------------------------------------------------------------------------------------------- model


def random_samples(spark: SparkSession, n: int = 1500) -> DataFrame:
    """n labelled random strings in each of four alphabets (hex, base64, URL-safe base64, capitals and digits), from SHA-256 of
    the numbers 0 to n - 1: the same ones in every run."""
    digest = F.sha2(F.concat(F.lit("random-sample-"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    capitals = F.substring(F.translate(F.upper(F.base64(F.unhex(F.sha2(digest.cast("binary"), 256)))), "+/=", ""), 1, 32)
    return spark.range(n).select(F.explode(F.array(digest, b64, F.translate(b64, "+/=", "-_"), capitals)).alias("token"))


def ordinary_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 400, per_doc: int = 200) -> DataFrame:
    """Labelled ordinary strings: the words of letters of some ``sample_docs`` documents (at most ``per_doc`` different ones of
    each), the fixed identifier words, and identifiers joined from both in the usual ways.

    The sample only fits the classifier: documents whose id's hash falls into one of n / sample_docs classes.
    """
    spark = docs.sparkSession
    classes = max(1, docs.count() // sample_docs)
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(classes)) == 0)
    letters = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[A-Za-z]{3,}"), F.lit(0))), 1, per_doc)
    n = len(IDENTIFIER_WORDS)
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) + 1).cast("int"))
    fixed = spark.range(4000).select(pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), pick(4).alias("d"))
    own = some.select(letters.alias("w")).filter(F.size("w") >= 4).select(F.explode(F.expr("sequence(1, size(w) - 3)")).alias("i"), "w")
    own = own.select(*[F.element_at("w", F.col("i") + k).alias(name) for k, name in enumerate("abcd")])
    four = fixed.unionByName(own)
    number = F.pmod(F.xxhash64("a", "b"), F.lit(100)).cast("string")
    forms = [
        F.concat_ws("_", "a", "b", "c", "d"), F.concat_ws("-", "a", "b", "c"), F.concat_ws("/", "a", "b", "c", "d"),
        F.concat(F.lower("a"), F.initcap("b"), F.initcap("c"), F.initcap("d")), F.concat_ws("_", F.upper("a"), F.upper("b"), F.upper("c")),
        F.concat_ws("_", "a", "b", number), F.concat("a", "b", "c"), F.concat_ws("-", F.lit("20"), number, "a", "b"),
        F.concat_ws("+", "a", "b", "c"), F.concat_ws("=", "a", "b", "c"), F.concat_ws("//", "a", "b", "c"), F.upper(F.concat("a", "b", "c")),
        F.rpad(F.abs(F.xxhash64("b", "c")).cast("string"), 24, "0123456789"), F.concat_ws("-", F.concat(F.lit("20"), number), number, F.reverse(number), "a", number, "b"),
    ]
    rules = F.split(F.lit(RULED), "")
    ruled = spark.range(200).select(F.explode(F.filter(rules, lambda c: c != "")).alias("c")).select(F.repeat("c", F.lit(24)).alias("token"))
    return four.select(F.explode(F.array(*forms)).alias("token")).unionByName(ruled)


class Model(NamedTuple):
    """The log-likelihood ratio of every pair of ASCII codes in thousandths (index 128 * first + second), and the mean a character
    from which a token counts as a random string."""

    ratios: list[int]
    least_mean: int


def trained(random: DataFrame, ordinary: DataFrame, *, spared: float = 0.999, floor: int = 300) -> Model:
    """Two first-order models with add-one smoothing, compared pair by pair, and the threshold that ``spared`` of the ordinary
    samples of a token's length stay below (``floor`` at least). What comes to the driver is a count per label and pair, at most
    2 * 128 * 128, and the threshold."""
    labelled = random.select("token", F.lit(1).alias("label")).unionByName(ordinary.select("token", F.lit(0).alias("label")))
    chars = labelled.select("label", F.filter(F.split("token", ""), lambda c: c != "").alias("c")).filter(F.size("c") > 1)
    pairs = chars.select("label", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("x"), F.slice("c", 2, F.size("c") - 1).alias("y"))).alias("p"))
    rows = pairs.select("label", F.ascii("p.x").alias("x"), F.ascii("p.y").alias("y")).filter("x < 128 AND y < 128").groupBy("label", "x", "y").count().collect()
    counts = {(r["label"], r["x"], r["y"]): r["count"] for r in rows}
    totals: dict[tuple[int, int], int] = {}
    for (label, x, _), n in counts.items():
        totals[label, x] = totals.get((label, x), 0) + n
    symbols = 66
    log = lambda label, x, y: math.log((counts.get((label, x, y), 0) + 1) / (totals.get((label, x), 0) + symbols))
    ratios = [round(1000 * (log(1, x, y) - log(0, x, y))) for x in range(128) for y in range(128)]
    long = ordinary.filter(F.col("token").rlike(f"^{TOKEN}$"))
    reached = long.select((likelihood(F.col("token"), ratios) / F.length("token")).alias("mean")).agg(F.percentile("mean", F.lit(spared)).alias("p")).first()["p"]
    return Model(ratios, max(floor, math.ceil(reached or 0)))


def likelihood(token: Column, model: list[int]) -> Column:
    """The summed log-likelihood ratio of a token, in thousandths; above 0 it is likelier a random string."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, c: Column) -> Column:
        gain = F.when((a["last"] >= 0) & (a["last"] < 128) & (c < 128), F.get(table, a["last"] * 128 + c)).otherwise(F.lit(0))
        return F.struct(c.alias("last"), (a["sum"] + gain).alias("sum"))

    return F.aggregate(codes, start, step, lambda a: a["sum"])


# ----------------------------------------------------------------------------------------------------------------- scan


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that touch no base span, told in one pass over both in order: the furthest end before and the nearest start after."""

    def told(every: Column) -> Column:
        before = scanned(F.transform(every, lambda e: F.when(e["base"], e["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        far = F.lit(2**31 - 1)
        backwards = F.reverse(F.transform(every, lambda e: F.when(e["base"], e["start"]).otherwise(far)))
        after = F.reverse(scanned(backwards, lambda a, b: F.least(a, b), far))
        seen = F.zip_with(F.arrays_zip(before.alias("before"), after.alias("after")), every, lambda x, e: F.struct(e.alias("e"), (~e["base"] & (x["before"] <= e["start"]) & (x["after"] >= e["end"])).alias("free")))
        return F.transform(F.filter(seen, lambda x: x["free"]), lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["found"].alias("found")))

    marked = lambda spans_, flag: F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("base"), s["found"].alias("found")))
    both = (F.size(tokens) > 0) & (F.size(base) > 0)
    return F.when(both, let(F.array_sort(F.concat(marked(base, True), marked(tokens, False))), told)).otherwise(tokens)


def with_spans(docs: DataFrame, text: Column, model: Model) -> DataFrame:
    """Adds ``__sf_spans`` (kind, start, end by start and kind) and the base kinds' own columns to rows of ``docs``.

    A token of 20 characters or more is a secret if its log-likelihood ratio is at least the model's threshold a character, and it
    touches no base span. The time grows with the text and n log n of its n matches.
    """
    out = docs.withColumn("__sf_text", F.coalesce(text.cast("string"), F.lit("")))
    for kind, column in base_spans(F.col("__sf_text")).items():
        out = out.withColumn(f"__sf_{kind}", column)
    random = lambda s: likelihood(s["found"], model.ratios) >= model.least_mean * F.length(s["found"])
    out = out.withColumn("__sf_tokens", spans(F.col("__sf_text"), TOKEN))
    out = out.withColumn("__sf_free", apart(F.col("__sf_tokens"), F.concat("__sf_assign", "__sf_access", "__sf_hex")))
    out = out.withColumn("__sf_markov", F.when(F.size("__sf_free") > 0, F.filter("__sf_free", random)).otherwise(F.array().cast(SPANS)))
    one = lambda k, kind: F.transform(f"__sf_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    every = [one(k, kind) for k, kind in enumerate(KINDS)]
    return out.withColumn("__sf_base", F.array_sort(F.concat(*every[:3]))).withColumn("__sf_spans", F.array_sort(F.concat(*every)))


def listed(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def model_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The models' ratios and threshold, trained from generated random strings and the corpus's own words."""
    return trained(random_samples(docs.sparkSession), ordinary_samples(docs, id_col=id_col, text_col=text_col))


def scan(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans, over its whole text.

    A null or empty text has no spans (base_sha256 is that of the empty string); repeated rows each have a row; a null id stays
    null; spans that start together are listed in the order of the kinds. There is no shuffle: a row's spans depend on its text
    and the model. Only the columns named are read, so others may have any names. An empty table gives no rows.
    """
    model = model or model_of(docs, id_col=id_col, text_col=text_col)
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__sf_in")), F.col("__sf_in"), model)
    counts = [F.size(f"__sf_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("__sf_base").cast("binary"), 256).alias("base_sha256"), listed("__sf_spans").alias("spans"))


def base_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The three base kinds alone, as :func:`scan` has them: doc_id, n_assign, n_access, n_hex and base_sha256."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__sf_text"))
    for kind, column in base_spans(F.col("__sf_text")).items():
        out = out.withColumn(f"__sf_{kind}", column)
    one = lambda k, kind: F.transform(f"__sf_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    out = out.withColumn("__sf_base", F.array_sort(F.concat(*[one(k, kind) for k, kind in enumerate(KINDS[:3])])))
    return out.select("doc_id", *[F.size(f"__sf_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed("__sf_base").cast("binary"), 256).alias("base_sha256"))


def _replaced(text: Column, spans_: Column, mark: str) -> Column:
    """The text with its spans (in order) replaced by ``mark``, overlapping ones by one.

    The text is cut at the ends of what goes and at every ``BLOCK`` code points, so each piece is taken out of a block.
    """
    bounds = F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def holes(sorted_: Column) -> Column:
        def opened(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            kept = F.zip_with(before, sorted_, lambda e, s: F.struct(s["start"].alias("start"), e.alias("before")))
            starts = F.filter(kept, lambda x: x["start"] >= x["before"])  # where a hole opens, and how far the one before it reached

            def closed(x: Column) -> Column:
                reach = F.concat(F.slice(F.transform(x, lambda y: y["before"]), F.lit(2), F.size(x)), F.array(F.element_at(ends, -1)))
                return F.zip_with(x, reach, lambda y, e: F.struct(y["start"].alias("start"), e.alias("end")))

            return let(starts, closed)

        return let(scanned(F.transform(sorted_, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), opened)

    def glued(x: Column) -> Column:
        length = F.length(x["text"])
        opens = F.concat(F.array(F.lit(0)), F.transform(x["holes"], lambda h: h["end"]))
        closes = F.concat(F.transform(x["holes"], lambda h: h["start"]), F.array(length))
        gaps = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        blocks = F.regexp_extract_all(x["text"], F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

        def cut(y: Column) -> Column:
            def gap(g: Column) -> Column:
                first, last = F.floor(g["a"] / BLOCK).cast("int"), F.floor((g["b"] - 1) / BLOCK).cast("int")
                inner = F.transform(F.sequence(first, last), lambda k: F.substring(F.get(y["blocks"], k), F.greatest(g["a"] - k * BLOCK, F.lit(0)) + 1, F.least(g["b"] - k * BLOCK, F.lit(BLOCK)) - F.greatest(g["a"] - k * BLOCK, F.lit(0))))
                return F.when(g["b"] > g["a"], F.array_join(inner, "")).otherwise(F.lit(""))

            return F.array_join(F.transform(y["gaps"], gap), mark)

        return let(F.struct(blocks.alias("blocks"), gaps.alias("gaps")), cut)

    return let(F.struct(text.alias("text"), let(bounds, holes).alias("holes")), glued)


def redacted(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with every secret replaced by ``mark`` (overlapping spans by one), in the columns of ``docs``.

    A text without secrets, empty or null, stays as it is; repeated rows stay; a column ``n_chars`` follows the new length; an
    empty table gives no rows. The time grows with the text and n log n of its n secrets.
    """
    model = model or model_of(docs, id_col=id_col, text_col=text_col)
    found = with_spans(docs, F.col(text_col), model)
    out = found.withColumn("__sf_new", F.when(F.size("__sf_spans") > 0, _replaced(F.col("__sf_text"), F.col("__sf_spans"), mark)).otherwise(F.col(text_col)))
    columns = {text_col: F.col("__sf_new"), "n_chars": F.when(F.size("__sf_spans") > 0, F.length("__sf_new")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes).get("n_chars", "long")) if "n_chars" in docs.columns else None}
    return out.select(*[columns[c].alias(c) if columns.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
