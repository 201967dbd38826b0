"""Page regions: geometry of the boxes that are read, and what region names say. Literal tables and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import let

MODES = ("fast", "balanced", "stable")
# Named boxes as left, top, right, bottom in hundredths of the page.
PRIORITY = [
    ("priority-left-middle", 0, 42, 58, 66),
    ("priority-left-upper", 0, 8, 62, 34),
    ("priority-full-middle", 0, 36, 100, 68),
    ("priority-left-lower-middle", 0, 54, 64, 82),
]
ENHANCED = [
    ("full-middle", 0, 36, 100, 68),
    ("left-middle", 0, 42, 58, 66),
    ("left-lower-middle", 0, 54, 64, 82),
    ("full-upper-middle", 0, 22, 100, 54),
    ("left-wide-middle", 0, 32, 72, 74),
]
ENHANCED_OUTSIDE_STABLE = 3
GRID_ROWS, GRID_COLUMNS, GRID_OVERLAP = 8, 3, 0.04
LEAST_SIDE = 20
SOURCES, VARIANTS = ("400dpi", "base"), ("plain", "x2sharp", "x2binary")
#: Reading modes of the recogniser for enhanced regions.
READINGS = {"stable": [6, 7, 11], "other": [6, 11], "secondary": [6]}
#: Least score and lead of a repaired candidate that is promoted.
PROMOTION = {"stable": (80, 15), "balanced": (90, 25)}


def mode_of(mode: str | None) -> str:
    """The mode, or balanced for anything unknown."""
    m = (mode or "").strip().lower()
    return m if m in MODES else "balanced"


def box(width: Column, height: Column, left, top, right, bottom) -> list[Column]:
    """A box in pixels, cut off at the page; fractions of the page, rounded down."""
    at = lambda side, part: (side * part).cast("int")
    return [
        F.greatest(F.lit(0), at(width, left)).alias("left"),
        F.greatest(F.lit(0), at(height, top)).alias("top"),
        F.least(width, at(width, right)).alias("right"),
        F.least(height, at(height, bottom)).alias("bottom"),
    ]


def named_regions(pages: DataFrame, which: str, mode: str = "balanced") -> DataFrame:
    """pages: page_id, width, height. One row per page and box: region_ord, region_name, left, top, right, bottom; none for pages under 20 pixels."""
    table = PRIORITY[: 3 if mode == "fast" else None] if which == "priority" else ENHANCED[: None if mode == "stable" else ENHANCED_OUTSIDE_STABLE]
    rows = F.array(*(F.struct(F.lit(i).alias("region_ord"), F.lit(n).alias("region_name"), *(F.lit(v / 100).alias(f"f{k}") for k, v in enumerate(b))) for i, (n, *b) in enumerate(table, 1)))
    each = pages.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE)).select("page_id", "width", "height", F.explode(rows).alias("r"))
    return each.select("page_id", "r.region_ord", "r.region_name", *box(F.col("width"), F.col("height"), F.col("r.f0"), F.col("r.f1"), F.col("r.f2"), F.col("r.f3")))


def grid_regions(pages: DataFrame) -> DataFrame:
    """As named_regions() for the eight by three cells, which overlap by four hundredths; cells under 20 pixels are left out."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRID_ROWS - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(GRID_COLUMNS - 1)), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    each = pages.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE)).select("page_id", "width", "height", F.explode(cells).alias("cell"))
    r, c = F.col("cell.r"), F.col("cell.c")
    w, h = F.col("width"), F.col("height")
    edge = lambda k, side, n: (k * side / n).cast("int")
    over = lambda side: (side * GRID_OVERLAP).cast("int")
    sides = [
        F.greatest(F.lit(0), edge(c, w, GRID_COLUMNS) - over(w)).alias("left"),
        F.greatest(F.lit(0), edge(r, h, GRID_ROWS) - over(h)).alias("top"),
        F.least(w, edge(c + 1, w, GRID_COLUMNS) + over(w)).alias("right"),
        F.least(h, edge(r + 1, h, GRID_ROWS) + over(h)).alias("bottom"),
    ]
    name = F.concat(F.lit("cell-r"), (r + 1).cast("string"), F.lit("-c"), (c + 1).cast("string"))
    out = each.select("page_id", (r * GRID_COLUMNS + c + 1).cast("int").alias("region_ord"), name.alias("region_name"), *sides)
    return out.filter((F.col("right") - F.col("left") >= LEAST_SIDE) & (F.col("bottom") - F.col("top") >= LEAST_SIDE))


def enhanced_names(files: DataFrame, mode: str = "balanced", *carried: str) -> DataFrame:
    """files: file_id, suffix. The enhanced regions of a file in order: carried (columns of files), seq, source, box_name, variant, region_name."""
    boxes = [b[0] for b in (ENHANCED if mode == "stable" else ENHANCED[:ENHANCED_OUTSIDE_STABLE])]
    every = [(s, b, v) for s in SOURCES for b in boxes for v in VARIANTS]
    rows = F.array(*(F.struct(F.lit(i).alias("at"), *(F.lit(x).alias(k) for k, x in zip(("source", "box_name", "variant"), t, strict=True))) for i, t in enumerate(every)))
    each = files.select("file_id", "suffix", *carried, F.explode(rows).alias("r")).select("file_id", "suffix", *carried, "r.*")
    binary = F.lit(mode == "stable") | (F.col("suffix") != ".pdf") | (F.col("source") == SOURCES[0])
    kept = each.filter(((F.col("source") != SOURCES[0]) | (F.col("suffix") == ".pdf")) & ((F.col("variant") != VARIANTS[2]) | binary))
    return kept.select("file_id", *carried, F.col("at").alias("seq"), "source", "box_name", "variant", F.concat_ws("-", F.lit("enhanced"), "source", "box_name", "variant").alias("region_name"))


def enhanced_table(pdf: bool, mode: str = "balanced") -> list[tuple[int, str, str, str, str]]:
    """The enhanced regions of a document or an image in order: seq, source, box_name, variant, region_name."""
    boxes = [b[0] for b in (ENHANCED if mode == "stable" else ENHANCED[:ENHANCED_OUTSIDE_STABLE])]
    every = enumerate((s, b, v) for s in SOURCES for b in boxes for v in VARIANTS)
    kept = ((i, s, b, v) for i, (s, b, v) in every if (s != SOURCES[0] or pdf) and (v != VARIANTS[2] or mode == "stable" or not pdf or s == SOURCES[0]))
    return [(i, s, b, v, f"enhanced-{s}-{b}-{v}") for i, s, b, v in kept]


def evidence_source(name: Column) -> Column:
    out = F.lit("other")
    for s in SOURCES:
        out = F.when(F.startswith(name, F.lit(f"enhanced-{s}-")), s).otherwise(out)
    return out


def evidence_region(name: Column) -> Column:
    """The box of an enhanced region: its name without prefix, source and variant."""
    body = F.regexp_replace(F.regexp_replace(name, "^enhanced-", ""), "^(400dpi|base)-", "")
    return F.regexp_replace(body, r"-(plain|x2sharp|x2binary)\z", "")


def evidence_variant(name: Column) -> Column:
    return F.when(name.rlike(r"-(plain|x2sharp|x2binary)\z"), F.regexp_extract(name, r"-(plain|x2sharp|x2binary)\z", 1)).otherwise("other")


def evidence_parts(name: Column) -> Column:
    """struct(source, box, variant) as the three functions above have them, without patterns: for names within arrays, where patterns cost most."""

    def cut(c: Column, heads) -> Column:
        out = c
        for h in heads:
            out = F.when(F.startswith(c, F.lit(h)), F.substr(c, F.lit(len(h) + 1))).otherwise(out)
        return out

    def ending(c: Column, of) -> Column:
        out = of(None)
        for v in VARIANTS:
            out = F.when(F.endswith(c, F.lit(f"-{v}")), of(v)).otherwise(out)
        return out

    variant = ending(name, lambda v: F.lit(v or "other"))
    box_of = lambda b: ending(b, lambda v: F.left(b, F.length(b) - len(v) - 1) if v else b)
    return let(let(cut(name, ["enhanced-"]), lambda a: cut(a, [f"{s}-" for s in SOURCES])), lambda b: F.struct(evidence_source(name).alias("source"), box_of(b).alias("box"), variant.alias("variant")))


def is_secondary(name: Column) -> Column:
    return name.rlike(r"-(x2sharp|x2binary)\z")


def is_diagnostic(name: Column) -> Column:
    return F.startswith(name, F.lit("区域裁剪失败")) | F.startswith(name, F.lit("区域裁剪跳过"))


def review_box(name: Column) -> Column:
    """struct(l, t, r, b) in thousandths for priority regions and grid cells; null for others."""
    out = F.lit(None).cast("struct<l:int,t:int,r:int,b:int>")
    for n, *sides in PRIORITY:
        out = F.when(name == n, F.struct(*(F.lit(10 * v).alias(k) for k, v in zip("ltrb", sides, strict=True)))).otherwise(out)
    row, col = (F.regexp_extract(name, r"^cell-r([0-9]+)-c([0-9]+)\z", k).try_cast("int") - 1 for k in (1, 2))
    over = int(1000 * GRID_OVERLAP)
    low = lambda i, n: F.greatest(F.lit(0), F.floor(i * 1000 / n) - over)
    high = lambda i, n: F.least(F.lit(1000), F.floor((i + 1) * 1000 / n) + over)
    cell = F.struct(*(x.cast("int").alias(k) for k, x in zip("ltrb", (low(col, GRID_COLUMNS), low(row, GRID_ROWS), high(col, GRID_COLUMNS), high(row, GRID_ROWS)), strict=True)))
    return F.when(row.between(0, GRID_ROWS - 1) & col.between(0, GRID_COLUMNS - 1), cell).otherwise(out)


def apart(a: Column, b: Column) -> Column:
    """Whether two boxes share no area."""
    return (a["r"] <= b["l"]) | (b["r"] <= a["l"]) | (a["b"] <= b["t"]) | (b["b"] <= a["t"])


def page_number(stem: Column) -> Column:
    """N of `page-N`, at least 1; 1 for other names."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(stem, r"^page-(.*)\z", 1).try_cast("int"), F.lit(1)))


def otsu_threshold(histograms: DataFrame) -> DataFrame:
    """histograms: image_id, level (0 to 255), n. The level that best parts dark from light: image_id, threshold; the first on ties, 127 if none parts."""
    from pyspark.sql import Window

    upto = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("image_id")
    level, n = F.col("level"), F.col("n")
    h = histograms.filter(level < 256).select(
        "image_id", "level", F.sum("n").over(upto).alias("back"), F.sum(level * n).over(upto).alias("back_sum"), F.sum("n").over(all_).alias("total"), F.sum(level * n).over(all_).alias("sum")
    )
    fore = F.col("total") - F.col("back")
    gap = F.col("back_sum") / F.nullif("back", F.lit(0)) - (F.col("sum") - F.col("back_sum")) / F.nullif(fore, F.lit(0))
    v = F.when((F.col("back") > 0) & (fore > 0), F.col("back") * fore * gap * gap)
    best = h.withColumn("v", v).groupBy("image_id").agg(F.max_by("level", F.when(F.col("v").isNotNull(), F.struct("v", (-level).alias("minus")))).alias("t"))
    return best.select("image_id", F.coalesce("t", F.lit(127)).cast("int").alias("threshold"))
