"""Figures of pages: size filter and numbering, captions, nearby text, and what text alone says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.operators import evidence as E

# The sentences of an explanation, by language.
SAYINGS = {
    "English": {
        "caption": "Original caption: ",
        "nearby": "Nearby text on the same page: ",
        "structure": "The caption indicates that the figure explains a structure, process, or experimental layout.",
        "relationship": "The caption indicates that the figure compares items or shows a relationship between variables.",
        "image": "The caption identifies an image, map, or spectrum; specific visual features still require inspection of the figure.",
        "provisional": "The figure's role in the paper can only be inferred provisionally from its caption and should be checked against the main text.",
        "none": "No caption or nearby text was detected for a grounded explanation.",
        "unknown": [
            "Axis meanings, exact values, colors, and line styles cannot be confirmed from the current text evidence.",
            "Trends or objects not stated in the caption cannot be inferred safely from this text-only baseline.",
        ],
    },
    "中文": {
        "caption": "原文 caption：",
        "nearby": "同页邻近文字：",
        "structure": "caption 表明该图用于说明结构、流程或实验布局。",
        "relationship": "caption 表明该图用于比较对象或展示变量之间的关系。",
        "image": "caption 表明该图呈现实验图像、映射或谱学结果；具体视觉特征仍需查看原图。",
        "provisional": "该图在论文论证中的作用只能依据 caption 初步判断，需结合正文核实。",
        "none": "未检测到可用于解释该图的 caption 或邻近文字。",
        "unknown": ["坐标轴含义、精确数值、颜色和线型不能由当前文本证据确认。", "图像中未写入 caption 的趋势或对象不能安全推断。"],
    },
}


def extract_figures(images: DataFrame, blocks: DataFrame, page_sizes: DataFrame, min_width: int = 80, min_height: int = 80, min_area: int = 12_000) -> DataFrame:
    """Rows of images that are large enough, with image_index, caption and nearby_text.

    images: doc_id, page_number, image_no (order on the page), x0, y0, x1, y1 (null: the whole page), width, height and
    any other columns; image_index counts the kept ones of a page from 1. blocks: doc_id, page_number, block_no, x0, y0,
    x1, y1, text. page_sizes: doc_id, page_number, page_width, page_height.
    """
    size = [F.coalesce(c, F.lit(0)) for c in (F.col("width"), F.col("height"))]
    kept = images.where((size[0] >= min_width) & (size[1] >= min_height) & (size[0] * size[1] >= min_area)).join(page_sizes, ["doc_id", "page_number"])
    placed = kept.select(
        *[c for c in images.columns if c not in ("x0", "y0", "x1", "y1")],
        F.coalesce("x0", F.lit(0.0)).alias("x0"),
        F.when(F.col("x0").isNull(), 0.0).otherwise(F.col("y0")).alias("y0"),
        F.coalesce("x1", "page_width").alias("x1"),
        F.when(F.col("x0").isNull(), F.col("page_height")).otherwise(F.col("y1")).alias("y1"),
        "page_width",
        "page_height",
        F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("image_no")).alias("image_index"),
    )
    keys = ["doc_id", "page_number", "image_no"]
    named = placed.join(O.nearest_captions(placed, blocks), keys)
    return named.join(E.nearby_text(named, blocks).withColumnRenamed("nearby", "nearby_text"), keys).drop("page_width", "page_height")


def explained(caption: Column, nearby: Column, language: str = "English", purposes: dict[str, list[str]] = L.FIGURE_PURPOSES) -> Column:
    """(direct, inference, unknown), three arrays: what caption and nearby text say, what the caption suggests, what stays open."""
    say = SAYINGS[language]
    beside = T.clean_text(nearby)
    direct = F.filter(
        F.array(F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit(say["caption"]), caption)), F.when(beside != "", F.concat(F.lit(say["nearby"]), F.left(beside, F.lit(600))))),
        lambda x: x.isNotNull(),
    )
    purpose = E.figure_purpose(caption, nearby, purposes)
    told = F.coalesce(*[F.when(purpose == p, F.lit(say[p])) for p in (*purposes, "provisional")])
    return F.struct(
        F.when(F.size(direct) > 0, direct).otherwise(F.array(F.lit(say["none"]))).alias("direct"),
        F.filter(F.array(told), lambda x: x.isNotNull()).alias("inference"),
        F.array(*map(F.lit, say["unknown"])).alias("unknown"),
    )


def source_label(name: Column, page: Column) -> Column:
    return F.concat(name, F.lit(" · page "), page.cast("string"))
