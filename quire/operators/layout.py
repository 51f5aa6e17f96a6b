"""Layout boxes of page images (page_id, label, score, x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from .rows import flat_map, written


def kind(label: Column) -> Column:
    return F.when(label.isin(*folds.FIGURE_LABELS, *folds.ASSET_LABELS), "visual").when(label.isin(*folds.DROPPED_LABELS), "drop").otherwise("text")


def priority(label: Column) -> Column:
    k = kind(label)
    return F.when(k == "visual", 3).when(k == "text", 2).otherwise(1)


def normalised(raw: DataFrame) -> DataFrame:
    """page_id, label, score, bbox from page_id, box struct<label, score, bbox>: boxes with four numbers, scores that can be read."""
    box = F.transform("box.bbox", lambda x: x.try_cast("double"))
    score = F.coalesce(F.nullif(F.col("box.score"), F.lit("")), F.lit("0")).try_cast("double")
    out = raw.select("page_id", F.lower(F.trim(F.coalesce("box.label", F.lit("")))).alias("label"), score.alias("score"), box.alias("bbox"))
    return out.filter((F.size("bbox") == 4) & F.col("score").isNotNull() & F.forall("bbox", lambda x: x.isNotNull()))


#: Layout detectors by name: what makes a client, in each task, that maps an image to JSON, a list of {label, score, bbox}. The stub
#: takes the image's bytes for its answer; others are added by the user.
DETECTORS: dict[str, Callable[[], Callable[[bytes], str]]] = {"stub": lambda: lambda image: bytes(image).decode("utf-8", "replace")}
ANSWER = "array<struct<label:string,score:string,bbox:array<string>>>"


def detected(images: DataFrame, backend: str = "stub", most_tasks: int | None = None) -> DataFrame:
    """page_id, label, score, bbox of images (page_id, image): a detector's answers, written since asking is dear, then parsed and put
    in shape in the JVM. An answer that isn't JSON, or none, gives no boxes. `most_tasks` bounds how many clients work at once."""

    def ask(client, page, image):
        try:
            yield page, client(bytes(image))
        except Exception:  # a page without boxes, to be read as a whole
            yield page, None

    images = images.repartition(most_tasks) if most_tasks else images
    answers = written(flat_map(images.select("page_id", "image"), ask, "page_id long, answer string", DETECTORS[backend]))
    return normalised(answers.select("page_id", F.explode(F.from_json("answer", ANSWER)).alias("box")))


def keep_visual(label: Column, score: Column, x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column) -> Column:
    """Whether a picture's box is sure and large enough."""
    w, h = F.greatest(F.lit(0), x2 - x1), F.greatest(F.lit(0), y2 - y1)
    small = (w * h < 0.008 * F.greatest(F.lit(1), page_w * page_h)) & (F.greatest(w, h) < 180)
    return (score >= F.when(label.isin(*folds.FIGURE_LABELS), 0.2).otherwise(0.25)) & (w >= 48) & (h >= 48) & ~small


def overlaps(boxes: DataFrame, iou: float = 0.5, cover: float = 0.85) -> DataFrame:
    """Pairs of a page's boxes (box_id, a smaller than b) that overlap so much that one may suppress the other. A page holds a
    few dozen boxes, so pairs stay within it."""
    a = boxes.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("box_id", "label", "x1", "y1", "x2", "y2")])
    b = boxes.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("box_id", "label", "x1", "y1", "x2", "y2")])
    p = a.join(b, "page_id").filter("a_box_id < b_box_id")
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"a_{hi}"), F.col(f"b_{hi}")) - F.greatest(F.col(f"a_{lo}"), F.col(f"b_{lo}")))
    area = lambda t: F.greatest(F.lit(0), F.col(f"{t}_x2") - F.col(f"{t}_x1")) * F.greatest(F.lit(0), F.col(f"{t}_y2") - F.col(f"{t}_y1"))
    p = p.withColumn("common", side("x1", "x2") * side("y1", "y2")).filter("common > 0")
    ratio = F.col("common") / (area("a") + area("b") - F.col("common"))
    inner = F.col("common") / F.least(area("a"), area("b"))
    same_side = (kind(F.col("a_label")) == "visual") == (kind(F.col("b_label")) == "visual")
    return p.filter(same_side & ((ratio >= iou) | (inner >= cover))).select("page_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round(ratio, 6).alias("iou"), F.round(inner, 6).alias("cover"))


def suppressed(pages: DataFrame) -> DataFrame:
    """page_id, boxes: those that stay of array<struct<label, score, bbox>>, in reading order."""
    shape = "array<struct<label:string,score:double,bbox:array<double>>>"
    run = lambda i, boxes: [(i, [{"label": b[0], "score": b[1], "bbox": list(b[2])} for b in folds.suppress_boxes([(x["label"], x["score"], x["bbox"]) for x in boxes or []])])]
    return flat_map(pages.select("page_id", "boxes"), run, f"page_id long, boxes {shape}")


def page_parts(boxes: DataFrame, page_w: int, page_h: int, most_visuals: int = 24, least: int = 16) -> DataFrame:
    """page_id, box_id, kind, x1, y1, x2, y2 of the boxes that are read (text) or kept as pictures (visual): cut to the page, at least
    `least` pixels on either side, and of the pictures that are sure and large enough the first `most_visuals` in reading order."""
    side = lambda c, most: F.greatest(F.lit(0), F.least(F.bround(c).cast("int"), F.lit(most)))
    cut = boxes.select("page_id", "box_id", "label", "score", side("x1", page_w - 1).alias("x1"), side("y1", page_h - 1).alias("y1"), side("x2", page_w).alias("x2"), side("y2", page_h).alias("y2"), kind(F.col("label")).alias("kind"))
    cut = cut.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least) & (F.col("kind") != "drop"))
    sure = keep_visual(*[F.col(c) for c in ("label", "score", "x1", "y1", "x2", "y2")], F.lit(page_w), F.lit(page_h))
    cut = cut.filter((F.col("kind") == "text") | sure)
    place = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("y1", "x1", "box_id"))
    return cut.withColumn("place", place).filter((F.col("kind") == "text") | (F.col("place") <= most_visuals)).select("page_id", "box_id", "kind", "x1", "y1", "x2", "y2")


def reading_order(parts: DataFrame) -> DataFrame:
    """page_id, text: the contents of a page's parts (page_id, x1, y1, content) from top to bottom, then left to right."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "content"))), lambda x: x["content"])
    return parts.filter(F.trim("content") != "").groupBy("page_id").agg(F.array_join(own, "\n\n").alias("text"))


def is_full_page(white: Column, dark: Column, active: Column) -> Column:
    """Whether a page is one picture, by the shares of white and dark pixels and of rows that hold something."""
    return (white <= 0.76) & (dark >= 0.08) & (active >= 0.72)


def pixel_shares(image: bytes) -> tuple[float, float, float]:
    """White, dark and active-row shares of an image, on a thumbnail; needs an imaging library."""
    import io

    import numpy as np
    from PIL import Image

    picture = Image.open(io.BytesIO(image)).convert("RGB")
    picture.thumbnail((96, 96))
    x = np.asarray(picture, dtype=np.int64)
    light = x @ np.array([299, 587, 114]) // 1000
    dark = light <= 110
    return float((light >= 245).mean()), float(dark.mean()), float((dark.sum(1) >= max(3, int(light.shape[1] * 0.12))).mean())
