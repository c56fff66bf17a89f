"""Frame operators: luma planes as numpy arrays inside Arrow functions, decisions on sequences as windows or folds.

Blur, resize and edges are this library's own (separable kernels, clamped borders); equality with other image
libraries isn't promised beyond rounding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Structural similarity constants; scroll offsets, the similarity that makes one, and its least rows.
C1, C2, SIGMA = 6.5025, 58.5225, 1.5
OFFSETS, SCROLLED, LEAST_OVERLAP, LEAST_SIDE = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 0.85, 10, 40
#: Fixed values of code regions: dark and light pixels and the share that decides, the share of a dark row or column, the
#: deviation under which a side strip or a top bar is chrome, the least size, and edges of light screens.
DARK, LIGHT, SHARE, DARK_LINE, FLAT_SIDE, FLAT_BAR, LEAST_REGION, EDGE_LINE, EDGE_PAD = 80, 200, 0.3, 0.5, 15.0, 20.0, 100, 5.0, 10
#: Fixed values of terminals: a mean under this and fewer bright pixels than that share.
TERMINAL_MEAN, BRIGHT, BRIGHT_SHARE = 40.0, 180, 0.15
FRAME = "w int, h int, luma binary"
REGION = "x int, y int, w int, h int, region_type string"


def plane(w: int, h: int, luma: bytes | None) -> np.ndarray | None:
    if not luma or w <= 0 or h <= 0 or len(luma) != w * h:
        return None
    return np.frombuffer(luma, np.uint8).reshape(int(h), int(w))


@lru_cache(maxsize=256)
def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Triangle filter from ``n_in`` to ``n_out`` samples, widened when shrinking."""
    scale = n_in / n_out
    reach = max(1.0, scale)
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1 - np.abs(np.arange(n_in)[None, :] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    if image.shape == (h, w):
        return image
    out = _weights(image.shape[0], h) @ image.astype(np.float64) @ _weights(image.shape[1], w).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _kernel() -> np.ndarray:
    radius = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * SIGMA**2))
    return kernel / kernel.sum()


def blur_matrix(n: int) -> np.ndarray:
    """The blur of ``n`` samples as a matrix; samples beyond an end are like the end."""
    kernel = _kernel()
    radius = len(kernel) // 2
    out = np.zeros((n, n))
    for t, k in enumerate(kernel):
        out[np.arange(n), np.clip(np.arange(n) + t - radius, 0, n - 1)] += k
    return out


def _blur(images: np.ndarray) -> np.ndarray:
    """Gaussian blur over the last two axes."""
    kernel = _kernel().astype(images.dtype)
    radius = len(kernel) // 2
    for axis in (-1, -2):
        n = images.shape[axis]
        padded = np.pad(images, [(radius, radius) if a == images.ndim + axis else (0, 0) for a in range(images.ndim)], mode="edge")
        at = lambda j: padded[..., j : j + n] if axis == -1 else padded[..., j : j + n, :]  # noqa: B023, E731
        images = kernel[radius] * at(radius)
        for j in range(radius):
            both = at(j) + at(2 * radius - j)
            both *= kernel[j]
            images += both
    return images


class Blurred:
    """A plane as numbers, with the blurs of it and of its square."""

    def __init__(self, image: np.ndarray):
        self.x = image.astype(np.float32)
        self.mean, self.square = _blur(self.x), _blur(self.x * self.x)


def ssim(a: np.ndarray | Blurred, b: np.ndarray | Blurred) -> float:
    """Mean structural similarity of two planes of one size; 1 for empty ones."""
    if not isinstance(a, Blurred) and not a.size:
        return 1.0
    a, b = (p if isinstance(p, Blurred) else Blurred(p) for p in (a, b))
    mx, my = a.mean, b.mean
    both, sx, sy = mx * my, mx * mx, my * my
    cxy = _blur(a.x * b.x)
    cxy -= both
    vx, vy = a.square - sx, b.square - sy
    sx += sy
    sx += C1
    vx += vy
    vx += C2
    both *= 2
    both += C1
    cxy *= 2
    cxy += C2
    both *= cxy
    sx *= vx
    both /= sx
    return float(np.mean(both, dtype=np.float64))


def similarities(pairs: DataFrame) -> DataFrame:
    """``pairs (w, h, luma, other)`` with the ``similarity`` of both planes; null where one can't be read."""

    @F.pandas_udf("double")
    def compare(w: pd.Series, h: pd.Series, luma: pd.Series, other: pd.Series) -> pd.Series:
        planes = ((plane(a, b, x), plane(a, b, y)) for a, b, x, y in zip(w, h, luma, other, strict=True))
        return pd.Series([None if x is None or y is None else ssim(x, y) for x, y in planes], dtype="float64")

    return pairs.withColumn("similarity", compare("w", "h", "luma", "other"))


def narrow(image: np.ndarray, w: int = 320) -> np.ndarray:
    return resize(image, w, max(1, int(np.floor(image.shape[0] * w / image.shape[1] + 0.5))))


def is_scroll(before: np.ndarray | None, now: np.ndarray | None, width: int = 320, resize: Callable[[np.ndarray, int, int], np.ndarray] = resize) -> bool:
    """Whether the view moved down: the lower part of one frame is the upper part of the next, at some offset, both
    resized to ``width``."""
    if before is None or now is None:
        return False
    h, w = min(before.shape[0], now.shape[0]), min(before.shape[1], now.shape[1])
    if h < LEAST_SIDE or w < LEAST_SIDE:
        return False
    tall = max(1, int(np.floor(h * width / w + 0.5)))
    a, b = resize(before, width, tall), resize(now, width, tall)
    shifts = [int(tall * part) for part in OFFSETS]
    return any(ssim(a[s:], b[: tall - s]) > SCROLLED for s in shifts if tall - s >= LEAST_OVERLAP)


#: Frames of a video that are compared, each with the one before, in one task.
RUN = 256


def _schema(frames: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema), f"`{name}` {kind}"])


def _tasks(frames: DataFrame) -> int:
    """As many as the session has shuffle partitions: small frames are dear, so their tasks aren't merged by bytes."""
    return int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _planes(pdf: pd.DataFrame) -> Iterator[np.ndarray | None]:
    return (None if pd.isna(w) or pd.isna(h) else plane(int(w), int(h), luma) for w, h, luma in zip(pdf.w, pdf.h, pdf.luma, strict=True))


def _against_before(frames: DataFrame, compare: Callable[[], Callable[[np.ndarray | None, np.ndarray | None], float | None]], name: str) -> DataFrame:
    """``frames`` with ``name``: what ``compare`` says of the plane before, in its video, and each plane; null for the first.
    Videos are dealt out in runs of RUN frames, each told the last frame of the run before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say, before = compare(), None
        for pdf in batches:
            said = []
            for place, known, image in zip(pdf["__p"], pdf["__known"], _planes(pdf), strict=True):
                said.append(None if place == 0 or known else say(before, image))
                before = image
            yield pdf.assign(**{name: pd.Series(said, dtype="float64", index=pdf.index)})[~pdf["__known"]].drop(columns=["__p", "__run", "__known"])

    place = F.row_number().over(Window.partitionBy("video_id").orderBy("seq")) - 1
    n = F.floor(F.col("__p") / RUN)
    own = F.struct(n.alias("run"), F.lit(False).alias("known"))
    both = F.when(F.col("__p") % RUN == RUN - 1, F.array(own, F.struct((n + 1).alias("run"), F.lit(True).alias("known")))).otherwise(F.array(own))
    dealt = frames.withColumn("__p", place).withColumn("__r", F.explode(both)).select(*frames.columns, "__p", F.col("__r.run").alias("__run"), F.col("__r.known").alias("__known"))
    sorted_runs = dealt.repartition(_tasks(frames), "video_id", "__run").sortWithinPartitions("video_id", "__run", "__p")
    return sorted_runs.mapInPandas(run, _schema(frames, name, "double"))


def dedup_frames(frames: DataFrame, threshold: float = 0.95, width: int = 320) -> DataFrame:
    """Frames ``(video_id, seq, w, h, luma, ...)`` that differ from the last one kept: similarity, at ``width``, under
    ``threshold`` (held to 0..1), or another size. The first stays; unreadable ones go, but an unreadable first keeps all.

    Each frame is first compared with the one before, in any order; a pass over each video then compares only those
    whose frame before was dropped and isn't equal to the last one kept.
    """
    threshold = min(1.0, max(0.0, threshold))

    def compare() -> Callable[[np.ndarray | None, np.ndarray | None], float | None]:
        held: list = [None, None]

        def blurred(image: np.ndarray) -> Blurred:
            if held[0] is not image:
                held[:] = image, Blurred(narrow(image, width))
            return held[1]

        def say(before: np.ndarray | None, image: np.ndarray | None) -> float | None:
            if before is None or image is None:
                return None
            if np.array_equal(before, image):
                held[0] = image if held[0] is before else held[0]
                return 1.0
            a, b = blurred(before), blurred(image)
            return ssim(a, b) if a.x.shape == b.x.shape else -2.0

        return say

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, begun, last, everything, say, near = None, False, None, False, compare(), False
        for pdf in batches:
            flags = []
            for own, image, score in zip(pdf.video_id, _planes(pdf), pdf["__s"], strict=True):
                if not begun or own != video:
                    video, begun, last, everything = own, True, None, image is None
                if image is None or everything:
                    flags.append(everything)
                    near = False
                    continue
                score = -2.0 if last is None else score if near and not pd.isna(score) else say(last, image)
                flags.append(score < threshold)
                near = flags[-1] or np.array_equal(last, image)
                last = image if flags[-1] else last
            yield pdf.drop(columns="__s")[np.array(flags, bool)]

    compared = _against_before(frames, compare, "__s")
    in_order = compared.repartition(_tasks(frames), "video_id").sortWithinPartitions("video_id", "seq")
    return in_order.mapInPandas(run, frames.schema)


def scroll_groups(frames: DataFrame, width: int = 320) -> DataFrame:
    """Frames with ``group_idx`` and ``seq_in_group``: a new group begins unless a frame scrolls on from the one before.

    Scores come from one pass that holds the frame before, groups from a running sum of breaks.
    """

    def compare() -> Callable[[np.ndarray | None, np.ndarray | None], float | None]:
        resized: list[tuple[np.ndarray, np.ndarray]] = []

        def once(image: np.ndarray, w: int, h: int) -> np.ndarray:
            """Each frame is resized to one size once, though it is looked at twice."""
            found = next((x for own, x in resized if own is image and x.shape == (h, w)), None)
            if found is None:
                resized.append((image, found := resize(image, w, h)))
                del resized[:-2]
            return found

        return lambda before, image: float(is_scroll(before, image, width, once))

    w = Window.partitionBy("video_id").orderBy("seq")
    scored = _against_before(frames, compare, "__on").withColumn("__on", F.coalesce(F.col("__on") > 0, F.lit(False)))
    grouped = scored.withColumn("group_idx", F.sum((~F.col("__on")).cast("int")).over(w) - 1)
    place = F.row_number().over(Window.partitionBy("video_id", "group_idx").orderBy("seq")) - 1
    return grouped.withColumn("seq_in_group", place).drop("__on")


def _first_last(share: np.ndarray, above: float) -> tuple[int, int]:
    at = np.flatnonzero(share > above)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, len(share))


def _flat(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, under: float) -> bool:
    part = image[y0:y1, x0:x1]
    return part.size > 0 and float(part.std()) < under


def _edges(image: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """255 at edges: gradient maxima over ``low`` that touch, directly or through others, one over ``high``."""
    p = np.pad(_blur(image.astype(np.float64)), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.hypot(gx, gy)
    turn = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    q = np.pad(size, 1)
    top = np.zeros_like(size, bool)
    for t, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
        behind = q[1 - dy : q.shape[0] - 1 - dy, 1 - dx : q.shape[1] - 1 - dx]
        top |= (turn == t) & (size >= ahead) & (size >= behind)
    weak, strong = top & (size > low), top & (size > high)
    while True:
        near = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([near[a : a + strong.shape[0], b : b + strong.shape[1]] for a in range(3) for b in range(3)])
        if (grown == strong).all():
            return np.where(strong, 255, 0).astype(np.uint8)
        strong = grown


def code_region(image: np.ndarray | None) -> tuple[int, int, int, int, str] | None:
    """The part of a frame that shows code, and whether it looks like an editor or a terminal."""
    if image is None:
        return None
    h, w = image.shape
    dark, light = float((image < DARK).mean()), float((image > LIGHT).mean())
    kind = "editor"
    if dark > SHARE and dark > light:
        x0, x1 = _first_last((image < DARK).mean(0), DARK_LINE)
        y0, y1 = _first_last((image < DARK).mean(1), DARK_LINE)
        side, bar = max(30, int(w * 0.04)), max(20, int(h * 0.04))
        if x1 - x0 > int(w * 0.6) and _flat(image, x0, y0, min(x0 + side, w), min(y1, h), FLAT_SIDE):
            x0 += side
        if y1 - y0 > int(h * 0.5) and _flat(image, x0, y0, min(x1, w), min(y0 + bar, h), FLAT_BAR):
            y0 += bar
        box = (x0, y0, max(x1 - x0, LEAST_REGION), max(y1 - y0, LEAST_REGION))
        part = image[y0 : y0 + box[3], x0 : x0 + box[2]]
        if part.size and part.mean() < TERMINAL_MEAN and (part > BRIGHT).mean() < BRIGHT_SHARE:
            kind = "terminal"
    elif light > SHARE:
        edges = _edges(image)
        x0, x1 = _first_last(edges.mean(0), EDGE_LINE)
        y0, y1 = _first_last(edges.mean(1), EDGE_LINE)
        x0, y0, x1, y1 = max(0, x0 - EDGE_PAD), max(0, y0 - EDGE_PAD), min(w, x1 + EDGE_PAD), min(h, y1 + EDGE_PAD)
        box = (x0, y0, x1 - x0, y1 - y0)
    else:
        box = (0, 0, w, h)
    return (*clamp(box, w, h), kind)


def clamp(box: tuple[int, int, int, int], w: int, h: int) -> tuple[int, int, int, int]:
    x, y = min(box[0], w - 1), min(box[1], h - 1)
    return x, y, max(1, min(box[2], w - x)), max(1, min(box[3], h - y))


def code_regions(frames: DataFrame) -> DataFrame:
    """``(video_id, x, y, w, h, region_type)``: the region of each video's first frame, which holds for all its frames."""
    first = frames.groupBy("video_id").agg(F.min_by(F.struct("w", "h", "luma"), "seq").alias("f"))

    @F.pandas_udf(REGION)
    def find(w: pd.Series, h: pd.Series, luma: pd.Series) -> pd.DataFrame:
        found = [code_region(plane(a, b, c)) or (None,) * 5 for a, b, c in zip(w, h, luma, strict=True)]
        return pd.DataFrame(found, columns=["x", "y", "w", "h", "region_type"]).astype({c: "Int32" for c in "xywh"})

    return first.select("video_id", find("f.w", "f.h", "f.luma").alias("r")).select("video_id", "r.*")


def crop(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames cut to the region of their video, planes and, if there is such a column, the pixels of ``rgb``; a frame that
    can't be read, or without a region, stays as it is."""
    colour = "rgb" in frames.columns

    @F.pandas_udf(FRAME + ", rgb binary")
    def cut(w: pd.Series, h: pd.Series, luma: pd.Series, rgb: pd.Series, x: pd.Series, y: pd.Series, rw: pd.Series, rh: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, pixels, *box in zip(w, h, luma, rgb, x, y, rw, rh, strict=True):
            image = plane(a, b, c)
            if image is not None and not any(pd.isna(v) for v in box):
                cx, cy, cw, ch = clamp(tuple(int(v) for v in box), int(a), int(b))
                if pixels is not None:
                    pixels = np.frombuffer(pixels, np.uint8).reshape(int(b), int(a), 3)[cy : cy + ch, cx : cx + cw].tobytes()
                a, b, c = cw, ch, image[cy : cy + ch, cx : cx + cw].tobytes()
            out.append((a, b, c, pixels))
        return pd.DataFrame(out, columns=["w", "h", "luma", "rgb"])

    r = regions.select("video_id", F.struct("x", "y", "w", "h").alias("__r"))
    pixels = F.col("rgb") if colour else F.lit(None).cast("binary")
    cropped = frames.join(r, "video_id", "left").withColumn("__c", cut("w", "h", "luma", pixels, "__r.x", "__r.y", "__r.w", "__r.h"))
    return cropped.select(*(F.col(f"__c.{c}").alias(c) if c in ("w", "h", "luma", "rgb") else F.col(c) for c in frames.columns))


def as_png(frames: DataFrame, name: str = "content") -> DataFrame:
    """Frames with the bytes of a PNG in ``name``: of ``rgb`` where there is such a column and it isn't null, else of the
    plane; null if that can't be read either."""

    @F.pandas_udf("binary")
    def write(w: pd.Series, h: pd.Series, luma: pd.Series, rgb: pd.Series) -> pd.Series:
        def one(a, b, c, pixels):
            if pixels is not None:
                return png(np.frombuffer(pixels, np.uint8).reshape(int(b), int(a), 3))
            image = None if pd.isna(a) or pd.isna(b) else plane(int(a), int(b), c)
            return None if image is None else png(image)

        return pd.Series([one(*row) for row in zip(w, h, luma, rgb, strict=True)], dtype=object)

    pixels = F.col("rgb") if "rgb" in frames.columns else F.lit(None).cast("binary")
    return frames.withColumn(name, write("w", "h", "luma", pixels))


def backfill(keyframes: DataFrame, scenes: DataFrame, least: int = 5) -> DataFrame:
    """``(video_id, timestamp, path, is_keyframe)``: a video with fewer than ``least`` key frames also gets the scene frames
    at tenths of a second that no key frame has. Scene frames don't count against each other."""
    tenth = F.round(F.col("timestamp") * 10)
    few = scenes.select("video_id").distinct().join(keyframes.groupBy("video_id").agg(F.count("*").alias("__n")), "video_id", "left")
    few = few.filter(F.coalesce("__n", F.lit(0)) < least).select("video_id")
    more = scenes.withColumn("__t", tenth).join(keyframes.select("video_id", tenth.alias("__t")), ["video_id", "__t"], "left_anti").join(few, "video_id", "left_semi")
    cols = ["video_id", "timestamp", "path"]
    return keyframes.select(*cols, F.lit(True).alias("is_keyframe")).unionByName(more.select(*cols, F.lit(False).alias("is_keyframe")))


def line_height(img_h: Column) -> Column:
    return F.greatest(img_h / F.lit(1080.0) * F.lit(25.0), F.lit(12.0)).cast("int")


def text_bands(rows: DataFrame, above: float = 0.02) -> DataFrame:
    """``(frame_id, y0, y1)``: maximal runs of rows ``(frame_id, y, density)`` denser than ``above``."""
    dense = rows.filter(F.col("density") > above)
    island = F.col("y") - F.row_number().over(Window.partitionBy("frame_id").orderBy("y"))
    return dense.withColumn("__i", island).groupBy("frame_id", "__i").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).drop("__i")


def text_lines(rows: DataFrame, sizes: DataFrame, above: float = 0.02) -> DataFrame:
    """``(frame_id, y0, y1)`` of text lines, in pixels of the frame: the bands of ``rows (frame_id, y, density)`` scaled from
    the ``map_h`` rows of the map to the height ``img_h`` of ``sizes (frame_id, map_h, img_h)`` and cut into lines. A frame
    without a band is sliced by line heights from the top, with what is left over if that is more than half of one."""
    scale = F.col("img_h") / F.col("map_h")
    found = text_bands(rows, above).join(sizes, "frame_id")
    scaled = found.select("frame_id", "img_h", (F.col("y0") * scale).cast("int").alias("y0"), (F.col("y1") * scale).cast("int").alias("y1"))
    cut = split_bands(scaled, F.col("img_h"))
    line = line_height(F.col("img_h"))
    bare = sizes.join(found.select("frame_id").distinct(), "frame_id", "left_anti").withColumn("__line", line)
    bare = bare.withColumn("__n", F.floor(F.col("img_h") / F.col("__line")).cast("int"))
    whole = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: F.struct((k * F.col("__line")).alias("y0"), ((k + 1) * F.col("__line")).alias("y1")))
    end = F.col("__n") * F.col("__line")
    rest = F.when(F.col("img_h") - end > F.floor(F.col("__line") / 2), F.array(F.struct(end.alias("y0"), F.col("img_h").cast("int").alias("y1"))))
    none = F.array().cast("array<struct<y0:int,y1:int>>")
    every = F.concat(F.when(F.col("__n") > 0, whole).otherwise(none), F.coalesce(rest, none))
    return cut.unionByName(bare.select("frame_id", F.inline(every)))


def split_bands(bands: DataFrame, img_h: Column) -> DataFrame:
    """Bands over 1.8 line heights cut into as many equal slices as line heights fit (two at least); the last slice takes
    the rest."""
    line, tall = line_height(img_h), F.col("y1") - F.col("y0")
    n = F.when(tall <= (line * F.lit(1.8)).cast("int"), F.lit(1)).otherwise(F.greatest(F.round(tall / line).cast("int"), F.lit(2)))
    cut = bands.withColumns({"__n": n}).withColumn("__step", F.floor((F.col("y1") - F.col("y0")) / F.col("__n"))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low = F.col("y0") + F.col("__k") * F.col("__step")
    return cut.select("frame_id", low.cast("int").alias("y0"), F.when(F.col("__k") == F.col("__n") - 1, F.col("y1")).otherwise(low + F.col("__step")).cast("int").alias("y1"))


def best_class(scores: Column) -> Column:
    """The place, from 0, of the largest of an array of scores; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ctc_decode(steps: Column, dictionary: Column) -> Column:
    """Text of a best-class sequence (0 is blank, class c is entry c - 1 of the dictionary, classes beyond say nothing).

    Repeats of a class count once. A blank run inside the text becomes a space if it is long: two and a half times the
    upper median of such runs and four at least, or eight where there are two runs or fewer.
    """
    zero = F.lit(0)
    start = F.struct(zero.alias("run"), F.lit(False).alias("seen"), F.array().cast("array<int>").alias("runs"))

    def gap(acc: Column, c: Column) -> Column:
        inner = acc["seen"] & (acc["run"] > 0) & (c != 0)
        runs = F.when(inner, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"])
        return F.struct(F.when(c == 0, acc["run"] + 1).otherwise(zero).alias("run"), (acc["seen"] | (c != 0)).alias("seen"), runs.alias("runs"))

    runs = F.sort_array(F.aggregate(steps, start, gap)["runs"])
    median = F.get(runs, F.floor(F.size(runs) / 2).cast("int"))
    limit = F.when(F.size(runs) > 2, F.greatest((median * F.lit(2.5)).cast("int"), F.lit(4))).otherwise(F.lit(8))
    begin = F.struct(zero.alias("last"), zero.alias("run"), F.lit("").alias("out"))

    def read(acc: Column, c: Column, wide: Column) -> Column:
        spaced = F.when((acc["run"] >= wide) & (acc["out"] != ""), F.concat(acc["out"], F.lit(" "))).otherwise(acc["out"])
        told = F.when(c != acc["last"], F.concat(spaced, F.coalesce(F.get(dictionary, c - 1), F.lit("")))).otherwise(spaced)
        return F.struct(c.alias("last"), F.when(c == 0, acc["run"] + 1).otherwise(zero).alias("run"), F.when(c == 0, acc["out"]).otherwise(told).alias("out"))

    return F.get(F.transform(F.array(limit), lambda wide: F.aggregate(steps, begin, lambda acc, c: read(acc, c, wide))["out"]), F.lit(0))


def png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of a plane or of colour pixels (h, w, 3)."""
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The colour pixels (h, w, 3) of an 8-bit PNG that isn't interlaced and has no palette; alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("this kind of PNG is not read here")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:].reshape(h, w, n), strict=True)):
        out[y] = above = _unfiltered(kind, line, above)
    return np.repeat(out[..., :1], 3, 2) if n < 3 else np.ascontiguousarray(out[..., :3])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A PNG line of pixels without its filter: none, left, above, their mean, or the nearest of three to a prediction."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, 0, dtype=np.uint8)
    if kind == 2:
        return line + above
    left, corner, out = np.zeros(line.shape[1], np.int16), np.zeros(line.shape[1], np.int16), np.empty_like(line)
    for x, (delta, up) in enumerate(zip(line.astype(np.int16), above.astype(np.int16), strict=True)):
        if kind == 3:
            guess = (left + up) // 2
        else:
            far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        out[x] = (delta + guess) & 255
        left, corner = out[x].astype(np.int16), up
    return out
