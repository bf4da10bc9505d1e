"""Track features over time and between tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgraph.functions import arrays, boxes
from clipgraph.operators.ordering import row_index
from clipgraph.operators.windows import window_count

_BLOCK = 1024
#: Windows of one key that are cut from one row.
_WINDOWS = 32


def with_halo(df: DataFrame, pos: str, ahead: int = 0, back: int = 0, block: int = _BLOCK) -> DataFrame:
    """Cut each key's positions into blocks; rows near a border are also shown to the next block.

    Adds ``_block`` and ``_core`` (the row belongs to that block). A window over
    (key, ``_block``) then sees every neighbour up to ``ahead``/``back`` positions away while
    no task ever gets more than one block of a long key.
    """
    own = F.floor(F.col(pos) / block)
    shown = F.array_distinct(F.array(own, F.floor((F.col(pos) + ahead) / block), F.floor((F.col(pos) - back) / block)))
    return df.withColumn("_own", own).withColumn("_block", F.explode(shown)).withColumn(
        "_core", F.col("_block") == F.col("_own")
    ).drop("_own")


def box_features(detections: DataFrame, width: float, height: float) -> DataFrame:
    """Add ``cx, cy, w, h, area, presence`` (shares of the image)."""
    cx, cy, w, h = boxes.to_center(boxes.box(), width, height)
    return detections.withColumns({"cx": cx, "cy": cy, "w": w, "h": h, "area": w * h, "presence": F.lit(1.0)})


def temporal_deltas(features: DataFrame, video: str = "video_id", track: str = "track_id", t: str = "t_idx") -> DataFrame:
    """Add ``dcx, dcy, darea, velocity`` against the row one step earlier; 0 where there is none."""
    shown = with_halo(features, t, ahead=1)
    along = Window.partitionBy(video, track, "_block").orderBy(t)
    adjacent = F.coalesce(F.lag(t).over(along) == F.col(t) - 1, F.lit(False))

    def delta(c: str) -> Column:
        return F.when(adjacent, F.col(c) - F.lag(c).over(along)).otherwise(F.lit(0.0))

    moved = shown.withColumns({"dcx": delta("cx"), "dcy": delta("cy"), "darea": delta("area")})
    moved = moved.where("_core").drop("_block", "_core")
    return moved.withColumn("velocity", F.sqrt(F.col("dcx") * F.col("dcx") + F.col("dcy") * F.col("dcy")))


GEOMETRY = ["cx", "cy", "w", "h", "cx", "cy", "area", "presence", "dcx", "dcy", "darea", "velocity"]
PAIR = ["iou", "distance", "cont_ij", "cont_ji", "dx", "dy"]


def track_pairs(features: DataFrame, video: str = "video_id", t: str = "t_idx", track: str = "track_id") -> DataFrame:
    """Pair features of tracks present in the same frame, ``track_i < track_j``.

    Frames where one of the two is absent have all-zero features and no row.
    """
    cols = ["x1", "y1", "x2", "y2", "cx", "cy"]
    a = features.select(video, t, F.col(track).alias("track_i"), F.struct(*cols).alias("a"))
    b = features.select(video, t, F.col(track).alias("track_j"), F.struct(*cols).alias("b"))
    pairs = a.join(b, [video, t]).where("track_i < track_j")
    ba, bb = boxes.box("a."), boxes.box("b.")
    dx, dy = F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")
    return pairs.select(
        video, t, "track_i", "track_j",
        boxes.box_iou(ba, bb, 1e-6).alias("iou"),
        F.sqrt(dx * dx + dy * dy).alias("distance"),
        boxes.box_containment(ba, bb).alias("cont_ij"),
        boxes.box_containment(bb, ba).alias("cont_ji"),
        dx.alias("dx"),
        dy.alias("dy"),
    )


def gather_windows(
    rows: DataFrame, keys: list[str], values: list[str], n_frames: int | str, length: int, stride: int, t: str = "t_idx"
) -> DataFrame:
    """Dense ``length`` x ``len(values)`` matrix per (keys, clip), zero where a frame has no row.

    ``n_frames`` is the frame count of every video, or the column that holds it, equal in all rows of a key. Every key gets
    every window of its video (at least one), also those it is absent from; rows at or beyond its end are in none.

    Rows move once, to blocks of 32 windows of their key; those that windows of two blocks share are shown to both. A block
    holds a bounded number of rows because (keys, t) is unique, and its windows are cut from it in place.
    """
    total = F.lit(n_frames) if isinstance(n_frames, int) else F.col(n_frames).cast("int")
    rows = rows.where(F.col(t) < total)
    last_clip = window_count(total, length, stride, "at_least_one") - 1
    vec = F.array(*[F.col(c).cast("double") for c in values])
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / stride).cast("int"))
    last = F.least(last_clip, F.floor(F.col(t) / stride).cast("int"))
    item = F.when(first <= last, F.struct(F.col(t).alias("t"), vec.alias("v")))
    whole = isinstance(n_frames, int) and n_frames <= _WINDOWS * stride + length - stride
    if whole:  # one block holds all windows
        shown = rows.select(*keys, F.lit(0).alias("_block"), total.alias("_total"), item.alias("_item"))
    else:
        own = F.greatest(F.lit(0), F.floor(last / _WINDOWS).cast("int"))
        blocks = F.sequence(F.least(F.floor(first / _WINDOWS).cast("int"), own), own)
        shown = rows.select(*keys, F.explode(blocks).alias("_block"), total.alias("_total"), item.alias("_item"))
        # keys with more windows than a block get all their blocks
        long = rows.where(last_clip >= _WINDOWS).groupBy(*keys).agg(F.max(total).alias("_total"))
        end = F.floor((window_count(F.col("_total"), length, stride, "at_least_one") - 1) / _WINDOWS).cast("int")
        every = long.select(*keys, F.explode(F.sequence(F.lit(0), end)).alias("_block"), "_total")
        shown = shown.unionByName(every, allowMissingColumns=True)
    filled = shown.groupBy(*keys, "_block").agg(
        F.map_from_entries(F.collect_list("_item")).alias("_by_t"), F.max("_total").alias("_total"))
    upto = F.least((F.col("_block") + 1) * _WINDOWS, window_count(F.col("_total"), length, stride, "at_least_one")) - 1
    cut = filled.withColumn("clip_index", F.explode(F.sequence(F.col("_block") * _WINDOWS, upto)))
    zeros = F.array(*[F.lit(0.0) for _ in values])
    start = F.col("clip_index") * stride
    win = F.least(F.lit(length), F.col("_total") - start)

    def at(i: Column) -> Column:
        return F.coalesce(F.element_at("_by_t", (start + i).cast(filled.schema["_by_t"].dataType.keyType)), zeros)

    if length <= _WINDOWS:  # items one by one stay in generated code, a lambda would not
        matrix = F.slice(F.array(*[at(F.lit(i)) for i in range(length)]), F.lit(1), win)
    else:
        matrix = F.transform(F.sequence(F.lit(0), win - 1), at)
    return cut.select(*keys, "clip_index", matrix.alias("matrix"))


#: Most boxes of one category in one frame that are compared inside their own rows; more meet in a grid.
_CLOSE = 64
_CORNER = ["x1", "y1", "x2", "y2"]


def separation_scores(detections: DataFrame) -> DataFrame:
    """Add ``match_score`` of each box as a stand-in for an object of its category.

    1.0 for the only box of its category in the frame; else (1 - max IoU with the others) *
    max(score, 0.1). Copies of a box overlap each other fully. All boxes go to their frame and category once; up to 64
    of them are compared as an array beside each box. In larger groups overlapping boxes meet in a grid cell, so
    far-apart boxes are never paired and copies of a box are counted once. The cells of a frame and category are as
    large as its mean box, or a sixteenth of its largest one, in whatever unit the coordinates are.
    """
    group = ["video_id", "frame_index", "_cat"]
    tagged = detections.withColumn("_cat", F.lower("category"))
    return separation_in(tagged, group).select(*detections.columns, "match_score")


def separation_in(tagged: DataFrame, group: list[str]) -> DataFrame:
    """``separation_scores`` of the boxes of each ``group``; rows already dealt by the group are not moved again."""
    whole = Window.partitionBy(*group)
    counted = tagged.withColumn("_n", F.count("x1").over(whole))
    close = F.col("_n") <= _CLOSE
    box = F.struct(*_CORNER)
    complete = F.lit(True)
    for c in [*group, *_CORNER]:
        complete = complete & F.col(c).isNotNull()
    near = counted.where(close).withColumn("_all", F.collect_list(F.when(complete, box)).over(whole))
    near = near.withColumn("_worst", F.when(complete, _worst_iou(F.col("_all"), box)))
    # The rows of large groups move by their box, once for the distinct boxes and for the way back.
    far = counted.where(~close).repartition(*group, *_CORNER)
    far = far.join(_grid_overlap(far, group), [*group, *_CORNER], "left")
    score = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((1 - F.col("_worst")) * F.greatest("score", F.lit(0.1)))
    # Rows without a box match nothing and score 0.
    out = [*tagged.columns, F.when(F.col("_worst").isNotNull(), F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)).alias("match_score")]
    return near.select(*out).unionByName(far.select(*out))


def _worst_iou(others: Column, box: Column) -> Column:
    """Largest IoU of a box with the boxes of a list that holds it, too; 1 where the list holds a copy of it."""
    def overlap(worst: Column, o: Column) -> Column:
        corners = tuple(o[c] for c in _CORNER)
        return F.greatest(worst, F.when(box == o, F.lit(0.0)).otherwise(boxes.box_iou(boxes.box(), corners)))

    copies = F.size(F.filter(others, lambda o: box == o))
    copied = (copies > 1) & (boxes.area(boxes.box()) > 0)
    found = F.when(copied, F.lit(1.0)).otherwise(F.aggregate(others, F.lit(0.0), overlap))
    return F.when(F.size(others) <= 1, F.lit(0.0)).otherwise(found)


def _grid_overlap(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, corners, ``_worst``): largest IoU of each distinct box with the others of its group, which meet in grid cells."""
    distinct = rows.where("x1 is not null").groupBy(*group, *_CORNER).agg(F.count(F.lit(1)).alias("_copies"))
    whole = Window.partitionBy(*group)

    def cell(lo: str, hi: str) -> Column:
        extent = F.abs(F.col(hi) - F.col(lo))
        return F.greatest(F.avg(extent).over(whole), F.max(extent).over(whole) / 16, F.lit(1e-9))

    sized = distinct.withColumns({"_wx": cell("x1", "x2"), "_wy": cell("y1", "y2")})

    def span(lo: str, hi: str, size: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.col(size)), F.floor(F.col(hi) / F.col(size)))

    placed = sized.withColumn("_gx", F.explode(span("x1", "x2", "_wx"))).withColumn("_gy", F.explode(span("y1", "y2", "_wy"))).drop("_wx", "_wy")
    others = placed.select(*group, "_gx", "_gy", F.struct(*_CORNER).alias("o"))
    # A box meets itself too, so boxes without any overlap stay in the result.
    itself = F.struct(*_CORNER) == F.col("o")
    iou = F.when(itself, F.lit(0.0)).otherwise(boxes.box_iou(boxes.box(), boxes.box("o.")))
    met = placed.join(others, [*group, "_gx", "_gy"])
    worst = met.groupBy(*group, *_CORNER).agg(F.max(iou).alias("_iou"), F.max("_copies").alias("_copies"))
    copied = (F.col("_copies") > 1) & (boxes.area(boxes.box()) > 0)
    return worst.withColumn("_worst", F.when(copied, F.lit(1.0)).otherwise(F.col("_iou"))).drop("_iou", "_copies")


def mean_embedding(rows: DataFrame, keys: list[str], vec: str, dim: int) -> DataFrame:
    """Element-wise mean vector and row count per key."""
    return arrays.vector_aggregate(rows, keys, vec, dim, F.avg, "embedding", n=F.count(F.lit(1)))


def category_ids(detections: DataFrame, video: str = "video_id", track: str = "track_id", t: str = "frame_index") -> DataFrame:
    """First category seen per track and its rank among the sorted categories of the video."""
    tracks = detections.groupBy(video, track).agg(F.min_by("category", t).alias("category"))
    names = row_index(tracks.select(video, "category").distinct(), ["category"], [video], name="category_id")
    return tracks.join(names, [video, "category"]).select(video, track, "category", F.col("category_id").cast("int"))


def nodes_from_presence(detections: DataFrame, video: str = "video_id", track: str = "track_id", t: str = "frame_index") -> DataFrame:
    """Graph nodes from tracked boxes: first and last frame present, first category, confidence 1.

    A track none of whose rows counts as present (``presence`` <= 0.5) gets frames 0 and 0.
    """
    seen = F.when(F.col("presence") > 0.5, F.col(t)) if "presence" in detections.columns else F.col(t)
    return detections.groupBy(video, track).agg(
        F.min_by("category", t).alias("category"),
        F.coalesce(F.min(seen), F.lit(0)).alias("first_seen_frame"),
        F.coalesce(F.max(seen), F.lit(0)).alias("last_seen_frame"),
        F.lit(1.0).alias("confidence"),
    )


def nodes_from_slots(slots: DataFrame, key: list[str], clip: str, threshold: float = 0.3, apply_sigmoid: bool = True) -> DataFrame:
    """Graph nodes from slot predictions of consecutive clips.

    Category and first frame come from the first clip that shows the slot, the last frame and
    the confidence are maxima. By default the existence goes through a sigmoid once more,
    which never drops a slot at 0.3; ``apply_sigmoid=False`` filters the existence itself.
    """
    exist = arrays.sigmoid(F.col("existence")) if apply_sigmoid else F.col("existence")
    shown = slots.withColumn("_e", exist).where(F.col("_e") >= threshold)
    return shown.groupBy(*key).agg(
        F.min_by(arrays.argmax(F.col("cat_logits")), clip).alias("category_id"),
        F.min_by("first_frame", clip).alias("first_seen_frame"),
        F.max("last_frame").alias("last_seen_frame"),
        F.max("_e").alias("confidence"),
    )
