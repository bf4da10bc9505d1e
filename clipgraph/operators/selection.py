"""Stratified choice of clips for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Clips of one video that are ranked in one task.
_WHOLE = 1 << 20


def action_coverage(selected: DataFrame) -> DataFrame:
    """Distinct actions and videos among selected clips; the action set is bounded by the vocabulary."""
    return selected.agg(
        F.count_distinct("action").alias("n_actions"),
        F.count_distinct("video_id").alias("n_videos"),
        F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"),
    )


def _tie(seed: int):
    return F.md5(F.concat_ws("|", F.col("video_id").cast("string"), F.col("clip_index").cast("string"), F.lit(str(seed))))


def middle_clip(clips: DataFrame, video: str = "video_id", order: str = "clip_index") -> DataFrame:
    """The clip at position floor(n/2) of each video."""
    from clipgraph.operators.ordering import row_index

    n = clips.groupBy(video).agg(F.count(F.lit(1)).alias("_n"))
    whole = (n.agg(F.max("_n")).first()[0] or 0) <= _WHOLE
    placed = row_index(clips, [order], [video], name="_at", split=False if whole else None)
    at, middle = F.col("_at"), F.floor(F.col("_n") / 2)
    # As a difference the position is no key of the join, and clips stay where their video was ranked; clips of a
    # video too large for that are spread by their position.
    found = at - middle == 0 if whole else at == middle
    # Estimates know nothing of exploded clips: without the hint either side may be broadcast at any size.
    return placed.join(n.hint("merge"), video).where(found).drop("_at", "_n")


def shortlist(clips: DataFrame, actions: list[str], quotas: tuple[int, int, int], seed: int) -> DataFrame:
    """Candidates per stratum, enough for every choice the selection can make.

    ``clips``: (video_id, clip_index, status, actions ARRAY, n_events). At most ``depth`` clips
    (and so videos) are ever taken. A stratum therefore needs its ``depth`` best clips, and
    the ``depth`` best clips of each of the ``depth`` videos whose best clip ranks highest:
    whatever is taken or seen, the best of the rest is among them. The rank limits are pushed
    below the shuffles, so no stratum or video is gathered whole.
    """
    depth = len(actions) + sum(quotas) + 1
    n_actions = F.size(F.array_distinct("actions"))
    strata = [
        F.when(F.array_contains("actions", a), F.struct(F.lit(f"action_type:{a}").alias("stratum"), (-n_actions).alias("_w")))
        for a in actions
    ]
    none = (F.size("actions") == 0) & (F.col("n_events") == 0)
    for name, cond, weight in (
        ("fill_event", F.size("actions") > 0, (-F.col("n_events")).cast("int")),
        ("no_event_annotated", (F.col("status") == "annotated") & none, F.lit(0)),
        ("motion_filtered", F.col("status") == "motion_filtered", F.lit(0)),
    ):
        strata.append(F.when(cond, F.struct(F.lit(name).alias("stratum"), weight.alias("_w"))))
    tagged = clips.select(
        "video_id", "clip_index", "n_events", n_actions.alias("n_actions"), _tie(seed).alias("_tie"),
        F.explode(F.array_compact(F.array(*strata))).alias("_s"),
    ).select("*", "_s.*").drop("_s")

    def best(df: DataFrame, within: list[str]) -> DataFrame:
        over = Window.partitionBy(*within).orderBy("_w", "_tie")
        return df.withColumn("_rn", F.row_number().over(over)).where(F.col("_rn") <= depth)

    overall = best(tagged, ["stratum"]).drop("_rn")
    per_video = best(tagged, ["stratum", "video_id"])
    heads = best(per_video.where("_rn = 1").drop("_rn"), ["stratum"]).select("stratum", "video_id")
    # At most depth videos per stratum: a few hundred rows.
    spread = per_video.drop("_rn").join(F.broadcast(heads), ["stratum", "video_id"], "left_semi")
    return overall.unionByName(spread).distinct()


def stratified_select(
    clips: DataFrame, actions: list[str], n_event: int = 15, n_empty: int = 5, n_static: int = 5, seed: int = 42
) -> DataFrame:
    """About 25 clips: one per action, filled up with event clips, then empty and static ones.

    An unseen video comes first, then diversity (or event count), then a seeded md5. The
    preference for unseen videos depends on the choices before it, so it runs over the
    shortlist, whose size depends on the quotas and actions only, never on the corpus.
    """
    listed = shortlist(clips, actions, (n_event, n_empty, n_static), seed)
    rows = [r.asDict() for r in listed.select("stratum", "video_id", "clip_index", "_w", "_tie").collect()]
    chosen: list[tuple] = []
    taken: set[tuple] = set()
    videos: set = set()

    def order(r: dict):
        return (r["video_id"] in videos, r["_w"], r["_tie"])

    def take(stratum: str, pool: list[dict]) -> None:
        r = pool[0]
        chosen.append((r["video_id"], r["clip_index"], stratum))
        taken.add((r["video_id"], r["clip_index"]))
        videos.add(r["video_id"])

    for a in actions:
        pool = sorted((r for r in rows if r["stratum"] == f"action_type:{a}"), key=order)
        fresh = [r for r in pool if (r["video_id"], r["clip_index"]) not in taken]
        if pool:
            take(f"action_type:{a}", fresh or pool)
    for stratum, quota in (
        ("fill_event", n_event - len(chosen)), ("no_event_annotated", n_empty), ("motion_filtered", n_static)
    ):
        # The order is fixed when a stratum starts, as its videos are marked only afterwards.
        pool = sorted((r for r in rows if r["stratum"] == stratum), key=order)
        pool = [r for r in pool if (r["video_id"], r["clip_index"]) not in taken]
        for r in pool[: max(0, quota)]:
            take(stratum, [r])
    field = clips.schema
    schema = f"video_id {field['video_id'].dataType.simpleString()}, clip_index {field['clip_index'].dataType.simpleString()}, selection_reason string"
    return clips.sparkSession.createDataFrame(chosen, schema)
