"""Event graphs: assembly, JSON form and queries over edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import ids
from clipgraph.operators.ordering import row_index

ROLES = ["agent_track_id", "target_track_id", "source_track_id", "destination_track_id"]


def number_events(edges: DataFrame, order: list[str], video: str = "video_id") -> DataFrame:
    """Add ``event_pos`` and ``event_id`` by list order within the video.

    ``order`` ascends; pass a negated confidence for the tracker form or the frame for the
    script form, with a unique column last.
    """
    return row_index(edges, order, [video], name="event_pos").withColumn("event_id", ids.event_id(F.col("event_pos")))


def build_graph(nodes: DataFrame, edges: DataFrame, metadata: Column | None = None, video: str = "video_id") -> DataFrame:
    """Nested graph rows ``(video, nodes, edges, metadata)``, one for each video whatever its size.

    ``edges`` come from :func:`number_events`. The row is as large as the video's graph; jobs that do
    not need one value for each video work on the node and edge tables themselves.
    """
    def nest(df: DataFrame, pos: str, out: str) -> DataFrame:
        fields = F.struct(pos, F.struct(*[c for c in df.columns if c not in (video, pos)]).alias("v"))
        listed = df.groupBy(video).agg(F.sort_array(F.collect_list(fields)).alias("_l"))
        return listed.select(video, F.transform("_l", lambda x: x["v"]).alias(out))

    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    placed = row_index(nodes, ["track_id"], [video], name="node_pos")
    n, e = nest(placed, "node_pos", "nodes"), nest(edges, "event_pos", "edges")
    return n.join(e, video, "full").withColumn("metadata", meta)


JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def graph_json(graphs: DataFrame) -> DataFrame:
    """Graph rows as JSON text; nulls are kept and timestamps are ISO. One text a video: see :func:`graph_json_parts`."""
    return graphs.select("video_id", F.to_json(F.struct(*graphs.columns), JSON_OPTIONS).alias("json"))


#: Sections of a graph text: its start, the nodes, what lies between, the edges, its end.
HEAD, NODES, MIDDLE, EDGES, TAIL = range(5)


def graph_json_parts(nodes: DataFrame, edges: DataFrame, metadata: Column | None = None, size: int = 1024) -> DataFrame:
    """The texts of :func:`graph_json` in parts ``(video_id, section, part, json)`` of at most ``size`` nodes or edges.

    The parts of a video, joined in the order of section and part, are its text, so that a video of any
    size is written without a row that holds it whole. ``edges`` come from :func:`number_events`.
    """
    video = "video_id"

    def listed(df: DataFrame, pos: str, section: int) -> DataFrame:
        fields = F.struct(pos, F.struct(*[c for c in df.columns if c not in (video, pos)]).alias("v"))
        part = F.floor(F.col(pos) / size).alias("part")
        cut = df.groupBy(video, part).agg(F.sort_array(F.collect_list(fields)).alias("_l"))
        text = F.to_json(F.transform("_l", lambda x: x["v"]), JSON_OPTIONS)
        opened = F.concat(F.when(F.col("part") == 0, "[").otherwise(","), text.substr(F.lit(2), F.length(text) - 2))
        return cut.select(video, F.lit(section).alias("section"), "part", opened.alias("json"))

    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    placed = row_index(nodes, ["track_id"], [video], name="node_pos")
    n, e = nodes.select(video).distinct().withColumn("_n", F.lit(1)), edges.select(video).distinct().withColumn("_e", F.lit(1))
    id_text = F.to_json(F.struct(video), JSON_OPTIONS)
    around = n.join(e, video, "full").select(video, F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), text.alias("json")) for section, text in (
            (HEAD, F.concat(id_text.substr(F.lit(1), F.length(id_text) - 1), F.lit(',"nodes":'), F.when(F.isnull("_n"), "null").otherwise(""))),
            (MIDDLE, F.concat(F.when(F.isnull("_n"), "").otherwise("]"), F.lit(',"edges":'), F.when(F.isnull("_e"), "null").otherwise(""))),
            (TAIL, F.concat(F.when(F.isnull("_e"), "").otherwise("]"), F.lit(',"metadata":'), F.to_json(meta), F.lit("}"))),
        )])).alias("_s")).select(video, "_s.section", F.lit(0).cast("bigint").alias("part"), "_s.json")
    return around.unionByName(listed(placed, "node_pos", NODES)).unionByName(listed(edges, "event_pos", EDGES))


def edges_of_parts(parts: DataFrame, edge: str) -> DataFrame:
    """``(video_id, edge fields)`` read back from the texts of :func:`graph_json_parts`; ``edge`` is the fields' DDL."""
    body = F.concat(F.lit("["), F.col("json").substr(F.lit(2), F.length("json")), F.lit("]"))
    listed = F.from_json(body, f"array<struct<{edge}>>")
    return parts.where(F.col("section") == EDGES).select("video_id", F.explode(listed).alias("e")).select("video_id", "e.*")


def object_timeline(edges: DataFrame, track: int | None = None) -> DataFrame:
    """Edges in which a track has any role; without a track, one row per (edge, track)."""
    if track is not None:
        cond = F.lit(False)
        for r in ROLES:
            cond = cond | F.coalesce(F.col(r) == track, F.lit(False))
        return edges.where(cond)
    tracks = F.array_distinct(F.array_compact(F.array(*ROLES)))
    return edges.withColumn("track_id", F.explode(tracks))


def events_in_range(edges: DataFrame, start: int, end: int) -> DataFrame:
    return edges.where(F.col("frame").between(start, end))


def object_history(
    edges: DataFrame, nodes: DataFrame, category: str, frames: tuple[int, int] | None = None,
    attributes: dict[str, str] | None = None,
) -> DataFrame:
    """Events of all objects of a category, optionally with attributes and within frames."""
    wanted = nodes.where(F.col("category") == category)
    for axis, value in (attributes or {}).items():
        wanted = wanted.where(F.element_at("attributes", axis) == value)
    used = edges if frames is None else events_in_range(edges, *frames)
    return object_timeline(used).join(wanted.select("video_id", "track_id", "category"), ["video_id", "track_id"])


# Actions that change where an object is, and their sign for a container.
MOVES = ["place_on", "put_in", "move"]
PUT, TAKE = "put_in", "take_out"


def current_location(edges: DataFrame, at_frame: int | None = None, moves: list[str] = MOVES) -> DataFrame:
    """Destination of each object's last move, up to a frame."""
    used = edges.where(F.col("action").isin(moves))
    if at_frame is not None:
        used = used.where(F.col("frame") <= at_frame)
    last = F.struct("frame", "event_seq")
    return used.groupBy("video_id", F.col("target_track_id").alias("track_id")).agg(
        F.max_by("destination_track_id", last).alias("location"), F.max("frame").alias("since_frame")
    )


def with_category(edges: DataFrame, nodes: DataFrame, role: str, out: str) -> DataFrame:
    """Add the category of the track in a role (null for an unknown track)."""
    side = nodes.select("video_id", F.col("track_id").alias(role), F.col("category").alias(out))
    return edges.join(side, ["video_id", role], "left")


def events_by_action(
    edges: DataFrame, nodes: DataFrame, action: str, frames: tuple[int, int] | None = None, agent_category: str | None = None
) -> DataFrame:
    used = edges.where(F.col("action") == action)
    if frames is not None:
        used = events_in_range(used, *frames)
    if agent_category is None:
        return used
    return with_category(used, nodes, "agent_track_id", "agent_category").where(F.col("agent_category") == agent_category)


def location_contents(edges: DataFrame, at_frame: int | None = None, put: str = PUT, take: str = TAKE) -> DataFrame:
    """Objects inside each location: those whose last put or take up to the frame is a put there."""
    used = edges.where(F.col("action").isin(put, take))
    if at_frame is not None:
        used = used.where(F.col("frame") <= at_frame)
    place = F.when(F.col("action") == put, F.col("destination_track_id")).otherwise(F.col("source_track_id"))
    placed = used.withColumn("location", place).where(F.col("location").isNotNull())
    last = F.max_by(F.col("action") == put, F.struct("frame", "event_seq"))
    inside = placed.groupBy("video_id", "location", F.col("target_track_id").alias("track_id")).agg(last.alias("_in"))
    return inside.where("_in").drop("_in")


def search_events(
    edges: DataFrame,
    nodes: DataFrame,
    action: str | None = None,
    agent_category: str | None = None,
    target_category: str | None = None,
    frames: tuple[int, int] | None = None,
    video: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Events that meet every given condition; conditions on edges come before any join."""
    out = edges
    if action is not None:
        out = out.where(F.col("action") == action)
    if video is not None:
        out = out.where(F.col("video_id") == video)
    if frames is not None:
        out = events_in_range(out, *frames)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    for role, wanted in (("agent", agent_category), ("target", target_category)):
        if wanted is not None:
            side = nodes.where(F.col("category") == wanted)
            out = with_category(out, side, f"{role}_track_id", f"{role}_category").where(F.col(f"{role}_category").isNotNull())
    return out
