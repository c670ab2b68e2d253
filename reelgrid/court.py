"""The canonical court: 22 keypoints, court templates, mirror pairs, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical ids in canonical order, each with its place in feet
# (along from the north baseline, across from the west sideline) on the NFHS and the
# NBA court, and its description.
KEYPOINTS = [
    ("north_baseline_sideline_east", (0.0, 50.0), (0.0, 50.0), "North baseline / east-sideline corner"),
    ("north_three_point_baseline_east", (0.0, 44.75), (0.0, 47.0), "North three-point line / baseline junction"),
    ("north_lane_baseline_east", (0.0, 31.0), (0.0, 33.0), "North lane / baseline corner"),
    ("north_lane_baseline_west", (0.0, 19.0), (0.0, 17.0), "North lane / baseline corner"),
    ("north_three_point_baseline_west", (0.0, 5.25), (0.0, 3.0), "North three-point line / baseline junction"),
    ("north_baseline_sideline_west", (0.0, 0.0), (0.0, 0.0), "North baseline / west-sideline corner"),
    ("north_lane_free_throw_east", (19.0, 31.0), (19.0, 33.0), "North lane / free-throw-line corner"),
    ("north_lane_free_throw_west", (19.0, 19.0), (19.0, 17.0), "North lane / free-throw-line corner"),
    ("north_three_point_apex", (25.0, 25.0), (29.0, 25.0), "Apex of the north three-point arc (farthest point from the north baseline, on the basket axis)"),
    ("midcourt_sideline_west", (42.0, 0.0), (47.0, 0.0), "West sideline / midcourt-line intersection"),
    ("midcourt_sideline_east", (42.0, 50.0), (47.0, 50.0), "East sideline / midcourt-line intersection"),
    ("center_circle_midcourt_west", (42.0, 19.0), (47.0, 19.0), "Center circle / midcourt-line intersection, west side"),
    ("center_circle_midcourt_east", (42.0, 31.0), (47.0, 31.0), "Center circle / midcourt-line intersection, east side"),
    ("south_baseline_sideline_west", (84.0, 0.0), (94.0, 0.0), "South baseline / west-sideline corner"),
    ("south_three_point_baseline_west", (84.0, 5.25), (94.0, 3.0), "South three-point line / baseline junction"),
    ("south_lane_baseline_west", (84.0, 19.0), (94.0, 17.0), "South lane / baseline corner"),
    ("south_lane_baseline_east", (84.0, 31.0), (94.0, 33.0), "South lane / baseline corner"),
    ("south_three_point_baseline_east", (84.0, 44.75), (94.0, 47.0), "South three-point line / baseline junction"),
    ("south_baseline_sideline_east", (84.0, 50.0), (94.0, 50.0), "South baseline / east-sideline corner"),
    ("south_lane_free_throw_west", (65.0, 19.0), (75.0, 17.0), "South lane / free-throw-line corner"),
    ("south_lane_free_throw_east", (65.0, 31.0), (75.0, 33.0), "South lane / free-throw-line corner"),
    ("south_three_point_apex", (59.0, 25.0), (65.0, 25.0), "Apex of the south three-point arc (farthest point from the south baseline, on the basket axis)"),
]
# Canonical ids in the order of an 18-point court model's own keypoints.
EIGHTEEN_POINT_ORDER = [
    "north_baseline_sideline_east", "north_three_point_baseline_east", "north_lane_baseline_east", "north_lane_baseline_west", "north_three_point_baseline_west",
    "north_baseline_sideline_west", "midcourt_sideline_west", "midcourt_sideline_east", "north_lane_free_throw_east", "north_lane_free_throw_west",
    "south_baseline_sideline_west", "south_three_point_baseline_west", "south_lane_baseline_west", "south_lane_baseline_east", "south_three_point_baseline_east",
    "south_baseline_sideline_east", "south_lane_free_throw_east", "south_lane_free_throw_west",
]
# Fixed values.
SCHEMA_NAME, SCHEMA_VERSION = "basketball-court-keypoints", "3.0.0"
DIMENSIONS = {"nfhs_84x50": (84.0, 50.0), "nba_94x50": (94.0, 50.0)}
DIAGRAM_ORIGIN, DIAGRAM_SCALE, VIEW_BOX = (25, 92), 9, (0, 0, 500, 940)
ENDS, SIDES = ("north", "south", "mid"), ("east", "west", "center")
TOLERANCE = 1e-6

IDS = [k[0] for k in KEYPOINTS]
COUNT = len(IDS)
INDEX = {cid: i for i, cid in enumerate(IDS)}


class UnknownTemplate(ValueError):
    pass


def end_of(cid: str) -> str:
    return cid.split("_")[0] if cid.startswith(("north_", "south_")) else "mid"


def side_of(cid: str) -> str:
    return cid.rsplit("_", 1)[1] if cid.endswith(("_east", "_west")) else "center"


def mirror_pairs() -> dict[str, list[tuple[str, str]]]:
    """Pairs of ids that differ in side only (east first), and in end only (north first)."""
    by_side = [(i, i[: -len("east")] + "west") for i in IDS if side_of(i) == "east"]
    by_end = [(i, "south" + i[len("north") :]) for i in IDS if end_of(i) == "north"]
    return {"east_west": by_side, "north_south": by_end}


def flip_order(pair_set: str = "north_south") -> list[int]:
    """Where each keypoint goes under a horizontal flip; its own inverse."""
    order = list(range(COUNT))
    for a, b in mirror_pairs()[pair_set]:
        order[INDEX[a]], order[INDEX[b]] = INDEX[b], INDEX[a]
    assert all(order[j] == i for i, j in enumerate(order))
    return order


def templates() -> list[str]:
    return sorted(DIMENSIONS)


def template(name: str) -> dict[str, tuple[float, float]]:
    """Canonical id -> (along, across) in feet."""
    if name not in DIMENSIONS:
        raise UnknownTemplate(f"no court template {name}; there are {', '.join(templates())}")
    at = 1 if name == "nfhs_84x50" else 2
    return {k[0]: k[at] for k in KEYPOINTS}


def keypoint_table(spark: SparkSession) -> DataFrame:
    """22 rows of a fixed size: index (from 1), id, feature, end, side, court_position, court_xy_ft, diagram_xy."""
    rows = []
    for i, (cid, (along, across), _, feature) in enumerate(KEYPOINTS):
        end, side = end_of(cid), side_of(cid)
        place = f"{'midcourt' if end == 'mid' else end}-{side}"
        rows.append((i + 1, cid, feature, end, side, place, [along, across], [DIAGRAM_ORIGIN[0] + DIAGRAM_SCALE * across, DIAGRAM_ORIGIN[1] + DIAGRAM_SCALE * along]))
    return spark.createDataFrame(rows, "index int, id string, feature string, end string, side string, court_position string, court_xy_ft array<double>, diagram_xy array<double>")


def pair_table(spark: SparkSession) -> DataFrame:
    rows = [(name, a, b) for name, pairs in mirror_pairs().items() for a, b in pairs]
    return spark.createDataFrame(rows, "pair_set string, id_a string, id_b string")


def template_table(spark: SparkSession) -> DataFrame:
    """22 rows for each template: template, id, along, across, length, width."""
    rows = [(name, cid, *xy, *DIMENSIONS[name]) for name in templates() for cid, xy in template(name).items()]
    return spark.createDataFrame(rows, "template string, id string, along double, across double, length double, width double")
