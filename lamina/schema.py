"""Schemas of the tables that the stages exchange."""

POINTS = "point_id long, row int, col int, features array<float>"
KNN_EDGES = "src long, dst long, rank int, dist double"
MEMBERSHIP = "level int, point_id long, component_id long"
PARENTS = "level int, component_id long, parent_id long"
SPATIAL_NEIGHBORS = "level int, component_id long, neighbor_id long"
WALKS = "level int, row_id long, col_id long, value double"
LEVEL_DIST = "level int, row_id long, col_id long, rank int, dist double"
PROB_DIST = "level int, row_id long, col_id long, p double"
EMBEDDING = "level int, component_id long, x double, y double"
LEVEL_STATS = "level int, num_components long, reduction_rate double, zero_sim long, forced_merge long, not_merged long"
