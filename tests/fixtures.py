"""Small graphs and images whose results are known. All tables of this file are inputs with results that any engine of this kind must give."""

# neighbour ids of a 4 x 4 image, four each, the pixel itself first
GRID_4X4 = """
0 1 2 4 | 1 2 3 4 | 2 3 4 5 | 3 2 5 6
4 8 12 3 | 5 6 7 15 | 6 10 7 1 | 7 11 0 15
8 12 2 3 | 9 5 0 15 | 10 9 0 7 | 11 15 12 9
12 8 2 3 | 13 14 7 2 | 14 13 2 11 | 15 11 12 5
"""
# two rows more
GRID_6X4 = GRID_4X4 + """
16 17 18 20 | 17 16 19 18 | 18 19 16 17 | 19 18 17 16
20 21 22 16 | 21 20 22 23 | 22 23 21 20 | 23 22 20 0
"""
LEVELS_4X4 = [
    [0, 0, 0, 0, 1, 2, 2, 3, 1, 2, 2, 3, 1, 4, 4, 3],
    [0, 0, 0, 0, 0, 1, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1],
    [0] * 16,
]
LEVELS_6X4 = [
    LEVELS_4X4[0] + [5, 5, 5, 5, 6, 6, 6, 6],
    LEVELS_4X4[1] + [2, 2, 2, 2, 2, 2, 2, 2],
    [0] * 24,
]
QUANTILE_VALUES = [-1.0, 3.0, 7.0, 5.0, 2.0, 5.0, 3.0, 6.0, 7.0, 8.0, 1.0, -1.0, -1.0, 9.0]
# q: midpoint, midpoint without -1, linear
QUANTILES = {
    0.0: (-1, 1, -1),
    0.2: (0, 3, 0.2),
    0.35: (2.5, 4, 2.55),
    0.4: (3, 5, 3),
    0.5: (4, 5, 4),
    0.6: (5, 6, 5),
    0.8: (7, 7, 7),
    1.0: (9, 9, 9),
}


def rows(text):
    """Lists of ids, one a pixel."""
    return [list(map(int, part.split())) for part in text.replace("\n", "|").split("|") if part.strip()]


def edges(spark, text):
    """(src, dst, rank, dist): the ids at their ranks, at distance rank / 10."""
    data = [(r[0], d, i, i / 10) for r in rows(text) for i, d in enumerate(r)]
    return spark.createDataFrame(data, "src long, dst long, rank int, dist double")
