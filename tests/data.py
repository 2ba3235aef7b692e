"""Tiny inputs, 0-based."""

T337 = [(0, 0, 0, 1), (0, 1, 0, 2), (0, 3, 0, 10), (1, 0, 1, 7), (1, 1, 0, 8), (1, 2, 0, 6), (2, 0, 2, 3), (2, 2, 0, 4), (3, 0, 1, 5)]
T337_DIMS = (4, 4, 3)
TINY = [(0, 0, 1), (0, 1, 2), (0, 3, 10), (1, 0, 7), (1, 1, 8), (1, 2, 6), (2, 0, 3), (2, 2, 4), (3, 0, 5)]


def ramp(n, r=2):
    return [[float(i + k + 1) for k in range(r)] for i in range(n)]
