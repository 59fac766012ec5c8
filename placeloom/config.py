"""Per-city settings and compatibility switches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class City:
    """Bounding box (left/top and right/bottom, degrees), area claims, and the candidate filter."""

    name: str
    west: float
    north: float
    east: float
    south: float
    eps: float
    min_points: int
    clean_side: str  # whose name loses its brackets before names are compared
    measure: str  # jaccard (character sets) or levenshtein
    likeness: float
    distance: int
    has_category: bool = True
    max_depth: int = 9  # of the quadtree: projected root diagonal halved until at most 15


#: Fixed values of the three cities.
CITIES = {
    "nj": City("nj", 118.78479874404546, 31.949171622741847, 118.82612463290835, 31.928912246338754, 38.54, 5, "right", "jaccard", 0.225, 400),
    "pit": City("pit", -80.1089065368723, 40.50751849049542, -79.8481037, 40.3509222, 353.17, 5, "right", "levenshtein", 0.4, 491, has_category=False, max_depth=12),
    "hz": City("hz", 120.239, 30.2366, 120.2694, 30.2124, 55.13, 5, "left", "levenshtein", 0.55, 350),
}

#: Kinds of record, in the column `belong`.
LEFT, RIGHT, AREA = 0, 1, 2


@dataclass(frozen=True)
class Options:
    """null_text: what a missing text compares as. secondary_offset: keep the labels of the second clustering pass apart.
    matching_bonus: what every kept match is worth beside its confidence (1: as many matches as possible; 0: true maximum weight)."""

    null_text: str = "nan"
    secondary_offset: bool = False
    matching_bonus: float = 1.0
