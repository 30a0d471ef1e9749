"""Parameters of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pixelyard.errors import InvalidConfig
from pixelyard.functions.numeric import IOU_LADDER, RECALL_LADDER, ladder

#: The least similarity of a match is a threshold, or just under 1.
MOST_SEED = 1 - 1e-10
#: A detection's fates by threshold are the bits of a long.
MOST_THRESHOLDS = 62


@dataclass(frozen=True)
class Area:
    """A closed range of areas; ranges may overlap."""

    label: str
    lo: float
    hi: float


#: Area ranges in square pixels, closed at both ends.
AREAS = (Area("all", 0.0, 1e10), Area("small", 0.0, 1024.0), Area("medium", 1024.0, 9216.0), Area("large", 9216.0, 1e10))
KEYPOINT_AREAS = (AREAS[0], AREAS[2], AREAS[3])


@dataclass(frozen=True)
class Params:
    iou_thresholds: tuple[float, ...] = IOU_LADDER
    recall_thresholds: tuple[float, ...] = RECALL_LADDER
    max_dets: tuple[int, ...] = (1, 10, 100)
    areas: tuple[Area, ...] = AREAS
    use_cats: bool = True
    mode: str = "corrected"

    def __post_init__(self) -> None:
        object.__setattr__(self, "iou_thresholds", ladder(self.iou_thresholds, "iou_thresholds"))
        object.__setattr__(self, "recall_thresholds", ladder(self.recall_thresholds, "recall_thresholds"))
        if not self.max_dets or any(int(m) < 1 for m in self.max_dets):
            raise InvalidConfig("max_dets must be positive")
        object.__setattr__(self, "max_dets", tuple(sorted(int(m) for m in self.max_dets)))
        if len(self.iou_thresholds) > MOST_THRESHOLDS:
            raise InvalidConfig(f"at most {MOST_THRESHOLDS} IoU thresholds at once: they don't depend on each other, so evaluate more in parts")
        if not self.areas or any(not a.lo <= a.hi for a in self.areas):
            raise InvalidConfig("area ranges must not be empty")
        if self.mode not in ("strict", "corrected"):
            raise InvalidConfig(f"unknown mode {self.mode!r}")

    @property
    def seeds(self) -> tuple[float, ...]:
        return tuple(min(t, MOST_SEED) for t in self.iou_thresholds)

    def area_index(self, label: str) -> int:
        for i, a in enumerate(self.areas):
            if a.label == label:
                return i
        raise InvalidConfig(f"no area range is called {label!r}")

    def iou_index(self, value: float) -> int:
        for i, t in enumerate(self.iou_thresholds):
            if abs(t - value) <= 1e-12:
                return i
        raise InvalidConfig(f"{value} isn't an IoU threshold")

    def but(self, **changes) -> Params:
        return replace(self, **changes)

    @property
    def is_default_grid(self) -> bool:
        return self.iou_thresholds == IOU_LADDER and self.recall_thresholds == RECALL_LADDER and self.areas in (AREAS, KEYPOINT_AREAS)


@dataclass(frozen=True)
class Line:
    """A summary line. ``cap``: "largest", ("index", i), ("value", n) or ("value_or_none", n)."""

    metric: str
    iou: float | None = None
    area: str = "all"
    cap: str | tuple = "largest"
    frequency: str | None = None
    name: str | None = None

    def cap_index(self, caps: Sequence[int]) -> int | None:
        if self.cap == "largest":
            return len(caps) - 1
        how, n = self.cap
        if how == "index":
            if n >= len(caps):
                raise InvalidConfig(f"the plan needs {n + 1} max_dets")
            return n
        if n in caps:
            return caps.index(n)
        if how == "value_or_none":
            return None
        raise InvalidConfig(f"max_dets lacks {n}")


def coco_plan(mode: str = "corrected") -> tuple[Line, ...]:
    return (
        Line("AP", cap=("value_or_none", 100) if mode == "strict" else "largest"),
        Line("AP", 0.5),
        Line("AP", 0.75),
        *(Line("AP", area=a) for a in ("small", "medium", "large")),
        *(Line("AR", cap=("index", i)) for i in range(3)),
        *(Line("AR", area=a) for a in ("small", "medium", "large")),
    )


def keypoint_plan() -> tuple[Line, ...]:
    return tuple(line for m in ("AP", "AR") for line in (Line(m), Line(m, 0.5), Line(m, 0.75), Line(m, area="medium"), Line(m, area="large")))


def lvis_plan() -> tuple[Line, ...]:
    sizes = ("small", "medium", "large")
    return (
        Line("AP"),
        Line("AP", 0.5),
        Line("AP", 0.75),
        *(Line("AP", area=a) for a in sizes),
        *(Line("AP", frequency=f) for f in ("r", "c", "f")),
        Line("AR"),
        *(Line("AR", area=a) for a in sizes),
    )


@dataclass(frozen=True)
class Bbox:
    name: str = "bbox"


@dataclass(frozen=True)
class Segm:
    name: str = "segm"


@dataclass(frozen=True)
class Boundary:
    dilation_ratio: float = 0.02
    name: str = "boundary"


@dataclass(frozen=True)
class Keypoints:
    #: sigmas by category; other categories have the seventeen standard ones
    sigmas: dict[int, tuple[float, ...]] = field(default_factory=dict)
    name: str = "keypoints"


@dataclass(frozen=True)
class ByFrequency:
    """Categories of a frequency tag, r, c or f."""

    tag: str

    def __post_init__(self) -> None:
        if self.tag not in ("r", "c", "f"):
            raise InvalidConfig(f"unknown frequency {self.tag!r}")


@dataclass(frozen=True)
class ByIds:
    ids: frozenset[int]


@dataclass(frozen=True)
class ByGroup:
    """The categories of one group of a table ``label, category_id``."""

    label: str
