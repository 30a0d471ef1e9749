"""Errors that callers can tell apart."""


class EvalError(ValueError):
    """Anything wrong with inputs or parameters."""


class InvalidConfig(EvalError):
    """Parameters that contradict each other."""


class InvalidAnnotation(EvalError):
    """A ground truth row that names an unknown image or category, or breaks a rule."""


class InvalidDetection(EvalError):
    """A detection that can't be scored."""


class DimensionMismatch(EvalError):
    """Masks of different sizes."""


class IncompatibleSummaryPlan(EvalError):
    """A custom grid has no default summary; ask for tables instead."""


class UnknownImage(EvalError):
    """Predictions are missing for an image of the ground truth."""


class RepeatedImage(EvalError):
    """A stream brought an image again."""


class PartitionOverlap(EvalError):
    """Two ranks hold the same image."""


class RankCollision(EvalError):
    """Two partial states have the same rank."""


class PartialMismatch(EvalError):
    """Partial states of different datasets or parameters."""


class TooManySlices(EvalError):
    """More slices than the cap allows."""


class OutOfBudget(EvalError):
    """A table is larger than its cap."""


class QueueFull(EvalError):
    """A background evaluator took no batch in time."""
