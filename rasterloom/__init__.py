"""Typed image, tensor and geometry operators as Spark column expressions."""

from .functions.shapes import (  # noqa: F401
    BBOX_SCHEMA, CONTOUR_SCHEMA, CONTOUR_SET_SCHEMA, CORRESPONDENCE_SCHEMA, POINT_SCHEMA, POINT_SET_SCHEMA, RING_SCHEMA, TENSOR_SCHEMA,
    bbox, contour, contour_from_coords, contour_from_points, contour_set_from_coords, mask_dice, mask_iou, point, region_stats, tagged, validate_contour, validate_point,
)
from .operators.core import dtype_name as dtype_name_for  # noqa: F401
from .operators.core import operator  # noqa: F401
from .plans.graph import IMAGENET_MEAN, IMAGENET_STD, OptFlags, Pipeline, Sink, cv, this, use_operator  # noqa: F401


def build_info() -> dict:
    """Versions that results may depend on."""
    import numpy
    import pyarrow
    import pyspark

    from .operators import OPERATORS

    return {"numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "pyspark": pyspark.__version__, "operators": len(OPERATORS)}


def set_row_parallelism(enabled: bool) -> None:
    """Rows are split by Spark's partitions alone; kept so that callers need not change."""
