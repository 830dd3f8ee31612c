"""Row kernels over typed NumPy buffers and shapes, by operator name."""

from . import colour, contours, filters, pixels, reductions, resample, views  # noqa: F401
from .core import OPERATORS, convert  # noqa: F401
