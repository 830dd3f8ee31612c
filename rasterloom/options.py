"""Names of the options, as enumerations; the plain strings are accepted everywhere too."""

from __future__ import annotations

from enum import Enum

#: The vocabulary of each option.
VOCABULARIES = {
    "ApproxMethod": "none simple approx",
    "BorderArc": "shortest clockwise counterclockwise",
    "BorderMode": "replicate zero reflect",
    "BoxFormat": "xyxy xywh cxcywh",
    "ColorSpace": "rgb bgr hsv lab ycbcr gray",
    "CoordOrder": "xy yx",
    "DType": "u8 i8 u16 i16 u32 i32 u64 i64 f32 f64",
    "Domain": "buffer contour scalar vector",
    "ExtractMode": "external all",
    "FetchErrorPolicy": "raise null",
    "FilterType": "nearest bilinear catmullrom gaussian lanczos3 area",
    "Footprint": "square disk",
    "HashAlgorithm": "average difference perceptual blockhash",
    "HistogramClosed": "left right",
    "HistogramOutput": "counts normalized quantized edges buckets",
    "InterpolationType": "nearest bilinear",
    "LabelRegionMode": "interior boundary bbox",
    "LineCap": "round square butt",
    "LineJoin": "round miter bevel",
    "NormalizeMethod": "minmax zscore",
    "NullParamPolicy": "raise null",
    "Orientation": "stored exif",
    "PadMode": "constant edge reflect symmetric",
    "PadPosition": "center top-left bottom-right",
    "RowErrorPolicy": "raise null null_with_message",
    "ScaleOrigin": "centroid bbox_center origin",
    "Statistic": "sum mean min max std median count",
    "Winding": "ccw counterclockwise cw clockwise",
}
globals().update({name: Enum(name, {v.upper().replace("-", "_"): v for v in words.split()}, type=str) for name, words in VOCABULARIES.items()})
