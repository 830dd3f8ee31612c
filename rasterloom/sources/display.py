"""Images of a few rows as a page."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.core import convert
from .blobs import MAGIC, from_blob
from .codecs import decode, encode_png


def show_images(df: DataFrame, column: str, *, rows: int = 8, label: str | None = None, width: int = 160) -> str:
    """HTML with the images of the first rows of a column of image bytes or blobs; null rows say so."""
    cells = []
    for r in df.select(F.col(column).alias("b"), (F.col(label) if label else F.lit("")).cast("string").alias("l")).limit(rows).collect():
        if r.b is None:
            cells.append(f"<figure>null<figcaption>{r.l or ''}</figcaption></figure>")
            continue
        x = from_blob(bytes(r.b)) if bytes(r.b[:4]) == MAGIC else decode(bytes(r.b))
        x = convert(x * 255 if x.dtype.kind == "f" and x.size and np.nanmax(x) <= 1 else x, np.uint8)
        png = base64.b64encode(encode_png(x)).decode()
        cells.append(f'<figure><img width="{width}" src="data:image/png;base64,{png}"><figcaption>{r.l or ""}</figcaption></figure>')
    return "<div>" + "".join(cells) + "</div>"
