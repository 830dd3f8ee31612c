"""Pipelines of operators on one or more columns, run as one Arrow function per sink.

A pipeline is a graph of nodes. Equal nodes are one (common subexpressions), each is evaluated once a row, and all
outputs of a sink come from one function, so a chain of operators reads its input once. Element type and rank of every
node are planned before a row is seen; they make the result's schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import OPERATORS
from ..operators.contours import from_value
from ..operators.core import DTYPES, REQUIRED, dtype_name, wide
from .arrow import reader, sink_type, whole, writer

POLICIES = ("raise", "null", "null_with_message")
#: Channel means and deviations of a common image collection.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)


class This:
    """Arithmetic over the shape of the operator's own input, settled on each row."""

    def __init__(self, f: Callable, text: str):
        self.f, self.text = f, text

    def __repr__(self) -> str:
        return self.text

    def _with(self, other, f, sign):
        get = other.f if isinstance(other, This) else lambda x: other
        return This(lambda x: f(self.f(x), get(x)), f"({self} {sign} {other})")

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b, "+")

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b, "-")

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b, "*")

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b, "/")

    def __floordiv__(self, o):
        return self._with(o, lambda a, b: a // b, "//")

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return This(lambda x: o - self.f(x), f"({o} - {self})")


class _Shape:
    height = This(lambda x: x.shape[0], "this.height")
    width = This(lambda x: x.shape[1], "this.width")
    channels = This(lambda x: x.shape[2] if x.ndim > 2 else 1, "this.channels")
    ndim = This(lambda x: x.ndim, "this.ndim")


this = _Shape()


@dataclass(eq=False)
class Node:
    op: str
    inputs: tuple
    params: dict
    domain: str
    dtype: str | None
    ndim: int | None
    column: Column | None = None
    options: dict = field(default_factory=dict)

    def key(self, memo: dict) -> tuple:
        if self not in memo:
            same = (self.op, tuple(i.key(memo) for i in self.inputs), repr(sorted((k, _text(v)) for k, v in {**self.params, **self.options}.items())), str(self.column) if self.column is not None else None)
            memo[self] = same
        return memo[self]


def _text(v) -> str:
    return v._jc.toString() if isinstance(v, Column) and hasattr(v, "_jc") else str(v) if isinstance(v, Column) else repr(v)


class Graph:
    """What Pipeline and Lazy share: a method for every operator."""

    def _add(self, op: str, nodes: dict, params: dict):
        raise NotImplementedError

    # compositions of operators, and operators with further spellings of their parameters

    def flip_h(self, when=True):
        return self.flip(axes=[1], when=when)

    def flip_v(self, when=True):
        return self.flip(axes=[0], when=when)

    def crop_box(self, box: Column):
        """The smallest window of whole pixels around each row's box, cut to the image."""
        x, y, w, h = (box[k] for k in ("x", "y", "width", "height"))
        top, left = F.floor(y), F.floor(x)
        return self.crop_clip(top=top, left=left, height=F.ceil(y + h) - top, width=F.ceil(x + w) - left)

    def median_filter(self, size=3, border: str = "replicate"):
        return self.rank_filter(height=size, width=size, q=50.0, border=border)

    def adjust_brightness(self, factor, preserve_dtype: bool = False):
        out = self.scale(factor=factor).clamp(0, 255)
        return out._cast_to(self) if preserve_dtype else out

    def convert_color(self, from_space: str, to_space: str):
        return self.cvt_color(from_space=from_space, to_space=to_space)

    def to_hsv(self):
        return self.cvt_color(from_space="rgb", to_space="hsv")

    def to_lab(self):
        return self.cvt_color(from_space="rgb", to_space="lab")

    def to_bgr(self):
        return self.cvt_color(from_space="rgb", to_space="bgr")

    def to_ycbcr(self):
        return self.cvt_color(from_space="rgb", to_space="ycbcr")

    def sobel(self, axis: str = "x"):
        k = np.outer([1, 2, 1], [-1, 0, 1])
        return self.convolve2d(kernel=(k if axis == "x" else k.T).tolist())

    def laplacian(self):
        return self.convolve2d(kernel=[[0, 1, 0], [1, -4, 1], [0, 1, 0]])

    def sharpen(self, strength=1.0):
        """A kernel of sum 1: the pixel raised by `strength` times its difference to its four neighbours."""
        zero = F.lit(0.0) if isinstance(strength, Column) else 0.0
        return self.convolve2d(kernel=[zero, -strength, zero, -strength, 1 + 4 * strength, -strength, zero, -strength, zero])

    def morphology_open(self, ksize=3, footprint: str = "square"):
        return self.erode(ksize=ksize, footprint=footprint).dilate(ksize=ksize, footprint=footprint)

    def morphology_close(self, ksize=3, footprint: str = "square"):
        return self.dilate(ksize=ksize, footprint=footprint).erode(ksize=ksize, footprint=footprint)

    def shear(self, sx=0.0, sy=0.0, *, output_size, interpolation: str = "bilinear", border_value=0.0):
        return self.warp_affine(matrix=[1.0, sx, 0.0, sy, 1.0, 0.0], output_size=output_size, interpolation=interpolation, border_value=border_value)

    def normalize_imagenet(self):
        return self.scale(factor=1 / 255).normalize_preset(mean=list(IMAGENET_MEAN), std=list(IMAGENET_STD))


def _method(name: str):
    op = OPERATORS[name]

    def method(self, *args, out_dtype=REQUIRED, preserve_dtype: bool = False, **params):
        nodes = {}
        names = [*op.nodes, *op.params]
        for n, v in zip(names, args):
            params[n] = v
        for n in op.nodes:
            if n not in params:
                raise TypeError(f"{name}: {n} is missing")
            nodes[n] = params.pop(n)
        if "out_dtype" in op.params and out_dtype is not REQUIRED:
            params["out_dtype"] = out_dtype
        params = {k: v.value if isinstance(v, Enum) else v for k, v in params.items()}
        unknown = set(params) - set(op.params)
        if unknown:
            raise TypeError(f"{name}: unknown parameters {', '.join(sorted(unknown))}")
        full = {**op.params, **params}
        missing = [n for n, v in full.items() if v is REQUIRED]
        if missing:
            raise TypeError(f"{name}: {', '.join(missing)} is missing")
        for n in op.fixed:
            if isinstance(full[n], (Column, This)):
                raise TypeError(f"{name}: {n} decides the result's type, so it cannot be a column")
        out = self._add(name, nodes, full)
        if "out_dtype" not in op.params and out_dtype is not REQUIRED:
            out = out.cast(dtype=out_dtype)
        elif preserve_dtype:
            out = out._cast_back(name)
        return out

    method.__name__, method.__doc__ = name, op.run.__doc__
    return method


def _clamp(self, min_val=None, max_val=None, *, out_dtype=REQUIRED, preserve_dtype: bool = False, **ends):
    low, high = ends.get("min", min_val), ends.get("max", max_val)
    if low is None or high is None:
        raise TypeError("clamp: both ends are needed")
    return _PLAIN["clamp"](self, min=low, max=high, out_dtype=out_dtype, preserve_dtype=preserve_dtype)


def _resize_scale(self, scale=None, *, scale_x=None, scale_y=None, filter="lanczos3"):  # noqa: A002
    if (scale is None) == (scale_x is None and scale_y is None):
        raise TypeError("resize_scale: either scale, or scale_x and scale_y")
    return _PLAIN["resize_scale"](self, scale_x=scale if scale_x is None else scale_x, scale_y=scale if scale_y is None else scale_y, filter=filter)


def _rasterize(self, *, width=None, height=None, shape=None, **colours):
    """On a canvas of that size, or of another node's."""
    if (shape is None) == (width is None or height is None):
        raise TypeError("rasterize: either width and height, or shape")
    return _PLAIN["rasterize"](self, height=height if shape is None else shape, width=0 if shape is not None else width, **colours)


def _assert_shape(self, *, dims=None, height=None, width=None, channels=None, exact: bool = True):
    """By all dimensions, or by those of an image."""
    if dims is None:
        dims = [height, width] if channels is None else [height, width, channels]
        exact = channels is not None
    return _PLAIN["assert_shape"](self, dims=dims, exact=exact)


def _channel_merge(self, *others):
    return _PLAIN["channel_merge"](self, others=[o for v in others for o in (v if isinstance(v, (list, tuple)) else [v])])


#: Names that pipelines give to contour operators.
_SHORT = {n: n.removeprefix("contour_") for n in OPERATORS if n.startswith("contour_")}
for _n in OPERATORS:
    setattr(Graph, _n, _method(_n))
    if _n in _SHORT and _SHORT[_n] not in OPERATORS and not hasattr(Graph, _SHORT[_n]):
        setattr(Graph, _SHORT[_n], _method(_n))


def use_operator(name: str) -> None:
    """Give pipelines a method for an operator that was registered with `operator` after this module was loaded."""
    setattr(Graph, name, _method(name))


class Sink:
    """A sink with its settings: Sink.list(dtype="u8"), Sink.jpeg(quality=90)."""

    def __init__(self, fmt: str, **options):
        self.fmt, self.options = fmt, options


for _n in ("tensor", "numpy", "array", "list", "native", "long", "blob", "png", "jpeg", "tiff"):
    setattr(Sink, _n, staticmethod(lambda fmt=_n, **options: Sink(fmt, **options)))


_PLAIN = {n: getattr(Graph, n) for n in ("clamp", "resize_scale", "rasterize", "assert_shape", "channel_merge")}
Graph.clamp, Graph.resize_scale, Graph.rasterize, Graph.assert_shape, Graph.channel_merge = _clamp, _resize_scale, _rasterize, _assert_shape, _channel_merge


class Pipeline(Graph):
    """A recorded chain: Pipeline().source("image_bytes").resize(height=224, width=224).grayscale()."""

    def __init__(self):
        self.steps: list[tuple] = []
        self.from_ = ("auto", {})
        self.errors, self.null_params = "raise", "raise"

    def _copy(self) -> Pipeline:
        out = Pipeline()
        out.steps, out.from_, out.errors, out.null_params = list(self.steps), self.from_, self.errors, self.null_params
        return out

    def source(self, kind: str = "auto", **options) -> Pipeline:
        known = {"dtype", "shape", "ndim", "orientation", "decode_max_size", "require_contiguous", "allowed_roots", "on_error"}
        if kind not in ("auto", "image_bytes", "file_path", "blob", "raw", "list", "array", "tensor", "contour") or set(options) - known:
            raise ValueError(f"source {kind!r} with {sorted(options)} is unknown")
        if options.get("dtype"):
            options["dtype"] = dtype_name(options["dtype"])
        out = self._copy()
        out.from_ = (kind, options)
        return out

    def has_source(self) -> bool:
        return self.from_ != ("auto", {})

    def on_error(self, policy: str) -> Pipeline:
        if policy not in POLICIES:
            raise ValueError(f"on_error {policy!r} is none of {', '.join(POLICIES)}")
        out = self._copy()
        out.errors = policy
        return out

    def on_null_param(self, policy: str) -> Pipeline:
        if policy not in POLICIES[:2]:
            raise ValueError(f"on_null_param {policy!r} is neither raise nor null")
        out = self._copy()
        out.null_params = policy
        return out

    def _add(self, op, nodes, params):
        out = self._copy()
        out.steps.append((op, nodes, params))
        return out

    def _cast_back(self, name):
        return self._cast_to(None)

    def _cast_to(self, before: Pipeline | None):
        """To the element type that was planned after the steps of `before` (by default, before the last step)."""
        out = self._copy()
        out.steps.append(("__cast_back", {}, {"at": len(self.steps) - 1 if before is None else len(before.steps)}))
        return out

    # what a plan says before any column is known
    def _planned(self) -> Lazy:
        return cv(F.lit(None)).pipe(self)

    def output_dtype(self):
        return self._planned().node.dtype

    def current_domain(self) -> str:
        return self._planned().node.domain

    def validate(self) -> Pipeline:
        self._planned()
        return self

    def explain(self) -> str:
        return self._planned().explain()


class cv:  # noqa: N801
    """Entry to pipelines and header fields of a column: cv(F.col("image")).pipe(pipeline).sink("list")."""

    def __init__(self, column: Column | str):
        self.column = F.col(column) if isinstance(column, str) else column

    def pipe(self, p: Pipeline) -> Lazy:
        kind, options = p.from_
        domain = "contour" if kind == "contour" else "buffer"
        if kind == "auto" and p.steps and not p.steps[0][0].startswith("__") and OPERATORS[p.steps[0][0]].takes == "contour":
            domain = "contour"
        ndim = {"image_bytes": 3, "file_path": 3, "raw": 1}.get(kind, len(options["shape"]) if options.get("shape") else options.get("ndim"))
        dtype = options.get("dtype") or ("u8" if kind == "raw" else None)
        out = Lazy(Node("source", (), {}, domain, dtype, ndim, self.column, {"kind": kind, **options}), p.errors, p.null_params)
        return out._extend(p)

    def _info(self, name: str, kind: str) -> Column:
        from ..sources.codecs import info

        def one(v):
            try:
                return None if v is None else info(v)[name]
            except ValueError:
                return None

        def run(col: pa.Array) -> pa.Array:
            return pa.array([one(v.as_py()) for v in col], {"bigint": pa.int64(), "string": pa.string()}[kind])

        return F.arrow_udf(run, kind)(self.column)

    def width(self) -> Column:
        return self._info("width", "bigint")

    def height(self) -> Column:
        return self._info("height", "bigint")

    def channels(self) -> Column:
        return self._info("channels", "bigint")

    def image_dtype(self) -> Column:
        return self._info("dtype", "string")

    def image_info(self) -> Column:
        """All header fields in one read; null for bytes that are no image."""
        from ..sources.codecs import info

        kind = pa.struct([("width", pa.int64()), ("height", pa.int64()), ("channels", pa.int64()), ("dtype", pa.string()), ("orientation", pa.int64())])

        def one(v):
            try:
                return None if v is None else info(v)
            except ValueError:
                return None

        return F.arrow_udf(lambda col: pa.array([one(v.as_py()) for v in col], kind), "struct<width:bigint,height:bigint,channels:bigint,dtype:string,orientation:bigint>")(self.column)


@dataclass
class OptFlags:
    """Passes that may be switched off: equal nodes as one."""

    cse: bool = True


class Lazy(Graph):
    """A node of a graph over columns; its operators give further nodes."""

    def __init__(self, node: Node, errors: str = "raise", null_params: str = "raise", names: dict | None = None):
        self.node, self.errors, self.null_params, self.names = node, errors, null_params, dict(names or {})

    def _at(self, node: Node) -> Lazy:
        return Lazy(node, self.errors, self.null_params, self.names)

    def _extend(self, p: Pipeline) -> Lazy:
        out = self
        before: list[Lazy] = []
        for op, nodes, params in p.steps:
            before.append(out)
            if op == "__cast_back":
                out = out._cast_to(before[params["at"]])
                continue
            out = out._add(op, nodes, params)
        return out

    def pipe(self, p: Pipeline) -> Lazy:
        """Go on with the steps of a pipeline."""
        return self._extend(p)

    def _cast_back(self, name):
        return self._cast_to(self._at(self.node.inputs[0]))

    def _cast_to(self, before: Lazy):
        if before.node.dtype is None:
            raise ValueError("preserve_dtype: the element type is not known before the rows are; give the source a dtype")
        return self.cast(dtype=before.node.dtype)

    def _add(self, op, nodes, params):
        spec = OPERATORS[op]
        domain = self.node.domain
        if spec.takes == "contour" and domain != "contour" or spec.takes == "buffer" and domain not in ("buffer", "vector"):
            raise ValueError(f"{op} takes a {spec.takes}, not a {domain}")
        inputs, order = [self.node], []
        for n in spec.nodes:
            v = nodes[n]
            several = v if isinstance(v, (list, tuple)) else [v]
            start = len(inputs)
            for x in several:
                if isinstance(x, Column):  # a bare column: contours or a buffer
                    x = cv(x).pipe(Pipeline().source("contour" if n == "contours" or spec.takes == "contour" else "auto"))
                inputs.append(x.node)
            order.append((n, start, len(inputs), isinstance(v, (list, tuple))))
        if op == "rasterize" and isinstance(params["height"], Lazy):
            inputs.append(params["height"].node)
            params = {**params, "height": None, "width": 0}
            order.append(("height", len(inputs) - 1, len(inputs), False))
        buffers = [i.dtype for i in inputs]
        dtype = spec.dtype(buffers, params)
        gives = spec.gives(params) if callable(spec.gives) else spec.gives
        node = Node(op, tuple(inputs), params, gives, dtype, spec.ndim(self.node.ndim, params), options={"order": tuple(order)})
        return self._at(node)

    def alias(self, name: str) -> Lazy:
        out = self._at(self.node)
        out.names = {**self.names, name: self.node}
        return out

    def merge_pipe(self, *others: Lazy) -> Lazy:
        """Named nodes of the others can be outputs of this one's sink."""
        out = self._at(self.node)
        for o in others:
            out.names.update(o.names)
        return out

    def background_divide(self, sigma, epsilon: float = 1e-6) -> Lazy:
        return self.divide(self.blur(sigma=sigma).add_constant(value=epsilon))

    def apply_contour_mask(self, contours, invert: bool = False) -> Lazy:
        """The image inside the contours, drawn on a canvas of its size."""
        if isinstance(contours, Column):
            contours = cv(contours).pipe(Pipeline().source("contour"))
        return self.apply_mask(contours.rasterize(shape=self), invert=invert)

    def statistics_lazy(self, include=("mean", "std", "min", "max"), mask: Lazy | None = None) -> dict[str, Lazy]:
        return {n: self.reduce_masked(mask, reduction=n) if mask is not None else self.reduce(reduction=n) for n in include}

    def explain(self) -> str:
        lines, seen = [], {}

        def show(n: Node, depth: int):
            tag = "" if n not in seen else " (above)"
            seen.setdefault(n, len(seen))
            detail = ", ".join(f"{k}={_text(v)}" for k, v in n.params.items() if v is not None) or n.options.get("kind", "")
            lines.append("  " * depth + f"{n.op}({detail}) -> {n.domain} {n.dtype or '?'} rank {'?' if n.ndim is None else n.ndim}{tag}")
            if not tag:
                for i in n.inputs:
                    show(i, depth + 1)

        show(self.node, 0)
        return "\n".join(lines)

    def show_graph(self) -> str:
        """The graph in DOT."""
        ids, lines = {}, []

        def walk(n: Node):
            if n in ids:
                return
            for i in n.inputs:
                walk(i)
            ids[n] = len(ids)
            lines.append(f'  n{ids[n]} [label="{n.op}"];')
            lines.extend(f"  n{ids[i]} -> n{ids[n]};" for i in n.inputs)

        walk(self.node)
        return "digraph {\n" + "\n".join(lines) + "\n}"

    def statistics(self, include=("mean", "std", "min", "max"), mask: Lazy | None = None) -> Column:
        """A struct of reductions in one pass."""
        out = self
        for n, v in self.statistics_lazy(include, mask).items():
            out = out.merge_pipe(v.alias(n))
        return out.sink({n: "native" for n in include})

    def sink(self, fmt: str | Sink | dict = "tensor", flags: OptFlags | None = None, **options) -> Column:
        """The column of results; a dict of {name of a node: format, Sink or (format, options)} gives a struct."""
        if isinstance(fmt, Sink):
            fmt, options = fmt.fmt, {**fmt.options, **options}
        if isinstance(fmt, dict):
            outs = []
            for name, f in fmt.items():
                if name not in self.names:
                    raise ValueError(f"sink: no node is named {name!r}; names: {', '.join(self.names) or 'none'}")
                f, o = (f, {}) if isinstance(f, str) else (f.fmt, f.options) if isinstance(f, Sink) else f
                outs.append((name, self.names[name], f, o))
        else:
            outs = [("value", self.node, fmt, options)]
        return _emit(outs, isinstance(fmt, dict), self.errors, self.null_params, flags or OptFlags())


def _number(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


def _emit(outs, many: bool, errors: str, null_params: str, flags: OptFlags) -> Column:
    """One Arrow function for all outputs."""
    plan, place, memo = [], {}, {}
    columns: list[Column] = []

    def visit(n: Node) -> int:
        mark = n.key(memo) if flags.cse else n
        if mark in place:
            return place[mark]
        if n.op == "source":
            columns.append(n.column)
            plan.append(("source", len(columns) - 1, reader(n.options["kind"], n.options), n.options.get("on_error")))
        else:
            args = [visit(i) for i in n.inputs]
            params = {}
            for k, v in n.params.items():
                if isinstance(v, Column):
                    columns.append(v)
                    params[k] = ("column", len(columns) - 1)
                elif isinstance(v, (list, tuple)) and any(isinstance(x, Column) for x in v):
                    columns.append(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]))
                    params[k] = ("column", len(columns) - 1)
                elif isinstance(v, This):
                    params[k] = ("this", v.f)
                elif isinstance(v, (list, tuple)) and any(isinstance(x, This) for x in v):
                    params[k] = ("this", lambda x, v=v: [_number(e.f(x)) if isinstance(e, This) else e for e in v])
                else:
                    params[k] = ("value", v)
            plan.append(("op", OPERATORS[n.op].run, args, params, n.options["order"], n.domain, n.op))
        place[mark] = len(plan) - 1
        return place[mark]

    targets = [(name, visit(n), writer(f, n.domain, n.dtype, n.ndim, o), sink_type(f, n.domain, n.dtype, n.ndim, o)) for name, n, f, o in outs]
    message = errors == "null_with_message"

    def run(*cols):
        cols = [whole(c) for c in cols]
        n = len(cols[0])
        opened = [step[2](cols[step[1]]) if step[0] == "source" else None for step in plan]
        values = {i: cols[i].to_pylist() for step in plan if step[0] == "op" for kind, i in step[3].values() if kind == "column"}
        results: list[list] = [[] for _ in targets]
        notes: list = []
        for r in range(n):
            got: list = []
            note = None
            try:
                for k, step in enumerate(plan):
                    if step[0] == "source":
                        try:
                            got.append(opened[k](r))
                        except ValueError:
                            if step[3] != "null":
                                raise
                            got.append(None)
                        continue
                    _, f, args, params, order, domain, _ = step
                    given = [got[a] for a in args]
                    if any(v is None for v in given):
                        got.append(None)
                        continue
                    p = {key: v if kind == "value" else v(given[0]) if kind == "this" else values[v][r] for key, (kind, v) in params.items()}
                    empty = [key for key, (kind, _) in params.items() if kind == "column" and p[key] is None]
                    if empty:
                        if null_params == "null":
                            got.append(None)
                            continue
                        raise ValueError(f"{step[6]}: parameter {empty[0]} is null")
                    for key, (kind, _) in params.items():
                        if kind == "this" and isinstance(p[key], float) and key in WHOLE:
                            p[key] = int(p[key])
                    for name, a, b, several in order:
                        p[name] = given[a:b] if several else given[a]
                    got.append(f(given[0], **p))
            except (ValueError, IndexError, OverflowError, ZeroDivisionError, FileNotFoundError) as e:
                if errors == "raise":
                    raise
                note = str(e)
                got = [None] * len(plan)
            for out, (_, k, _, _) in zip(results, targets, strict=True):
                out.append(got[k])
            notes.append(note)
        arrays = [w(rows) for rows, (_, _, w, _) in zip(results, targets, strict=True)]
        if not many and not message:
            return arrays[0]
        names = [t[0] for t in targets]
        if message:
            arrays.append(pa.array(notes, pa.string()))
            names.append("_error")
        return pa.StructArray.from_arrays(arrays, names)

    ddl = targets[0][3]
    if many or message:
        ddl = "struct<" + ",".join([f"`{t[0]}`:{t[3]}" for t in targets] + ["_error:string"] * message) + ">"
    return F.arrow_udf(run, ddl)(*columns)


WHOLE = {"height", "width", "top", "left", "bottom", "right", "ksize", "iterations", "max_size", "min_size", "index"}
