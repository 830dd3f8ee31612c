"""Row kernels on odd types, NaN, empty and null input, against plain loops or known answers."""

import math

import numpy as np
import pytest

from rasterloom.operators import OPERATORS, convert
from rasterloom.operators import contours as C
from rasterloom.operators import planar as P
from rasterloom.sources import blobs, codecs

G = np.random.default_rng(3)


def run(name, x, *nodes, **params):
    op = OPERATORS[name]
    return op.run(x, *nodes, **{**op.params, **params})


def test_conversion_rules():
    f = np.asarray([0.5, 1.5, 2.5, -0.5, 254.5, 300.0, -3.0, np.nan, np.inf])
    assert convert(f, "u8").tolist() == [1, 2, 3, 0, 255, 255, 0, 0, 255]
    assert convert(np.asarray([300, -1]), "u8").tolist() == [44, 255]
    assert convert(np.asarray([1e30, -1e30, np.nan]), "i64").tolist() == [2**63 - 1, -(2**63), 0]
    assert convert(np.asarray([1e30, -5.0]), "u64").tolist() == [2**64 - 1, 0]


@pytest.mark.parametrize("dtype", ["u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8"])
def test_integers_saturate(dtype):
    info = np.iinfo(dtype)
    a, b = np.asarray([info.max, info.min, 3], dtype), np.asarray([info.max, info.max, 2], dtype)
    for name, f in (("add", lambda p, q: p + q), ("subtract", lambda p, q: p - q), ("multiply", lambda p, q: p * q)):
        want = [min(max(f(int(p), int(q)), int(info.min)), int(info.max)) for p, q in zip(a, b, strict=True)]
        assert run(name, a, b).tolist() == want and run(name, a, b).dtype == a.dtype


def test_nan_passes_through_extremes():
    x = np.asarray([np.nan, 2.0, -1.0])
    y = np.asarray([2.0, np.nan, 0.0])
    assert np.isnan(run("minimum", x, y)[:2]).all() and np.isnan(run("maximum", x, y)[:2]).all()
    assert np.isnan(run("reduce_min", x)) and np.isnan(run("reduce_max", x)) and run("reduce_argmin", x, axis=0) == 0
    assert np.isnan(run("relu", x)[0]) and np.isnan(run("reduce_percentile", x, q=50))
    assert run("threshold", x, value=0.0).tolist() == [0, 255, 0]
    with np.errstate(all="ignore"):
        assert np.isnan(run("sqrt", np.asarray([-1.0]))[0]) and run("reciprocal", np.asarray([0.0, -0.0])).tolist() == [np.inf, -np.inf]


def test_refusals():
    x = np.zeros((3, 4, 1), np.uint8)
    for name, nodes, params in (
        ("crop", (), {"top": 2, "height": 2}), ("crop_clip", (), {"top": 9, "height": 2}), ("add", (np.zeros((3, 4), np.uint8),), {}), ("pad_to_size", (), {"height": 2, "width": 9}),
        ("reduce_max", (), {"x": np.zeros(0)}), ("warp_affine", (), {"matrix": [1, 1, 0, 1, 1, 0], "output_size": [2, 2]}), ("normalize_range", (), {"low": 2.0, "high": 1.0}), ("transpose", (), {"axes": [0, 0, 1]}),
        ("bitwise_and", (np.zeros((3, 4, 1)),), {}), ("cvt_color", (), {"from_space": "rgb", "to_space": "hsv"}), ("erode", (), {"x": np.zeros((3, 3, 2))}), ("resize", (), {"height": 0, "width": 1}),
        ("apply_lut", (), {"table": [1], "x": np.ones((2, 2), np.uint8)}), ("histogram", (), {"bins": [1.0, 0.0]}), ("reduce", (), {"reduction": "p101"}), ("assert_shape", (), {"dims": [3, 5, 1]}),
    ):
        with pytest.raises(ValueError):
            run(name, params.pop("x", x), *nodes, **params)


def test_empty_reductions():
    e = np.zeros(0)
    assert math.isnan(run("reduce_mean", e)) and run("reduce_sum", e) == 0 and run("reduce", e, reduction="count") == 0 and np.isnan(run("reduce", e, reduction="median"))
    m = np.zeros((2, 2), np.uint8)
    assert math.isnan(run("reduce_masked", m, m)) and run("reduce_masked", m, m, reduction="sum") == 0


@pytest.mark.parametrize("name", ["nearest", "bilinear", "catmullrom", "gaussian", "lanczos3", "area"])
def test_resize_keeps_constants_and_types(name):
    for dtype in (np.uint8, np.uint16, np.float32, np.float64, np.int32):
        for shape in ((9, 7), (9, 7, 3), (9, 7, 4)):
            x = np.full(shape, 77, dtype)
            y = run("resize", x, height=4, width=13, filter=name)
            assert y.dtype == x.dtype and y.shape == (4, 13, *shape[2:]) and np.allclose(y, 77, atol=1e-3)


def test_colour_round_trips():
    x = G.random((12, 9, 3))
    for space in ("bgr", "hsv", "ycbcr", "lab"):
        there = run("cvt_color", x, from_space="rgb", to_space=space)
        assert np.abs(run("cvt_color", there.astype(float), from_space=space, to_space="rgb") - x).max() < 2e-5
    u = np.asarray([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)
    assert run("cvt_color", u, from_space="rgb", to_space="hsv").tolist() == [[[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255]]]
    lab = run("cvt_color", u, from_space="rgb", to_space="lab")
    assert lab.dtype == np.float32 and np.abs(lab[0, 3] - [100, 0, 0]).max() < 0.02 and np.abs(lab[0, 0] - [53.24, 80.09, 67.2]).max() < 0.1
    a = np.concatenate((u, np.full((1, 4, 1), 9, np.uint8)), 2)
    assert (run("cvt_color", a, from_space="rgb", to_space="bgr")[:, :, 3] == 9).all()


def test_perceptual_hashes():
    g = np.indices((64, 48)).sum(0)
    x = np.stack((g * 2 % 256, g * 3 % 256, 255 - g), 2).astype(np.uint8)
    for algorithm in ("perceptual", "average", "difference", "blockhash"):
        a, b = run("perceptual_hash", x, algorithm=algorithm), run("perceptual_hash", run("resize", x, height=128, width=96, filter="lanczos3"), algorithm=algorithm)
        assert a.dtype == np.uint8 and len(a) == 8 and int(np.bitwise_count(a ^ b).sum()) <= 6
    small = run("resize", run("grayscale", x, keepdims=False), height=32, width=32, filter="lanczos3").astype(float)
    t = np.arange(32)
    want = np.asarray([[sum(small[i, j] * math.cos(math.pi * u * (2 * i + 1) / 64) * math.cos(math.pi * v * (2 * j + 1) / 64) for i in t for j in t) for v in range(8)] for u in range(8)])
    want[np.abs(want) <= np.abs(want).max() * 1e-9] = 0
    assert (np.unpackbits(run("perceptual_hash", x)).reshape(8, 8) == (want > np.median(want))).all()


def test_distance_transform_by_brute_force():
    m = (G.random((11, 14)) > 0.3).astype(np.uint8)
    off = np.argwhere(m == 0)
    want = np.asarray([[0.0 if not m[i, j] else np.sqrt(((off - [i, j]) ** 2).sum(1)).min() for j in range(14)] for i in range(11)])
    assert np.allclose(run("distance_transform", m), want)
    assert np.isinf(run("distance_transform", np.ones((2, 2), np.uint8))).all()


def test_canny_finds_the_edge_of_a_step():
    x = np.zeros((20, 20), np.uint8)
    x[:, 10:] = 200
    e = run("canny", x)
    assert e.shape == (20, 20, 1) and set(np.unique(e)) == {0, 255} and (e[:, :, 0].astype(bool).sum(1) == 1).all() and e[:, 9:11].any()
    assert not run("canny", np.full((9, 9), 7, np.uint8)).any()


def rect(x, y, w, h):
    return P.Shape([np.asarray([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)])


def test_boolean_results_have_the_areas_of_slabs_and_of_samples():
    for t in range(12):
        a, b = [P.Shape([G.random((5, 2)) * 10])], [P.Shape([G.random((6, 2)) * 10]), P.Shape([G.random((3, 2)) * 10])]
        one, two, both = P.areas(a, b)
        total = lambda s: sum(P.area([v]) for v in s)
        want = {"union": one + two - both, "intersection": both, "difference": one - both, "symmetric_difference": one + two - 2 * both}
        for name, area in want.items():
            out = run(name, a, b)
            assert total(out) == pytest.approx(area, abs=1e-5) and P.areas(out, [])[0] == pytest.approx(area, abs=1e-5)  # disjoint
        if t == 0:
            p = G.random((100_000, 2)) * 10
            assert (P.inside(a, p) & P.inside(b, p)).mean() * 100 == pytest.approx(both, abs=0.6)


def test_holes_count_once_and_rasters_follow_areas():
    s = P.Shape([rect(0, 0, 10, 10).rings[0], rect(2, 2, 3, 3).rings[0], rect(4, 4, 3, 3).rings[0]])
    assert C.area(s) == pytest.approx(83) and run("rasterize", [s], height=12, width=12, fill_value=1).sum() >= 83
    assert run("rasterize", [rect(1, 1, 4, 2)], height=6, width=8, fill_value=0, background=255).sum() == 255 * (48 - 8)
    assert C.overlap(rect(0, 0, 2, 2), rect(5, 5, 0, 0)) == 0.0


def test_contours_of_a_mask_give_the_mask_back():
    for _ in range(10):
        m = (G.random((9, 11)) > 0.5).astype(np.uint8) * 255
        borders = run("extract_contours", m, mode="all", method="none")
        assert sum(P.shoelace(s.rings[0]) for s in borders) == (m > 0).sum()
        outer = run("extract_contours", m)
        filled = run("rasterize", outer, height=9, width=11)[:, :, 0] if outer else np.zeros_like(m)
        assert ((filled > 0) | (m == 0)).all()
    ring = np.zeros((7, 7), np.uint8)
    ring[1:6, 1:6] = 255
    ring[2:5, 2:5] = 0
    ring[3, 3] = 255
    assert len(run("extract_contours", ring)) == 1 and len(run("extract_contours", ring, mode="all")) == 3
    assert len(run("extract_contours", ring, mode="all", min_area=5.0)) == 2
    corner = np.eye(2, dtype=np.uint8)
    assert [C.area(s) for s in run("extract_contours", corner)] == [2.0]


def test_offset_stroke_and_lines():
    grown = {j: sum(C.area(s) for s in run("contour_offset", [rect(0, 0, 10, 10)], distance=1.0, join=j)) for j in ("round", "miter", "bevel")}
    assert grown["miter"] == pytest.approx(144) and grown["bevel"] == pytest.approx(142) and grown["round"] == pytest.approx(140 + math.pi, abs=0.1)
    assert run("contour_offset", [rect(0, 0, 4, 4)], distance=-2.5) == []
    rim = run("contour_stroke", [rect(0, 0, 10, 10)], width=2.0)
    assert len(rim) == 1 and len(rim[0].rings) == 2
    line = P.Shape([np.asarray([[0, 0], [5, 0.01], [10, 0]], float)], False)
    assert len(run("contour_simplify", [line], tolerance=0.1)[0].rings[0]) == 2
    with pytest.raises(ValueError):
        run("contour_area", [line])
    closed = C.close_along_border(P.Shape([np.asarray([[0.5, 3], [4, 4], [3, 0.2]])], False), 10, 10)
    assert C.area(closed) == pytest.approx(P.area([P.Shape([np.asarray([[0.5, 3], [4, 4], [3, 0.2], [3, 0], [0, 0], [0, 3]])])]))


def test_matching_and_suppression_by_brute_force():
    boxes = [{"x": float(a), "y": float(b), "width": 3.0, "height": 3.0} for a, b in G.integers(0, 8, (25, 2))]
    scores = G.integers(0, 5, 25).astype(float).tolist()
    kept = []
    for i in sorted(range(25), key=lambda i: (-scores[i], i)):
        if all(C.box_iou(boxes[i], boxes[j]) <= 0.3 for j in kept):
            kept.append(i)
    assert C.nms(boxes, scores, 0.3) == kept
    for bad in ((boxes, scores[:-1], 0.3), (boxes, scores, 1.5), ([None], [1.0], 0.5), (boxes[:1], [math.nan], 0.5)):
        with pytest.raises(ValueError):
            C.nms(*bad)
    m = [[0.5, 0.5, 0.2], [0.9, 0.1, 0.0], [0.5, 0.0, 0.0]]
    assert C.greedy(m, 3, 0.5) == {"right_idx": [0, None, None], "overlap": [0.5, 0.0, 0.0], "duplicate": [False, True, True]}
    assert C.greedy(m, 3, 0.5, [1, 0, 2])["right_idx"] == [1, 0, None] and C.greedy([], 0, 0.5) == {"right_idx": [], "overlap": [], "duplicate": []}


def test_boundary_distances():
    d = C.boundary_distances([rect(0, 0, 4, 4)], [rect(1, 0, 4, 4)], sample_step=0.5)
    assert d["hd"] == pytest.approx(1.0) and 0 < d["assd"] <= 1 and d["hd95"] <= d["hd"]
    assert C.boundary_distances([rect(0, 0, 4, 4)], [P.Shape([np.zeros((0, 2))])]) is None
    assert C.coverage(rect(0, 0, 4, 4), rect(0, 0, 4, 4), 0.0) == 1.0 and C.hausdorff(rect(0, 0, 4, 4), rect(3, 0, 4, 4)) == 3.0


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_codecs_round_trip(channels):
    for dtype in (np.uint8, np.uint16):
        x = G.integers(0, np.iinfo(dtype).max + 1, (7, 9, channels)).astype(dtype)
        for encode in (codecs.encode_png, codecs.encode_tiff):
            b = encode(x)
            assert (codecs.decode(b) == x).all()
            i = codecs.info(b)
            assert (i["height"], i["width"], i["channels"], i["dtype"]) == (7, 9, channels, "u8" if dtype == np.uint8 else "u16")
        assert (blobs.from_blob(blobs.to_blob(x)) == x).all() and (blobs.from_tensor(blobs.to_tensor(x)) == x).all()
    t = blobs.to_tensor(np.arange(6, dtype=np.float32).reshape(2, 3), half=True)
    assert t["dtype"] == "float16" and blobs.from_tensor(t).dtype == np.float32
    with pytest.raises(ValueError):
        blobs.from_tensor({**blobs.to_tensor(np.arange(4)), "strides": [64]})


def test_other_formats():
    x = G.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (codecs.decode(b"P6\n# note\n5 3\n255\n" + x.tobytes()) == x).all()
    assert codecs.decode(b"P2 2 1 15 0 15").tolist() == [[[0], [255]]] and codecs.decode(b"P1\n2 1\n1 0").tolist() == [[[0], [255]]]
    rows = np.zeros((3, 16), np.uint8)
    rows[:, :15] = x[::-1, :, ::-1].reshape(3, 15)
    import struct

    bmp = b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()
    assert (codecs.decode(bmp) == x).all() and codecs.info(bmp)["width"] == 5
    far = b"farbfeld" + struct.pack(">II", 1, 1) + struct.pack(">4H", 1, 2, 3, 4)
    assert codecs.decode(far).tolist() == [[[1, 2, 3, 4]]]
    qoi = b"qoif" + struct.pack(">IIBB", 3, 1, 3, 0) + bytes([254, 10, 20, 30, 0xC1]) + b"\0" * 7 + b"\1"
    assert codecs.decode(qoi).tolist() == [[[10, 20, 30]] * 3]
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0x80, 0, 0) + bytes([0, 0, 0, 255, 9, 8]) + b"," + struct.pack("<HHHHB", 0, 0, 3, 1, 0) + b"\x02\x03\x0c\x12\x05\x00;"
    assert codecs.decode(gif).shape == (1, 3, 4) and codecs.info(gif)["width"] == 3
    hdr = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + bytes([128, 64, 0, 129, 0, 0, 0, 0])
    assert codecs.decode(hdr).tolist() == [[[1.0, 0.5, 0.0], [0.0, 0.0, 0.0]]] and codecs.info(hdr)["dtype"] == "f32"
    png = codecs.encode_png(x)
    ico = b"\0\0\1\0\1\0" + struct.pack("<BBBBHHII", 5, 3, 0, 0, 1, 32, len(png), 22) + png
    assert (codecs.decode(ico) == x).all() and codecs.info(ico)["height"] == 3
    px = G.integers(0, 256, (2, 2, 4)).astype(np.uint8)
    dib = struct.pack("<IiiHHIIiiII", 40, 2, 4, 1, 32, 0, 0, 0, 0, 0, 0) + px[::-1, :, [2, 1, 0, 3]].tobytes() + b"\0" * 8
    assert (codecs.decode(b"\0\0\1\0\1\0" + struct.pack("<BBBBHHII", 2, 2, 0, 0, 1, 32, len(dib), 22) + dib) == px).all()
    for bad in (b"", b"no image", codecs.encode_png(x)[:40], b"P6 9 9 255 "):
        with pytest.raises(ValueError):
            codecs.decode(bad)


def test_gif_codes():
    """Against an encoder that never lets its table grow: a clear code before every index."""
    x = G.integers(0, 4, (5, 6)).astype(np.uint8)
    bits, n = 0, 0
    for v in x.ravel().tolist():
        for code in (4, v):
            bits |= code << n
            n += 3
    bits, n = bits | 5 << n, n + 3
    data = bits.to_bytes((n + 7) // 8, "little")
    import struct

    table = G.integers(0, 256, (4, 3)).astype(np.uint8)
    gif = b"GIF89a" + struct.pack("<HHBBB", 6, 5, 0x81, 0, 0) + table.tobytes() + b"," + struct.pack("<HHHHB", 0, 0, 6, 5, 0) + bytes([2, len(data)]) + data + b"\0;"
    assert (codecs.decode(gif)[:, :, :3] == table[x]).all()


def test_jpeg_is_near_and_small():
    g = np.indices((45, 67)).sum(0)
    x = np.stack((128 + 60 * np.sin(g / 9), 90 + g, 200 - g), 2).astype(np.uint8)
    for channels, quality, most in ((3, 85, 3), (3, 30, 8), (1, 90, 3)):
        b = codecs.ENCODERS["jpeg"](x[:, :, :channels], quality)
        y = codecs.decode(b)
        assert y.shape == (45, 67, channels) and np.abs(y.astype(int) - x[:, :, :channels]).mean() < most and len(b) < x.nbytes / 2
        assert codecs.info(b)["height"] == 45


def test_orientation_tags():
    x = np.arange(6).reshape(2, 3, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.transpose(1, 0, 2), 6: np.rot90(x, -1), 7: np.rot90(x, 2).transpose(1, 0, 2), 8: np.rot90(x)}
    for tag, y in want.items():
        assert (codecs.oriented(x, tag) == y).all(), tag
