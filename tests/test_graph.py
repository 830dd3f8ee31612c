"""Pipelines over columns: sources, sinks, policies, plans, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as GE
from rasterloom.functions import layout as L
from rasterloom.functions import pixel as PX
from rasterloom.functions.shapes import bbox, contour, contour_from_coords, contour_from_points, point, region_stats, tagged, validate_contour
from rasterloom.operators import OPERATORS
from rasterloom.plans.graph import OptFlags, Pipeline, cv, this
from rasterloom.sources import blobs, codecs
from rasterloom.sources.files import image_files, read_bytes
from rasterloom.streaming import collect_batches, stream_files, windowed

G = np.random.default_rng(9)
IMAGES = [G.integers(0, 256, (6, 8, 3)).astype(np.uint8), G.integers(0, 256, (5, 4, 3)).astype(np.uint8)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, codecs.encode_png(IMAGES[0]), 2), (1, None, 2), (2, b"no image", 2), (3, codecs.encode_png(IMAGES[1]), None)]
    return spark.createDataFrame(data, "id int, png binary, h int")


def values(df, c):
    return {r.id: r.v for r in df.select("id", c.alias("v")).collect()}


def test_chain_and_nested_list(rows):
    p = Pipeline().source("image_bytes", dtype="u8", on_error="null").resize(height=4, width=3, filter="nearest").grayscale()
    got = values(rows, cv("png").pipe(p).sink("list"))
    assert got[1] is None and got[2] is None
    for i, x in ((0, IMAGES[0]), (3, IMAGES[1])):
        y = OPERATORS["grayscale"].run(OPERATORS["resize"].run(x, 4, 3, "nearest"), True)
        assert np.asarray(got[i]).tolist() == y.tolist()


def test_error_policies(rows):
    p = Pipeline().source("image_bytes").reduce_max()
    with pytest.raises(Exception, match="no image"):
        values(rows, cv("png").pipe(p).sink("native"))
    assert values(rows, cv("png").pipe(p.on_error("null")).sink("native"))[2] is None
    noted = values(rows, cv("png").pipe(p.on_error("null_with_message")).sink("native"))
    assert "no image" in noted[2]["_error"] and noted[0]["_error"] is None and noted[0]["value"] == IMAGES[0].max()


def test_row_parameters_and_their_nulls(rows):
    p = Pipeline().source("image_bytes", on_error="null").crop(height=F.col("h")).extract_shape()
    with pytest.raises(Exception, match="parameter height is null"):
        values(rows, cv("png").pipe(p).sink("native"))
    got = values(rows, cv("png").pipe(p.on_null_param("null")).sink("native"))
    assert got[0] == [2.0, 8.0, 3.0] and got[3] is None
    with pytest.raises(TypeError):
        Pipeline().reduce_max(axis=F.col("h"))


def test_several_outputs_of_one_pass(rows):
    a = cv("png").pipe(Pipeline().source("image_bytes", on_error="null"))
    g = a.grayscale()
    out = g.alias("g").merge_pipe(a.reduce_mean().alias("m"), g.perceptual_hash().alias("h"), a.reduce_max().alias("t"))
    got = values(rows, out.sink({"m": "native", "h": "native", "g": "blob", "t": "native"}))
    assert got[0].m == pytest.approx(IMAGES[0].mean()) and len(got[0].h) == 8 and got[1].m is None
    assert (blobs.from_blob(bytes(got[0].g)) == OPERATORS["grayscale"].run(IMAGES[0], True)).all()
    with pytest.raises(ValueError):
        out.sink({"other": "native"})


def test_plans(rows):
    p = Pipeline().source("raw", dtype="u16").scale(factor=2.0)
    assert p.output_dtype() == "f32" and p.current_domain() == "buffer" and p.has_source() and p.validate() is p
    e = cv("png").pipe(Pipeline().source("image_bytes").grayscale().resize(height=this.height // 2, width=4)).explain()
    assert e.splitlines()[0].startswith("resize") and "this.height" in e and "source" in e
    assert "->" in cv("png").pipe(p).show_graph()
    with pytest.raises(ValueError):
        cv("png").pipe(Pipeline().source("image_bytes")).sink("list")  # the element type is not known
    with pytest.raises(ValueError):
        cv("png").pipe(Pipeline().source("image_bytes").perimeter())
    a = cv("png").pipe(Pipeline().source("image_bytes", on_error="null"))
    twice = a.grayscale().add(a.grayscale()).reduce_max()
    assert values(rows, twice.sink("native")) == values(rows, twice.sink("native", OptFlags(cse=False)))


def test_sources_by_column_type(spark):
    tensor = blobs.to_tensor(np.arange(6, dtype=np.int32).reshape(2, 3))
    kind = "struct<data:binary,dtype:string,shape:array<bigint>,strides:array<bigint>,offset:bigint>"
    df = spark.createDataFrame([(0, tensor, [[1, 2], [3, 4]], blobs.to_blob(np.ones(3, np.float32)), [[1], [2, 3]])], f"id int, t {kind}, n array<array<int>>, b binary, jag array<array<int>>")
    plain = Pipeline()
    for c, total in (("t", 15.0), ("n", 10.0), ("b", 3.0)):
        assert values(df, cv(c).pipe(plain.reduce_sum()).sink("native"))[0] == total
    assert values(df, cv("jag").pipe(plain.reduce_sum().on_error("null")).sink("native"))[0] is None
    back = values(df, cv("t").pipe(plain.transpose(axes=[1, 0])).sink("tensor"))[0]
    assert blobs.from_tensor(back.asDict(recursive=True)).tolist() == [[0, 3], [1, 4], [2, 5]]
    assert values(df, cv("n").pipe(Pipeline().source("list", dtype="u64", ndim=2)).sink("list"))[0] == [[1, 2], [3, 4]]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, x in enumerate(IMAGES):
        (tmp_path / "in" / f"{i}.png").write_bytes(codecs.encode_png(x))
    root = str(tmp_path / "in")
    df = spark.createDataFrame([(0, f"{root}/0.png"), (1, f"{root}/1.png"), (2, f"{root}/gone.png"), (3, None), (4, f"{root}/../secret.png")], "id int, path string")
    got = {r.id: r.w for r in read_bytes(df, "path", root).select("id", cv("bytes").width().alias("w")).collect()}
    assert got == {0: 8, 1: 4, 2: None, 3: None, 4: None}
    p = Pipeline().source("file_path", allowed_roots=[root], on_error="null").reduce_max()
    one = values(df.where("id in (0, 1, 4)"), cv("path").pipe(p).sink("native"))
    assert one[0] == IMAGES[0].max() and one[4] is None
    assert image_files(spark, root).count() == 2
    seen = stream_files(spark, root, "*.png").select(cv("content").height().alias("h"))
    q = seen.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.h for r in spark.table("seen").collect()) == [5, 6]


def test_stream_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = windowed(s, "ts", F.col("value"), every="1 day", late="3650 days", by=("event_type",)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    key = lambda rows: sorted((str(r[0]), r[1], r[2], r[3]) for r in rows)
    assert key(spark.table("days").select("start", "event_type", "n", "top").collect()) == key(want.select("window.start", "event_type", "n", "top").collect())


def test_batches(spark):
    tables = list(collect_batches(spark.range(25).repartition(3), 10))
    assert [t.num_rows for t in tables] == [10, 10, 5] and sorted(v for t in tables for v in t["id"].to_pylist()) == list(range(25))


def test_accessor_policies_and_sets(spark):
    square = contour_from_points([(0, 0), (4, 0), (4, 4), (0, 4)])
    line = contour_from_points([(0, 0), (4, 0)], is_closed=False)
    assert validate_contour(square) and not validate_contour({"exterior": [{"x": 1}]})
    kind = "struct<exterior:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>,is_closed:boolean>"
    df = spark.createDataFrame([(0, square, [square, square]), (1, None, None), (2, line, [line])], f"id int, c {kind}, s array<{kind}>")
    assert values(df, contour("c").on_error("null").area()) == {0: 16.0, 1: None, 2: None}
    with pytest.raises(Exception, match="no region"):
        values(df, contour("c").area())
    assert values(df.where("id < 2"), contour("s", many=True).area()) == {0: [16.0, 16.0], 1: None}
    assert values(df.where("id < 2"), contour("s", many=True).iou("c")) == {0: [1.0, 1.0], 1: None}
    assert values(df.where("id = 2"), contour("s", many=True).single(F.lit("x")))[2] is not None
    with pytest.raises(Exception, match="not one contour"):
        values(df.where("id = 0"), contour("s", many=True).single(F.lit("x")))
    match = values(df.where("id = 0"), contour("s", many=True).correspond(F.col("s")))[0]
    assert match.right_idx == [0, 1] and match.duplicate == [False, False]
    cover = values(df.where("id = 0"), contour("s", many=True).correspond_by_coverage(F.col("s"), 0.1))[0]
    assert cover.overlap == [1.0, 1.0]
    img = cv(F.array(*[F.array(*[F.lit(float(4 * i + j)) for j in range(4)]) for i in range(4)])).pipe(Pipeline().source("list", dtype="f64", ndim=2)).sink("blob")
    got = values(df.where("id = 0"), region_stats(F.col("s"), {"top": (img, "max"), "mean": (img, "mean")}))[0]
    assert got.top == [15.0, 15.0] and got.mean == [7.5, 7.5]
    assert tagged(F.col("c"), "c", "contour") is not None
    frame = F.struct(*[F.lit(v).alias(k) for k, v in (("x", -1.0), ("y", -1.0), ("width", 9.0), ("height", 9.0))])
    assert values(df.where("id = 0"), contour("c").boundary_distances(F.col("c"), 1.0, frame))[0].hd == 0
    assert values(df.where("id = 0"), contour("s", many=True).set_boundary_distances(F.col("s")))[0].assd == 0


def test_refused_boxes_and_points(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "id int, v double")
    box = GE.bbox(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    with pytest.raises(Exception, match="shrinks"):
        values(df, bbox(box).pad(-3.0).getField("width"))
    assert values(df, bbox(box).pad(F.col("v"))["width"]) == {0: 4.0, 1: None}
    with pytest.raises(Exception, match="size of 0"):
        values(df, point(GE.point(F.col("v"), F.col("v"))).normalize(0.0, 1.0).getField("x"))


def test_native_arrays_with_null_nan_and_no_elements(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [3.0, nan, 1.0, 2.0]), (1, None), (2, []), (3, [5.0, 5.0, 5.0, 5.0])], "id int, x array<double>")
    x = F.col("x")
    assert str(values(df, PX.reduce_min(x))) == "{0: nan, 1: None, 2: None, 3: 5.0}"
    assert values(df, PX.argmin(x)) == {0: 1, 1: None, 2: None, 3: 0} and values(df, PX.argmax(x))[0] == 1
    low = values(df, PX.minimum(x, F.reverse("x")))
    assert str(low[0]) == "[2.0, nan, nan, 2.0]" and low[1] is None and low[2] == []
    assert values(df, PX.normalize_minmax(x))[3] == [0.0] * 4 and values(df, PX.normalize_zscore(x))[3] == [0.0] * 4
    for out in (L.pad(x, 2, 2, 1, 1, 1, 1), L.pad(x, 2, 2, 1, 1, 1, 1, mode="reflect"), L.erode(x, 2, 2), L.block_mean(x, 2, 2, 2, 2), L.flip_h(x, 2, 2), L.rotate90(x, 2, 2, 3)):
        got = values(df.where("id in (1, 3)"), out)
        assert got[1] is None and set(got[3]) <= {0.0, 5.0}
    empty = df.where("id = 2")
    assert values(empty, L.erode(x, 0, 0))[2] == [] and values(empty, L.median_filter(x, 0, 0))[2] == []
    a, b = F.array(F.lit(1), F.lit(255)), F.array(F.lit(3), F.lit(0))
    assert values(df, PX.hamming_distance(a, b))[0] == 9 and values(df, PX.hash_similarity(a, b))[0] == pytest.approx(100 * (1 - 9 / 16))
    with pytest.raises(Exception, match="differ in length"):
        values(df, PX.hamming_distance(a, F.array(F.lit(1))))
    with pytest.raises(Exception, match="differ in shape"):
        values(df.where("id = 0"), PX.add(x, F.array(F.lit(1.0))))


def test_statistics_are_linear_in_the_array(spark):
    big = spark.range(1).select(F.lit(0).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(50_176)), lambda v: v.cast("double")).alias("x"))
    import time

    values(big, F.size(PX.scale(F.col("x"), 2.0)))
    for f in (PX.normalize_minmax, PX.normalize_zscore, lambda x: PX.adjust_contrast(x, 2.0), PX.bits, lambda x: L.median_filter(PX.scale(x, 2.0), 224, 224)):
        t = time.time()
        values(big, F.size(f(F.col("x"))))
        assert time.time() - t < 10


def test_own_operators_sinks_and_helpers(spark, rows, tmp_path):
    import rasterloom as RL
    from rasterloom.sources.blobs import numpy_from_column
    from rasterloom.sources.cloud import CloudCredentialError, CloudOptions, check_cloud_access
    from rasterloom.sources.display import show_images

    RL.operator("own_halved", {"by": 2})(lambda x, by: x // by)
    RL.use_operator("own_halved")
    a = cv("png").pipe(Pipeline().source("image_bytes", dtype="u8", on_error="null"))
    df = rows.where("id < 2").select("id", a.own_halved(by=4).sink(RL.Sink.tensor()).alias("t"))
    got = numpy_from_column(df, "t")
    assert (got[0] == IMAGES[0] // 4).all() and got[1] is None
    assert values(rows, a.reduce_max().alias("m").sink({"m": RL.Sink.native()}))[0].m == IMAGES[0].max()
    assert show_images(rows.where("id < 2"), "png", label="id").count("<figure>") == 2
    assert RL.build_info()["operators"] >= 115 and RL.dtype_name_for("float32") == "f32" and RL.set_row_parallelism(False) is None
    assert "fs.s3a.access.key" in CloudOptions(s3_access_key="k", anonymous=True).hadoop()
    assert check_cloud_access(spark, str(tmp_path), CloudOptions(extra={"fs.own": "1"})) == 0
    with pytest.raises(CloudCredentialError):
        check_cloud_access(spark, str(tmp_path / "gone"))
    with pytest.raises(CloudCredentialError):
        CloudOptions(token_command=["/no/such/command"]).hadoop()


def test_spellings_and_vocabularies(spark, rows):
    from rasterloom import options

    assert len(options.VOCABULARIES) == 28
    a = cv("png").pipe(Pipeline().source("image_bytes", dtype="u8", on_error="null"))
    ok = rows.where("id = 0")
    small = a.resize_scale(0.5, filter=options.FilterType.NEAREST)
    assert values(ok, small.extract_shape().sink("native"))[0] == [3.0, 4.0, 3.0]
    assert values(ok, a.resize(height=4, width=4, filter="nearest").reshape(shape=[this.height * this.width, this.channels]).extract_shape().sink("native"))[0] == [16.0, 3.0]
    assert values(ok, a.clamp(10, 20).reduce_max().sink("native"))[0] == 20.0 and values(ok, a.assert_shape(height=6, width=8, channels=3).reduce_max().sink("native"))[0] is not None
    kept = Pipeline().source("image_bytes", dtype="u8", on_error="null").scale(0.5).adjust_brightness(factor=2.0, preserve_dtype=True)
    assert kept.output_dtype() == "f32" and Pipeline().source("raw", dtype="u8").adjust_brightness(factor=2.0, preserve_dtype=True).output_dtype() == "u8"
    with pytest.raises(TypeError):
        a.resize_scale()
    with pytest.raises(TypeError):
        a.no_such(1) if hasattr(a, "no_such") else a.resize(height=1)
    ring = contour_from_coords(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))]))
    assert values(ok, a.apply_contour_mask(ring).crop(top=3).reduce_max().sink("native"))[0] == 0
    every = {n for n, op in OPERATORS.items() if not n.startswith("own_")}
    assert all(hasattr(Pipeline, n) for n in every) and len(every) >= 115
