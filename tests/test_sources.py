"""Files, annotations, result tables and streams."""

from __future__ import annotations

import gzip
import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import metrics
from tessella.sources import images, tables
from tessella.streaming import results


def test_images_of_every_kind(spark, tmp_path):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4) * 300
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", masks=a)
    (tmp_path / "c.png").write_bytes(images.write_png(a))
    (tmp_path / "d.pgm").write_bytes(b"P5\n# note\n4 3\n65535\n" + a.astype(">u2").tobytes())
    body = zlib.compress(a.astype("<u2").tobytes())
    tags = [(256, 4), (257, 3), (258, 16), (259, 8), (273, 8), (277, 1), (278, 3), (279, len(body))]
    (tmp_path / "e.tif").write_bytes(b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0")
    rows = images.read_label_maps(spark, str(tmp_path)).toPandas()
    assert rows["path"].nunique() == 5
    for _, part in rows.groupby("path"):
        assert part.sort_values(["y", "x"])["label"].tolist() == a.ravel().tolist()


def test_volumes_matrices_and_archives(spark, tmp_path):
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)  # planes, rows, columns
    head = b"NRRD0004\n# note\ntype: short\ndimension: 3\nsizes: 3 4 2\nendian: little\nencoding: gzip\n\n"
    (tmp_path / "a.nrrd").write_bytes(head + gzip.compress(np.moveaxis(a, 0, 2).tobytes(order="F")))
    rows = images.read_volumes(spark, str(tmp_path), glob="*.nrrd").toPandas().sort_values(["z", "y", "x"])
    assert rows["v"].tolist() == a.ravel().tolist()

    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(name, m):
        return element(14, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name) + element(9, m.astype("<f8").tobytes(order="F")))

    m = np.arange(6).reshape(2, 3)
    packed = zlib.compress(matrix(b"inst_map", m))
    data = b" " * 124 + b"\x00\x01IM" + matrix(b"abc", m + 1) + struct.pack("<II", 15, len(packed)) + packed
    assert (images.decode("x.mat", data, "inst_map") == m).all() and (images.decode("x.mat", data, "abc") == m + 1).all()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("case/1.mat", data)
        z.writestr("case/2.png", images.write_png(m))
    got = {r["member"]: images.decode(r["member"], bytes(r["content"]), "inst_map") for r in images.archive_members(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["case/1.mat", "case/2.png"] and all((x == m).all() for x in got.values())


def test_png_filters():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (6, 5, 3)).astype(np.int64)
    lines, before = b"", np.zeros(15, np.int64)
    for y, row in enumerate(a.reshape(6, 15)):
        left, corner = np.concatenate([np.zeros(3, np.int64), row[:-3]]), np.concatenate([np.zeros(3, np.int64), before[:-3]])
        paeth = np.array([min((l, u, c), key=lambda v, l=l, u=u, c=c: abs(l + u - c - v)) for l, u, c in zip(left, before, corner, strict=True)])
        guess = [0, left, before, (left + before) // 2, paeth][y % 5]
        lines += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode("x.png", data) == a).all()


def test_listing_and_pairing(spark, tmp_path):
    for name in ("img10.png", "img2.png", "img2_masks.png", "img10_masks.tif", "img3.png", "note.txt", "img2_flows.tif"):
        (tmp_path / name).write_bytes(b"x")
    files = images.image_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.orderBy("key").collect()] == ["img2.png", "img3.png", "img10.png"]
    labels = spark.read.format("binaryFile").option("pathGlobFilter", "*_masks.*").load(str(tmp_path)).select("path")
    assert {r["label_path"].rsplit("/", 1)[1] for r in images.pair_by_stem(files, labels).collect()} == {"img2_masks.png", "img10_masks.tif"}


def test_scores_resume(spark, tmp_path):
    head = tables.SCORE_SCHEMA.replace(" string", "").replace(" ", "")
    (tmp_path / "s.csv").write_text(head + "\noral,1,a,m,0.5,0.5,0.5,0.5,0.5,0.5,0.5\noral,2,a,m,0.5,,0.5,0.5,nan,0.5,0.5\npannuke,3,a,m,0.5,,,,0.5,0.5,0.5\n")
    rows = tables.read_scores(spark, str(tmp_path / "s.csv"))
    assert {r["sample_id"] for r in tables.complete(rows).collect()} == {"1", "3"}
    tables.write_scores(rows, str(tmp_path / "out"))
    tables.write_scores(rows, str(tmp_path / "out"), append=True)
    assert tables.read_scores(spark, str(tmp_path / "out")).count() == 6


def test_coco_and_outlines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.tif"}], "annotations": [{"id": 5, "image_id": 1, "segmentation": [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]]}]}))
    assert [(r["file_name"], r["annotation_id"], r["ring"]) for r in tables.read_coco(spark, str(tmp_path / "a.json")).orderBy("ring").collect()] == [("a.tif", 5, 0), ("a.tif", 5, 1)]
    rows = spark.createDataFrame([(1, 7, 0, 2), (1, 7, 0, 1), (1, 7, 1, 1)], "img int, label int, y int, x int")
    assert [tuple(r) for r in tables.outlines(rows).select("name", "points").collect()] == [("0007", "1,0,2,0,1,1")]


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(text.slug(F.lit(" (x) ")), text.slug(F.lit("Tumor Cells (old) 2")), text.latex_escape(F.lit("50% \\ {a}_b")), text.mean_cell(F.lit(None).cast("double")), text.is_image(F.lit("d/_masks.png"))).first()
    assert tuple(got) == ("layer", "tumor_cells2", r"50\% \textbackslash{} \{a\}\_b", "—", False)


def test_stream_keeps_latest(spark, tmp_path):
    schema = "k string, n int, v int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        results.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["n"]).awaitTermination(60)
        if k == 0:
            spark.createDataFrame([("a", 2, 9), ("b", 0, 7)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch=1").select("k", "n", "v").collect()}
    assert got == {("a", 2, 9), ("b", 1, 2)}
    spark.createDataFrame([("c", 5, 5), ("a", 1, 0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    results.keep_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["n"]).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/batch=2").count() == 2  # only what the batch touched is written
    assert {tuple(r) for r in results.current(spark, f"{tmp_path}/out", ["k"]).select("k", "n", "v").collect()} == {("a", 2, 9), ("b", 1, 2), ("c", 5, 5)}


def pair(spark, rows):
    return spark.createDataFrame(rows, "img int, gt int, pr int, n long")


def test_metrics_at_the_edges(spark):
    empty, only_gt, only_pr = [(1, 0, 0, 9)], [(2, 1, 0, 4), (2, 0, 0, 5)], [(3, 0, 1, 4), (3, 0, 0, 5)]
    half = [(4, 1, 1, 2), (4, 1, 2, 2)]  # one label split into two predictions of exactly a half
    three_quarters = [(5, 1, 1, 3), (5, 1, 0, 1)]
    t = pair(spark, empty + only_gt + only_pr + half + three_quarters)
    got = {r["img"]: r for r in metrics.evaluate(t).collect()}
    assert [got[i]["dice"] for i in (1, 2, 3)] == [1.0, 0.0, 0.0]
    assert [got[i]["aji"] for i in (1, 2, 3)] == [1.0, 0.0, 0.0]
    assert [got[i]["map"] for i in (1, 2, 3)] == [0.0, 0.0, 0.0]  # even where both are empty
    assert [got[i]["pq"] for i in (1, 2, 3, 4)] == [1.0, 0.0, 0.0, 0.0]  # strictly above a half
    assert got[4]["f1_050"] == 2 / 3  # at a half, one of two
    assert got[5]["f1_075"] == 1.0 and abs(got[5]["map"] - 0.5) < 1e-9  # 0.75 misses the sixth step


def test_equal_maps_are_perfect_whatever_the_names(spark):
    rows = [(1, a, b, n) for a, b, n in ((0, 0, 5), (1, 9, 3), (2, 4, 6))]
    r = metrics.evaluate(pair(spark, rows)).first()
    assert (r["dice"], r["pq"], r["aji"], r["map"], r["f1_075"]) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_methods_skip_what_is_done_and_report_errors(spark):
    from tessella.operators import methods

    images_ = spark.createDataFrame([(i, 2, 3, [0.0, 0.0, 9.0, 0.0, 0.0, 9.0]) for i in range(3)], "sample_id int, height int, width int, data array<double>")
    methods.add_method("fails", lambda a: 1 / 0)
    done = spark.createDataFrame([(0, "watershed")], "sample_id int, method string")
    made = methods.run(images_, ["watershed", "fails"], done).collect()
    assert sorted((r["sample_id"], r["method"], r["error"] is None) for r in made) == [(0, "fails", False), (1, "fails", False), (1, "watershed", True), (2, "fails", False), (2, "watershed", True)]
    spread = methods.pixels(methods.run(images_, ["watershed"])).where("label > 0").collect()
    assert {(r["y"], r["x"]) for r in spread} == {(0, 2), (1, 2)}


def test_frames_maps_and_packs(spark, tmp_path):
    a = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    (tmp_path / "m.dax").write_bytes(a.astype("<u2").tobytes())
    (tmp_path / "m.inf").write_text("frame dimensions = 3 x 4\nnumber of frames = 2\ndata type = 16 bit integers (binary, little endian)\n")
    rows = images.read_frames(spark, str(tmp_path)).orderBy("z", "y", "x").collect()
    assert [r["v"] for r in rows] == list(range(24))
    labels = spark.createDataFrame([("i", y, x, int(v)) for (y, x), v in np.ndenumerate(a[0])], "img string, y int, x int, label long")
    made = images.encode_label_maps(labels).first()
    assert made["n_labels"] == 11 and made["kind"] == "png" and (images.decode("x.png", bytes(made["content"])) == a[0]).all()
    many = images.encode_label_maps(labels.withColumn("label", F.col("label") + 70_000)).first()
    assert many["kind"] == "tif" and (images.decode("x.tif", bytes(many["content"])) == a[0].astype(int) + 70_000).all()
    cells = spark.createDataFrame([("h", "r", 2, 0.5), ("h", "r", 1, 0.25)], "category string, roi string, gt_id int, br double")
    pack = tables.cell_pack(cells).first()
    assert pack["n"] == 2 and [c["gt_id"] for c in json.loads(pack["manifest"])] == [1, 2]
    lines = tables.latex_rows(spark.createDataFrame([("a_b", 0.5, None)], "m string, x double, y double"), "m", ["x", "y"]).first()["line"]
    assert lines == r"a\_b & 0.5000 & — \\"
    assert json.loads(tables.progress_line(1, 4, 2.0, "s", "now")) == {"sample": "s", "current": 1, "total": 4, "pct": 25.0, "eta_s": 6.0, "at": "now"}


def test_matching_at_any_threshold(spark):
    from itertools import permutations

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for img in range(40):
        n = rng.integers(0, 12, (4, 4))
        rows += [(img, g + 1, p + 1, int(n[g, p])) for g in range(4) for p in range(4) if n[g, p]] + [(img, 0, 0, 5)]
        iou = n / np.maximum(n.sum(1)[:, None] + n.sum(0)[None, :] - n, 1)
        for t in (0.1, 0.15, 0.3, 0.5, 0.9):
            want[img, t] = max(sum(iou[i, q[i]] >= t for i in range(4)) for q in permutations(range(4)))
    t = pair(spark, rows)
    got = {(r["img"], r["t"]): r["tp"] for r in metrics.detection(t, (0.1, 0.15, 0.3, 0.5, 0.9)).collect()}
    assert got == want
    only_low = {(r["img"], r["t"]): r["tp"] for r in metrics.detection(t, (0.1, 0.3)).collect()}
    assert only_low == {k_: v for k_, v in want.items() if k_[1] in (0.1, 0.3)}


def test_logs_are_told_apart(spark):
    lines = [("a.log", 1, "label 3: no fg seeds, kept Base mask"), ("b.log", 1, "label 3: area=7 < min_cell_area, kept Base mask"), ("b.log", 2, "label 4: bbox=(1,2,3,4) placed_pixels=9"), ("b.log", 3, "label 4: no fg seeds, kept Base mask"), ("b.log", 4, "done")]
    frame = spark.createDataFrame(lines, "file string, n int, line string")
    got = {(r["file"], r["label"], r["status"], r["placed"]) for r in text.parse_log(frame, keys=["file"]).collect()}
    assert got == {("a.log", 3, "no_fg_seeds_fallback", None), ("b.log", 3, "min_cell_area_fallback", 7), ("b.log", 4, "no_fg_seeds_fallback", None)}


def test_numbers_and_shards_without_one_window(spark):
    from tessella.operators import compare

    values = [((i * 7919) % 1000, i) for i in range(3000)]
    frame = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = [(r["v"], r["i"]) for r in compare.numbered(frame, ["v", "i"]).orderBy("at").collect()]
    assert got == sorted(values) and compare.numbered(frame, ["v", "i"]).agg(F.max("at"), F.count_distinct("at")).first()[:] == (2999, 3000)
    assert [r["i"] for r in compare.shard(frame, "i", 10, 3, 4).orderBy("at").collect()] == [3, 13, 23, 33]
    assert "Window [" not in compare.shard(frame, "i", 10, 3)._jdf.queryExecution().executedPlan().toString() or compare.numbered(frame.limit(0), ["v"]).count() == 0


def test_cells_meet_pixels_of_their_tiles(spark):
    from tessella.operators import boundary, labels

    rng = np.random.default_rng(2)
    rows = [(i, y, x, int(rng.integers(0, 9)), int(rng.integers(0, 9))) for i in range(2) for y in range(14) for x in range(11)]
    frame = spark.createDataFrame(rows, "img int, y int, x int, gt int, pr int")
    table = labels.contingency(frame)
    few, many = (sorted(map(tuple, boundary.cells(frame, table, 1, 14, 11, tile=t).collect())) for t in (3, 100))
    assert few == many and len(few) > 1000


def test_block_store_and_block_runs(spark, tmp_path):
    from tessella.operators import blocks, kernels
    from tessella.sources import blocks as store

    rng = np.random.default_rng(3)
    a = (rng.random((2, 30, 22)) < 0.5).astype(np.int64)
    rows = spark.createDataFrame([(i, y, x, int(v)) for (i, y, x), v in np.ndenumerate(a)], "img int, y int, x int, v long")
    store.write_blocks(rows, str(tmp_path / "s"), 8)
    assert sorted(map(tuple, store.read_blocks(spark, str(tmp_path / "s")).select("img", "y", "x", "v").collect())) == sorted(map(tuple, rows.collect()))
    part = store.read_blocks(spark, str(tmp_path / "s"), rows=(9, 17))
    assert {r["y"] for r in part.select("y").distinct().collect()} == set(range(9, 17)) and "PartitionFilters: [isnotnull(by" in part._jdf.queryExecution().toString()
    joined, boxes = blocks.join_blocks(blocks.run_blocks(rows, lambda b: kernels.components(b > 0, kernels.FOUR), "v", 8, 2, 30, 22), 8, 4)
    for i in range(2):
        want = kernels.components(a[i] > 0, kernels.FOUR)
        got = np.zeros(want.shape, np.int64)
        for r in joined.where(F.col("img") == i).collect():
            got[r["y"], r["x"]] = r["label"]
        assert len(set(zip(got.ravel(), want.ravel(), strict=True))) == len(np.unique(want)) == len(np.unique(got))
    assert boxes.count() == joined.where("label > 0").select("label").distinct().count()
    doubled = blocks.run_blocks(rows, lambda b: b, "v", 8, 0, 30, 22, steps=[lambda b: b * 2])
    assert doubled.agg(F.sum("label")).first()[0] == 2 * a.sum()
    named = store.blocks_of_files(spark.createDataFrame([("v_Z1Y22X3.tif",), ("other.tif",)], "path string"))
    assert [tuple(r)[1:] for r in named.collect()] == [(1, 22, 3)]


def test_data_sets_in_their_layouts(spark, tmp_path):
    from tessella.sources import datasets

    for case, parts in (("c1", 2), ("c2", 1)):
        (tmp_path / "dsb" / case / "masks").mkdir(parents=True)
        for k in range(parts):
            m = np.zeros((4, 5), np.int64)
            m[k, k : k + 2] = 255
            (tmp_path / "dsb" / case / "masks" / f"{'ba'[k]}.png").write_bytes(images.write_png(m))
    got = {(r["case_id"], r["instance"], r["y"], r["x"]) for r in datasets.instance_masks(spark, str(tmp_path / "dsb")).collect()}
    assert got == {("c1", 2, 0, 0), ("c1", 2, 0, 1), ("c1", 1, 1, 1), ("c1", 1, 1, 2), ("c2", 1, 0, 0), ("c2", 1, 0, 1)}

    (tmp_path / "folds").mkdir()
    fold = np.arange(24, dtype=np.float64).reshape(2, 2, 3, 2)
    np.save(tmp_path / "folds" / "fold_2.npy", fold)
    rows = {(r["sample_id"], r["y"], r["x"], r["c"]): r["v"] for r in datasets.fold_samples(spark, str(tmp_path / "folds")).collect()}
    assert len(rows) == 24 and rows["fold2_00001", 1, 2, 0] == fold[1, 1, 2, 0]

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "s1_tile.xml").write_text('<tile><bounds x1="1" y1="2" x2="30" y2="40"/></tile>')
    (tmp_path / "lab.json").write_text(json.dumps([{"path": "w", "tiles": [{"rects": [[1, 2, 30, 40]], "segmentation_layers": [{"name": "Cells (x)", "polygons": [[[1, 2], [3, 4], [5, 6]], [[0, 0], [1, 1]]]}]}, {"rects": [[9, 9, 9, 9]], "segmentation_layers": []}, {"rects": []}]}]))
    got = {(r["slice"], r["tile"], r["layer"], r["polygon"], len(r["points"])) for r in datasets.slice_layers(spark, str(tmp_path / "lab.json"), str(tmp_path / "t")).collect()}
    assert got == {("w", "s1", "cells", 1, 3), ("w", "s1", "cells", 2, 2)}

    xml = '<Annotations><Annotation Id="1"><Attributes><Attribute Name="Epithelial"/></Attributes><Regions><Region><Vertices><Vertex X="1" Y="2"/><Vertex X="3" Y="4"/></Vertices></Region></Regions></Annotation><Annotation Id="2"><Attributes><Attribute Name="Neutrophil"/></Attributes><Region><Vertices><Vertex X="5" Y="6"/></Vertices></Region></Annotation></Annotations>'
    rows = datasets.class_polygons(spark.createDataFrame([("i", xml)], "name string, xml string")).collect()
    assert {(r["class"], r["region"], r["vertex"], r["x"]) for r in rows} == {("Epithelial", 1, 1, 1.0), ("Epithelial", 1, 2, 3.0), ("Neutrophil", 1, 1, 5.0)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(b"x"), (tmp_path / "m" / "a.xml").write_text(xml), (tmp_path / "m" / "b.xml").write_text(xml)
    assert [r["stem"] for r in datasets.annotated_images(spark, str(tmp_path / "m"), str(tmp_path / "m")).collect()] == ["a"]


def test_bitmaps():
    a = np.random.default_rng(5).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes().ljust(16, b"\0") for r in a[::-1])
    head = lambda depth, height, colours: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 4 * colours) + struct.pack("<IiiHHIIiiII", 40, 5, height, 1, depth, 0, 0, 0, 0, colours, 0)
    assert (images.decode("x.bmp", head(24, 3, 0) + rows) == a).all()
    grey = b"".join(struct.pack("BBBB", v, v, v, 0) for v in range(256))
    assert (images.decode("x.bmp", head(8, -3, 256) + grey + b"".join(r.tobytes().ljust(8, b"\0") for r in a[:, :, 0])) == a[:, :, 0]).all()


def test_outlines_and_region_files(spark):
    import io
    import zipfile

    labels = spark.createDataFrame([("i", y, x, 1 + int(x > 4)) for y in range(3) for x in (*range(3), *range(5, 9))], "img string, y int, x int, label int")
    made = tables.traced(labels)
    assert {(r["name"], r["n"]) for r in made.collect()} == {("0001", 8), ("0002", 10)}
    one = tables.roi_archives(made).first()
    with zipfile.ZipFile(io.BytesIO(bytes(one["content"]))) as archive:
        assert archive.namelist() == ["0001.roi", "0002.roi"]
        data = archive.read("0002.roi")
    top, left, bottom, right, n = struct.unpack(">hhhhh", data[8:18])
    xs = struct.unpack(f">{n}h", data[64 : 64 + 2 * n])
    assert data[:4] == b"Iout" and (top, left, bottom, right, n) == (0, 5, 2, 8, 10) and xs[0] == 0 and max(xs) == 3


def test_benchmark_resumes(spark, tmp_path):
    from tessella.operators import methods

    rows = spark.createDataFrame([(s, y, x, float(x - s), int(x > 1)) for s in range(4) for y in range(3) for x in range(4)], "sample_id int, y int, x int, v double, gt int")
    known = {"a": F.col("v") > 0, "b": F.col("v") > 1}
    first = methods.resume(spark, str(tmp_path / "scores"), rows.select("sample_id").where("sample_id < 2").distinct(), rows, known)
    assert first.count() == 4
    again = methods.resume(spark, str(tmp_path / "scores"), rows.select("sample_id").distinct(), rows, known)
    assert again.count() == 8 and spark.read.parquet(str(tmp_path / "scores")).count() == 8
    dice = {(r["sample_id"], r["method"]): r["dice"] for r in again.collect()}
    assert dice[1, "a"] == 1.0 and dice[0, "b"] == 1.0 and dice[3, "a"] == 0.0


def test_directions_of_largest_variance(spark):
    from tessella.operators import neighbours

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    frame = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, 0, None)], "vec_id int, label int, embedding array<double>")
    got = np.array([[r["pc1"], r["pc2"]] for r in neighbours.principal(frame, 2).orderBy("vec_id").collect()])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert got.shape == (200, 2) and np.allclose(got, x @ axes.T, atol=1e-8)


def test_maps_of_different_shapes_are_an_error(spark):
    import pytest

    from tessella.operators import labels

    a = spark.createDataFrame([(1, y, x, 1) for y in range(2) for x in range(2)], "img int, y int, x int, label int")
    assert labels.pair_maps(a, a.withColumn("label", F.lit(3))).where("gt = 1 and pr = 3").count() == 4
    with pytest.raises(Exception, match="differ in shape"):
        labels.pair_maps(a, a.where("y = 0")).collect()


def test_records_and_images_of_one_shape(spark):
    labels = spark.createDataFrame([(1, y, x, int(x > 0)) for y in range(3) for x in range(4)], "img int, y int, x int, label int")
    r = tables.records(labels, tables.traced(labels)).first()
    assert (r["height"], r["width"], r["n_labels"]) == (3, 4, 1) and r["masks"] == [0, 1, 1, 1] * 3 and len(r["outlines"]) == 1
    a = np.arange(12).reshape(3, 4) * 1000.0
    grey = spark.createDataFrame([("a", y, x, 0, float(v)) for (y, x), v in np.ndenumerate(a)], "path string, y int, x int, c int, v double")
    for h, w in ((6, 2), (3, 4), (2, 9)):
        got = np.full((h, w, 3), -1)
        for p in images.rgb_of_shape(grey, h, w).collect():
            got[p["y"], p["x"], p["c"]] = p["v"]
        want = np.floor(a / a.max() * 255).astype(int)[np.arange(h) * 3 // h][:, np.arange(w) * 4 // w]
        assert (got == want[:, :, None]).all()


def test_intermediate_data_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    import pytest

    from tessella.operators import durable

    def session(master, folder=None):
        given = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: given[-1] if given else None, setCheckpointDir=given.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            durable.shared_folder(session(master))
        assert durable.shared_folder(session(master, "/shared")) == "/shared"
    assert "checkpoints-" in durable.shared_folder(session("local[8]"))
    frame = spark.range(5)
    frame.write.parquet(f"{tmp_path}/gone")
    durable.remove(spark, f"{tmp_path}/gone")
    assert not (tmp_path / "gone").exists() and durable.checkpoint(frame).count() == 5


def test_regions_that_do_not_fit_name_their_label(spark):
    import pytest

    far = spark.createDataFrame([(4, "0007", "0,0,40000,1,3,3", 3)], "img long, name string, points string, n long")
    with pytest.raises(Exception, match="image 4, label 0007: a region file holds at most 32767"):
        tables.roi_archives(far).collect()
