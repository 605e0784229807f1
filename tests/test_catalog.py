"""Registering found files."""

from voxtrace.sources import catalog, slice_folders


def test_registering_keeps_the_order_of_the_request_and_says_why_paths_are_skipped(spark):
    known = spark.createDataFrame(
        [("d", False), ("d/b.csv", True), ("d/a.csv", True), ("d/e", False), ("d/e/f/c.csv", True), ("d/x.png", True), ("o.csv", None)],
        "path string, is_file boolean",
    )
    asked = spark.createDataFrame(
        [("o.csv", 0), ("zz", 1), ("d/b.csv", 2), ("d/e", 3), ("o.csv", 9)], "path string, place int"
    )

    def found(**more):
        rows = catalog.register_artifacts(known, asked, ["csv"], **more).collect()
        assert len({r["path"] for r in rows}) == len(rows)
        return {r["path"]: r["position"] or r["status"] for r in rows}

    skipped = {"zz": "not_found", "d/e": "not_a_file"}
    assert found() == {"o.csv": 1, "d/b.csv": 2, "d/a.csv": 3, "d/e/f/c.csv": 4, **skipped}
    assert found(folder="d/", max_depth=0, max_files=2) == {"o.csv": 1, "d/b.csv": 2, "d/a.csv": "over_limit", **skipped}
    assert found(folder="d", max_depth=2)["d/e/f/c.csv"] == 4
    assert found(folder="none") == {"o.csv": 1, "d/b.csv": 2, "none": "folder_not_found", **skipped}
    assert found(folder="d/a.csv") == {"o.csv": 1, "d/b.csv": 2, "d/a.csv": "not_a_folder", **skipped}


def test_slice_folders(spark):
    one = [0.5] * 6
    rows = [("a", f"s{n}.tif", 2, 3, [float(n)] * 6, "x") for n in (10, 9, 2)]
    rows += [("b", "s1.tif", 2, 3, one, "x"), ("b", "s2.tif", 3, 2, one, "x")]
    rows += [("c", "s1.tif", 2, 3, one, "x"), ("c", "t1.tif", 2, 3, one, "x")]
    rows += [("d", "s1.tif", 2, 3, one[:5], "x"), ("e", "s1.tif", 2, 3, None, "x"), ("f", None, 2, 3, one, "x")]
    rows += [("g", "n.tif", 2, 3, one, "x"), ("g", "N.tif", 2, 3, one, "x"), (None, "s1.tif", 2, 3, one, "x")]
    rows += [("h", "n.tif", 2, 3, one, "x")] * 2 + [("i", "s1.tif", 0, 3, [], "x"), ("j", "s1.tif", 1, None, [1.0], "x")]
    schema = "folder string, name string, height int, width int, pixels array<double>, status string"
    slices = spark.createDataFrame(rows, schema)
    folders = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "folder string")
    report = {r["folder"]: r for r in slice_folders.volume_report(slices, "auto", folders).collect()}
    assert {k: r["status"] for k, r in report.items()} == {
        "a": "ok", "b": "unequal_shapes", "c": "repeated_slice", "d": "broken_slice", "e": "broken_slice",
        "f": "broken_slice", "g": "ok", "h": "repeated_slice", "i": "broken_slice", "j": "broken_slice", "z": "no_slices",
    }
    assert (report["a"]["depth"], report["a"]["height"], report["a"]["width"]) == (3, 2, 3)
    assert report["b"]["height"] is None and report["z"]["depth"] == 0
    strict = {r["folder"]: r["status"] for r in slice_folders.volume_report(slices, "numeric").collect()}
    assert strict["g"] == "missing_index" and "z" not in strict
    volumes = slice_folders.folder_volumes(slices).sort("volume_id", "z").collect()
    assert [(r["volume_id"], r["z"], r["pixels"][0]) for r in volumes if r["volume_id"] == "a"] == [
        ("a", 0, 2.0), ("a", 1, 9.0), ("a", 2, 10.0)
    ]
    assert {r["volume_id"] for r in volumes} == {"a", "g"}
    by_name = slice_folders.folder_volumes(slices, "lexicographic").where("volume_id = 'a'").sort("z").collect()
    assert [r["pixels"][0] for r in by_name] == [10.0, 2.0, 9.0]
    assert slice_folders.folder_volumes(slices.limit(0)).count() == 0
