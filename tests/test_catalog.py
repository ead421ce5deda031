import subprocess

import pytest

from cellweave.operators import catalog as C

#: Name, options, whether they are allowed.
SCENARIOS = [("default", [], True), ("webp", ["COMPRESS=WEBP", "WEBP_QUALITY=90"], True), ("jpeg", ["COMPRESS=JPEG", "JPEG_QUALITY=75"], True), ("zstd", ["COMPRESS=ZSTD"], True), ("webp_ycbcr", ["COMPRESS=WEBP", "PHOTOMETRIC=YCBCR"], False), ("predictor", ["COMPRESS=LZW", "PREDICTOR=3"], False)]


@pytest.mark.parametrize(("name", "options", "ok"), SCENARIOS)
def test_creation_option_scenarios(spark, name, options, ok):
    C.require_options(spark, ["gdal_translate", *(x for o in options for x in ("-co", o))])
    assert (C.conflicts(dict(o.split("=") for o in options)) is None) == ok


@pytest.mark.parametrize(
    ("flag", "error"),
    [("TILED=YES", None), ("tiled=yes", None), ("COMPRESS=FAKE", None), ("FLAG", None), ("TILD=YES", "unknown option"), ("JPEG_QUALITY=101", "above the maximum"), ("JPEG_QUALITY=0", "below the minimum"), ("JPEG_QUALITY=x", None), ("INTERLEAVE=pixel", None), ("INTERLEAVE=row", "not an allowed value")],
)
def test_options(spark, flag, error):
    flags = spark.createDataFrame([(0, "gtiff", flag)], "id int, driver string, flag string")
    assert C.check_options(flags, C.option_schema(spark)).first()["error"] == error


def test_command_lines(spark):
    with pytest.raises(ValueError, match="did you mean TILED"):
        C.require_options(spark, ["gdalwarp", "-co", "TILD=YES"])
    with pytest.raises(ValueError, match="MBTILES"):
        C.require_options(spark, ["gdal_translate", "-of", "MBTILES", "-co", "TILED=YES"])
    C.require_options(spark, ["gdaladdo", "-co", "TILD=YES"])  # no driver is known
    C.require_options(spark, ["cp", "-of", "GTiff", "-co", "TILD=YES"])
    C.require_options(spark, ["gdal_translate", "-of", "PNG", "-co", "TILD=YES"])  # no schema is known
    C.require_options(spark, [])


def test_schema_of_xml(spark):
    xml = '<CreationOptionList><Option name="COMPRESS" type="string-select"><Value>LZW</Value><Value>NONE</Value></Option><Option name="Q" type="int" min="1" max="9"/><Option name="S"/></CreationOptionList>'
    rows = {r["name"]: (r["type"], r["min"], r["max"], r["values"]) for r in C.option_schema_from_xml(spark, "X", xml).collect()}
    assert rows == {"COMPRESS": ("string-select", None, None, ["LZW", "NONE"]), "Q": ("int", 1.0, 9.0, []), "S": ("string", None, None, [])}


def test_validate(spark):
    df = spark.createDataFrame([(1, 1000, 10, 100), (2, 999, 10, 100), (3, 5000, None, None), (4, 5000, 9, 111), (5, None, None, None)], "id int, size_bytes long, width int, height int")
    errors = [r["error"] for r in C.validate_rasters(df).orderBy("id").collect()]
    assert errors == [None, "999 bytes, fewer than 1000", "not a raster", "999 pixels, fewer than 1000", "file is missing"]
    assert C.require_valid(df.where("id = 1")).count() == 1
    with pytest.raises(Exception, match="not a raster"):
        C.require_valid(df.where("id = 3")).collect()


def test_versions(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    assert C.git_version(str(tmp_path)) is None
    run("init")
    (tmp_path / "README.md").write_text("")
    run("add", "README.md")
    run("commit", "-m", "first")
    version = C.git_version(str(tmp_path))
    assert len(version) == 40
    (tmp_path / "README.md").write_text("changed")
    assert C.git_version(str(tmp_path)) == version + "-dirty"


def test_tags(spark):
    meta = spark.createDataFrame([("a", "VERSION", "1"), ("a", "X", "2"), ("b", "VERSION", "3")], "path string, key string, value string")
    new = spark.createDataFrame([("a", "VERSION", "9"), ("c", "VERSION", "7")], meta.schema)
    done = C.set_tags(meta, new)
    assert {tuple(r) for r in done.collect()} == {("a", "VERSION", "9"), ("a", "X", "2"), ("b", "VERSION", "3"), ("c", "VERSION", "7")}
    paths = spark.createDataFrame([("a",), ("d",)], "path string")
    assert {tuple(r) for r in C.get_tag(done, paths).collect()} == {("a", "9"), ("d", None)}
    info = spark.createDataFrame([('{"metadata": {"": {"VERSION": "abc"}, "IMAGE": {"I": "1"}}}',), ("{}",), ("broken",)], "info string")
    assert [r[0] for r in info.select(C.tag_of_info(info["info"])).collect()] == ["abc", None, None]


def test_manifest(spark, tmp_path):
    (tmp_path / "B.TIF").write_bytes(b"one")
    (tmp_path / "a.asc").write_bytes(b"two")
    (tmp_path / "notes.txt").write_bytes(b"three")
    sources = C.sources_frame(spark, {"B.TIF": "https://example.org/b", "a.asc": {"dataset": "d"}})
    files = C.with_sources(C.list_rasters(spark, str(tmp_path)), sources)
    import hashlib
    import json

    made = json.loads(C.manifest_json({"hash_algo": "sha256"}, files))
    assert set(made["files"]) == {"B.TIF", "a.asc"}
    assert made["files"]["B.TIF"]["sha256"] == hashlib.sha256(b"one").hexdigest() and made["files"]["B.TIF"]["source"] == {"url": "https://example.org/b"}
    assert made["files"]["a.asc"]["source"] == {"dataset": "d", "url": "Unknown"} and made["files"]["a.asc"]["size_bytes"] == 3


def test_publish(tmp_path):
    source, out = tmp_path / "s.tif", tmp_path / "out"
    source.write_bytes(b"x")
    with pytest.raises(NotADirectoryError):
        C.publish(str(source), str(out))
    out.mkdir()
    assert C.publish(str(source), str(out), host="None", rename="t.tif") == str(out / "t.tif")
    with pytest.raises(FileExistsError):
        C.publish(str(source), str(out), rename="t.tif")
    C.publish(str(source), str(out), rename="t.tif", overwrite=True)
    assert C.publish(str(source), str(out), disable=True, marker=str(tmp_path / "m" / "done")) is None and (tmp_path / "m" / "done").exists()
    with pytest.raises(FileNotFoundError):
        C.publish(str(tmp_path / "none"), str(out))
