"""Registration documents and XML trees."""

import json

import pytest

from slidespark.functions import xml
from slidespark.sources import configs


def document(**changes):
    image = {"path": "a", "pixel_size_um": 1.0, "image_shape": [358, 666], "reader_kws": {}}
    held = {"schema_version": "1", "fixed_paths": [image], "moving_paths": [image, image]}
    held |= {k: [[i + 0.5, 2, 3], [4, 5, 6], [0, 0, 1]] for i, k in enumerate(configs.KEYS)}
    return held | changes


def test_every_matrix(spark, tmp_path):
    assert configs.KEYS[0] == "matrix_yx_px" and len(set(configs.KEYS)) == 8
    (tmp_path / "a.json").write_text(json.dumps(document(), indent=1))
    toml = 'schema_version = "1"\nmatrix_yx_px = [[0.5, 2, 3], [4, 5, 6], [0, 0, 1]]\n' + "".join(f'[[{k}]]\npath = "a"\npixel_size_um = 1.0\nimage_shape = [358, 666]\n' for k in ("fixed_paths", "moving_paths"))
    (tmp_path / "b.toml").write_text(toml)
    for i, key in enumerate(configs.KEYS):
        r = configs.read_registrations(spark, str(tmp_path / "*.json"), "yx" in key, "px" in key, "inv" in key).first()
        assert (r["m00"], r["m01"], r["m22"]) == (i + 0.5, 2.0, 1.0) and (r["fixed_height"], r["fixed_width"], r["moving_width"], r["moving_um"]) == (358, 666, 666, 1.0)
    both = configs.read_registrations(spark, str(tmp_path)).collect()
    assert [r["m00"] for r in both] == [0.5, 0.5] and {r["path"].rsplit("/", 1)[-1] for r in both} == {"a.json", "b.toml"}


def test_problems(spark, tmp_path):
    image = document()["fixed_paths"][0]
    bad = {
        "no matrix_yx_px": {"matrix_yx_px": None},
        "matrix_yx_px is not 3 x 3": {"matrix_yx_px": [[1, 2, 3], [4, 5, 6]]},
        "different image shapes of fixed images": {"fixed_paths": [image, image | {"image_shape": [1, 2]}]},
        "different pixel sizes of moving images": {"moving_paths": [image, image | {"pixel_size_um": 2.0}]},
        "no image shapes of moving images": {"moving_paths": []},
    }
    rows = [(k, json.dumps(document(**v))) for k, v in bad.items()] + [("no JSON", "{"), ("fine", json.dumps(document()))]
    found = {r["k"]: r for r in configs.registrations(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert all(found[k]["problem"] == k and found[k]["m00"] is None and found[k]["fixed_um"] is None for k in [*bad, "no JSON"])
    assert found["fine"]["problem"] is None and found["fine"]["m00"] == 0.5
    (tmp_path / "c.json").write_text(rows[2][1])
    with pytest.raises(Exception, match="different image shapes of fixed images"):
        configs.read_registrations(spark, str(tmp_path)).collect()


def test_xml_variant(spark):
    text = ['<A k="1">t<B>x</B><B><C/></B><D>5</D></A>', "<A><B/></A>", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k int, t string")
    found = [json.loads(r[0]) if r[0] else None for r in df.orderBy("k").select(xml.xml_variant(df.t).cast("string")).collect()]
    assert found == [{"A": {"@k": "1", "#text": "t", "D": "5", "B": ["x", {"C": None}]}}, {"A": {"B": None}}, None, None]
    assert df.where("k < 2").select(xml.xml_root(df.t)).distinct().collect()[0][0] == "A"
    with pytest.raises(Exception):
        spark.createDataFrame([("<A><B></A>",)], "t string").select(xml.xml_variant("t").cast("string")).collect()
