"""Registered queries of metadata documents: registrations in JSON and trees in XML, made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidespark.functions import xml
from slidespark.plans import model
from slidespark.plans.queries import query
from slidespark.sources import configs


@query(
    "WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 3 THEN 'no matrix_yx_um' WHEN s_suppkey % 10 = 0 THEN 'different image shapes of fixed images' END AS problem, s_nationkey AS n, s_acctbal AS b FROM supplier), "
    "v AS (SELECT s_suppkey, 1 + s_suppkey / 100.0::DOUBLE AS m00, 0.5::DOUBLE AS m01, b AS m02, -0.25::DOUBLE AS m10, 1.0::DOUBLE AS m11, CAST(n AS DOUBLE) AS m12, 0.0::DOUBLE AS m20, 0.0::DOUBLE AS m21, 1.0::DOUBLE AS m22, "
    "CAST(100 + n AS DOUBLE) AS fixed_height, CAST(200 AS DOUBLE) AS fixed_width, 0.5::DOUBLE AS fixed_um, CAST(50 AS DOUBLE) AS moving_height, CAST(n + 1 AS DOUBLE) AS moving_width, 0.25::DOUBLE AS moving_um FROM s WHERE problem IS NULL) "
    "SELECT s.s_suppkey, v.* EXCLUDE (s_suppkey), s.problem FROM s LEFT JOIN v ON v.s_suppkey = s.s_suppkey"
)
def stored_registrations(spark, d):
    """Matrices, shapes and pixel sizes out of registration documents; some lack the matrix, in some the shapes disagree."""
    s, k, n = model.load(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")

    def image(height, width, um):
        return F.struct(F.lit("a.tiff").alias("path"), F.lit(um).alias("pixel_size_um"), F.array(height.cast("int"), width.cast("int")).alias("image_shape"))

    def row(*values):
        return F.array(*(v.cast("double") for v in values))

    matrix = F.array(row(1 + k / 100, F.lit(0.5), F.col("s_acctbal")), row(F.lit(-0.25), F.lit(1), n), row(F.lit(0), F.lit(0), F.lit(1)))
    fixed = F.array(image(100 + n, F.lit(200), 0.5), image(100 + n + (k % 10 == 0).cast("int"), F.lit(200), 0.5))
    text = F.to_json(F.struct(F.lit("1.3").alias("schema_version"), fixed.alias("fixed_paths"), F.array(image(F.lit(50), n + 1, 0.25)).alias("moving_paths"), F.when(k % 7 != 3, matrix).alias("matrix_yx_um")))
    found = configs.registrations(s.select("s_suppkey", text.alias("text")), px=False)
    return found.withColumns({f"{side}_{c}": F.col(f"{side}_{c}").cast("double") for side in ("fixed", "moving") for c in ("height", "width")})


@query(
    "SELECT p_partkey, 'Image' AS root, p_brand AS brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size > 10 THEN 'um' END AS unit, p_name AS first, p_type AS second, "
    "'kept' AS note, CAST(NULL AS VARCHAR) AS missing FROM part"
)
def xml_tree(spark, d):
    """Nodes, attributes and repeats out of the variant of an XML tree."""
    size = F.when(F.col("p_size") > 10, F.concat(F.lit("<Size Unit='um'>"), F.col("p_size").cast("string"), F.lit("</Size>"))).otherwise("")
    channels = F.concat(F.lit("<Channel Name='"), F.col("p_name"), F.lit("'/><Channel Name='"), F.col("p_type"), F.lit("'><Note> kept </Note></Channel>"))
    text = F.concat(F.lit("<Image Brand='"), F.col("p_brand"), F.lit("'>"), size, channels, F.lit("</Image>"))
    p = model.load(spark, d, "part").select("p_partkey", xml.xml_root(text).alias("root"), xml.xml_variant(text).alias("v"))
    paths = {"brand": "$.Image['@Brand']", "size": "$.Image.Size['#text']", "unit": "$.Image.Size['@Unit']", "first": "$.Image.Channel[0]['@Name']", "second": "$.Image.Channel[1]['@Name']", "note": "$.Image.Channel[1].Note", "missing": "$.Image.Channel[2]['@Name']"}
    return p.select("p_partkey", "root", *(F.try_variant_get("v", path, "string").alias(n) for n, path in paths.items()))
