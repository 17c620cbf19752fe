"""Meshes: Wavefront OBJ in and out, texture folders, and a glTF light-map rewrite."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.operators.dag import running_start


def parse_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, seq, line) to vertices (path, vertex, x, y, z) and triangles (path, tri, a, b, c); polygons become fans.

    Vertices are numbered from 1 in file order; negative references count back from the face's line.
    """
    words = lines.select("path", "seq", F.split(F.trim("line"), r"\s+").alias("w")).where(F.element_at("w", 1).isin("v", "f"))
    one = F.when(F.element_at("w", 1) == "v", 1).otherwise(0).cast("long").alias("one")
    counted = running_start(words.withColumn("one", one), "path", "seq", "one", "before")
    number = lambda i: F.try_element_at("w", F.lit(i)).try_cast("double")
    vertices = counted.where("one = 1").select("path", (F.col("before") + 1).alias("vertex"), *[number(i + 2).alias(a) for i, a in enumerate("xyz")])
    ids = F.transform(F.slice("w", 2, F.size("w") - 1), lambda x: F.split(x, "/")[0].try_cast("long"))
    faces = counted.where("one = 0 and size(w) >= 4").select("path", "seq", F.transform(ids, lambda i: F.when(i < 0, F.col("before") + i + 1).otherwise(i)).alias("v"))
    fans = faces.select("path", "seq", "v", F.explode(F.sequence(F.lit(2), F.size("v") - 1)).alias("k"))
    corner = lambda i: F.try_element_at("v", i)
    tri = (F.col("seq") * 1024 + F.col("k") - 2).alias("tri")
    return vertices, fans.select("path", tri, corner(F.lit(1)).alias("a"), corner(F.col("k")).alias("b"), corner(F.col("k") + 1).alias("c"))


def triangle_corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(path, tri, ax..cz); triangles with a missing vertex are dropped."""
    out = triangles
    for p in "abc":
        v = vertices.select(F.col("path").alias("_p"), F.col("vertex").alias("_v"), *[F.col(a).alias(f"{p}{a}") for a in "xyz"])
        out = out.join(v, (F.col("path") == F.col("_p")) & (F.col(p) == F.col("_v"))).drop("_p", "_v")
    return out.drop("a", "b", "c")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))
    return triangle_corners(*parse_obj(text.withColumn("seq", F.col("seq").cast("long"))))


def transformed(corners: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Corners under a 4x4 matrix (rows), as a scene graph's node has it."""
    at = lambda p, r: sum((float(r[i]) * F.col(f"{p}{a}") for i, a in enumerate("xyz")), F.lit(float(r[3])))
    return corners.withColumns({f"{p}{a}": at(p, matrix[i]) for p in "abc" for i, a in enumerate("xyz")})


def obj_lines(vertices: DataFrame, quads: DataFrame) -> DataFrame:
    """(part, seq, line): OBJ text of a face mesh (``faces_mesh``): vertices by place, then quads."""
    place = F.shiftleft("vx", 42) + F.shiftleft("vy", 21) + F.col("vz")
    numbered = running_start(vertices.select("vx", "vy", "vz", place.alias("k"), F.lit(1).alias("g"), F.lit(1).cast("long").alias("one")), "g", "k", "one", "n")
    v = numbered.select(F.lit(0).alias("part"), F.col("n").alias("seq"), F.concat_ws(" ", F.lit("v"), "vx", "vy", "vz").alias("line"))
    each = quads.withColumn("q", F.xxhash64("x", "y", "z", "nx", "ny", "nz")).select("q", F.posexplode("corners").alias("i", "v")).select("q", "i", "v.*")
    ids = each.join(numbered.select("vx", "vy", "vz", "n"), ["vx", "vy", "vz"]).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("n") + 1).alias("n")))).alias("c"))
    f = ids.select(F.lit(1).alias("part"), F.col("q").alias("seq"), F.concat(F.lit("f "), F.array_join(F.transform("c", lambda x: x.n.cast("string")), " ")).alias("line"))
    return v.unionByName(f)


def write_obj(vertices: DataFrame, quads: DataFrame, path: str) -> None:
    obj_lines(vertices, quads).coalesce(1).sortWithinPartitions("part", "seq").select("line").write.text(path)


def texture_files(names: DataFrame) -> DataFrame:
    """(path) to (path, material, face): from names such as ``stone_top.png``; a name without a face is all faces."""
    base = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    face = F.regexp_extract(base, r"_(top|bottom|side|front|back|left|right|end)$", 1)
    return names.select("path", F.regexp_replace(base, r"_(top|bottom|side|front|back|left|right|end)$", "").alias("material"), F.when(face == "", "all").otherwise(face).alias("face"))


def read_texture_folder(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return texture_files(files.select("path")).join(files.select("path", "content"), "path")


def light_maps_to_occlusion(gltf: str) -> str:
    """A glTF document whose materials' ``extras.metadata.lightmapTexture`` is also their occlusion texture."""
    doc = json.loads(gltf)
    for material in doc.get("materials", []):
        found = material.get("extras", {}).get("metadata", {}).get("lightmapTexture")
        if found is not None:
            material["occlusionTexture"] = found
    return json.dumps(doc)
