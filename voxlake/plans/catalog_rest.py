"""Registered queries: values on voxels, bounds, hashes, frame statistics, lookups in encoded forms, garbage."""

from pyspark.sql import DataFrame, functions as F

from voxlake.functions import bounds, hashes
from voxlake.operators import attributes, dag as dags, edits, encode, octree, palette, rays, recorder, voxelize
from voxlake.plans.catalog import DAG, LEAVES, R, ROOT, SQL, VOXELS, _probes, cells, query, sql_morton, table, voxels
from voxlake.plans.catalog_more import _L1, _colored, _points, _transform_dag, COLORED, SCENE, SQL_GRID, SQL_SUPPLIERS, _LEAST, _MOST, triangles
from voxlake.operators.transform16 import Transform16
from voxlake.storage import stored


# --- values on voxels -------------------------------------------------------------

def _valued(spark, sf_dir) -> DataFrame:
    return voxels(spark, sf_dir).withColumn("material", F.pmod(F.col("x") * 3 + F.col("y") * 5 + F.col("z"), F.lit(7)).cast("int"))


VALUED = f"{VOXELS}, valued AS (SELECT x, y, z, CAST((x * 3 + y * 5 + z) % 7 AS INT) AS material FROM voxels)"
PROBES = f"q AS (SELECT event_id, CAST(event_id % {R} AS BIGINT) AS x, CAST((event_id * 7) % {R} AS BIGINT) AS y, CAST((event_id * 13) % 100 AS BIGINT) AS z FROM events)"


@query(f"WITH {VALUED}, {PROBES} SELECT event_id, q.x, q.y, q.z, material FROM q LEFT JOIN valued v ON v.x = q.x AND v.y = q.y AND v.z = q.z")
def value_lookup(spark, sf_dir):
    return attributes.looked_up(_probes(spark, sf_dir), attributes.packed(_valued(spark, sf_dir)))


@query(f"WITH {VALUED} SELECT x, y, z, material * 2 + 1 AS material FROM valued")
def attribute_map(spark, sf_dir):
    return attributes.unpacked(attributes.mapped(attributes.packed(_valued(spark, sf_dir)), lambda v: v * 2 + 1))


@query(f"WITH {VALUED}, m AS (SELECT {sql_morton()} AS m FROM valued WHERE material >= 4) SELECT m >> 6 AS tile, count(*) AS voxels FROM m GROUP BY 1")
def attribute_binarise(spark, sf_dir):
    from voxlake.functions import morton as m

    return attributes.binarised(attributes.packed(_valued(spark, sf_dir)), lambda v: v >= 4).select("tile", m.popcount().alias("voxels"))


@query(f"""WITH {VALUED}, m AS (SELECT {sql_morton()} AS m, material FROM valued), t AS (SELECT m >> 6 AS tile, string_agg(CAST(m & 63 AS VARCHAR) || ':' || material, ',' ORDER BY m) AS content FROM m GROUP BY 1)
SELECT min(tile) AS id, count(*) AS uses FROM t GROUP BY content""")
def attribute_leaf_dedup(spark, sf_dir):
    return attributes.deduplicated(attributes.packed(_valued(spark, sf_dir))).select("id", "uses")


def _solid_valued(spark, sf_dir) -> DataFrame:
    v = edits.add_region(voxels(spark, sf_dir), edits.box_voxels(spark, (40, 40, 10), (72, 60, 40)))
    return v.withColumn("material", F.when(F.col("z") < 24, 1).otherwise(F.pmod(F.col("x"), F.lit(3)).cast("int")))


SOLID_VALUED = f"""{VOXELS}, sv AS (SELECT x, y, z, CAST(CASE WHEN z < 24 THEN 1 ELSE x % 3 END AS INT) AS material FROM (SELECT x, y, z FROM voxels
  UNION SELECT x, y, z FROM (SELECT unnest(range(40, 72)) AS x), (SELECT unnest(range(40, 60)) AS y), (SELECT unnest(range(10, 40)) AS z)))"""


@query(f"WITH {SOLID_VALUED}, k AS (SELECT {sql_morton()} >> 6 AS tile, material FROM sv) SELECT tile, min(material) AS material FROM k GROUP BY tile HAVING count(*) = 64 AND min(material) = max(material)")
def homogeneous_leaves(spark, sf_dir):
    return octree.homogeneous_leaves(_solid_valued(spark, sf_dir))


@query(f"WITH {VOXELS} SELECT x, y, z, floor(x * 255 / {R - 1})::BIGINT + floor(y * 255 / {R - 1})::BIGINT * 256 + floor(z * 255 / {R - 1})::BIGINT * 65536 AS color FROM voxels")
def debug_colors_position(spark, sf_dir):
    return attributes.debug_colors(voxels(spark, sf_dir), "position", R)


def _face_colors(spark) -> DataFrame:
    return spark.createDataFrame([(k, f, k / 8.0, f / 8.0, (k + f) / 16.0) for k in range(7) for f in range(5)], "material int, face int, r double, g double, b double")


@query(f"""WITH {SCENE}, p AS (SELECT ray_id, CAST((x + y + z) % 7 AS INT) AS material, CASE WHEN nx <> 0 THEN CASE WHEN nx > 0 THEN 1 ELSE 0 END WHEN ny <> 0 THEN CASE WHEN ny > 0 THEN 3 ELSE 2 END ELSE CASE WHEN nz > 0 THEN 5 ELSE 4 END END AS face FROM seen)
SELECT ray_id, material, CASE WHEN face < 5 THEN material / 8.0::DOUBLE ELSE 1 END AS r, CASE WHEN face < 5 THEN face / 8.0::DOUBLE ELSE 1 END AS g, CASE WHEN face < 5 THEN (material + face) / 16.0::DOUBLE ELSE 1 END AS b FROM p""")
def surface_colors(spark, sf_dir):
    points, solid = _points(spark, sf_dir)
    held = attributes.packed(solid.withColumn("material", F.pmod(F.col("x") + F.col("y") + F.col("z"), F.lit(7)).cast("int")))
    return attributes.surface_colors(points, held, _face_colors(spark)).select("ray_id", "material", "r", "g", "b")


@query(f"WITH {COLORED} SELECT CAST(x % 7 AS INT) AS material, {', '.join(f'round(avg({e}), 6) AS {n}' for e, n in zip(_L1, 'lab', strict=True))} FROM colored GROUP BY 1")
def material_means_lab(spark, sf_dir):
    v = _colored(spark, sf_dir).withColumn("material", (F.col("x") % 7).cast("int"))
    return palette.material_means(v, "lab").select("material", *[F.round(n, 6).alias(n) for n in "lab"])


# --- bounds, hashes, statistics ---------------------------------------------------

MATRIX = [[0.0, -2.0, 0.5, 3.0], [1.0, 0.0, 0.0, -4.0], [0.25, 0.0, -1.0, 10.0]]


def _boxes(spark, sf_dir) -> DataFrame:
    p = _probes(spark, sf_dir)
    return p.select("event_id", *[F.col(a).cast("double").alias(f"p{a}0") for a in "xyz"], *[(F.col(a) + 8).cast("double").alias(f"p{a}1") for a in "xyz"], *[F.lit(float(v)).alias(f"q{a}{i}") for i, ends in enumerate(((30, 40, 20), (120, 90, 70))) for a, v in zip("xyz", ends, strict=True)])


@query(f"""WITH {PROBES}, b AS (SELECT event_id, {', '.join(f'{a}::DOUBLE AS {a}0, ({a} + 8)::DOUBLE AS {a}1' for a in 'xyz')} FROM q),
i AS (SELECT *, {', '.join(f'greatest({a}0, {l}) AS i{a}0, greatest(greatest({a}0, {l}), least({a}1, {h})) AS i{a}1' for a, l, h in zip('xyz', (30, 40, 20), (120, 90, 70), strict=True))} FROM b)
SELECT event_id, {' AND '.join(f'{a}0 < {h} AND {l} < {a}1' for a, l, h in zip('xyz', (30, 40, 20), (120, 90, 70), strict=True))} AS meets, 384.0::DOUBLE AS area, (x0 + x1) / 2 AS cx,
  CAST((ix1 - ix0) * (iy1 - iy0) * (iz1 - iz0) AS DOUBLE) AS shared, {', '.join(' + '.join(f'{k!r}::DOUBLE * {b}{(0 if k >= 0 else 1) if e == 0 else (1 if k >= 0 else 0)}' for k, b in zip(row[:3], 'xyz', strict=True)) + f' + {row[3]!r}::DOUBLE AS t{a}{e}' for e in (0, 1) for a, row in zip('xyz', MATRIX, strict=True))} FROM i""")
def bounds_algebra(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    shared = b.select("*", F.struct(*bounds.intersection("p", "q")).alias("i")).select("*", *[F.col(f"i.{a}{e}").alias(f"i{a}{e}") for a in "xyz" for e in (0, 1)])
    moved = [c.alias(f"t{a}{e}") for c, (e, a) in zip(bounds.transformed(MATRIX, "p"), ((e, a) for e in (0, 1) for a in "xyz"), strict=True)]
    return shared.select("event_id", bounds.overlap("p", "q").alias("meets"), bounds.area("p").alias("area"), bounds.centre("p")[0].alias("cx"), bounds.volume("i").alias("shared"), *moved)


def sql_finalized(x: str) -> str:
    """The murmur finalizer, as a fold over (shift, multiplier)."""
    return f"list_reduce([({x})::HUGEINT, {hashes.FINAL[0]}, {hashes.FINAL[1]}, 1], lambda h, k: (xor(h, h >> CASE k WHEN {hashes.FINAL[1]} THEN 13 ELSE 16 END) * k) % 4294967296)"


def sql_row_hash(*values: str) -> str:
    h, v = "h", "v"
    return f"list_reduce([0::HUGEINT, {', '.join(sql_finalized(f'({x}) & 4294967295') for x in values)}], lambda {h}, {v}: xor({h}, ({v} + {hashes.GOLDEN} + ({h} * 64) % 4294967296 + ({h} // 4)) % 4294967296))"


@query(f"WITH {VOXELS} SELECT x, y, z, CAST({sql_row_hash('x', 'y', 'z')} AS BIGINT) AS hash FROM voxels")
def voxel_hashes(spark, sf_dir):
    return voxels(spark, sf_dir).withColumn("hash", hashes.of_values(F.col("x"), F.col("y"), F.col("z")))


@query(f"WITH {LEAVES}, h AS (SELECT CAST({sql_row_hash('tile', 'lo', 'hi')} AS BIGINT) AS h FROM leaves) SELECT count(*) AS n, bit_xor(h) AS xor, CAST(sum(h) AS BIGINT) AS sum FROM h")
def leaf_checksum(spark, sf_dir):
    return octree.leaves(cells(spark, sf_dir)).agg(*hashes.checksum(F.col("tile"), F.col("lo"), F.col("hi")))


@query("SELECT event_type AS name, count(value) AS n, min(value) AS least, max(value) AS most, round(sum(value), 6) AS total, round(avg(value), 6) AS average FROM events GROUP BY 1")
def frame_stats(spark, sf_dir):
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), F.col("event_type").alias("name"), "value")
    return recorder.summed(values).select("name", "n", "least", "most", F.round("total", 6).alias("total"), F.round("average", 6).alias("average"))


# --- structures -------------------------------------------------------------------

@query(SQL["member_lookup"])
def words16_member_lookup(spark, sf_dir):
    words = stored(encode.no_transform16(dags.Dag(cells(spark, sf_dir), ROOT)), "words")
    return encode.members16(words, _probes(spark, sf_dir), ROOT)


@query(SQL["member_lookup"])
def transform16_member_lookup(spark, sf_dir):
    return Transform16.of(_transform_dag(spark, sf_dir)).members(_probes(spark, sf_dir))


@query(f"""WITH {VOXELS}, {PROBES}, l AS (SELECT *, CAST(event_id % 6 AS INT) AS level FROM q),
p AS (SELECT DISTINCT CAST(level AS INT) AS level, x >> level AS x, y >> level AS y, z >> level AS z FROM voxels, (SELECT unnest(range(0, 6)) AS level))
SELECT event_id, x, y, z, level, EXISTS (SELECT 1 FROM p WHERE p.level = l.level AND p.x = l.x >> l.level AND p.y = l.y >> l.level AND p.z = l.z >> l.level) AS found FROM l""")
def member_levels(spark, sf_dir):
    return octree.member_levels(_probes(spark, sf_dir).withColumn("level", F.pmod("event_id", F.lit(6)).cast("int")), voxels(spark, sf_dir))


def sql_svo_words() -> str:
    out = [DAG] + [f"o{k} AS (SELECT morton, row_number() OVER (ORDER BY morton) - 1 AS place FROM t{k})" for k in range(2, ROOT + 1)]
    rows = ["SELECT CAST(2 AS INT) AS level, morton, place, lo AS first, hi AS mask FROM o2 JOIN t2 USING (morton)"]
    for k in range(3, ROOT + 1):
        rows.append(f"SELECT CAST({k} AS INT), a.morton, a.place, min(b.place), CAST(bit_or(1 << CAST(b.morton & 7 AS INT)) AS BIGINT) FROM o{k} a JOIN o{k - 1} b ON b.morton >> 3 = a.morton GROUP BY a.morton, a.place")
    return f"WITH {(','+chr(10)).join(out)}\n" + " UNION ALL ".join(rows)


@query(sql_svo_words())
def svo32_words(spark, sf_dir):
    return encode.svo32_words(dags.Dag(cells(spark, sf_dir), ROOT))


@query(f"""WITH RECURSIVE {DAG}, live(level, id) AS (SELECT 6, id FROM t6 WHERE morton = id AND id % 2 = 0 UNION SELECT e.level - 1, e.child FROM live l JOIN edges e ON e.level = l.level AND e.parent = l.id AND l.level > 2)
SELECT CAST(t.level AS INT) AS level, t.id FROM tree t WHERE t.morton = t.id AND t.level <= 6 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.level = t.level AND l.id = t.id)""")
def gc_all_levels(spark, sf_dir):
    d = dags.Dag(cells(spark, sf_dir), ROOT)
    return d.garbage(d.nodes[6].where("id % 2 = 0"), 6)


@query(f"WITH {VOXELS} SELECT x, y, z, row_number() OVER (ORDER BY z, y, x) - 1 AS place FROM voxels")
def place_by_zyx(spark, sf_dir):
    v = voxels(spark, sf_dir).withColumn("_g", F.lit(0))
    return dags.ranked(v, "_g", [F.asc("z"), F.asc("y"), F.asc("x")], "place").drop("_g")


@query(f"WITH {SQL_SUPPLIERS}, {SQL_GRID} SELECT DISTINCT x, y, z FROM g, s WHERE {_LEAST} <= r AND {_MOST} >= r")
def voxelize_two_pass(spark, sf_dir):
    return voxelize.surface(triangles(spark, sf_dir), 64, two_pass=True)


@query(f"""WITH {SQL_SUPPLIERS}, t AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y), (SELECT unnest(range(0, 4)) AS z))
SELECT DISTINCT x, y, z FROM t, s WHERE {' + '.join(f'greatest(0.0, 16 * {c} - p{c}, p{c} - 16 * {c} - 16)' for c in 'xyz')} <= r AND {' + '.join(f'greatest(abs(16 * {c} - p{c}), abs(16 * {c} + 16 - p{c}))' for c in 'xyz')} >= r""")
def coarse_tiles(spark, sf_dir):
    return voxelize.coarse_tiles(triangles(spark, sf_dir), 64)


@query(f"WITH {SCENE} SELECT ray_id, greatest(0::DOUBLE, least(1::DOUBLE, 2 - greatest(abs(px - 32), abs(py - 32), abs(pz - 32)) / 12::DOUBLE)) > 0.5 AS near FROM seen")
def tool_overlay(spark, sf_dir):
    points, _ = _points(spark, sf_dir)
    return points.select("ray_id", (rays.tool_strength((32.0, 32.0, 32.0), 12.0, cube=True) > 0.5).alias("near"))
