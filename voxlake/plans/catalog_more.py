"""More registered queries: symmetry, encoding, translation, geometry, rays, colours, images, replay."""

from pyspark.sql import DataFrame, functions as F

from voxlake.functions import colors as c
from voxlake.functions import huffman
from voxlake.functions import morton as m
from voxlake.operators import dag as dags, edits, encode, images, octree, palette, rays, symmetric, translation, voxelize
from voxlake.plans import pipelines
from voxlake.plans.catalog import BOX, DAG, IN_BOX, LEAVES, R, ROOT, VOXELS, cells, query, sql_leaves, sql_morton, table, voxels
from voxlake.sources import replay as replays
from voxlake.operators.transform import TransformDag
from voxlake.operators.transform16 import Transform16
from voxlake.storage import shared_path, stored

# --- symmetry ---------------------------------------------------------------------


def _sql_images() -> str:
    """All 48 images of all 256 masks, by SQL arithmetic on axis orders and mirrors."""
    orders = "(VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS o(p0, p1, p2)"
    return f"""masks AS (SELECT CAST(unnest(range(0, 256)) AS INT) AS mask), slots AS (SELECT CAST(unnest(range(0, 8)) AS INT) AS s), mirrors AS (SELECT CAST(unnest(range(0, 8)) AS INT) AS mir),
moved AS (SELECT p0, p1, p2, mir, s, CAST(xor(((s >> p0) & 1) + 2 * ((s >> p1) & 1) + 4 * ((s >> p2) & 1), mir) AS INT) AS t FROM {orders}, mirrors, slots),
images AS (SELECT mask, p0, p1, p2, mir, CAST(sum(((mask >> s) & 1) << t) AS INT) AS image FROM masks, moved GROUP BY ALL)"""


@query(f"WITH {_sql_images()}, k AS (SELECT mask, min(image) AS canonical FROM images GROUP BY mask) SELECT CAST(mask AS INT) AS mask, canonical, CAST(sum(CASE WHEN image = mask THEN 1 ELSE 0 END) AS INT) AS stabiliser FROM images JOIN k USING (mask) GROUP BY 1, 2")
def canonical_2x2x2(spark, sf_dir):
    return symmetric.mask_classes(spark)


@query(f"""WITH {_sql_images()}, g AS (SELECT *, (p0 = 0 AND p1 = 1) AS straight FROM images),
k AS (SELECT mask, min(image) AS a, min(CASE WHEN straight THEN image END) AS m, min(CASE WHEN mir = 0 THEN image END) AS x, bit_count(mask) AS n FROM g GROUP BY mask)
SELECT 'identity' AS study, 256 AS classes UNION ALL SELECT 'mirror', CAST(count(DISTINCT m) AS INT) FROM k UNION ALL SELECT 'axes', CAST(count(DISTINCT x) AS INT) FROM k UNION ALL SELECT 'all', CAST(count(DISTINCT a) AS INT) FROM k UNION ALL SELECT 'slots', CAST(count(DISTINCT n) AS INT) FROM k""")
def mask_class_counts(spark, sf_dir):
    return symmetric.class_counts(spark)


def _sql_leaf_classes(mirror_only: bool) -> str:
    """Distinct leaf masks and their least image, bit by bit."""
    orders = "(VALUES (0, 1, 2)) AS o(p0, p1, p2)" if mirror_only else "(VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS o(p0, p1, p2)"
    return f"""slots AS (SELECT CAST(unnest(range(0, 8)) AS INT) AS s), mirrors AS (SELECT CAST(unnest(range(0, 8)) AS INT) AS mir),
moved AS (SELECT p0 * 100 + p1 * 10 + p2 AS o, mir, s, CAST(xor(((s >> p0) & 1) + 2 * ((s >> p1) & 1) + 4 * ((s >> p2) & 1), mir) AS INT) AS t FROM {orders}, mirrors, slots),
bits AS (SELECT a.o, a.mir, a.s * 8 + b.s AS bit, a.t * 8 + b.t AS dest FROM moved a JOIN moved b ON a.o = b.o AND a.mir = b.mir),
distinct_leaves AS (SELECT lo, hi, min(tile) AS id FROM leaves GROUP BY lo, hi),
set_bits AS (SELECT id, bit FROM distinct_leaves, (SELECT CAST(unnest(range(0, 64)) AS INT) AS bit) WHERE (CASE WHEN bit < 32 THEN (lo >> bit) & 1 ELSE (hi >> (bit - 32)) & 1 END) = 1),
pictures AS (SELECT id, o, mir, list_sort(list(dest)) AS picture FROM set_bits JOIN bits USING (bit) GROUP BY 1, 2, 3),
least AS (SELECT id, min(array_to_string(list_transform(picture, lambda v: lpad(CAST(v AS VARCHAR), 2, '0')), '.')) AS key FROM pictures GROUP BY id)"""


def _leaf_class_count(spark, sf_dir, group: str) -> DataFrame:
    leaf = octree.leaves(cells(spark, sf_dir)).groupBy("lo", "hi").agg(F.min("tile").alias("id"))
    keyed = symmetric.canonical_leaves(leaf, symmetric.GROUPS[group])
    return keyed.agg(F.count("*").alias("masks"), F.count_distinct("key").alias("classes"))


for _name, _only, _group in (("leaf_classes_mirror", True, "mirror"), ("leaf_classes_all", False, "all")):

    def _make(group):
        return lambda spark, sf_dir: _leaf_class_count(spark, sf_dir, group)

    _f = _make(_group)
    _f.__name__ = _name
    query(f"WITH {VOXELS},\n{sql_leaves()},\n{_sql_leaf_classes(_only)} SELECT count(*) AS masks, count(DISTINCT key) AS classes FROM least")(_f)


def sql_classes(mirror_only: bool) -> str:
    """``classes`` (level, id, key): nodes' orbits, by the least order-free sum of hashed cells over the images of all their voxels."""
    orders = "(VALUES (0, 1, 2)) AS o(p0, p1, p2)" if mirror_only else "(VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS o(p0, p1, p2)"
    at = lambda i: f"CASE p{i} WHEN 0 THEN cx WHEN 1 THEN cy ELSE cz END"
    flip = lambda i: f"(CASE WHEN (mir >> {i}) & 1 = 1 THEN side - 1 - ({at(i)}) ELSE {at(i)} END)"
    return f"""keyed AS (SELECT x, y, z, {sql_morton()} AS m FROM voxels),
cells AS (SELECT t.level, t.id, 1 << CAST(t.level AS INT) AS side, x & ((1 << CAST(t.level AS INT)) - 1) AS cx, y & ((1 << CAST(t.level AS INT)) - 1) AS cy, z & ((1 << CAST(t.level AS INT)) - 1) AS cz
  FROM tree t JOIN keyed ON keyed.m >> CAST(3 * t.level AS INT) = t.morton WHERE t.morton = t.id),
images AS (SELECT level, id, p0, p1, p2, mir, sum(CAST(hash(1 + {flip(0)} + 1024 * {flip(1)} + 1048576 * {flip(2)}) AS HUGEINT)) AS key
  FROM cells, {orders}, (SELECT CAST(unnest(range(0, 8)) AS INT) AS mir) GROUP BY ALL),
classes AS (SELECT level, id, min(key) AS key FROM images GROUP BY 1, 2)"""


@query(f"WITH {DAG},\n{sql_classes(True)} SELECT CAST(level AS INT) AS level, count(*) AS dag_nodes, count(DISTINCT key) AS classes FROM classes GROUP BY 1")
def mirror_dag(spark, sf_dir):
    return symmetric.SymmetricDag(dags.Dag(cells(spark, sf_dir), ROOT), symmetric.GROUPS["mirror"]).counts()


@query(f"WITH {DAG},\n{sql_classes(False)} SELECT CAST(level AS INT) AS level, count(*) AS dag_nodes, count(DISTINCT key) AS classes FROM classes GROUP BY 1")
def transform_dag(spark, sf_dir):
    return symmetric.SymmetricDag(dags.Dag(cells(spark, sf_dir), ROOT), symmetric.GROUPS["all"]).counts()


@query(f"WITH {VOXELS} SELECT x, y, z FROM voxels")
def transform_dag_round_trip(spark, sf_dir):
    sym = symmetric.SymmetricDag(dags.Dag(cells(spark, sf_dir), ROOT), symmetric.GROUPS["all"])
    return encode.symmetric_voxels(sym)


def sql_slot_orders() -> str:
    """(level, classes) of nodes as bags: by level, the sorted classes of the children."""
    blocks = ", ".join(f"bit_count(({h} >> {8 * i}) & 255)" for h in ("lo", "hi") for i in range(4))
    out = [f"b2 AS (SELECT id, array_to_string(list_sort([{blocks}]), ',') AS key FROM t2 WHERE morton = id)", "k2 AS (SELECT id, min(id) OVER (PARTITION BY key) AS cid FROM b2)"]
    for k in range(3, ROOT + 1):
        out.append(f"b{k} AS (SELECT parent AS id, array_to_string(list_sort(list(cid)), ',') AS key FROM edges JOIN k{k - 1} ON child = k{k - 1}.id WHERE level = {k} GROUP BY parent)")
        out.append(f"k{k} AS (SELECT id, min(id) OVER (PARTITION BY key) AS cid FROM b{k})")
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS level, count(DISTINCT cid) AS classes FROM k{k}" for k in range(2, ROOT + 1))


@query(f"WITH {DAG},\n{sql_slot_orders()}")
def slot_order_study(spark, sf_dir):
    return symmetric.slot_order_classes(dags.Dag(cells(spark, sf_dir), ROOT))


# --- encoding ---------------------------------------------------------------------

@query(f"""WITH {DAG}, w AS (SELECT level, parent AS id, 1 + count(*) AS words FROM edges GROUP BY 1, 2 UNION ALL SELECT 2, id, 2 FROM t2 WHERE morton = id)
SELECT CAST(level AS INT) AS level, count(*) AS nodes, CAST(sum(words) AS BIGINT) AS words, CAST(4 * sum(words) AS BIGINT) AS bytes FROM w GROUP BY 1""")
def svdag32_sizes(spark, sf_dir):
    return encode.svdag32_sizes(dags.Dag(cells(spark, sf_dir), ROOT))


@query(f"WITH {DAG} SELECT CAST(level AS INT) AS level, count(*) AS nodes, CAST(count(*) * CASE WHEN level = 2 THEN 2 ELSE 1 END AS BIGINT) AS words, CAST(4 * count(*) * CASE WHEN level = 2 THEN 2 ELSE 1 END AS BIGINT) AS bytes FROM tree GROUP BY level")
def svo32_sizes(spark, sf_dir):
    return encode.svo32_sizes(dags.Dag(cells(spark, sf_dir), ROOT))


@query(f"""WITH {DAG},
{sql_classes(True)},
n AS (SELECT c.level, c.key, max(CASE WHEN c.level = 2 THEN 2 ELSE 1 + children END) AS words FROM classes c LEFT JOIN (SELECT level, parent, count(*) AS children FROM edges GROUP BY 1, 2) e ON e.level = c.level AND e.parent = c.id GROUP BY 1, 2)
SELECT CAST(level AS INT) AS level, count(*) AS nodes, CAST(sum(words) AS BIGINT) AS words, CAST(4 * sum(words) AS BIGINT) AS bytes FROM n GROUP BY 1""")
def ssvdag32_sizes(spark, sf_dir):
    return encode.ssvdag32_sizes(symmetric.SymmetricDag(dags.Dag(cells(spark, sf_dir), ROOT), symmetric.GROUPS["mirror"]))


def _transform_dag(spark, sf_dir) -> TransformDag:
    sym = symmetric.SymmetricDag(dags.Dag(cells(spark, sf_dir), ROOT), symmetric.GROUPS["all"])
    return TransformDag(sym)


@query()
def translated_dag(spark, sf_dir):
    """Nodes left after the pass over shifts, and pointers that shift."""
    return _transform_dag(spark, sf_dir).counts()


@query()
def transform16_sizes(spark, sf_dir):
    return Transform16.of(_transform_dag(spark, sf_dir)).sizes()


@query(f"WITH {VOXELS} SELECT x, y, z FROM voxels")
def transform16_round_trip(spark, sf_dir):
    """From the words as they are written and read again."""
    at = shared_path(spark, "transform16")
    Transform16.of(_transform_dag(spark, sf_dir)).write(at)
    return Transform16.read(spark, at).voxels()


@query()
def encoded_report(spark, sf_dir):
    return pipelines.encoded_report(dags.Dag(cells(spark, sf_dir), ROOT))


@query(f"WITH {VOXELS} SELECT x, y, z FROM voxels")
def words16_round_trip(spark, sf_dir):
    return encode.decoded16(stored(encode.no_transform16(dags.Dag(cells(spark, sf_dir), ROOT)), "words"), ROOT)


def sql_words16() -> str:
    """``w2``..: (id, n, start) of the 16-bit form's nodes, bottom-up."""
    out = ["w2 AS (SELECT id, 4 AS n, 4 * (row_number() OVER (ORDER BY id) - 1) AS start FROM t2 WHERE morton = id)"]
    for k in range(3, ROOT + 1):
        n = f"SELECT parent AS id, 1 + sum(CASE WHEN start < 65536 THEN 1 WHEN start < 4294967296 THEN 2 ELSE 3 END) AS n FROM edges JOIN w{k - 1} ON child = w{k - 1}.id WHERE level = {k} GROUP BY parent"
        out.append(f"w{k} AS (SELECT id, n, sum(n) OVER (ORDER BY id) - n AS start FROM ({n}))")
    return ",\n".join(out)


@query(f"WITH {DAG},\n{sql_words16()}\n" + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS words, CAST(2 * sum(n) AS BIGINT) AS bytes FROM w{k}" for k in range(2, ROOT + 1)))
def words16_sizes(spark, sf_dir):
    return encode.word_size_report(encode.no_transform16(dags.Dag(cells(spark, sf_dir), ROOT)), 2)


@query(f"""WITH {VOXELS}, q AS (SELECT event_id, CAST(event_id % {R} AS BIGINT) AS x, CAST((event_id * 7) % {R} AS BIGINT) AS y, CAST((event_id * 13) % 100 AS BIGINT) AS z FROM events)
SELECT event_id, x, y, z, EXISTS (SELECT 1 FROM voxels v WHERE v.x = q.x AND v.y = q.y AND v.z = q.z) AS found FROM q""")
def svdag32_member_lookup(spark, sf_dir):
    from voxlake.plans.catalog import _probes

    words = stored(encode.svdag32_words(dags.Dag(cells(spark, sf_dir), ROOT)), "words")
    return encode.svdag32_members(words, _probes(spark, sf_dir), ROOT)


@query()
def pointer_codes(spark, sf_dir):
    return Transform16.of(_transform_dag(spark, sf_dir)).codes


@query()
def huffman_codes(spark, sf_dir):
    counts = octree.leaves(cells(spark, sf_dir)).groupBy(m.block_mask().alias("symbol")).agg(F.count("*").alias("n"))
    return huffman.code_table(spark, counts, "symbol", "n")


@query(f"""WITH RECURSIVE {LEAVES}, b AS (SELECT {' + '.join(f'(CASE WHEN ({h} >> {8 * i}) & 255 > 0 THEN {1 << (i + 4 * k)} ELSE 0 END)' for k, h in enumerate(('lo', 'hi')) for i in range(4))} AS symbol, count(*) AS n FROM leaves GROUP BY 1),
-- the two least weights become one, and their sum is paid, until one is left
h(w, paid) AS (SELECT list_sort(list(n)), CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END::HUGEINT FROM b UNION ALL SELECT list_sort(list_append(w[3:], w[1] + w[2])), paid + w[1] + w[2] FROM h WHERE len(w) > 1)
SELECT (SELECT count(*) FROM b) AS symbols, CAST(max(paid) AS BIGINT) AS bits FROM h""")
def huffman_cost(spark, sf_dir):
    """Bits of the coded symbols in an optimal code: rare symbols of large tables have codes longer than ``huffman_codes`` allows."""
    counts = octree.leaves(cells(spark, sf_dir)).groupBy(m.block_mask().alias("symbol")).agg(F.count("*").alias("n"))
    coded = huffman.code_table(spark, counts, "symbol", "n", most=None)
    return coded.agg(F.count("*").alias("symbols"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).alias("bits"))


# --- translation ------------------------------------------------------------------

@query(f"""WITH {LEAVES}, items AS (SELECT min(tile) AS id, lo, hi, bit_count(lo) + bit_count(hi) AS n FROM leaves GROUP BY lo, hi),
bits AS (SELECT id, CAST(b AS INT) AS b FROM items, (SELECT unnest(range(0, 64)) AS b) WHERE (CASE WHEN b < 32 THEN (lo >> CAST(b AS INT)) & 1 ELSE (hi >> CAST(b - 32 AS INT)) & 1 END) = 1),
places AS (SELECT id, (b & 1) + ((b >> 3) & 1) * 2 AS x, ((b >> 1) & 1) + ((b >> 4) & 1) * 2 AS y, ((b >> 2) & 1) + ((b >> 5) & 1) * 2 AS z FROM bits),
o AS (SELECT CAST(unnest(range(-3, 4)) AS INT) AS v), shifts AS (SELECT a.v AS tx, b.v AS ty, c.v AS tz FROM o a, o b, o c),
crops AS (SELECT id AS parent, tx, ty, tz, sum(CAST(1 AS HUGEINT) << CAST((x + tx) + 4 * (y + ty) + 16 * (z + tz) AS INT)) AS mask FROM places, shifts
  WHERE x + tx BETWEEN 0 AND 3 AND y + ty BETWEEN 0 AND 3 AND z + tz BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4),
own AS (SELECT parent AS child, mask FROM crops WHERE tx = 0 AND ty = 0 AND tz = 0),
pairs AS (SELECT child, parent, tx, ty, tz, n FROM own JOIN crops USING (mask) JOIN items ON items.id = parent),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent, abs(tx) + abs(ty) + abs(tz), tx, ty, tz) AS k FROM pairs) WHERE k = 1),
kept AS (SELECT child AS id FROM best WHERE child = parent UNION SELECT parent FROM best WHERE child <> parent)
SELECT child, CASE WHEN stay THEN child ELSE parent END AS target, 0 AS g, CAST(CASE WHEN stay THEN 0 ELSE tx END AS INT) AS tx, CAST(CASE WHEN stay THEN 0 ELSE ty END AS INT) AS ty, CAST(CASE WHEN stay THEN 0 ELSE tz END AS INT) AS tz
FROM (SELECT *, child IN (SELECT id FROM kept) AS stay FROM best)""")
def translation_dedup(spark, sf_dir):
    """Level-2 items: distinct leaves, and those kept once crops of shifted leaves are dropped."""
    d = dags.Dag(cells(spark, sf_dir), ROOT)
    best = translation.best_parents(translation.flattened(d, 2), 4)
    return translation.mapping(best).select("child", "target", "g", "tx", "ty", "tz")


# --- geometry ---------------------------------------------------------------------

def triangles(spark, sf_dir, resolution=64) -> DataFrame:
    """Closed octahedra about suppliers' places: eight triangles each, in voxel units."""
    s = table(spark, sf_dir, "supplier")
    at = lambda k, n: (F.pmod(F.col("s_suppkey") * k, F.lit(n)) + 8.25).cast("double")
    span = float(resolution - 16)
    centre = s.select("s_suppkey", at(7, span).alias("px"), at(13, span).alias("py"), at(29, span).alias("pz"), (F.pmod(F.col("s_suppkey"), F.lit(5)) + 2.6).cast("double").alias("r"))
    shapes = []
    for k in range(8):
        sx, sy, sz = (1 if k >> i & 1 else -1 for i in range(3))
        tips = [("px", sx, 0), ("py", sy, 1), ("pz", sz, 2)]
        if sx * sy * sz < 0:
            tips.reverse()
        shapes.append(F.struct(*[(F.col(f"p{a}") + (F.lit(float(sign)) * F.col("r") if i == axis else F.lit(0.0))).alias(f"{p}{a}") for p, (_, sign, axis) in zip("abc", tips, strict=True) for i, a in enumerate("xyz")]))
    return centre.select(F.col("s_suppkey").cast("int").alias("mesh"), F.posexplode(F.array(*shapes)).alias("k", "t")).select("mesh", F.col("k").cast("long").alias("tri"), "t.*")


SQL_SUPPLIERS = "s AS (SELECT DISTINCT ((s_suppkey * 7) % 48) + 8.25 AS px, ((s_suppkey * 13) % 48) + 8.25 AS py, ((s_suppkey * 29) % 48) + 8.25 AS pz, (s_suppkey % 5) + 2.6 AS r FROM supplier)"
SQL_GRID = "g AS (SELECT x, y, z FROM (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS x), (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS y), (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS z))"
#: Least and greatest sum-norm distance of a cell's cube from an octahedron's centre.
_LEAST = " + ".join(f"greatest(0.0, {c} - p{c}, p{c} - {c} - 1)" for c in "xyz")
_MOST = " + ".join(f"greatest(abs({c} - p{c}), abs({c} + 1 - p{c}))" for c in "xyz")


@query(f"WITH {SQL_SUPPLIERS}, {SQL_GRID} SELECT DISTINCT x, y, z FROM g, s WHERE {_LEAST} <= r AND {_MOST} >= r")
def voxelize_mesh(spark, sf_dir):
    """An octahedron's surface is a sphere of the sum norm: cells with points on both sides of it."""
    return voxelize.surface(triangles(spark, sf_dir), 64)


@query()
def voxelize_thin(spark, sf_dir):
    return voxelize.surface(triangles(spark, sf_dir), 64, conservative=False)


SQL_SOLID = """s AS (SELECT ((s_suppkey * 7) % 48) + 8.25 AS px, ((s_suppkey * 13) % 48) + 8.25 AS py, ((s_suppkey * 29) % 48) + 8.25 AS pz, (s_suppkey % 5) + 2.6 AS r FROM supplier),
g AS (SELECT x, y, z FROM (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS x), (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS y), (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS z)),
n AS (SELECT x, y, z, count(*) AS n FROM g, s WHERE abs(x + 0.5 - px) + abs(y + 0.5 - py) + abs(z + 0.5 - pz) < r GROUP BY 1, 2, 3), solid AS (SELECT x, y, z FROM n WHERE n % 2 = 1)"""


@query(f"WITH {SQL_SOLID} SELECT x, y, z FROM solid")
def solid_fill(spark, sf_dir):
    """Inside by parity: octahedra are balls of the sum norm, and overlaps cancel in pairs."""
    return voxelize.solid(triangles(spark, sf_dir), 64)


@query(f"""WITH {VOXELS}, r AS (SELECT x, y, z, row_number() OVER (PARTITION BY y, z ORDER BY x) AS n, lead(x, 1, {R}) OVER (PARTITION BY y, z ORDER BY x) AS next FROM voxels)
SELECT y, z, CAST(sum(next - x) AS BIGINT) AS n, CAST(sum((next - x) * (next + x - 1) // 2) AS BIGINT) AS total FROM r WHERE n % 2 = 1 GROUP BY y, z""")
def parity_fill_x(spark, sf_dir):
    return voxelize.parity_fill(voxels(spark, sf_dir), R).groupBy("y", "z").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query()
def voxelize_and_compress(spark, sf_dir):
    return pipelines.voxelized(triangles(spark, sf_dir), 6).level_counts()


@query(f"""WITH {VOXELS}, o(nx, ny, nz) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)),
f AS (SELECT x, y, z, nx, ny, nz FROM voxels v, o WHERE NOT EXISTS (SELECT 1 FROM voxels w WHERE w.x = v.x + nx AND w.y = v.y + ny AND w.z = v.z + nz)),
k AS (SELECT i, j FROM (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT DISTINCT CAST(x + CASE WHEN nx <> 0 THEN (nx + 1) / 2 ELSE i END AS BIGINT) AS vx, CAST(y + CASE WHEN ny <> 0 THEN (ny + 1) / 2 WHEN nx <> 0 THEN i ELSE j END AS BIGINT) AS vy, CAST(z + CASE WHEN nz <> 0 THEN (nz + 1) / 2 ELSE j END AS BIGINT) AS vz FROM f, k""")
def mesh_vertices(spark, sf_dir):
    return voxelize.faces_mesh(edits.exposed_faces(voxels(spark, sf_dir)))[0]


# --- rays -------------------------------------------------------------------------

def _rays(spark, sf_dir) -> DataFrame:
    """Along +z from under the grid: one for each event, at voxel centres."""
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select(
        F.col("event_id").alias("ray_id"), *[(F.pmod(F.col("event_id") * k, F.lit(R)) + 0.5).cast("double").alias(f"o{a}") for k, a in ((3, "x"), (11, "y"))], F.lit(-10.0).alias("oz"),
        F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"), F.lit(0.0).alias("tmin"), F.lit(1000.0).alias("tmax"),
    )


RAYS = f"r AS (SELECT event_id AS ray_id, CAST((event_id * 3) % {R} AS BIGINT) AS x, CAST((event_id * 11) % {R} AS BIGINT) AS y FROM events)"


@query(f"WITH {VOXELS}, {RAYS} SELECT ray_id, x, y, min(z) AS z, 2 AS axis, CAST(min(z) + 10.0 AS DOUBLE) AS t FROM r JOIN voxels USING (x, y) GROUP BY 1, 2, 3")
def ray_first_hit(spark, sf_dir):
    return rays.first_hits(_rays(spark, sf_dir), cells(spark, sf_dir), R)


@query(f"WITH {VOXELS}, {RAYS} SELECT ray_id, EXISTS (SELECT 1 FROM voxels v WHERE v.x = r.x AND v.y = r.y) AS hit FROM r")
def ray_any_hit(spark, sf_dir):
    return rays.any_hits(_rays(spark, sf_dir), cells(spark, sf_dir), R)


@query(f"WITH {VOXELS}, {RAYS} SELECT ray_id, x, y, min(z) AS z, x AS ax, y AS ay, min(z) - 1 AS az FROM r JOIN voxels USING (x, y) GROUP BY 1, 2, 3")
def ray_pick(spark, sf_dir):
    return rays.picked(_rays(spark, sf_dir), cells(spark, sf_dir), R)


WIDTH, HEIGHT, EYE, TARGET, SUN, FOG = 32, 24, (-20.0, 80.0, -20.0), (32.0, 32.0, 32.0), (0.36, 0.8, 0.48), 0.001


def _scene(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    solid = stored(voxelize.solid(triangles(spark, sf_dir), 64), "scene")
    return rays.camera_rays(spark, WIDTH, HEIGHT, EYE, TARGET), solid


def _points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    shot, solid = _scene(spark, sf_dir)
    return stored(rays.hit_points(shot, rays.first_hits(shot, solid, 64)), "points"), solid


def sql_camera() -> str:
    u, v, w, half = rays.camera_frame(EYE, TARGET)
    px, py = f"((((i % {WIDTH}) + 0.5::DOUBLE) / {WIDTH}) * 2 - 1)", f"(1 - (((i // {WIDTH}) + 0.5::DOUBLE) / {HEIGHT}) * 2)"
    d = [f"({w[k]!r}::DOUBLE + {px} * {u[k] * half * WIDTH / HEIGHT!r}::DOUBLE + {py} * {v[k] * half!r}::DOUBLE)" for k in range(3)]
    return f"""pixels AS (SELECT i, {d[0]} AS a, {d[1]} AS b, {d[2]} AS c FROM (SELECT unnest(range({WIDTH * HEIGHT})) AS i)),
camera AS (SELECT i AS ray_id, {', '.join(f'{e!r}::DOUBLE AS o{n}' for e, n in zip(EYE, 'xyz', strict=True))}, {', '.join(f'{n} / sqrt(a * a + b * b + c * c) AS d{m}' for n, m in zip('abc', 'xyz', strict=True))}, 0::DOUBLE AS tmin, 1e6::DOUBLE AS tmax FROM pixels)"""


def sql_hits(shot: str, out: str) -> str:
    """``out``: ``shot``'s rays with the nearest voxel of ``solid`` that each meets, the position and the face's normal."""
    inf = "'infinity'::DOUBLE"
    within = lambda c: f"o{c} >= {c} AND o{c} < {c} + 1"
    near = ", ".join(f"CASE WHEN d{c} = 0 THEN CASE WHEN {within(c)} THEN -{inf} ELSE {inf} END ELSE least(({c} - o{c}) / d{c}, ({c} + 1 - o{c}) / d{c}) END AS a{c}" for c in "xyz")
    far = ", ".join(f"CASE WHEN d{c} = 0 THEN CASE WHEN {within(c)} THEN {inf} ELSE -{inf} END ELSE greatest(({c} - o{c}) / d{c}, ({c} + 1 - o{c}) / d{c}) END AS f{c}" for c in "xyz")
    normal = ", ".join(f"CASE WHEN axis = {i} THEN -sign(d{c})::DOUBLE ELSE 0::DOUBLE END AS n{c}" for i, c in enumerate("xyz"))
    return f"""{out}_a AS (SELECT r.*, v.x, v.y, v.z, {near}, {far} FROM {shot} r, solid v),
{out}_b AS (SELECT * EXCLUDE (ax, ay, az, fx, fy, fz), greatest(ax, ay, az, tmin) AS t, CASE WHEN ax >= ay AND ax >= az THEN 0 WHEN ay >= az THEN 1 ELSE 2 END AS axis FROM {out}_a WHERE greatest(ax, ay, az, tmin) < least(fx, fy, fz, tmax)),
{out} AS (SELECT * EXCLUDE (k), {', '.join(f'o{c} + t * d{c} AS p{c}' for c in 'xyz')}, {normal} FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, x, y, z, axis) AS k FROM {out}_b) WHERE k = 1)"""


def sql_uniform(seed: int, *keys: str) -> str:
    halves = ", ".join(f"({k}) & 4294967295, (({k}) >> 32) & 4294967295" for k in keys)
    state = f"((((h + k) & 4294967295) * {rays.PCG_STEP} + {rays.PCG_ADD}) & 4294967295)"
    word = f"((xor({state} >> CAST(({state} >> 28) + 4 AS BIGINT), {state}) * {rays.PCG_OUT}) & 4294967295)"
    return f"(list_reduce([{seed}::BIGINT, {halves}], lambda h, k: xor({word} >> 22, {word})) / 4294967296::DOUBLE)"


def sql_bounce(points: str, out: str, u: str, v: str, ray_id: str, rest: str, most: str) -> str:
    """``out``: cosine-weighted rays from ``points``' faces."""
    up, across, turn = "sqrt(1 - u)", "sqrt(greatest(0, 1 - sqrt(1 - u) * sqrt(1 - u)))", "v * 6.283185307179586::DOUBLE"
    a, b = f"{across} * cos({turn})", f"{across} * sin({turn})"
    d = [f"CASE WHEN nx <> 0 THEN nx * {up} ELSE {a} END", f"CASE WHEN ny <> 0 THEN ny * {up} WHEN nx <> 0 THEN {a} ELSE {b} END", f"CASE WHEN nz <> 0 THEN nz * {up} ELSE {b} END"]
    return f"""{out}_u AS (SELECT *, {u} AS u, {v} AS v FROM {points}),
{out} AS (SELECT {ray_id} AS ray_id{rest}, {', '.join(f'p{c} + n{c} * 1e-3::DOUBLE AS o{c}' for c in 'xyz')}, {', '.join(f'{e} AS d{c}' for e, c in zip(d, 'xyz', strict=True))}, 0::DOUBLE AS tmin, {most}::DOUBLE AS tmax FROM {out}_u)"""


SCENE = f"{SQL_SOLID},\n{sql_camera()},\n{sql_hits('camera', 'seen')}"
OPEN = f"""sampled AS (SELECT s.*, CAST(i AS BIGINT) AS sample FROM seen s, (SELECT unnest(range(8)) AS i)),
{sql_bounce('sampled', 'tries', sql_uniform(1, 'ray_id', 'sample'), sql_uniform(2, 'ray_id', 'sample'), 'ray_id * 8 + sample', '', '32')},
{sql_hits('tries', 'blocked')},
visible AS (SELECT t.ray_id // 8 AS ray_id, avg(CASE WHEN b.ray_id IS NULL THEN 1.0 ELSE 0.0 END) AS visibility FROM tries t LEFT JOIN blocked b USING (ray_id) GROUP BY 1)"""
SUNLIT = f"""to_sun AS (SELECT ray_id, {', '.join(f'p{c} + n{c} * 1e-3::DOUBLE AS o{c}' for c in 'xyz')}, {', '.join(f'{v!r}::DOUBLE AS d{c}' for v, c in zip(SUN, 'xyz', strict=True))}, 0::DOUBLE AS tmin, 1e6::DOUBLE AS tmax FROM seen),
{sql_hits('to_sun', 'shaded')},
facing AS (SELECT s.ray_id, t, CASE WHEN h.ray_id IS NULL THEN greatest(0, {' + '.join(f'n{c} * {v!r}::DOUBLE' for v, c in zip(SUN, 'xyz', strict=True))}) ELSE 0 END AS sun FROM seen s LEFT JOIN (SELECT ray_id FROM shaded) h USING (ray_id))"""


@query(f"WITH {SCENE} SELECT ray_id, x, y, z, CAST(axis AS INT) AS axis, round(t, 6) AS t FROM seen")
def camera_first_hits(spark, sf_dir):
    shot, solid = _scene(spark, sf_dir)
    return rays.first_hits(shot, solid, 64).withColumn("t", F.round("t", 6))


@query(f"WITH {SCENE},\n{OPEN} SELECT ray_id, visibility FROM visible")
def ambient_occlusion(spark, sf_dir):
    points, solid = _points(spark, sf_dir)
    return rays.ambient_occlusion(points, solid, 64)


@query(f"WITH {SCENE},\n{OPEN},\n{SUNLIT} SELECT ray_id, round((0.7 * sun + 0.3 * visibility) * exp(-{FOG}::DOUBLE * t) + (1 - exp(-{FOG}::DOUBLE * t)), 6) AS light FROM facing JOIN visible USING (ray_id)")
def shaded_frame(spark, sf_dir):
    points, solid = _points(spark, sf_dir)
    shaded = rays.shade(points, rays.shadows(points, solid, 64, SUN), rays.ambient_occlusion(points, solid, 64), SUN, fog=FOG)
    return shaded.withColumn("light", F.round("light", 6))


def sql_paths(bounces: int = 2, seed: int = 3) -> str:
    out, lights = [SQL_SOLID, sql_camera(), "live0 AS (SELECT *, 1.0::DOUBLE AS weight FROM camera)"], []
    for k in range(bounces + 1):
        out.append(sql_hits(f"live{k}", f"hit{k}"))
        lights.append(f"SELECT ray_id, weight FROM live{k} WHERE ray_id NOT IN (SELECT ray_id FROM hit{k})")
        if k < bounces:
            out.append(sql_bounce(f"hit{k}", f"live{k + 1}", sql_uniform(seed + 2 * k, "ray_id"), sql_uniform(seed + 2 * k + 1, "ray_id"), "ray_id", ", weight * 0.7::DOUBLE AS weight", "1e6"))
    return f"WITH {(','+chr(10)).join(out)} SELECT ray_id, round(sum(weight), 6) AS light FROM (SELECT ray_id, 0::DOUBLE AS weight FROM camera UNION ALL {' UNION ALL '.join(lights)}) GROUP BY ray_id"


@query(sql_paths())
def path_traced_frame(spark, sf_dir):
    shot, solid = _scene(spark, sf_dir)
    return rays.path_trace(shot, solid, 64).withColumn("light", F.round("light", 6))


# --- colours and images -----------------------------------------------------------

def _colored(spark, sf_dir) -> DataFrame:
    v = voxels(spark, sf_dir)
    return v.select("x", "y", "z", *[(F.floor(F.col(a) / 64) / 4.0).alias(n) for a, n in zip("xyz", "rgb", strict=True)])


def _palette(spark) -> DataFrame:
    return spark.createDataFrame([(i, (i % 3) / 2.0, (i // 3 % 3) / 2.0, (i // 9) / 2.0) for i in range(27)], "material int, r double, g double, b double")


def sql_lab(r: str, g: str, b: str) -> tuple[str, str, str]:
    lin = lambda v: f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END * 100.0)"
    f = lambda v: f"(CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0 / 3.0) ELSE 7.787 * {v} + 16.0 / 116.0 END)"
    x, y, z = (f("((" + " + ".join(f"{lin(v)} * {k}" for v, k in zip((r, g, b), row, strict=True)) + f") / {w})") for row, w in zip(c.XYZ, c.WHITE, strict=True))
    return f"(116.0 * {y} - 16.0)", f"(500.0 * ({x} - {y}))", f"(200.0 * ({y} - {z}))"


COLORED = f"{VOXELS}, colored AS (SELECT x, y, z, floor(x / 64) / 4.0 AS r, floor(y / 64) / 4.0 AS g, floor(z / 64) / 4.0 AS b FROM voxels)"
PALETTE = "palette AS (SELECT CAST(i AS INT) AS material, (i % 3) / 2.0 AS pr, (i // 3 % 3) / 2.0 AS pg, (i // 9) / 2.0 AS pb FROM (SELECT unnest(range(0, 27)) AS i))"
_L1, _L2 = sql_lab("r", "g", "b"), sql_lab("pr", "pg", "pb")
NEAR = f"""{COLORED}, {PALETTE}, n AS (SELECT r, g, b, count(*) AS n FROM colored GROUP BY 1, 2, 3),
d AS (SELECT r, g, b, n, material, {' + '.join(f'({a} - {b}) * ({a} - {b})' for a, b in zip(_L1, _L2, strict=True))} AS d FROM n, palette),
k AS (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY round(d, 9), material) AS k FROM d)"""


@query(f"WITH {NEAR} SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, material FROM k WHERE k = 1")
def nearest_material(spark, sf_dir):
    return palette.nearest_materials(_colored(spark, sf_dir), _palette(spark))


@query(f"""WITH {NEAR}, s AS (SELECT a.material, a.n * (b.d - a.d) AS cost, a.n FROM k a JOIN k b USING (r, g, b) WHERE a.k = 1 AND b.k = 2)
SELECT material, round(coalesce(sum(cost), 0.0), 3) AS cost, CAST(coalesce(sum(n), 0) AS BIGINT) AS uses FROM palette LEFT JOIN s USING (material) GROUP BY 1""")
def palette_cost(spark, sf_dir):
    p = palette.palette_costs(_colored(spark, sf_dir), _palette(spark))
    return p.select("material", F.round("cost", 3).alias("cost"), "uses")


def sql_reduction(size: int = 27, keep: int = 20) -> str:
    """The materials left after dropping the one whose colours lose least, one by one."""
    far = " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(_L1, _L2, strict=True))
    out = [f"{COLORED}, {PALETTE}, n AS (SELECT r, g, b, count(*) AS n FROM colored GROUP BY 1, 2, 3), d AS MATERIALIZED (SELECT r, g, b, n, material, {far} AS d FROM n, palette), p0 AS (SELECT material FROM palette)"]
    for i in range(size - keep):
        out.append(f"k{i} AS (SELECT d.*, row_number() OVER (PARTITION BY r, g, b ORDER BY d, material) AS k FROM d JOIN p{i} USING (material))")
        out.append(f"c{i} AS (SELECT a.material, sum(a.n * (b.d - a.d)) AS cost FROM k{i} a JOIN k{i} b USING (r, g, b) WHERE a.k = 1 AND b.k = 2 GROUP BY 1)")
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT material FROM p{i} WHERE material <> (SELECT material FROM p{i} LEFT JOIN c{i} USING (material) ORDER BY coalesce(cost, 0), material LIMIT 1))")
    return "WITH " + ",\n".join(out) + f"\nSELECT material, pr AS r, pg AS g, pb AS b FROM palette JOIN p{size - keep} USING (material)"


@query(sql_reduction())
def palette_reduction(spark, sf_dir):
    return palette.reduced_palette(_colored(spark, sf_dir), _palette(spark), 20)


@query(f"""WITH {COLORED}, s AS (SELECT row_number() OVER (ORDER BY {"(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i + a})" for i in range(ROOT) for a, v in enumerate("xyz")) + ")"}) - 1 AS rank,
  CAST(floor(r * 255) AS BIGINT) + 256 * CAST(floor(g * 255) AS BIGINT) + 65536 * CAST(floor(b * 255) AS BIGINT) AS color FROM colored),
i AS (SELECT *, rank // 16384 AS macro, rank - row_number() OVER (PARTITION BY rank // 16384, color ORDER BY rank) AS island FROM s)
SELECT macro, min(rank) AS start, count(*) AS length, color FROM i GROUP BY macro, color, island""")
def rle_blocks(spark, sf_dir):
    return palette.run_blocks(palette.color_stream(_colored(spark, sf_dir)))


_ENDS = ", ".join(f"min({n}) OVER w AS l{n}, max({n}) OVER w AS h{n}" for n in "rgb")
_SHARE = " + ".join(f"({n} - l{n}) * (h{n} - l{n})" for n in "rgb")
_SPAN = " + ".join(f"(l{n} - h{n}) * (l{n} - h{n})" for n in "rgb")
_PACKED = {n: f"(floor({{0}}{n} * {most}) / {most}::DOUBLE)" for n, most in zip("rgb", (31, 63, 31), strict=True)}


@query(f"""WITH {COLORED}, s AS (SELECT row_number() OVER (ORDER BY {"(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i + a})" for i in range(ROOT) for a, v in enumerate("xyz")) + ")"}) - 1 AS rank, {', '.join(f'floor({n} * 255) / 255::DOUBLE AS {n}' for n in 'rgb')} FROM colored),
e AS (SELECT rank, r, g, b, {_ENDS} FROM s WINDOW w AS (PARTITION BY rank // 64)),
t AS (SELECT *, CASE WHEN {_SPAN} = 0 THEN 0 ELSE round(greatest(0, least(1, ({_SHARE}) / ({_SPAN}))) * 3) END AS w FROM e)
SELECT rank, {', '.join(f"round({_PACKED[n].format('l')} + ({_PACKED[n].format('h')} - {_PACKED[n].format('l')}) * (w / 3::DOUBLE), 6) AS {n}" for n in 'rgb')} FROM t""")
def color_weight_blocks(spark, sf_dir):
    blocks = palette.block_colors(palette.weight_blocks(palette.color_stream(_colored(spark, sf_dir))))
    return blocks.select("rank", *[F.round(n, 6).alias(n) for n in "rgb"])


@query(f"WITH {COLORED} SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, count(*) AS n FROM colored GROUP BY 1, 2, 3")
def color_occurrences(spark, sf_dir):
    return palette.color_counts(_colored(spark, sf_dir))


@query(f"WITH {COLORED} SELECT CAST(x % 7 AS INT) AS material, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM colored GROUP BY 1")
def material_means(spark, sf_dir):
    v = _colored(spark, sf_dir).withColumn("material", (F.col("x") % 7).cast("int"))
    return palette.material_means(v).select("material", *[F.round(n, 9).alias(n) for n in "rgb"])


def _depth(spark, sf_dir) -> DataFrame:
    return voxels(spark, sf_dir).groupBy("x", "y").agg(F.min("z").cast("double").alias("value"))


DEPTH = f"{VOXELS}, depth AS (SELECT x, y, CAST(min(z) AS DOUBLE) AS value FROM voxels GROUP BY 1, 2)"


@query(f"WITH {DEPTH} SELECT CAST(l AS INT) AS level, x >> l AS x, y >> l AS y, min(value) AS low, max(value) AS high FROM depth, (SELECT unnest(range(0, {ROOT + 1})) AS l) GROUP BY 1, 2, 3")
def depth_pyramid(spark, sf_dir):
    return images.min_max_levels(_depth(spark, sf_dir), ROOT)


@query(f"""WITH {DEPTH}, k(o, w) AS (VALUES {', '.join(f'({i}, {w!r})' for i, w in zip(range(-2, 3), images.gaussian(2, 1.0), strict=True))}),
a AS (SELECT x + o AS x, y, sum(w * value) / sum(w) AS value FROM depth, k WHERE x + o BETWEEN 0 AND {R - 1} GROUP BY 1, 2),
b AS (SELECT x, y + o AS y, sum(w * value) / sum(w) AS value FROM a, k WHERE y + o BETWEEN 0 AND {R - 1} GROUP BY 1, 2) SELECT x, y, round(value, 6) AS value FROM b""")
def depth_blur(spark, sf_dir):
    return images.blurred(_depth(spark, sf_dir), R, R).select("x", "y", F.round("value", 6).alias("value"))


# --- replay -----------------------------------------------------------------------

LOG = [
    "EditSphere,100,100,50,20,true,4", "EndFrame", "EditCube,40,40,20,6,false", "EditSphere,60.5,70,30,10,FALSE", "EndFrame", "Undo", "EndFrame", "SetLocation,1,2,3", "Redo", "EndFrame",
    "EditCopy,100,100,50,40,80,40,100,100,50,8", "EndFrame", "EditPaint,100,100,50,12,1,0,0,9", "EditFill,150,150,50,5", "EndFrame",
]


def _log(spark, lines=LOG) -> DataFrame:
    return replays.parse(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))


FAULTY = [*LOG, "EditCube,1,2,3,4,FALSE,,", "Nope,1", "EditFill,1"]
_ARG = lambda i, kind="DOUBLE": f"TRY_CAST(c[{i + 2}] AS {kind})"


@query(f"""WITH lines AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(FAULTY))}) AS v(seq, line)),
p AS (SELECT CAST(seq AS BIGINT) AS seq, string_split(regexp_replace(line, ',+$', ''), ',') AS c FROM lines),
k AS (SELECT *, c[1] AS name, len(c) - 1 AS n FROM p),
a AS (SELECT *, CASE name {' '.join(f"WHEN '{x}' THEN '{y}'" for x, y in replays.ACTIONS.items())} END AS action,
  CASE name {' '.join(f"WHEN '{x}' THEN n IN ({', '.join(map(str, y))})" for x, y in replays.ARITY.items())} ELSE true END AS fits FROM k)
SELECT seq, CAST((SELECT count(*) FROM a b WHERE b.name = 'EndFrame' AND b.seq < a.seq) AS INT) AS frame, action,
  {', '.join(f"CASE WHEN name LIKE 'Edit%' THEN {_ARG(i)} END AS {n}" for i, n in enumerate('xyz'))},
  CASE WHEN name = 'EditCopy' THEN {_ARG(9)} WHEN name LIKE 'Edit%' THEN {_ARG(3)} END AS radius,
  CASE WHEN name IN ('EditSphere', 'EditCube') THEN lower(c[6]) = 'true' END AS add,
  CASE WHEN name IN ('EditSphere', 'EditCube') THEN coalesce({_ARG(5, 'INT')}, 4) WHEN name = 'EditPaint' THEN coalesce({_ARG(7, 'INT')}, 1) END AS material,
  CASE WHEN action IS NULL THEN 'action' WHEN NOT fits THEN 'arguments' END AS fault FROM a""")
def replay_log(spark, sf_dir):
    return _log(spark, FAULTY).select("seq", "frame", "action", "x", "y", "z", "radius", "add", "material", "fault")


def sql_ball(x: float, y: float, z: float, r: float) -> str:
    return "(" + " + ".join(f"pow(greatest(0, {c} - {v}, {v} - {c} - 1), 2)" for c, v in zip("xyz", (x, y, z), strict=True)) + f" < {r * r})"


def sql_cube(x: float, y: float, z: float, r: float) -> str:
    return "(" + " AND ".join(f"{c} + 1 > {v - r} AND {c} < {v + r}" for c, v in zip("xyz", (x, y, z), strict=True)) + ")"


def sql_cells(x: int, y: int, z: int, r: int) -> str:
    return "(SELECT * FROM " + ", ".join(f"(SELECT CAST(unnest(range({v - r - 1}, {v + r + 1})) AS BIGINT) AS {c})" for c, v in zip("xyz", (x, y, z), strict=True)) + ")"


def sql_replay() -> str:
    """The sets s0 to s6 after each edit of ``LOG``, and what changed from one to the next."""
    out = [
        VOXELS,
        "s0 AS (SELECT x, y, z, 0 AS material FROM voxels)",
        f"s1 AS (SELECT * FROM s0 WHERE NOT {sql_ball(100, 100, 50, 20)} UNION ALL SELECT x, y, z, 4 FROM {sql_cells(100, 100, 50, 20)} WHERE {sql_ball(100, 100, 50, 20)})",
        f"s2 AS (SELECT * FROM s1 WHERE NOT {sql_cube(40, 40, 20, 6)})",
        f"s3 AS (SELECT * FROM s2 WHERE NOT {sql_ball(60.5, 70, 30, 10)})",
        f"read AS (SELECT x, y, z FROM {sql_cells(160, 120, 60, 8)} WHERE {sql_cube(160, 120, 60, 8)})",
        "s4 AS (SELECT * FROM s3 UNION ALL SELECT r.x, r.y, r.z, v.material FROM read r JOIN s3 v ON v.x = r.x - 60 AND v.y = r.y - 20 AND v.z = r.z - 10 WHERE NOT EXISTS (SELECT 1 FROM s3 o WHERE o.x = r.x AND o.y = r.y AND o.z = r.z))",
        f"s5 AS (SELECT x, y, z, CASE WHEN {sql_ball(100, 100, 50, 12)} THEN 9 ELSE material END AS material FROM s4)",
        "box AS (SELECT x, y, z FROM (SELECT * FROM (SELECT CAST(unnest(range(145, 155)) AS BIGINT) AS x), (SELECT CAST(unnest(range(145, 155)) AS BIGINT) AS y), (SELECT CAST(unnest(range(45, 55)) AS BIGINT) AS z)) b WHERE NOT EXISTS (SELECT 1 FROM s5 v WHERE v.x = b.x AND v.y = b.y AND v.z = b.z))",
        "flood(x, y, z) AS (SELECT 150::BIGINT, 150::BIGINT, 50::BIGINT UNION SELECT b.x, b.y, b.z FROM flood f JOIN box b ON abs(b.x - f.x) + abs(b.y - f.y) + abs(b.z - f.z) = 1)",
        "s6 AS (SELECT * FROM s5 UNION ALL SELECT x, y, z, 0 FROM flood f WHERE NOT EXISTS (SELECT 1 FROM s5 v WHERE v.x = f.x AND v.y = f.y AND v.z = f.z))",
        *[sql_leaves(f"s{i}", f"l{i}") for i in range(7)],
    ]
    rows = ["SELECT 0 AS version, (SELECT count(*) FROM l0) AS changed_leaves, (SELECT count(*) FROM s0) AS changed_materials"]
    for i in range(1, 7):
        changed = f"(SELECT count(*) FROM l{i} a FULL JOIN l{i - 1} b USING (tile) WHERE a.lo IS DISTINCT FROM b.lo OR a.hi IS DISTINCT FROM b.hi)"
        rows.append(f"SELECT {i}, {changed}, (SELECT count(*) FROM (SELECT * FROM s{i} EXCEPT SELECT * FROM s{i - 1}))")
    return f"WITH RECURSIVE {(','+chr(10)).join(out)}\n" + " UNION ALL ".join(rows)


@query(sql_replay())
def replay_versions(spark, sf_dir):
    return pipelines.replayed(voxels(spark, sf_dir), _log(spark), R)


def sql_copy(back: tuple[str, str, str], middle: tuple, reach: int) -> str:
    """A copy's result; ``back`` are the cells' images in the source, of rel = p - dest as i, j, k."""
    return f"""WITH {VOXELS}, cells AS (SELECT x, y, z, x - 120.0::DOUBLE AS i, y - 110.0::DOUBLE AS j, z - 60.0::DOUBLE AS k FROM {sql_cells(*middle, reach)} WHERE {sql_cube(*middle, reach)} AND x BETWEEN 0 AND {R - 1} AND y BETWEEN 0 AND {R - 1} AND z BETWEEN 0 AND {R - 1}),
images AS (SELECT x, y, z, {', '.join(f'{b} AS s{n}' for b, n in zip(back, 'xyz', strict=True))} FROM cells)
SELECT x, y, z FROM voxels UNION SELECT i.x, i.y, i.z FROM images i JOIN voxels v ON sx >= 0 AND sy >= 0 AND sz >= 0 AND v.x = CAST(floor(sx) AS BIGINT) AND v.y = CAST(floor(sy) AS BIGINT) AND v.z = CAST(floor(sz) AS BIGINT)"""


# a quarter turn about z, doubled: (x, y, z) to (-2y, 2x, 2z)
@query(sql_copy(("90 + 0.5 * j", "90 - 0.5 * i", "40 + 0.5 * k"), (116, 114, 64), 24))
def edit_copy_matrix(spark, sf_dir):
    return edits.copy_transformed(voxels(spark, sf_dir), (90.0, 90.0, 40.0), (120.0, 110.0, 60.0), (92.0, 92.0, 42.0), 12.0, R, matrix=[0, -2, 0, 2, 0, 0, 0, 0, 2])


@query(sql_copy(("90 + i * cos(j / 16) - k * sin(j / 16)", "90 + j", "40 + i * sin(j / 16) + k * cos(j / 16)"), (122, 112, 62), 20))
def edit_copy_swirl(spark, sf_dir):
    return edits.copy_transformed(voxels(spark, sf_dir), (90.0, 90.0, 40.0), (120.0, 110.0, 60.0), (92.0, 92.0, 42.0), 20.0, R, swirl_period=16.0)


@query(f"WITH {VOXELS} SELECT * FROM voxels WHERE NOT ({IN_BOX})")
def edit_expansion(spark, sf_dir):
    """Removal of a box by the level-wise verdicts: nodes filled whole, and voxels at the border."""
    v = voxels(spark, sf_dir)
    decided = edits.expand_edit(spark, ROOT, edits.box_region(*BOX), stop=2)
    filled = stored(decided.where("verdict = 'fill'").select("level", *[F.call_function("shiftright", F.col(a), F.col("level")).alias(f"c{a}") for a in "xyz"]), "filled")
    border = stored(decided.where("verdict = 'subdivide'").select(*[F.shiftright(a, 2).alias(f"c{a}") for a in "xyz"]), "border")
    each = v.withColumn("level", F.explode(F.sequence(F.lit(2), F.lit(ROOT))))
    at = each.select("x", "y", "z", "level", *[F.call_function("shiftright", F.col(a), F.col("level")).alias(f"c{a}") for a in "xyz"])
    gone = at.join(filled, ["level", "cx", "cy", "cz"]).select("x", "y", "z")
    near = v.select("x", "y", "z", *[F.shiftright(a, 2).alias(f"c{a}") for a in "xyz"]).join(border, ["cx", "cy", "cz"]).where(octree.in_box(*BOX)).select("x", "y", "z")
    return edits.difference(v, gone.unionByName(near))


@query(f"""WITH {VOXELS}, {sql_leaves()}, e AS (SELECT x, y, z FROM voxels UNION SELECT x, y, z FROM (SELECT unnest(range(40, 72)) AS x), (SELECT unnest(range(40, 60)) AS y), (SELECT unnest(range(10, 40)) AS z)), {sql_leaves('e', 'el')}
SELECT lo, hi FROM el EXCEPT SELECT lo, hi FROM leaves""")
def find_or_insert(spark, sf_dir):
    v = voxels(spark, sf_dir)
    edited = edits.add_region(v, edits.box_voxels(spark, *BOX))
    return edits.new_items(octree.leaves(edited), octree.leaves(v), ["lo", "hi"])
