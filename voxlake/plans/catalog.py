"""Registered queries over voxels of the driver's tables, each with its SQL where SQL can say it.

Voxels are the distinct (l_orderkey, l_partkey, l_suppkey), each modulo ``R``.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from voxlake.functions import morton as m
from voxlake.operators import dag as dags, edits, octree

R, ROOT = 256, 8
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.voxels_from(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", R)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``voxels`` with repeats, for what begins with leaves: no shuffle of its own."""
    return octree.cells_from(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", R)


# --- SQL pieces -------------------------------------------------------------------

def sql_morton(x="x", y="y", z="z", bits=ROOT) -> str:
    return "(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i + a})" for i in range(bits) for a, v in enumerate((x, y, z))) + ")"


VOXELS = f"voxels AS (SELECT DISTINCT CAST(l_orderkey % {R} AS BIGINT) AS x, CAST(l_partkey % {R} AS BIGINT) AS y, CAST(l_suppkey % {R} AS BIGINT) AS z FROM lineitem)"


def sql_leaves(source="voxels", out="leaves") -> str:
    return f"""{out}_m AS (SELECT {sql_morton()} AS m FROM {source}),
{out} AS (SELECT m >> 6 AS tile, CAST(bit_or(CASE WHEN m & 63 < 32 THEN CAST(1 AS BIGINT) << CAST(m & 63 AS INT) ELSE 0 END) AS BIGINT) AS lo,
  CAST(bit_or(CASE WHEN m & 63 >= 32 THEN CAST(1 AS BIGINT) << CAST((m & 63) - 32 AS INT) ELSE 0 END) AS BIGINT) AS hi FROM {out}_m GROUP BY 1)"""


LEAVES = f"{VOXELS},\n{sql_leaves()}"
KIDS = ", ".join(f"c{i}" for i in range(8))


def sql_dag() -> str:
    out = [f"{LEAVES},\nt2 AS (SELECT tile AS morton, min(tile) OVER (PARTITION BY lo, hi) AS id, lo, hi FROM leaves)"]
    for k in range(3, ROOT + 1):
        kids = ", ".join(f"coalesce(max(CASE WHEN morton & 7 = {i} THEN id END), -1) AS c{i}" for i in range(8))
        out.append(f"n{k} AS (SELECT morton >> 3 AS morton, {kids} FROM t{k - 1} GROUP BY 1),\nt{k} AS (SELECT morton, min(morton) OVER (PARTITION BY {KIDS}) AS id, {KIDS} FROM n{k})")
    edges = " UNION ALL ".join(f"SELECT {k} AS level, id AS parent, {i} AS slot, c{i} AS child FROM t{k} WHERE morton = id AND c{i} >= 0" for k in range(3, ROOT + 1) for i in range(8))
    tree = " UNION ALL ".join(f"SELECT {k} AS level, morton, id FROM t{k}" for k in range(2, ROOT + 1))
    return ",\n".join(out) + f",\nedges AS ({edges}),\ntree AS ({tree})"


DAG = sql_dag()
POP = "CAST(bit_count(lo) + bit_count(hi) AS BIGINT)"


# --- scans and keys ---------------------------------------------------------------

@query(f"WITH {VOXELS} SELECT * FROM voxels")
def voxel_scan(spark, sf_dir):
    return voxels(spark, sf_dir)


@query(f"WITH {VOXELS} SELECT x, y, z, {sql_morton()} AS morton, x AS dx, y AS dy, z AS dz, {sql_morton('z', 'y', 'x')} AS reversed FROM voxels")
def morton_encode(spark, sf_dir):
    v = octree.with_morton(voxels(spark, sf_dir))
    return v.select("x", "y", "z", "morton", *[c.alias(f"d{n}") for c, n in zip(m.unmorton3(), "xyz", strict=True)], m.reversed_slots("morton", ROOT).alias("reversed"))


@query(f"WITH {VOXELS} SELECT x, y, {' + '.join(f'(((x >> {i}) & 1) << {2 * i}) + (((y >> {i}) & 1) << {2 * i + 1})' for i in range(ROOT))} AS morton2 FROM (SELECT DISTINCT x, y FROM voxels)")
def morton_encode_2d(spark, sf_dir):
    return voxels(spark, sf_dir).select("x", "y").distinct().withColumn("morton2", m.morton2())


@query(f"""WITH {VOXELS} SELECT level, slot, count(*) AS n FROM (
  SELECT level, CAST(((x >> level) & 1) + 2 * ((y >> level) & 1) + 4 * ((z >> level) & 1) AS INT) AS slot FROM voxels, (SELECT CAST(unnest(range(0, {ROOT})) AS INT) AS level)) GROUP BY 1, 2""")
def child_slots(spark, sf_dir):
    v = voxels(spark, sf_dir)
    each = v.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), m.child_slot(k).alias("slot")) for k in range(ROOT)])).alias("s"))
    return each.groupBy("s.level", "s.slot").agg(F.count("*").alias("n"))


@query(f"WITH {LEAVES} SELECT tile, lo, hi FROM leaves")
def leaf_masks(spark, sf_dir):
    return octree.leaves(cells(spark, sf_dir))


@query(f"WITH {LEAVES} SELECT {POP} AS bits, count(*) AS leaves FROM leaves GROUP BY 1")
def leaf_popcount_hist(spark, sf_dir):
    return octree.leaves(cells(spark, sf_dir)).groupBy(m.popcount().alias("bits")).agg(F.count("*").alias("leaves"))


@query(f"WITH {LEAVES} SELECT lo, hi, count(*) AS uses, min(tile) AS id FROM leaves GROUP BY lo, hi")
def leaf_dedup(spark, sf_dir):
    return octree.leaves(cells(spark, sf_dir)).groupBy("lo", "hi").agg(F.count("*").alias("uses"), F.min("tile").alias("id"))


@query(f"WITH {LEAVES} SELECT CAST({' + '.join(f'(CASE WHEN ({h} >> {8 * i}) & 255 > 0 THEN {1 << (i + 4 * k)} ELSE 0 END)' for k, h in enumerate(('lo', 'hi')) for i in range(4))} AS INT) AS block_mask, count(*) AS n FROM leaves GROUP BY 1")
def leaf_block_masks(spark, sf_dir):
    return octree.leaves(cells(spark, sf_dir)).groupBy(m.block_mask().alias("block_mask")).agg(F.count("*").alias("n"))


@query(f"""WITH {LEAVES}, bits AS (SELECT tile, lo, hi, CAST(unnest(range(0, 64)) AS BIGINT) AS bit FROM leaves),
live AS (SELECT * FROM bits WHERE (CASE WHEN bit < 32 THEN (lo >> CAST(bit AS INT)) & 1 ELSE (hi >> CAST(bit - 32 AS INT)) & 1 END) = 1)
SELECT tile, bit, row_number() OVER (PARTITION BY tile ORDER BY bit) - 1 AS rank FROM live""")
def leaf_bit_ranks(spark, sf_dir):
    bits = octree.leaves(cells(spark, sf_dir)).select("tile", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).withColumn("bit", F.col("b").cast("long"))
    return bits.where(m.has_bit(F.col("bit"))).select("tile", "bit", m.rank(F.col("bit")).alias("rank"))


# --- levels and DAG ---------------------------------------------------------------

@query(f"WITH {DAG} SELECT CAST(level AS INT) AS level, count(*) AS nodes FROM tree GROUP BY 1")
def octree_levels(spark, sf_dir):
    return octree.level_counts(octree.leaves(cells(spark, sf_dir)), ROOT)


@query(f"WITH {DAG} SELECT CAST(level AS INT) AS level, count(*) AS tree_nodes, CAST(sum(CASE WHEN morton = id THEN 1 ELSE 0 END) AS BIGINT) AS dag_nodes FROM tree GROUP BY 1")
def dag_levels(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).level_counts()


@query(f"""WITH {DAG}, c AS (SELECT level, count(*) AS tree_nodes, CAST(sum(CASE WHEN morton = id THEN 1 ELSE 0 END) AS BIGINT) AS dag_nodes FROM tree GROUP BY 1),
e AS (SELECT level, count(*) AS children FROM edges GROUP BY 1)
SELECT CAST(level AS INT) AS level, tree_nodes, dag_nodes, coalesce(children, 0) AS children, round(100.0 * (1 - dag_nodes / tree_nodes), 6) AS saved_percent FROM c LEFT JOIN e USING (level)""")
def svo_vs_dag_stats(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).statistics()


@query(f"WITH {DAG} SELECT CAST(level AS INT) AS level, n_children, count(*) AS n_nodes FROM (SELECT level, parent, count(*) AS n_children FROM edges GROUP BY 1, 2) GROUP BY 1, 2")
def child_count_hist(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).child_histogram()


@query(f"WITH {VOXELS} SELECT count(*) AS voxels FROM voxels")
def voxel_count_by_multiplicity(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).voxel_count()


@query(f"WITH {DAG}, r AS (SELECT CAST(level - 1 AS INT) AS level, child, count(*) AS refs FROM edges GROUP BY 1, 2) SELECT level, child, refs, row_number() OVER (PARTITION BY level ORDER BY refs DESC, child) - 1 AS rank FROM r")
def refcount_rank(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).reference_ranks()


@query(f"""WITH {DAG}, w AS (SELECT level, parent AS id, 1 + count(*) AS words FROM edges GROUP BY 1, 2 UNION ALL SELECT 2, id, 2 FROM t2 WHERE morton = id)
SELECT CAST(level AS INT) AS level, id, CAST(words AS BIGINT) AS words, CAST(sum(words) OVER (PARTITION BY level ORDER BY id) - words AS BIGINT) AS start FROM w""")
def node_word_offsets(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).word_offsets()


@query(f"""WITH {DAG}, m AS (SELECT {sql_morton()} AS m FROM voxels)
SELECT CAST(t.level AS INT) AS level, t.id, count(*) AS voxels FROM tree t JOIN m ON m.m >> (3 * t.level) = t.morton WHERE t.morton = t.id GROUP BY 1, 2""")
def subtree_counts(spark, sf_dir):
    counts = dags.Dag(cells(spark, sf_dir), ROOT).subtree_counts()
    return reduce(DataFrame.unionByName, (d.withColumn("level", F.lit(k)) for k, d in counts.items())).select("level", "id", "voxels")


@query(f"""WITH {DAG}, q AS (SELECT event_id, CAST(event_id % {R} AS BIGINT) AS x, CAST((event_id * 7) % {R} AS BIGINT) AS y, CAST((event_id * 13) % 100 AS BIGINT) AS z FROM events)
SELECT event_id, x, y, z, EXISTS (SELECT 1 FROM voxels v WHERE v.x = q.x AND v.y = q.y AND v.z = q.z) AS found FROM q""")
def member_lookup(spark, sf_dir):
    return octree.members(_probes(spark, sf_dir), cells(spark, sf_dir))


@query(SQL["member_lookup"])
def dag_member_descent(spark, sf_dir):
    return dags.Dag(cells(spark, sf_dir), ROOT).members(_probes(spark, sf_dir))


def _probes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    at = lambda k, n: F.pmod(F.col("event_id") * k, F.lit(n)).cast("long")
    return e.select("event_id", at(1, R).alias("x"), at(7, R).alias("y"), at(13, 100).alias("z"))


@query(f"""WITH {DAG}, keep AS (SELECT DISTINCT child FROM edges WHERE level = 4 AND parent % 2 = 0) SELECT id FROM t3 WHERE morton = id AND id NOT IN (SELECT child FROM keep)""")
def gc_unreferenced(spark, sf_dir):
    d = dags.Dag(cells(spark, sf_dir), ROOT)
    return d.orphans(d.nodes[4].where("id % 2 = 0").select("id"), 4).select("id")


# --- set operators ----------------------------------------------------------------

@query(f"WITH {VOXELS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM voxels")
def bounds(spark, sf_dir):
    return octree.bounds(voxels(spark, sf_dir))


@query(f"WITH {VOXELS}, p AS (SELECT DISTINCT CAST(level AS INT) AS level, x >> level AS x, y >> level AS y, z >> level AS z FROM voxels, (SELECT unnest(range(0, {ROOT + 1})) AS level)) SELECT level, count(*) AS n, CAST(sum(x + y + z) AS BIGINT) AS total FROM p GROUP BY 1")
def downsample_pyramid(spark, sf_dir):
    return octree.pyramid(voxels(spark, sf_dir), ROOT).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("total"))


@query(f"WITH {VOXELS} SELECT CAST(2 * x + (s & 1) AS BIGINT) AS x, CAST(2 * y + ((s >> 1) & 1) AS BIGINT) AS y, CAST(2 * z + (s >> 2) AS BIGINT) AS z FROM (SELECT DISTINCT x >> 2 AS x, y >> 2 AS y, z >> 2 AS z FROM voxels), (SELECT unnest(range(0, 8)) AS s)")
def upsample(spark, sf_dir):
    return octree.upsample(octree.downsample(voxels(spark, sf_dir), 2))


@query(f"""WITH {VOXELS}, pa AS (SELECT DISTINCT CAST(level AS INT) AS level, x >> level AS x, y >> level AS y, z >> level AS z FROM voxels, (SELECT unnest(range(0, 7)) AS level)),
pb AS (SELECT DISTINCT CAST(level AS INT) AS level, x >> level AS x, y >> level AS y, z >> level AS z FROM voxels, (SELECT unnest(range(0, 7)) AS level) WHERE (x + y) % 3 = 0)
SELECT * FROM pa WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.level = pa.level AND pb.x = pa.x AND pb.y = pa.y AND pb.z = pa.z)
  AND EXISTS (SELECT 1 FROM pb WHERE pb.level = pa.level + 1 AND pb.x = pa.x >> 1 AND pb.y = pa.y >> 1 AND pb.z = pa.z >> 1)""")
def level_difference(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return edits.level_difference(octree.pyramid(v, 6), octree.pyramid(v.where("(x + y) % 3 = 0"), 6))


BOX = ((40, 40, 10), (72, 60, 40))
IN_BOX = " AND ".join(f"{c} >= {a} AND {c} < {b}" for c, a, b in zip("xyz", *BOX, strict=True))


@query(f"""WITH {VOXELS}, box AS (SELECT x, y, z FROM (SELECT unnest(range(40, 72)) AS x), (SELECT unnest(range(40, 60)) AS y), (SELECT unnest(range(10, 40)) AS z))
SELECT x, y, z FROM voxels UNION SELECT x, y, z FROM box""")
def box_add(spark, sf_dir):
    return edits.add_region(voxels(spark, sf_dir), edits.box_voxels(spark, *BOX))


@query(f"WITH {VOXELS} SELECT * FROM voxels WHERE NOT ({IN_BOX})")
def box_remove(spark, sf_dir):
    return edits.remove_where(voxels(spark, sf_dir), octree.in_box(*BOX))


SPHERE = "(x + 0.5 - 100) * (x + 0.5 - 100) + (y + 0.5 - 100) * (y + 0.5 - 100) + (z + 0.5 - 50) * (z + 0.5 - 50) < 900"


@query(f"WITH {VOXELS} SELECT * FROM voxels WHERE NOT ({SPHERE})")
def sphere_remove(spark, sf_dir):
    return edits.remove_where(voxels(spark, sf_dir), octree.in_sphere((100, 100, 50), 30))


@query(f"""WITH {VOXELS}, ball AS (SELECT x, y, z FROM (SELECT unnest(range(70, 131)) AS x), (SELECT unnest(range(70, 131)) AS y), (SELECT unnest(range(20, 81)) AS z) WHERE {SPHERE})
SELECT x, y, z FROM voxels UNION SELECT x, y, z FROM ball""")
def sphere_add(spark, sf_dir):
    return edits.add_region(voxels(spark, sf_dir), edits.sphere_voxels(spark, (100, 100, 50), 30, R))


@query(f"WITH {VOXELS} SELECT * FROM voxels UNION SELECT x + 60, y + 80, z + 20 FROM voxels WHERE {IN_BOX}")
def copy_shift(spark, sf_dir):
    return edits.copy_box(voxels(spark, sf_dir), *BOX, (100, 120, 30), R)


@query(f"WITH {VOXELS} SELECT * FROM voxels UNION SELECT x // 2 + 100, y // 2 + 100, z // 2 FROM voxels")
def graft_subtree(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return edits.graft(v, octree.downsample(v), (100, 100, 0))


@query(f"""WITH {VOXELS}, o AS (SELECT i, j, k FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS k) WHERE i <> 0 OR j <> 0 OR k <> 0),
p AS (SELECT x, y, z, x + i AS nx, y + j AS ny, z + k AS nz FROM voxels, o), n AS (SELECT p.x, p.y, p.z FROM p JOIN voxels w ON w.x = nx AND w.y = ny AND w.z = nz)
SELECT x, y, z FROM n GROUP BY x, y, z HAVING count(*) >= 2""")
def erosion_26(spark, sf_dir):
    return edits.erode(voxels(spark, sf_dir), 2)


@query(f"""WITH {VOXELS}, o(nx, ny, nz) AS (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
SELECT x, y, z, nx, ny, nz FROM voxels v, o WHERE NOT EXISTS (SELECT 1 FROM voxels w WHERE w.x = v.x + nx AND w.y = v.y + ny AND w.z = v.z + nz)""")
def exposed_faces_6(spark, sf_dir):
    return edits.exposed_faces(voxels(spark, sf_dir))


@query(f"""WITH {VOXELS}, b AS (SELECT event_id AS box_id, CAST(event_id % {R} AS BIGINT) AS x0, CAST((event_id * 7) % {R} AS BIGINT) AS y0, CAST((event_id * 13) % 100 AS BIGINT) AS z0 FROM events),
-- cells of 16 that a box of five may meet
c AS (SELECT DISTINCT box_id, x0, y0, z0, (x0 + i) >> 4 AS cx, (y0 + j) >> 4 AS cy, (z0 + k) >> 4 AS cz FROM b, (VALUES (0), (4)) a(i), (VALUES (0), (4)) d(j), (VALUES (0), (4)) e(k)),
h AS (SELECT DISTINCT box_id FROM c JOIN (SELECT *, x >> 4 AS cx, y >> 4 AS cy, z >> 4 AS cz FROM voxels) USING (cx, cy, cz) WHERE x >= x0 AND x < x0 + 5 AND y >= y0 AND y < y0 + 5 AND z >= z0 AND z < z0 + 5)
SELECT box_id, box_id NOT IN (SELECT box_id FROM h) AS is_empty FROM b""")
def region_empty(spark, sf_dir):
    b = _probes(spark, sf_dir).select(F.col("event_id").alias("box_id"), *[F.col(c).alias(f"{c}0") for c in "xyz"], *[(F.col(c) + 5).alias(f"{c}1") for c in "xyz"])
    return octree.boxes_empty(b, voxels(spark, sf_dir))


def _solid(spark, sf_dir):
    return edits.add_region(voxels(spark, sf_dir), edits.box_voxels(spark, *BOX))


SOLID = f"{VOXELS}, solid AS (SELECT x, y, z FROM voxels UNION SELECT x, y, z FROM (SELECT unnest(range(40, 72)) AS x), (SELECT unnest(range(40, 60)) AS y), (SELECT unnest(range(10, 40)) AS z))"


@query(f"WITH {SOLID}, {sql_leaves('solid', 'sl')} SELECT tile FROM sl WHERE bit_count(lo) + bit_count(hi) = 64")
def full_leaves(spark, sf_dir):
    return octree.full_leaves(octree.leaves(_solid(spark, sf_dir))).select("tile")


@query(f"WITH {SOLID} SELECT x, y, z FROM solid WHERE {IN_BOX}")
def region_readout(spark, sf_dir):
    leaf = octree.leaves_in_box(octree.leaves(_solid(spark, sf_dir)), *BOX, ROOT)
    return octree.voxels_of_leaves(leaf).where(octree.in_box(*BOX))


@query(f"WITH {VOXELS} SELECT x, y, z, row_number() OVER (ORDER BY {sql_morton()}) - 1 AS rank FROM voxels")
def depth_first_rank(spark, sf_dir):
    return dags.depth_first_rank(voxels(spark, sf_dir))


@query(f"""WITH {VOXELS}, g AS (SELECT *, x - lag(x) OVER (PARTITION BY y, z ORDER BY x) AS gap FROM voxels), r AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY y, z ORDER BY x) AS run FROM g)
SELECT y, z, min(x) AS x_first, max(x) AS x_last, count(*) AS n FROM r GROUP BY y, z, run""")
def runs_along_x(spark, sf_dir):
    w = W.partitionBy("y", "z").orderBy("x")
    gaps = edits.voxel_window(voxels(spark, sf_dir)).withColumn("run", F.sum(F.when(F.col("gap") == 1, 0).otherwise(1)).over(w))
    return gaps.groupBy("y", "z", "run").agg(F.min("x").alias("x_first"), F.max("x").alias("x_last"), F.count("*").alias("n")).drop("run")


@query(f"""WITH {VOXELS}, {sql_leaves()}, e AS (SELECT x, y, z FROM voxels WHERE NOT ({IN_BOX})), {sql_leaves('e', 'el')}
SELECT CAST(v.version AS INT) AS version, count(*) AS leaves, CAST(sum(bit_count(lo) + bit_count(hi)) AS BIGINT) AS voxels FROM (
  SELECT 0 AS version, * FROM leaves UNION ALL SELECT 1, * FROM el UNION ALL SELECT 2, * FROM leaves UNION ALL SELECT 3, * FROM el) v GROUP BY 1""")
def undo_redo(spark, sf_dir):
    v = edits.Versions.of(voxels(spark, sf_dir))
    v.commit(edits.remove_where(v.voxels(), octree.in_box(*BOX)))
    v.undo()
    undone = v.state()
    v.redo()
    states = [(0, v.state(0)), (1, v.state(1)), (2, undone), (3, v.state())]
    each = reduce(DataFrame.unionByName, (s.withColumn("version", F.lit(k)) for k, s in states))
    return each.groupBy("version").agg(F.count("*").alias("leaves"), F.sum(m.popcount()).alias("voxels"))
