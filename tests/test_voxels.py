"""Voxel operators: properties, round trips and known constants."""

import random

import numpy as np
import pytest

from voxlake.functions import bits, huffman, symmetries
from voxlake.functions import morton as m
from voxlake.operators import dag as dags, edits, encode, images, octree, palette, rays, symmetric, translation, voxelize
from voxlake.sources import meshes, replay, structures

XYZ = "x long, y long, z long"


def grid(spark, seed=0, side=16, share=0.3):
    r = random.Random(seed)
    base = [(x, y, z) for x in range(side // 2) for y in range(side // 2) for z in range(side // 2) if r.random() < share]
    moved = [(side - 1 - x, y, z) for x, y, z in base] + [(x, side // 2 + z, y) for x, y, z in base if y < side // 2]
    cells = sorted(set(base + moved))
    return cells, spark.createDataFrame(cells, XYZ)


def cells_of(df):
    return sorted(tuple(r) for r in df.select("x", "y", "z").collect())


@pytest.fixture(scope="module")
def built(spark):
    cells, v = grid(spark)
    return cells, v, dags.Dag(v, 4)


def test_morton_round_trip(spark):
    top = (1 << 21) - 1
    pts = [(0, 0, 0), (1, 2, 3), (top, 0, top), (123456, 654321, 1048575), (top, top, top)]
    got = spark.createDataFrame(pts, XYZ).withColumn("k", m.morton3()).select("x", "y", "z", "k", *[c.alias(f"d{i}") for i, c in enumerate(m.unmorton3("k"))]).collect()
    for r in got:
        assert r.k == sum((v >> i & 1) << (3 * i + a) for i in range(21) for a, v in enumerate((r.x, r.y, r.z)))
        assert (r.d0, r.d1, r.d2) == (r.x, r.y, r.z)


def test_dag_members_counts_and_words(spark, built):
    cells, v, d = built
    every = spark.createDataFrame([(x, y, z) for x in range(16) for y in range(16) for z in range(16)] + [(16, 0, 0)], XYZ)
    inside = set(cells)
    for found in (octree.members(every, v), d.members(every), encode.svdag32_members(encode.svdag32_words(d), every, 4)):
        assert all(r.found == ((r.x, r.y, r.z) in inside) for r in found.collect())
    assert d.voxel_count().first()[0] == len(cells)
    assert d.subtree_counts()[4].first()["voxels"] == len(cells)
    counts = {r.level: r for r in d.level_counts().collect()}
    assert counts[4].tree_nodes == 1 and all(r.dag_nodes <= r.tree_nodes for r in counts.values())
    assert cells_of(encode.decoded16(encode.no_transform16(d), 4)) == cells


@pytest.mark.parametrize("group", ["identity", "mirror", "axes", "all"])
def test_symmetric_round_trip(spark, built, group):
    cells, _, d = built
    sym = symmetric.SymmetricDag(d, symmetric.GROUPS[group])
    assert cells_of(encode.symmetric_voxels(sym)) == cells
    counts = {r.level: r for r in sym.counts().collect()}
    assert all(r.classes <= r.dag_nodes for r in counts.values())
    if group == "identity":
        assert all(r.classes == r.dag_nodes for r in counts.values())


def test_symmetric_classes_match_dense_grids(spark, built):
    _, _, d = built
    sym = {r.id: r.cid for r in symmetric.SymmetricDag(d, symmetric.GROUPS["all"]).classes[3].collect()}
    dense = {r.id: translation.unpacked(r.cells, 8) for r in translation.flattened(d, 3).collect()}
    key = {i: min(translation.packed(translation.transformed_grid(g, t)) for t in range(48)) for i, g in dense.items()}
    for a in key:
        for b in key:
            assert (key[a] == key[b]) == (sym[a] == sym[b])


def test_mask_class_constants(spark):
    got = {r.study: r.classes for r in symmetric.class_counts(spark).collect()}
    assert got == {"identity": 256, "mirror": 46, "axes": 80, "all": 22, "slots": 9}


def test_transform_tables():
    p, compose, inverse = symmetries.slots(), symmetries.composed(), symmetries.inverses()
    for a in range(48):
        assert compose[a][inverse[a]] == 0
        for b in range(0, 48, 7):
            assert (p[compose[a][b]] == p[a][p[b]]).all()
    for handle, g, t in ((0, 0, (0, 0, 0)), ((1 << 37) - 1, 47, (-32, 31, 5)), (12345, 17, (3, -4, 0))):
        assert symmetries.decode_pointer(symmetries.encode_pointer(handle, g, t)) == (handle, g, t)
    for rank in (0, 1, 5039, 40319, 777):
        assert symmetries.permutation_rank(symmetries.permutation_at(rank, 8)) == rank


def test_huffman_vectors():
    assert huffman.code_lengths([10, 6, 2, 1, 1, 1]) == [1, 2, 4, 4, 4, 4]
    got = huffman.limited_lengths([20, 17, 6, 3, 2, 2, 2, 1, 1, 1], 5)
    assert sorted(got) == sorted([2, 2, 3, 4, 4, 4, 4, 5, 5, 4]) and huffman.kraft(got) == 1
    codes = huffman.code_words([1, 2, 4, 5, 5, 5, 5, 5, 6, 6])
    assert codes == ["0", "10", "1100", "11010", "11011", "11100", "11101", "11110", "111110", "111111"]
    table = huffman.DecodeTable(codes)
    for i, c in enumerate(codes):
        assert table.decode(huffman.reversed_bits(c)) == (i, len(c))


def test_bit_streams():
    r = random.Random(1)
    for widths in ([16] * 128, [3] * 128, [r.randint(1, 16) for _ in range(128)]):
        values = [r.randrange(1 << w) for w in widths]
        a, b = bits.BitWriter(), bits.BitWriter()
        for i, (v, w) in enumerate(zip(values, widths, strict=True)):
            (a if i < 64 else b).append(v, w)
        reader = bits.BitReader(a.extend(b).to_bytes(4))
        assert [reader.read(w) for w in widths] == values


def test_translation(spark):
    r = np.random.default_rng(0)
    grids = [r.random((4, 4, 4)) < 0.5 for _ in range(4)]
    grids += [translation.shifted_grid(grids[0], t) for t in ((1, 0, 0), (0, -1, 2), (-2, 1, 1))] + [translation.shifted_grid(grids[1], (1, 1, -1))]
    table = spark.createDataFrame([(i, 4, translation.packed(g)) for i, g in enumerate(grids)], "id long, side int, cells binary")
    best = {x.child: x for x in translation.best_parents(table, 4).collect()}
    shifts = [(a, b, c) for a in range(-3, 4) for b in range(-3, 4) for c in range(-3, 4)]
    for i, g in enumerate(grids):
        able = [j for j, h in enumerate(grids) for t in shifts if (translation.shifted_grid(h, t) == g).all()]
        want = min(able, key=lambda j: (-grids[j].sum(), j))
        assert best[i].parent == want
        assert (translation.shifted_grid(grids[want], (best[i].tx, best[i].ty, best[i].tz)) == g).all()
    kept = {x.id for x in translation.kept_items(translation.best_parents(table, 4)).collect()}
    assert {x.target for x in translation.mapping(translation.best_parents(table, 4)).collect()} <= kept


def test_files_round_trip(spark, built, tmp_path):
    cells, _, d = built
    for name, write in (("a.svo", structures.write_svo), ("a.svdag", structures.write_svdag)):
        path = str(tmp_path / name)
        assert write(d, path) == (tmp_path / name).stat().st_size
        assert cells_of(structures.structure_voxels(structures.read_structures(spark, path), 4)) == cells


def test_edits_and_versions(spark, built):
    cells, v, _ = built
    store = edits.Versions.of(v)
    box = octree.in_box((2, 2, 2), (7, 9, 11))
    store.commit(edits.remove_where(store.voxels(), box))
    left = [c for c in cells if not (2 <= c[0] < 7 and 2 <= c[1] < 9 and 2 <= c[2] < 11)]
    assert cells_of(store.voxels()) == left
    store.undo()
    assert cells_of(store.voxels()) == cells
    store.redo()
    assert cells_of(store.voxels()) == left and cells_of(store.collected().voxels()) == left
    assert edits.check_leaves(store.state()).count() == 0
    near = {c: sum((c[0] + i, c[1] + j, c[2] + k) in set(cells) for i, j, k in edits.OFFSETS_26) for c in cells}
    assert cells_of(edits.erode(v, 3)) == sorted(c for c, n in near.items() if n >= 3)


def test_edit_expansion_covers_region(spark):
    got = edits.expand_edit(spark, 4, edits.sphere_region((8.0, 8.0, 8.0), 5.0), stop=0).collect()
    filled = {(r.x + i, r.y + j, r.z + k) for r in got if r.verdict == "fill" for i in range(1 << r.level) for j in range(1 << r.level) for k in range(1 << r.level)}
    assert filled == set(cells_of(edits.sphere_voxels(spark, (8, 8, 8), 5.0, 16)))


def test_flood_fill(spark):
    wall = [(x, y, z) for x in range(5) for y in range(5) for z in range(5) if 0 in (x, y, z) or 4 in (x, y, z)]
    out = edits.flood_fill(spark.createDataFrame(wall, XYZ), (2, 2, 2), (0, 0, 0), (8, 8, 8))
    assert len(cells_of(out)) == 125


def test_tile_ranges_cover_boxes():
    key = lambda p: sum((v >> b & 1) << (3 * b + i) for i, v in enumerate(p) for b in range(21))
    ranges = octree.tile_ranges((5, 9, 2), (30, 20, 17), 6)
    for x in range(5, 30):
        for y in range(9, 20):
            for z in range(2, 17):
                k = key((x >> 2, y >> 2, z >> 2))
                assert any(a <= k < b for a, b in ranges)


def cube_triangles(spark, lo, hi):
    def quad(a, b, c, d):
        return [(a, b, c), (a, c, d)]

    p = [(x, y, z) for x in (lo, hi) for y in (lo, hi) for z in (lo, hi)]
    faces = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tris = [t for f in faces for t in quad(*(p[i] for i in f))]
    rows = [(0, i, *map(float, a + b + c)) for i, (a, b, c) in enumerate(tris)]
    return spark.createDataFrame(rows, "mesh int, tri long, " + ", ".join(f"{c} double" for c in voxelize.CORNERS))


def test_voxelize(spark):
    t = cube_triangles(spark, 2.25, 9.75)
    solid = {(x, y, z) for x in range(2, 10) for y in range(2, 10) for z in range(2, 10)}
    assert set(cells_of(voxelize.solid(t, 16))) == solid
    shell = {c for c in solid if 2 in c or 9 in c}
    assert set(cells_of(voxelize.surface(t, 16))) == shell
    assert set(cells_of(voxelize.surface(t, 16, conservative=False))) <= shell
    n = voxelize.normalised(t, 16).selectExpr("min(least(ax,bx,cx)) lo", "max(greatest(az,bz,cz)) hi").first()
    assert (round(n.lo, 9), round(n.hi, 9)) == (0, 16)


def test_rays_against_brute_force(spark, built):
    cells, v, _ = built
    r = np.random.default_rng(4)
    made = []
    for i in range(60):
        o, d = r.uniform(-8, 24, 3), r.normal(size=3)
        d = d / np.linalg.norm(d) if i % 6 else np.eye(3)[i % 3] * (1 if i % 4 else -1)
        made.append((i, *map(float, o), *map(float, d), 0.0, 100.0))
    table = spark.createDataFrame(made, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    got = {h.ray_id: h for h in rays.first_hits(table, v, 16).collect()}
    seen = {h.ray_id: h.hit for h in rays.any_hits(table, v, 16).collect()}
    for i, *x in made:
        o, d = np.array(x[:3]), np.array(x[3:6])
        best = None
        for c in cells:
            lo, hi = np.array(c, float), np.array(c) + 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (lo - o) / d, (hi - o) / d
            within = (o >= lo) & (o < hi)
            near = np.where(d == 0, np.where(within, -np.inf, np.inf), np.minimum(a, b)).max()
            far = np.where(d == 0, np.where(within, np.inf, -np.inf), np.maximum(a, b)).min()
            t = max(near, 0.0)
            if t < far and (best is None or (t, *c) < best):
                best = (t, *c)
        assert seen[i] == (best is not None)
        if best is None:
            assert i not in got
        else:
            assert abs(got[i].t - best[0]) < 1e-9


def test_replay_log(spark):
    lines = ["EditSphere,1,2,3,4.5,true,7", "EditCube,1,2,3,4,FALSE,,", "EndFrame", "EditCopy,1,2,3,4,5,6,7,8,9,10", "Nope,1", "EditFill,1", "Undo", "EndFrame"]
    log = replay.parse(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))
    got = {r.seq: r for r in log.collect()}
    assert (got[0].action, got[0].radius, got[0].add, got[0].material, got[1].add, got[1].material) == ("sphere", 4.5, True, 7, False, 4)
    assert (got[3].frame, got[3].sx, got[3].dz, got[3].radius, got[4].fault, got[5].fault) == (1, 4.0, 9.0, 10.0, "action", "arguments")
    good = log.where("fault is null")
    again = replay.parse(replay.lines_of(good))
    assert sorted(map(str, again.drop("frame").collect())) == sorted(map(str, good.drop("frame").collect()))


def test_palette_and_streams(spark, built):
    cells, v, _ = built
    colored = v.selectExpr("x", "y", "z", "floor(x / 8) / 2.0 as r", "0.5 as g", "floor(z / 8) / 2.0 as b")
    stream = palette.color_stream(colored)
    runs = palette.run_blocks(stream)
    assert runs.selectExpr("sum(length) n").first().n == len(cells)
    looked = palette.lookup_colors(stream.select("rank"), runs).join(stream.withColumnRenamed("color", "was"), "rank").where("color <> was")
    assert looked.count() == 0
    back = palette.block_colors(palette.weight_blocks(stream)).join(stream, "rank")
    assert back.count() == len(cells)
    table = spark.createDataFrame([(i, i / 4, 0.5, 0.0) for i in range(4)], "material int, r double, g double, b double")
    assert palette.reduced_palette(colored, table, 2).count() == 2


def test_images(spark):
    image = spark.createDataFrame([(x, y, float(10 * x + y)) for x in range(2) for y in range(3)], "x long, y long, value double")
    at = spark.createDataFrame([(0.25, 1 / 6), (0.5, 0.5), (1.25, -5 / 6)], "u double, v double")
    assert [r.value for r in images.sample(at, image, 2, 3, bilinear=False).orderBy("u").collect()] == [0.0, 11.0, 0.0]
    assert [round(r.value, 6) for r in images.sample(at, image, 2, 3).orderBy("u").collect()] == [0.0, 6.0, 0.0]
    assert images.min_max_levels(image, 2).where("level = 2").first()["high"] == 12.0


def test_obj_round_trip(spark, tmp_path):
    _, v = grid(spark, side=4, share=0.6)
    vertices, quads = voxelize.faces_mesh(edits.exposed_faces(v))
    path = str(tmp_path / "mesh")
    meshes.write_obj(vertices, quads, path)
    read = meshes.read_obj(spark, path + "/part-*")
    assert read.count() == 2 * quads.count()
    assert cells_of(voxelize.solid(read.withColumn("mesh", read.tri.cast("int")), 4)) == cells_of(v)
    doc = '{"materials": [{"extras": {"metadata": {"lightmapTexture": {"index": 3}}}}, {}]}'
    assert '"occlusionTexture": {"index": 3}' in meshes.light_maps_to_occlusion(doc)
