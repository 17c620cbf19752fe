"""Table shapes that the operators exchange, as DDL."""

VOXELS = "x bigint, y bigint, z bigint"
LEAVES = "tile bigint, lo bigint, hi bigint"
NODES = "level int, morton bigint, " + ", ".join(f"c{i} bigint" for i in range(8))
TRIANGLES = "mesh int, tri bigint, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz")
RAYS = "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double"
HITS = "ray_id bigint, x bigint, y bigint, z bigint, axis int, t double"
EDITS = (
    "seq bigint, frame int, action string, x double, y double, z double, radius double, size double, add boolean, material int, "
    "sx double, sy double, sz double, dx double, dy double, dz double, min_neighbors int"
)
PALETTE = "material int, r double, g double, b double"
CHILDREN = [f"c{i}" for i in range(8)]
#: A missing child, where null would make a join key.
NO_CHILD = -1
