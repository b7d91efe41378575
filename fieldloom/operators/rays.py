"""Ray queries: generation, nearest hits on triangles, spheres and cylinders, shadow, ambient occlusion, shading, volume compositing.

rays: ray_id, ox, oy, oz, dx, dy, dz (unit direction). A hit table has ray_id, kind, idx (-1: none), dist, u, v.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import vector as v3
from fieldloom.shared import settle

#: Primitives that may go to every task; more are met by bins. Distance beyond which nothing is hit.
SMALL, FAR, EPS = 256, 1e6, 1e-9
#: Bins an axis at most; pieces of rays that may go to every task.
BINS, PIECES = 1024, 100_000
#: Columns that say where a primitive is.
PLACE = {"triangle": tuple(f"{p}{a}" for p in "abc" for a in "xyz"), "sphere": ("cx", "cy", "cz", "r"), "cylinder": (*(f"{p}{a}" for p in "ba" for a in "xyz"), "h", "r")}


def camera_rays(spark: SparkSession, w: int, h: int, eye, look, dx, dy) -> DataFrame:
    """One ray a pixel: look + dx * (2i - w)/2 + dy * (2j - h)/2, of unit length."""
    r = spark.range(w * h).withColumnRenamed("id", "ray_id")
    i, j = F.col("ray_id") % w, F.floor(F.col("ray_id") / w)
    d = [F.lit(float(look[k])) + F.lit(float(dx[k])) * ((2 * i - w) / 2.0) + F.lit(float(dy[k])) * ((2 * j - h) / 2.0) for k in range(3)]
    d = v3.normalize(d)
    return r.select("ray_id", *(F.lit(float(e)).alias(n) for e, n in zip(eye, ("ox", "oy", "oz"))), *(c.alias(n) for c, n in zip(d, ("dx", "dy", "dz"))))


def _ray() -> tuple[v3.Vec, v3.Vec]:
    return [F.col(c) for c in ("ox", "oy", "oz")], [F.col(c) for c in ("dx", "dy", "dz")]


def _p(*names: str) -> v3.Vec:
    return [F.col(n) for n in names]


def _boxes(prims: DataFrame, kind: str) -> list[tuple[Column, Column]]:
    if kind == "triangle":
        return [(F.least(*(f"{p}{a}" for p in "abc")), F.greatest(*(f"{p}{a}" for p in "abc"))) for a in "xyz"]
    if kind == "sphere":
        return [(F.col(f"c{a}") - F.col("r"), F.col(f"c{a}") + F.col("r")) for a in "xyz"]
    end = [F.col(f"b{a}") + F.col(f"a{a}") * F.col("h") for a in "xyz"]
    return [(F.least(F.col(f"b{a}"), e) - F.col("r"), F.greatest(F.col(f"b{a}"), e) + F.col("r")) for a, e in zip("xyz", end)]


class Scene(dict):
    """Primitives by kind as `once` gives them."""


def once(scene: dict[str, DataFrame]) -> Scene:
    """The scene with each place once, written down. Primitives in one place are hit at one distance, and of those the least idx counts, so
    the others change no result; a primitive with a null or NaN in its place is never hit."""
    if isinstance(scene, Scene):
        return scene
    return Scene({k: settle(p.sparkSession, p.dropna(subset=list(PLACE[k])).groupBy(*PLACE[k]).agg(F.min("idx").alias("idx")), "scene") for k, p in scene.items()})


def candidates(rays: DataFrame, prims: DataFrame, kind: str, far: float = FAR, small: int = SMALL) -> DataFrame:
    """Pairs of rays and primitives that may meet. At most `small` primitives (counted) go to every task; more are dealt to the cells of a
    uniform grid that their boxes touch, rays to the cells they pass, and the two meet by an equi-join on cells: the rays' pieces go to every
    task if they are at most PIECES (counted), else both sides are sorted. The primitives' cells are never sent whole: Spark takes them for as
    few as the primitives."""
    boxes = _boxes(prims, kind)
    ext = prims.agg(F.count(F.lit(1)).alias("n"), *(F.min(lo).alias(f"l{a}") for (lo, _), a in zip(boxes, "xyz")), *(F.max(hi).alias(f"h{a}") for (_, hi), a in zip(boxes, "xyz")), *(F.avg(hi - lo).alias(f"w{a}") for (lo, hi), a in zip(boxes, "xyz"))).first()
    if ext.n <= small:
        return rays.join(F.broadcast(prims))
    low, size = [ext[f"l{a}"] for a in "xyz"], [max(ext[f"h{a}"] - ext[f"l{a}"], 1e-9) for a in "xyz"]
    wide = [s for s in size if s > 1e-6 * max(size)]  # about one cell a primitive, none narrower than their mean box; flat axes have one
    edge = max((math.prod(wide) / ext.n) ** (1 / len(wide)), max(size) / BINS)
    nb = [max(1, round(s / max(edge, ext[f"w{a}"]))) for s, a in zip(size, "xyz")]
    width = [s / k for s, k in zip(size, nb)]
    piece = min((w for w, k in zip(width, nb) if k > 1), default=max(size))
    steps = [max(1, math.ceil(s / piece)) for s in size]  # a ray is cut along its main axis into pieces no longer than a cell
    cell = lambda c, k: F.least(F.greatest(F.floor((c - low[k]) / width[k]), F.lit(-1)), F.lit(nb[k])).cast("int")
    p = prims.repartition(max(1, min(ext.n // 1000, prims.sparkSession.sparkContext.defaultParallelism * 4)), "idx")
    for k, (lo, hi) in enumerate(boxes):
        p = p.withColumn(f"_b{k}", F.explode(F.sequence(F.greatest(cell(lo, k), F.lit(0)), F.least(F.greatest(cell(hi, k), F.lit(0)), F.lit(nb[k] - 1)))))
    o, d = _ray()
    mag = [F.abs(x) for x in d]
    major = F.when((mag[0] >= mag[1]) & (mag[0] >= mag[2]), 0).when(mag[1] >= mag[2], 1).otherwise(2)
    pick = lambda v: F.when(F.col("_m") == 0, v[0]).when(F.col("_m") == 1, v[1]).otherwise(v[2])
    r = rays.withColumn("_m", major)
    r = r.withColumn("_k", F.explode(F.sequence(F.lit(0), pick([F.lit(k - 1) for k in steps]))))
    step = pick([F.lit(s / k) for s, k in zip(size, steps)])
    at = pick([F.lit(x) for x in low]) + F.col("_k") * step
    t1, t2 = F.try_divide(at - pick(o), pick(d)), F.try_divide(at + step - pick(o), pick(d))  # a ray without direction meets nothing
    r = r.withColumn("_t0", F.greatest(F.least(t1, t2), F.lit(0.0))).withColumn("_t1", F.least(F.greatest(t1, t2), F.lit(far))).where("_t1 >= _t0")
    for k in range(3):
        a, b = o[k] + d[k] * F.col("_t0"), o[k] + d[k] * F.col("_t1")
        slack = F.lit(width[k] * 1e-9)
        lo, hi = F.greatest(cell(F.least(a, b) - slack, k), F.lit(0)), F.least(cell(F.greatest(a, b) + slack, k), F.lit(nb[k] - 1))
        r = r.withColumn(f"_r{k}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    r = settle(prims.sparkSession, r.drop("_m", "_k", "_t0", "_t1").dropDuplicates(["ray_id", "_r0", "_r1", "_r2"]), "pieces")
    r, p = (F.broadcast(r), p) if r.count() <= PIECES else (r, p.hint("merge"))
    joined = r.join(p, (F.col("_r0") == F.col("_b0")) & (F.col("_r1") == F.col("_b1")) & (F.col("_r2") == F.col("_b2")))
    return joined.drop(*(f"_{x}{k}" for x in "rb" for k in range(3)))


def triangle_hits(df: DataFrame, far: Column) -> DataFrame:
    """Moeller-Trumbore on columns ax..cz: pairs that meet, with dist, u, v."""
    o, d = _ray()
    a, b, c = (_p(*(f"{p}{x}" for x in "xyz")) for p in "abc")
    e1, e2 = v3.sub(b, a), v3.sub(c, a)
    pv = v3.cross(d, e2)
    det = v3.dot(e1, pv)
    tv = v3.sub(o, a)
    ok = F.abs(det) > EPS
    inv = F.when(ok, F.lit(1.0) / det)
    u = v3.dot(tv, pv) * inv
    qv = v3.cross(tv, e1)
    v = v3.dot(d, qv) * inv
    t = v3.dot(e2, qv) * inv
    return df.where(ok & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > EPS) & (t < far)).withColumns({"dist": t, "u": u, "v": v})


def sphere_hits(df: DataFrame, far: Column) -> DataFrame:
    """Columns cx, cy, cz, r. An origin inside is no hit."""
    o, d = _ray()
    to = v3.sub(_p("cx", "cy", "cz"), o)
    b = v3.dot(to, d)
    d2 = v3.dot(to, to) - b * b
    r2 = F.col("r") * F.col("r")
    t = b - F.sqrt(F.greatest(r2 - d2, F.lit(0.0)))
    return df.where((b >= 0) & (d2 <= r2) & (t > 0) & (t < far)).withColumns({"dist": t, "u": F.lit(0.0), "v": F.lit(0.0)})


def cylinder_hits(df: DataFrame, far: Column) -> DataFrame:
    """Columns bx, by, bz (base), ax, ay, az (unit axis), h, r; open ends; both crossings of the wall. u is the place along the axis, 0 to 1."""
    o, d = _ray()
    axis = _p("ax", "ay", "az")
    df, rel = let(df, "rel", v3.sub(o, _p("bx", "by", "bz")))
    df = df.withColumns({"_da": v3.dot(d, axis), "_ra": v3.dot(rel, axis)})
    df, dp = let(df, "dp", v3.sub(d, v3.scale(axis, F.col("_da"))))
    df, op = let(df, "op", v3.sub(rel, v3.scale(axis, F.col("_ra"))))
    df = df.withColumns({"_qa": v3.dot(dp, dp), "_qb": 2 * v3.dot(dp, op), "_qc": v3.dot(op, op) - F.col("r") * F.col("r")})
    df = df.withColumn("_s", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_disc", F.col("_qb") * F.col("_qb") - 4 * F.col("_qa") * F.col("_qc"))
    root = F.when((F.col("_qa") > EPS) & (F.col("_disc") >= 0), (-F.col("_qb") + F.col("_s") * F.sqrt(F.greatest("_disc", F.lit(0.0)))) / (2 * F.col("_qa")))
    df = df.withColumn("dist", root).withColumn("_along", F.col("_ra") + F.col("dist") * F.col("_da"))
    return df.where((F.col("dist") > EPS) & (F.col("dist") < far) & (F.col("_along") > 0) & (F.col("_along") < F.col("h"))).withColumns({"u": F.col("_along") / F.col("h"), "v": F.lit(0.0)})


_HITS = {"triangle": triangle_hits, "sphere": sphere_hits, "cylinder": cylinder_hits}


def hits(rays: DataFrame, prims: DataFrame, kind: str, far: float = FAR, small: int = SMALL) -> DataFrame:
    """Every hit: ray_id, kind, idx, dist, u, v."""
    return _HITS[kind](candidates(rays, prims, kind, far, small), F.lit(far)).select("ray_id", F.lit(kind).alias("kind"), "idx", "dist", "u", "v")


def nearest(rays: DataFrame, scene: dict[str, DataFrame], far: float = FAR, small: int = SMALL) -> DataFrame:
    """The nearest hit of each ray over all kinds; idx -1, dist, u, v 0 and kind null for a miss. Ties: kind, then idx."""
    rows = None
    for kind, prims in once(scene).items():
        h = hits(rays, prims, kind, far, small)
        rows = h if rows is None else rows.unionByName(h)
    best = rows.groupBy("ray_id").agg(F.min(F.struct("dist", "kind", "idx", "u", "v")).alias("m"))
    out = rays.select("ray_id").join(best, "ray_id", "left")
    zero = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0.0)).alias(c)
    return out.select("ray_id", F.col("m.kind").alias("kind"), F.coalesce("m.idx", F.lit(-1)).cast("long").alias("idx"), zero("dist"), zero("u"), zero("v"))


def let(df: DataFrame, name: str, v: v3.Vec) -> tuple[DataFrame, v3.Vec]:
    """Name a vector's parts as columns, so that expressions over it stay small."""
    return df.withColumns({f"_{name}{a}": c for a, c in zip("xyz", v)}), _p(*(f"_{name}{a}" for a in "xyz"))


def hit_points(rays: DataFrame, found: DataFrame) -> DataFrame:
    """Rays that hit, with the hit and its place px, py, pz."""
    j = rays.join(found.where("idx >= 0"), "ray_id")
    return j.withColumns({f"p{a}": F.col(f"o{a}") + F.col(f"d{a}") * F.col("dist") for a in "xyz"})


def triangle_normals(tris: DataFrame) -> DataFrame:
    a, b, c = (_p(*(f"{p}{x}" for x in "xyz")) for p in "abc")
    n = v3.normalize(v3.cross(v3.sub(b, a), v3.sub(c, a)))
    return tris.select("idx", *(x.alias(f"n{k}") for x, k in zip(n, "xyz")))


def shadow(rays: DataFrame, points: DataFrame, scene: dict[str, DataFrame], light, small: int = SMALL) -> DataFrame:
    """ray_id, lit (0 or 1) for every ray: 0 if it missed or anything stands between its hit and the light."""
    to = [F.lit(float(light[k])) - F.col(f"p{a}") for k, a in enumerate("xyz")]
    points, to = let(points, "to", to)
    points = points.withColumn("_len", v3.norm(to))
    length = F.col("_len")
    points, d = let(points, "d", [F.when(length > 0, x / length) for x in to])
    rays2 = points.select("ray_id", *((F.col(f"p{a}") + x * 1e-4).alias(f"o{a}") for a, x in zip("xyz", d)), *(x.alias(f"d{a}") for a, x in zip("xyz", d)), (length - 1e-4).alias("reach"))
    rays2 = settle(rays.sparkSession, rays2, "rays")
    dark = None
    for kind, prims in once(scene).items():
        h = _HITS[kind](candidates(rays2, prims, kind, FAR, small), F.col("reach")).select("ray_id")
        dark = h if dark is None else dark.union(h)
    lit = points.select("ray_id").join(dark.distinct(), "ray_id", "left_anti").withColumn("lit", F.lit(1))
    return rays.select("ray_id").join(lit, "ray_id", "left").select("ray_id", F.coalesce("lit", F.lit(0)).alias("lit"))


def radical_inverse(k: Column, base: int, most: int) -> Column:
    """Digits of k in the base, mirrored at the point; k is at most `most`."""
    digits = next(n for n in range(1, 64) if base**n > most)
    return sum((F.floor(k / base**i) % base / float(base ** (i + 1)) for i in range(digits)), F.lit(0.0))


def occlusion_rays(points: DataFrame, samples: int, seed: int | None = None) -> DataFrame:
    """ray_id, pixel: cosine-weighted directions about each hit's normal (nx, ny, nz), turned by a hash of (pixel, seed) if there is one."""
    s = points.withColumnRenamed("ray_id", "pixel").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    turn = F.lit(0.0) if seed is None else F.pmod(F.xxhash64("pixel", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    s = s.withColumns({"_u": radical_inverse(F.col("k"), 2, samples), "_phi": (radical_inverse(F.col("k"), 3, samples) + turn) * (2 * math.pi)})
    n = _p("nx", "ny", "nz")
    flat = F.abs(n[0]) > 0.9  # the frame's other axis: x, or y where the normal is near x
    up = [F.when(flat, 0.0).otherwise(1.0), F.when(flat, 1.0).otherwise(0.0), F.lit(0.0)]
    s, t = let(s, "c", v3.cross(up, n))
    s, t = let(s, "t", v3.normalize(t))
    s, b = let(s, "b", v3.cross(n, t))
    r = F.sqrt("_u")
    s = s.withColumns({"_p": r * F.cos("_phi"), "_q": r * F.sin("_phi"), "_w": F.sqrt(1.0 - F.col("_u"))})
    s, d = let(s, "d", v3.add(v3.add(v3.scale(t, F.col("_p")), v3.scale(b, F.col("_q"))), v3.scale(n, F.col("_w"))))
    return s.select(((F.col("pixel") * samples) + F.col("k") - 1).alias("ray_id"), "pixel", *((F.col(f"p{a}") + x * 1e-4).alias(f"o{a}") for a, x in zip("xyz", n)), *(x.alias(f"d{a}") for a, x in zip("xyz", d)))


def ambient_occlusion(points: DataFrame, scene: dict[str, DataFrame], samples: int, reach: float, seed: int | None = None, small: int = SMALL) -> DataFrame:
    """pixel, open: share of samples that meet nothing within reach."""
    r = settle(points.sparkSession, occlusion_rays(points, samples, seed), "rays")
    hit = None
    for kind, prims in once(scene).items():
        h = hits(r, prims, kind, reach, small).select("ray_id")
        hit = h if hit is None else hit.union(h)
    j = r.select("ray_id", "pixel").join(hit.distinct().withColumn("_hit", F.lit(1.0)), "ray_id", "left")
    return j.groupBy("pixel").agg((1.0 - F.sum(F.coalesce("_hit", F.lit(0.0))) / F.count(F.lit(1))).alias("open"))


def reflect(points: DataFrame) -> DataFrame:
    """Next rays: d - 2 n (n . d) with the normal turned to face the ray, from a little before the hit."""
    d, n = _p("dx", "dy", "dz"), _p("nx", "ny", "nz")
    away = v3.dot(n, d) > 0
    n = [F.when(away, -x).otherwise(x) for x in n]
    out = v3.sub(d, v3.scale(n, 2 * v3.dot(n, d)))
    return points.select("ray_id", *((F.col(f"p{a}") - x * 1e-4).alias(f"o{a}") for a, x in zip("xyz", d)), *(x.alias(f"d{a}") for a, x in zip("xyz", out)))


def hit_normals(points: DataFrame, scene: dict[str, DataFrame]) -> DataFrame:
    """points (with kind and idx) and the unit normal nx, ny, nz of what they lie on; a hit where there is none has null."""
    out = None
    for kind, prims in scene.items():
        p = points.where(F.col("kind") == kind)
        if kind == "triangle":
            p = p.join(triangle_normals(prims), "idx")
        else:
            own = [c for c in ("cx", "cy", "cz", "bx", "by", "bz", "ax", "ay", "az") if c in prims.columns]
            p = p.join(prims.select(F.col("idx"), *(F.col(c).alias(f"_{c}") for c in own)), "idx")
            if kind == "sphere":
                n = v3.sub(_p("px", "py", "pz"), _p("_cx", "_cy", "_cz"))
            else:  # away from the axis
                axis = _p("_ax", "_ay", "_az")
                p, rel = let(p, "rel", v3.sub(_p("px", "py", "pz"), _p("_bx", "_by", "_bz")))
                n = v3.sub(rel, v3.scale(axis, v3.dot(rel, axis)))
            p = p.withColumns({f"n{a}": x for a, x in zip("xyz", v3.normalize(n))}).drop(*(f"_{c}" for c in own), "_relx", "_rely", "_relz")
        out = p if out is None else out.unionByName(p)
    return out


def shade(points: DataFrame, light, eye, ambient: float = 0.2, diffuse: float = 0.6, specular: float = 0.3, shine: float = 10.0, falloff=(1.0, 0.0, 0.0), intensity: float = 1.0, depth: int = 0, materials: DataFrame | None = None) -> DataFrame:
    """ray_id, shade: Blinn-Phong at hits with normals and lit, times 0.3 per bounce, at most 1.

    materials (kind, idx, ambient, diffuse, specular, shine): own coefficients of some primitives; others have the given ones.
    """
    k = {"ambient": F.lit(ambient), "diffuse": F.lit(diffuse), "specular": F.lit(specular), "shine": F.lit(shine)}
    if materials is not None:
        points = points.join(materials.select("kind", "idx", *(F.col(c).alias(f"m_{c}") for c in k)), ["kind", "idx"], "left")
        k = {c: F.coalesce(F.col(f"m_{c}"), x) for c, x in k.items()}
    p, n = _p("px", "py", "pz"), _p("nx", "ny", "nz")
    points, to_l = let(points, "tl", v3.sub(v3.lit(*light), p))
    points, to_e = let(points, "te", v3.sub(v3.lit(*eye), p))
    points, l = let(points, "l", v3.normalize(to_l))
    points, e = let(points, "e", v3.normalize(to_e))
    points, h = let(points, "s", v3.add(l, e))
    points, h = let(points, "h", v3.normalize(h))
    d = v3.norm(to_l) + v3.norm(v3.sub(v3.lit(*eye), _p("ox", "oy", "oz")))
    fall = falloff[0] + falloff[1] * d + falloff[2] * d * d
    direct = k["diffuse"] * 0.9 * F.greatest(v3.dot(n, l), F.lit(0.0)) + k["specular"] * 0.9 * F.pow(F.greatest(v3.dot(n, h), F.lit(0.0)), k["shine"])
    return points.select("ray_id", F.least((k["ambient"] + direct * F.col("lit") * intensity / fall) * 0.3**depth, F.lit(1.0)).alias("shade"))


def trace(rays: DataFrame, scene: DataFrame | dict[str, DataFrame], light, eye, bounces: int = 1, samples: int = 0, reach: float = 1.0, small: int = SMALL, materials: DataFrame | None = None, color: Column | None = None) -> DataFrame:
    """ray_id, shade summed over bounces with shadows, and depth (of the first hit; null where nothing is hit, and shade is 0 there).

    scene: triangles, or primitives by kind. samples > 0: times the open share. color: a factor of each hit from kind, idx, u, v
    and its place px, py, pz, as a color map gives it. Rays, hits and shades of each bounce are written to the shared folder: shadows, shade and
    the next rays all start from them, and no plan holds more than one step's arithmetic.
    """
    spark = rays.sparkSession
    scene = once(scene if isinstance(scene, dict) else {"triangle": scene})
    rays = settle(spark, rays, "rays")
    total, at, first = None, rays, None
    for depth in range(bounces + 1):
        p = settle(spark, hit_normals(settle(spark, hit_points(at, nearest(at, scene, small=small)), "nearest"), scene), "hits")
        first = p.select("ray_id", F.col("dist").alias("depth")) if first is None else first
        p = settle(spark, p.join(shadow(at, p, scene, light, small), "ray_id"), "lit")
        s = shade(p, light, eye, depth=depth, materials=materials)
        if color is not None:
            s = s.join(p.select("ray_id", color.alias("c")), "ray_id").select("ray_id", (F.col("shade") * F.col("c")).alias("shade"))
        if samples:
            s = s.join(ambient_occlusion(p, scene, samples, reach, small=small).withColumnRenamed("pixel", "ray_id"), "ray_id").select("ray_id", (F.col("shade") * F.col("open")).alias("shade"))
        s = settle(spark, s, "shade")
        total = s if total is None else total.unionByName(s)
        at = settle(spark, reflect(p), "rays") if depth < bounces else None
    sums = total.groupBy("ray_id").agg(F.sum("shade").alias("s"))
    out = rays.select("ray_id").join(sums, "ray_id", "left").join(first, "ray_id", "left")
    return out.select("ray_id", F.least(F.coalesce("s", F.lit(0.0)), F.lit(1.0)).alias("shade"), "depth")


# --- volumes and images ----------------------------------------------------------------------------


def project(points: DataFrame, matrix: np.ndarray, w: int, h: int, samples: int) -> DataFrame:
    """node_id, px, py, pz: pixels and sample depth after projection, depth scaled over the points' range."""
    from .compute import transform

    p = transform(points, matrix)
    z = p.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    p = p.join(F.broadcast(z))  # z is one row
    return p.select("node_id", ((F.col("x") + 1) * 0.5 * w).alias("px"), ((F.col("y") + 1) * 0.5 * h).alias("py"), F.when(F.col("hi") > F.col("lo"), samples * (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("pz"))


def sample_tets(tets: DataFrame, w: int, h: int, depth: int) -> DataFrame:
    """x, y, z, s: scalar at lattice points in each tetrahedron (p0..p3: structs x, y, z, s in screen space); of several, the first tetrahedron's.

    Each tetrahedron's weights are linear in the place: their slopes are found once, before its box's lattice is exploded. Flat ones hold nothing.
    """
    ps = [F.col(f"p{k}") for k in range(4)]
    lo = lambda a, n: F.greatest(F.ceil(F.least(*(p[a] for p in ps))), F.lit(0)).cast("int")
    hi = lambda a, n: F.least(F.floor(F.greatest(*(p[a] for p in ps))), F.lit(n - 1)).cast("int")
    seq = lambda a, n: F.when(lo(a, n) <= hi(a, n), F.sequence(lo(a, n), hi(a, n))).otherwise(F.array().cast("array<int>"))
    edges = [v3.sub(v3.of(p), v3.of(ps[0])) for p in ps[1:]]
    t = tets
    for k, e in enumerate(edges, 1):
        t, edges[k - 1] = let(t, f"e{k}", e)
    normals = [v3.cross(edges[1], edges[2]), v3.cross(edges[2], edges[0]), v3.cross(edges[0], edges[1])]
    for k, n in enumerate(normals, 1):
        t, normals[k - 1] = let(t, f"n{k}", n)
    t = t.withColumn("_det", v3.dot(edges[0], normals[0])).where(F.col("_det") != 0)
    slopes = [f"_g{k}{a}" for k in (1, 2, 3) for a in "xyz"]
    t = t.select("cell_id", *(p["s"].alias(f"s{k}") for k, p in enumerate(ps)), *(ps[0][a].alias(f"o{a}") for a in "xyz"), *((F.col(f"_n{g[2]}{g[3]}") / F.col("_det")).alias(g) for g in slopes), *(seq(a, n).alias(f"in_{a}") for a, n in zip("xyz", (w, h, depth))))
    for a in "xyz":
        t = t.withColumn(a, F.explode(f"in_{a}")).drop(f"in_{a}")
    at = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    t = t.withColumns({f"w{k}": v3.dot(at, _p(*(f"_g{k}{a}" for a in "xyz"))) for k in (1, 2, 3)}).withColumn("w0", 1.0 - F.col("w1") - F.col("w2") - F.col("w3"))
    t = t.where(" and ".join(f"w{k} >= 0" for k in range(4)))
    s = sum((F.col(f"w{k}") * F.col(f"s{k}") for k in range(4)), F.lit(0.0))
    return t.groupBy("x", "y", "z").agg(F.min(F.struct("cell_id", s.alias("s"))).alias("m")).select("x", "y", "z", "m.s")


def gaussian_opacity(s: Column, center: float = 0.5, sigma: float = 0.13, scale: float = 0.02) -> Column:
    return scale * F.exp(-(s - center) * (s - center) / (2 * sigma * sigma))


def composite(samples: DataFrame, keys: list[str], depth: str, value: str, alpha: Column, slab: int = 256) -> DataFrame:
    """keys, color, opacity: back-to-front (largest depth first) blend of the value by alpha.

    Blending is associative, so slabs of `slab` units of depth blend by themselves, and then their results do, slab by slab of
    them, until a pixel has one: no list holds more than the samples of one slab.
    """
    q = F.struct((-F.col(depth)).cast("double").alias("z"), (F.col(value).cast("double") * alpha).alias("c"), alpha.alias("a"))
    r = samples.agg(F.min(depth).alias("lo"), F.max(depth).alias("hi")).first()
    first, top = (r.lo, int((r.hi - r.lo) // slab)) if r.lo is not None else (0, 0)
    rows = samples.select(*keys, q.alias("q"), F.floor((F.col(depth) - F.lit(first)) / slab).cast("long").alias("slab"))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"))
    # a layer in front: its color, and what it lets through of what is behind
    over = lambda acc, q: F.struct((acc["c"] * (1 - q["a"]) + q["c"]).alias("c"), (acc["a"] * (1 - q["a"]) + q["a"]).alias("a"))
    while True:
        rows = rows.groupBy(*keys, "slab").agg(F.aggregate(F.array_sort(F.collect_list("q")), start, over).alias("b"))
        if not top:
            return rows.select(*keys, F.col("b.c").alias("color"), F.col("b.a").alias("opacity"))
        rows = rows.select(*keys, F.struct((-F.col("slab")).cast("double").alias("z"), F.col("b.c").alias("c"), F.col("b.a").alias("a")).alias("q"), F.floor(F.col("slab") / slab).cast("long").alias("slab"))
        top //= slab


def z_composite(images: DataFrame, pixel: str, z: str, *values: str, background: tuple | None = None) -> DataFrame:
    """Per pixel the values at the least depth; equal depths are averaged, without those of the background color unless all have it."""
    vals = F.struct(*(F.col(v).cast("double").alias(v) for v in values))
    plain = F.lit(False) if background is None else F.struct(*(F.col(v).cast("double") for v in values)) == F.struct(*(F.lit(float(b)) for b in background))
    # first sums for each depth, then the least depth's, so that each image is shuffled as partial sums
    sums = [F.sum(F.col("v")[v]).alias(v) for v in values]
    level = images.select(pixel, F.col(z), plain.cast("int").alias("far"), vals.alias("v")).groupBy(pixel, z, "far").agg(*sums, F.count(F.lit(1)).alias("n"))
    best = level.groupBy(pixel).agg(F.min(F.struct(z, "far", "n", *values)).alias("m"))
    return best.select(pixel, F.col(f"m.{z}").alias(z), *((F.col(f"m.{v}") / F.col("m.n")).alias(v) for v in values))


def quadtree_values(points: DataFrame, leaves: DataFrame, level: int) -> DataFrame:
    """point_id, leaf_id, value at (x, y) in [-1, 1]^2: first closed leaf that holds it, sum of c[i][j] P_i P_j 2^(lvl-1).

    Points look for leaves by their cell's number at each level, an equi-join; `level` is the deepest level.
    """
    from fieldloom.functions.matrix import legendre

    near = points.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(level))))
    n = F.pow(F.lit(2.0), F.col("lvl"))
    at = lambda c: (F.col(c) + 1) / 2 * n
    both = lambda c: F.array_distinct(F.array(F.least(F.floor(at(c)), n - 1).cast("long"), F.greatest(F.ceil(at(c)) - 1, F.lit(0)).cast("long")))
    near = near.withColumn("ix", F.explode(both("x"))).withColumn("iy", F.explode(both("y")))
    side = 2.0 / F.pow(F.lit(2.0), F.col("lvl"))
    own = leaves.withColumn("ix", F.round((F.col("xmin") + 1) / side).cast("long")).withColumn("iy", F.round((F.col("ymin") + 1) / side).cast("long"))
    j = near.join(own, ["lvl", "ix", "iy"])
    xx, yy = (2 * (F.col(c) - F.col(f"{c}min")) / (F.col(f"{c}max") - F.col(f"{c}min")) - 1 for c in "xy")
    value = sum((F.col("coeffs")[3 * a + b] * legendre(a, xx) * legendre(b, yy) for a in range(3) for b in range(3)), F.lit(0.0)) * F.pow(F.lit(2.0), F.col("lvl") - 1)
    return j.groupBy("point_id").agg(F.min(F.struct("leaf_id", value.alias("value"))).alias("m")).select("point_id", "m.leaf_id", "m.value")
