"""Synthetic tables as column expressions over row ids: densities, manifolds, clusters, mixtures."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oosgauge.functions.draws import gauss, unit

MASS_FLOOR = 1e-8
RETRIES = 5


def _array(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _pick(cdf: Column, u: Column, n: int) -> Column:
    """First bin whose cumulative mass reaches u."""
    return F.least(F.size(F.filter(cdf, lambda c: c < u)), F.lit(n - 1))


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``: keeps nested draws from multiplying."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _draw_in(cdf: Column, u: Column, n: int) -> Column:
    """Bin of u plus a triangular offset in [0, 2): densities blend into the next bin."""

    def bounds(s):
        low = F.when(s["i"] > 0, F.element_at(s["c"], s["i"])).otherwise(F.lit(0.0))
        high = F.when(s["i"] < n - 1, F.element_at(s["c"], s["i"] + 1)).otherwise(F.lit(1.0))
        return F.struct(s["i"].alias("i"), F.try_divide(s["u"] - low, high - low).alias("r"))

    def offset(s):
        rising = F.lit(2.0) * F.sqrt(s["r"] * 0.5)
        falling = F.lit(2.0) * (F.lit(1.0) - F.sqrt((F.lit(1.0) - s["r"]) * 0.5))
        return s["i"] + F.when(s["r"] <= 0.5, rising).otherwise(falling)

    bound = F.struct(cdf.alias("c"), u.alias("u"))
    picked = _let(bound, lambda s: F.struct(s["c"].alias("c"), s["u"].alias("u"), _pick(s["c"], s["u"], n).alias("i")))
    return _let(_let(picked, bounds), offset)


def sample_pdf_1d(u: Column, pdf) -> Column:
    """Draw from a 1-D density over n bins, in [-0.5, 0.5 + 1/n)."""
    p = np.asarray(pdf, dtype=float)
    n = len(p)
    cdf = _array(np.cumsum(p / p.sum()))
    return _draw_in(cdf, u, n) / F.lit(float(n)) - F.lit(0.5)


def _conditional(p: np.ndarray) -> list[np.ndarray]:
    sums = p.sum(axis=1, keepdims=True)
    safe = np.where(sums < MASS_FLOOR, 1.0, sums)
    return [np.cumsum(r) for r in p / safe]


def _rows(cdfs) -> Column:
    rows = ("array(" + ", ".join(f"{float(v)!r}D" for v in c) + ")" for c in cdfs)
    return F.expr("array(" + ", ".join(rows) + ")")


def _flags(values) -> Column:
    return F.expr("array(" + ", ".join("true" if v else "false" for v in values) + ")")


def sample_pdf_2d(draws: list[Column], u2: Column, pdf) -> Column:
    """``struct<a, b>`` from a 2-D density, or null when every draw lands on an empty row.

    The row comes from the marginal, the column from that row; ``draws`` holds
    the first draw and its retries.
    """
    p = np.asarray(pdf, dtype=float)
    p = p / p.sum()
    rows, cols = p.shape
    marginal = _array(np.cumsum(p).reshape(p.shape)[:, -1])
    full = _flags(p.sum(axis=1) >= MASS_FLOOR)
    tries = [F.struct(_pick(marginal, u, rows).alias("i"), u.alias("u")) for u in draws]
    # the first draw on a filled row
    hit = F.get(F.filter(F.array(*tries), lambda t: F.element_at(full, t["i"] + 1)), 0)
    conds = _rows(_conditional(p))

    def both(t):
        a = _draw_in(marginal, t["u"], rows) / F.lit(float(rows)) - F.lit(0.5)
        b = _draw_in(F.element_at(conds, t["i"] + 1), u2, cols) / F.lit(float(cols)) - F.lit(0.5)
        return F.when(t.isNotNull(), F.struct(a.alias("a"), b.alias("b")))

    return _let(hit, both)


def sample_pdf_given(value: Column, axis: int, u: Column, pdf) -> Column:
    """Draw the other axis of a 2-D density given one; null on an empty slice.

    The slice is int(value * n) without the half shift of the drawn values.
    """
    p = np.asarray(pdf, dtype=float)
    p = p / p.sum()
    p = p if axis == 0 else p.T
    n, other = p.shape
    at = F.least(F.greatest((value * F.lit(float(n))).cast("int"), F.lit(0)), F.lit(n - 1))
    cond = F.element_at(_rows(_conditional(p)), at + 1)
    full = F.element_at(_flags(p.sum(axis=1) >= MASS_FLOOR), at + 1)
    return F.when(full, _draw_in(cond, u, other) / F.lit(float(other)) - F.lit(0.5))


# --- manifolds and affine maps ----------------------------------------------


def manifold_map(kind: str, t: Column, y: Column) -> Column:
    """``array<double>`` (x, y, z) of a point of the unit parameter square."""
    pi = math.pi
    if kind == "swiss_roll":
        turns = 3.0
        a = F.lit(pi * turns) * (t + F.lit(0.5))
        top = F.lit(pi * (1.0 + turns))
        return F.array(a * F.cos(a) / top, y, a * F.sin(a) / top)
    if kind == "cylinder":
        a = F.lit(2.0 * pi) * t
        return F.array(F.cos(a) * 0.5, y, F.sin(a) * 0.5)
    if kind == "s_curve":
        a = F.lit(3.0 * pi) * t
        return F.array(F.sin(a) * 0.5, y, F.signum(a) * (F.cos(a) - 1.0) * 0.25)
    if kind in ("plane", "none"):
        return F.array(t, y, F.lit(0.0))
    raise ValueError(f"unknown manifold {kind!r}")


def euler_matrix(axes: str, degrees) -> np.ndarray:
    """Rotation for an axis string: lower case turns about fixed axes, upper case about moving ones."""
    turn = np.eye(3)
    for axis, deg in zip(axes, np.atleast_1d(degrees)):
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        k = "xyz".index(axis.lower())
        m = np.eye(3)
        p, q = (k + 1) % 3, (k + 2) % 3
        m[p, p], m[q, q], m[p, q], m[q, p] = c, c, -s, s
        turn = turn @ m if axis.isupper() else m @ turn
    return turn


def affine_map(v: Column, rotations=(0, 0, 0), scale=(1, 1, 1), translate=(0, 0, 0), axes: str = "xyz") -> Column:
    """Scale, rotate, translate a 3-vector by literal numbers."""
    m = euler_matrix(axes, rotations) @ np.diag(np.asarray(scale, dtype=float))
    out = []
    for r in range(3):
        terms = [F.element_at(v, c + 1) * F.lit(float(m[r, c])) for c in range(3)]
        out.append(terms[0] + terms[1] + terms[2] + F.lit(float(translate[r])))
    return F.array(*out)


def hole_sample(key: Column | str, seed: int, hole: str = "none") -> Column:
    """``struct<a, b>`` on the unit square: all of it, its centre ninth, or the eight others."""
    a, b = unit(key, seed), unit(key, seed + 1)
    if hole == "none":
        return F.struct(a.alias("a"), b.alias("b"))
    if hole == "in":
        return F.struct(((a + 1.0) / 3.0).alias("a"), ((b + 1.0) / 3.0).alias("b"))
    if hole == "out":
        cell = F.floor(unit(key, seed + 2) * 8.0).cast("int")
        cell = F.when(cell >= 4, cell + 1).otherwise(cell)  # skip the centre of the 3 x 3
        row, col = F.floor(cell / 3), cell % 3
        return F.struct(((a + row) / 3.0).alias("a"), ((b + col) / 3.0).alias("b"))
    raise ValueError(f"unknown hole {hole!r}")


def manifold_table(ids: DataFrame, kind: str, seed: int, hole: str = "none") -> DataFrame:
    """``id, x, y, z, t``: one manifold point per id."""
    drawn = ids.select("id", hole_sample("id", seed, hole).alias("s"))
    shift = 0.5 if kind == "s_curve" else 0.0
    a, b = F.col("s.a") - F.lit(shift), F.col("s.b") - F.lit(shift)
    pt = manifold_map(kind, a, b)
    return drawn.select("id", pt.alias("p"), a.alias("t")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"), "t")


# --- clusters ---------------------------------------------------------------


def cluster_blobs(spark: SparkSession, clusters: list[dict], seed: int) -> DataFrame:
    """``id, x, y, z, label``: clusters laid out one after the other over one id range.

    Each cluster: ``n_samples, shape (plane | s_curve | swiss_roll | cylinder),
    c1, r1, c2, r2, noise, gaussian[, axes, level]``. A row finds its cluster by
    its id, so a cluster of any size is spread over all tasks.
    """
    starts = np.cumsum([0] + [int(c["n_samples"]) for c in clusters])
    ids = spark.range(int(starts[-1]))
    begin = F.array(*[F.lit(int(s)).cast("bigint") for s in starts[:-1]])
    at = F.size(F.filter(begin, lambda s: s <= F.col("id")))
    return blob_points(ids.withColumn("label", at.cast("int")), clusters, seed)


def blob_points(ids: DataFrame, clusters: list[dict], seed: int) -> DataFrame:
    """Points for rows ``id, label`` with 1-based cluster numbers."""
    lab = F.col("label")
    num = lambda k, default=0.0: F.element_at(_array([c.get(k, default) for c in clusters]), lab)
    text = lambda k, default: F.element_at(F.array(*[F.lit(c.get(k, default)) for c in clusters]), lab)
    normal = F.element_at(F.array(*[F.lit(bool(c.get("gaussian", True))) for c in clusters]), lab)
    key = "id"

    def draw(centre, spread, s):
        flat = centre + spread * (F.lit(2.0) * unit(key, seed + s) - F.lit(1.0))
        return F.when(normal, centre + spread * gauss(key, seed + s)).otherwise(flat)

    d = ids.select("id", "label", draw(num("c1"), num("r1"), 1).alias("_a"), draw(num("c2"), num("r2"), 2).alias("_b"))
    a, b, pi = F.col("_a"), F.col("_b"), math.pi
    level = num("level")
    plane = (
        F.when(text("axes", "yz") == "yz", F.array(level, a, b))
        .when(text("axes", "yz") == "xz", F.array(a, level, b))
        .otherwise(F.array(a, b, level))
    )
    ts = F.lit(3.0 * pi) * (a - 0.5)
    curve = F.array(F.sin(ts), F.lit(2.0) * b, F.signum(ts) * (F.cos(ts) - 1.0))
    tr = F.lit(1.5 * pi) * (F.lit(1.0) + F.lit(2.0) * a)
    roll = F.array(tr * F.cos(tr), F.lit(10.0) * b, tr * F.sin(tr))
    tc = F.lit(2.0 * pi) * (a - 0.5)
    tube = F.array(F.cos(tc), F.lit(10.0) * b, F.sin(tc))
    shape = text("shape", "plane")
    base = F.when(shape == "plane", plane).when(shape == "s_curve", curve).when(shape == "swiss_roll", roll).otherwise(tube)
    # rolls and cylinders are shrunk to a fifth, noise included
    shrink = F.when(shape.isin("swiss_roll", "cylinder"), F.lit(0.2)).otherwise(F.lit(1.0))
    noise = F.array(*[num("noise") * gauss(key, seed + s) for s in (11, 12, 13)])
    pt = F.zip_with(base, noise, lambda x, e: (x + e) * shrink)
    named = d.select("id", "label", pt.alias("_p"))
    return named.select("id", *[F.col("_p")[i].alias(c) for i, c in enumerate("xyz")], "label")


def plane_basis(normal) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions spanning the plane through the origin with that normal.

    The first is the plane's point above (1, 1).
    """
    n = np.asarray(normal, dtype=float)
    p = np.array([1.0, 1.0, -(n[0] + n[1]) / n[2]])
    p = p / np.linalg.norm(p)
    q = np.cross(n, p)
    return p, q / np.linalg.norm(q)


def plane_basis_sample(ids: DataFrame, normal, seed: int) -> DataFrame:
    """``id, x, y, z``: uniform (u, v) mapped onto the plane."""
    p, q = plane_basis(normal)
    u, v = unit("id", seed), unit("id", seed + 1)
    return ids.select("id", *[(u * F.lit(float(p[i])) + v * F.lit(float(q[i]))).alias(c) for i, c in enumerate("xyz")])


# --- mixtures ---------------------------------------------------------------

#: density class -> how it fills its dimensions
GENERATORS = {"OneDPDF": "one", "TwoDPDF": "two", "ThreeDPDF": "three", "PDP": "planar"}


def check_spec(spec: dict) -> None:
    known = set(range(spec["dims"]))
    for g in spec["generators"]:
        if g["type"] not in GENERATORS:
            raise ValueError(f"unknown generator {g['type']!r}")
        missing = set(g["params"]["dimensions"]) - known
        if missing:
            raise ValueError(f"dimensions {sorted(missing)} are undefined")


def _draw(gen: dict) -> Column:
    """``array<double>`` for the generator's dimensions; unfilled entries are null.

    Reads the row's state ``s0..`` and its uniforms ``_u0.., _w``, so one
    expression per generator serves every attempt.
    """
    values = [F.col(f"s{k}") for k in gen["params"]["dimensions"]]
    par, kind = gen["params"], GENERATORS[gen["type"]]
    pdf = par["pdf"]
    pdf = json.loads(pdf) if isinstance(pdf, str) else pdf
    us, u2 = [F.col(f"_u{r}") for r in range(RETRIES)], F.col("_w")
    if kind == "one":
        return F.array(sample_pdf_1d(us[0], pdf))
    if kind == "two":
        both = sample_pdf_2d(us, u2, pdf)
        a, b = values
        none = a.isNull() & b.isNull()
        first = F.when(none, both["a"]).when(a.isNull(), sample_pdf_given(b, 1, us[0], pdf)).otherwise(a)
        second = F.when(none, both["b"]).when(b.isNull(), sample_pdf_given(a, 0, us[0], pdf)).otherwise(b)
        return F.array(first, second)
    drawn = sample_pdf_2d(us, u2, pdf)
    shape = "none" if kind == "planar" else par["manifold"]
    scale = (1, 1, 1) if kind == "planar" else par.get("scale") or (1, 1, 1)
    turn, shift, axes = par.get("rotations") or (0, 0, 0), par.get("translate") or (0, 0, 0), par.get("rot_axis") or "xyz"
    pt = _let(drawn, lambda s: manifold_map(shape, s["a"], s["b"]))
    pt = _let(pt, lambda v: affine_map(v, turn, scale, shift, axes))
    fresh = F.lit(True)
    for v in values:
        fresh = fresh & v.isNull()
    return F.when(fresh, pt).otherwise(F.array(*values))


def _fill(df: DataFrame, dim: int, gens: list[dict], draws: list[Column], seed: int) -> DataFrame:
    """Fill one dimension where it is open, by a generator that can.

    Drawing again until a generator accepts is choosing by weight among those
    that accept, so every row is settled in one step.
    """
    uniforms = {f"_u{r}": unit("id", seed + 1009 + 31 * r) for r in range(RETRIES)}
    open_ = F.col(f"s{dim}").isNull()
    df = df.withColumns({**uniforms, "_w": unit("id", seed + 1986)})
    drawn = {f"_d{g}": F.when(open_, d) for g, d in enumerate(draws)}
    df = df.withColumns(drawn)
    upto, sums = F.lit(0.0), []
    for g, gen in enumerate(gens):
        place = gen["params"]["dimensions"].index(dim)
        can = F.get(F.col(f"_d{g}"), F.lit(place)).isNotNull()
        upto = upto + F.when(can, F.lit(float(gen["weight"]))).otherwise(F.lit(0.0))
        sums.append(upto)
    df = df.withColumn("_sums", F.array(*sums))
    goal = unit("id", seed) * F.element_at("_sums", len(gens))
    df = df.withColumn("_pick", F.when(open_, F.size(F.filter("_sums", lambda c: c <= goal))))
    new: dict[str, Column] = {}
    label = F.col("label")
    for g, gen in enumerate(gens):
        here, got = F.col("_pick") == g, F.col(f"_d{g}")
        for at, k in enumerate(gen["params"]["dimensions"]):
            new[f"s{k}"] = F.when(here, got[at]).otherwise(new.get(f"s{k}", F.col(f"s{k}")))
        if gen["params"].get("labeled") is not None:
            whole = here & F.forall(got, lambda x: x.isNotNull())
            label = F.when(F.col("label").isNull() & whole, F.lit(int(gen["params"]["labeled"]))).otherwise(label)
    return df.withColumns({**new, "label": label}).drop("_pick", "_sums", "_w", *uniforms, *drawn)


def mixture_rows(ids: DataFrame, spec: dict, seed: int) -> DataFrame:
    """``id, features, label`` for every id from a generator specification.

    Each dimension picks one of its generators by weight; a joint generator fills
    its dimensions together and respects those already drawn; dimensions without
    a generator are uniform over eleven bins. The label is that of the first
    labelled generator that filled all its dimensions, else 0.
    """
    check_spec(spec)
    dims = spec["dims"]
    gens = spec["generators"]
    df = ids.select("id", *[F.lit(None).cast("double").alias(f"s{i}") for i in range(dims)], F.lit(None).cast("int").alias("label"))
    made: dict[int, tuple] = {}
    for i in range(dims):
        mine = [g for g in gens if i in g["params"]["dimensions"]] or [
            {"type": "OneDPDF", "weight": 1.0, "params": {"pdf": [1.0] * 11, "dimensions": [i]}}
        ]
        for g in mine:
            if id(g) not in made:
                made[id(g)] = (g, _draw(g))
        draws = [made[id(g)][1] for g in mine]
        df = _fill(df, i, mine, draws, seed + 100_003 * (i + 1))
    return df.select("id", F.array(*[f"s{i}" for i in range(dims)]).alias("features"), F.coalesce("label", F.lit(0)).alias("label"))


def spec_from_table(rows: DataFrame) -> dict:
    """Generator specification from the exploded JSON table (one row per generator)."""
    got = [r.asDict(recursive=True) for r in rows.orderBy("pos").collect()]
    keys = ("pdf", "dimensions", "labeled", "manifold", "rotations", "scale", "translate", "rot_axis")
    return {
        "samples": got[0]["samples"],
        "dims": got[0]["dims"],
        "generators": [
            {"type": g["type"], "weight": g["weight"], "params": {k: g[k] for k in keys if g[k] is not None}} for g in got
        ],
    }
