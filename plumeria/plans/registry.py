"""The registered queries and their DuckDB counterparts.

Frames are the ``embeddings`` (8 x 8 pixels, grouped by label), times are the ``events``. Frames of
label 0 stand for darks and those of label 1 for flats. Floats are rounded, so that the order of
additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions.shared import new_path, until_exit
from plumeria.operators import background, calibration, detection, incremental, nearest, photometry, registration, resample, stacking, timeline, validity
from plumeria.sources import frames
from plumeria.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The frames as pixel rows, for the DuckDB side.
PIXELS = """px AS (SELECT vec_id AS frame_id, label AS group_id, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, embedding[i]::DOUBLE AS v
FROM embeddings, range(1, 65) t(i))"""


def query(sql: str | None = None, pixels: bool = True):
    """Registers a function of (spark, sf_dir), or of pixel rows, under its name."""

    def add(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, sf_dir: f(frames.embedding_pixels(spark, sf_dir))) if pixels else f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {PIXELS}{', ' if not sql.lstrip().startswith('SELECT') else ' '}{sql}") if pixels else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; minus zero as zero."""
    return df.select(*(((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


@query("SELECT group_id, x, y, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS stddev, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM px GROUP BY ALL")
def p01_basic_stack(px):
    return rounded(stacking.basic_stack(px))


@query("""c1 AS (SELECT *, avg(v) OVER c AS m, stddev_pop(v) OVER c AS s FROM px WINDOW c AS (PARTITION BY group_id, x, y)),
c2 AS (SELECT frame_id, group_id, x, y, v, avg(v) OVER c AS m, stddev_pop(v) OVER c AS s FROM c1 WHERE abs(v - m) <= 2::DOUBLE * s WINDOW c AS (PARTITION BY group_id, x, y))
SELECT group_id, x, y, round(avg(v), 6) AS value, count(*) AS n FROM c2 WHERE abs(v - m) <= 2::DOUBLE * s GROUP BY ALL""")
def p02_sigma_clip_stack(px):
    return rounded(stacking.sigma_clip_stack(px, 2.0, 2))


@query("""r AS (SELECT 0 AS pass, group_id, x, y, v, TRUE AS changed FROM px
UNION ALL SELECT pass + 1, group_id, x, y, v, n > kept FROM (SELECT *, count(*) OVER c AS n, count(*) FILTER (WHERE near) OVER c AS kept FROM
(SELECT *, abs(v - avg(v) OVER c) <= 2::DOUBLE * (1 + 1e-15::DOUBLE) * stddev_pop(v) OVER c AS near FROM r WHERE changed WINDOW c AS (PARTITION BY group_id, x, y)) WINDOW c AS (PARTITION BY group_id, x, y))
WHERE near OR kept = 0)
SELECT group_id, x, y, round(avg(v), 6) AS value, count(*) AS n, (pass - 1)::INT AS passes FROM r WHERE NOT changed GROUP BY ALL""")
def p03_sigma_clip_converged(px):
    return rounded(stacking.sigma_clip_converged(px, 2.0))


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY group_id, x, y ORDER BY v, frame_id) AS up, count(*) OVER (PARTITION BY group_id, x, y) AS k FROM px)
SELECT group_id, x, y, round(avg(v), 6) AS value, count(*) AS n FROM r WHERE up > 1 AND up <= k - 1 GROUP BY ALL""")
def p04_minmax_reject_stack(px):
    return rounded(stacking.minmax_reject_stack(px, 1, 1))


QUANTILES = "q AS (SELECT group_id, x, y, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY ALL)"


@query(f"{QUANTILES} SELECT group_id, x, y, round(avg(greatest(lo, least(hi, v))), 6) AS value, count(*) AS n FROM px JOIN q USING (group_id, x, y) GROUP BY ALL")
def p05_winsorised_stack(px):
    return rounded(stacking.winsorised_stack(px))


MAD = """d AS (SELECT group_id, x, y, median(v) AS med FROM px GROUP BY ALL),
m AS (SELECT group_id, x, y, any_value(med) AS med, median(abs(v - med)) AS mad FROM px JOIN d USING (group_id, x, y) GROUP BY ALL)"""


@query(f"{MAD} SELECT group_id, x, y, round(med, 6) AS median, round(mad, 6) AS mad FROM m")
def p06_median_absolute_deviation(px):
    return rounded(stacking.median_absolute_deviation(px))


@query(f"{MAD} SELECT group_id, x, y, round(avg(v), 6) AS value, count(*) AS n FROM px JOIN m USING (group_id, x, y) WHERE abs(v - med) <= 3::DOUBLE * 1.4826::DOUBLE * mad GROUP BY ALL")
def p07_mad_clip_stack(px):
    return rounded(stacking.mad_clip_stack(px))


@query(f"{QUANTILES} SELECT group_id, x, y, round(avg(v), 6) AS value, count(*) AS n FROM px JOIN q USING (group_id, x, y) WHERE v BETWEEN lo AND hi GROUP BY ALL")
def p08_percentile_clip_stack(px):
    return rounded(stacking.percentile_clip_stack(px))


LEVELS = "l AS (SELECT group_id, frame_id, median(v) AS level, stddev_pop(v) AS spread FROM px GROUP BY ALL)"


@query(f"{LEVELS} SELECT group_id, x, y, round(sum((v - level) / (spread * spread)) / sum(1 / (spread * spread)), 6) AS value, round(sum(1 / (spread * spread)), 4) AS weight FROM px JOIN l USING (group_id, frame_id) GROUP BY ALL")
def p09_weighted_stack(px):
    s = stacking.weighted_stack(px)
    return rounded(s.withColumn("weight", F.round("weight", 4)))


@query(f"""{LEVELS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY spread, frame_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM l)
SELECT px.group_id, x, y, round(avg(v), 6) AS value, count(*) AS n FROM px JOIN r USING (group_id, frame_id) WHERE k <= ceil(r.n * 0.5) GROUP BY ALL""")
def p10_selected_stack(px):
    return rounded(stacking.selected_stack(px, 0.5))


def _kinds(px):
    """(darks, flats, lights)"""
    g = F.col("group_id")
    return px.where(g == 0), px.where(g == 1), px.where(g > 1)


DARK = "dark AS (SELECT x, y, avg(v) AS d FROM px WHERE group_id = 0 GROUP BY ALL)"


@query(f"{DARK} SELECT frame_id, round(avg(v - d), 6) AS mean, round(min(v - d), 6) AS min, round(max(v - d), 6) AS max FROM px JOIN dark USING (x, y) WHERE group_id > 0 GROUP BY ALL")
def p11_subtract_master(px):
    dark, flat, light = _kinds(px)
    done = calibration.subtract_master(px.where("group_id > 0"), calibration.master(dark))
    return rounded(done.groupBy("frame_id").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")))


@query(f"""{DARK}, flat AS (SELECT x, y, avg(v - d) AS f FROM px JOIN dark USING (x, y) WHERE group_id = 1 GROUP BY ALL),
level AS (SELECT avg(f) AS l FROM flat)
SELECT frame_id, round(median((v - d) * l / nullif(f, 0)), 5) AS median, count(*) AS n FROM px JOIN dark USING (x, y) JOIN flat USING (x, y), level WHERE group_id > 1 GROUP BY ALL""")
def p12_divide_flat(px):
    dark, flat, light = _kinds(px)
    bias = calibration.master(dark)
    done = calibration.divide_flat(calibration.subtract_master(light, bias), calibration.master(calibration.subtract_master(flat, bias)))
    return rounded(done.groupBy("frame_id").agg(F.median("v").alias("median"), F.count("*").alias("n")), 5)


@query("""t AS (SELECT frame_id, group_id, sum(floor(v * 65536)::BIGINT)::BIGINT AS t FROM px GROUP BY ALL),
p AS (SELECT a.frame_id, b.frame_id AS master_id, abs(a.t - b.t) AS distance FROM t a, t b WHERE a.group_id > 0 AND b.group_id = 0)
SELECT frame_id, arg_min(master_id, (distance, master_id)) AS master_id, min(distance) AS distance FROM p GROUP BY ALL""")
def p13_nearest_master(px):
    t = px.groupBy("frame_id", "group_id").agg(F.sum(F.floor(F.col("v") * 65536)).alias("t"))
    masters = t.where("group_id = 0").select(F.col("frame_id").alias("master_id"), "t")
    return calibration.nearest_by_scalar(t.where("group_id > 0"), masters, "frame_id", "master_id", "t")


@query("SELECT frame_id, (x // 4)::INT AS tx, (y // 4)::INT AS ty, round(median(v), 6) AS background FROM px GROUP BY ALL")
def p14_tile_background(px):
    return rounded(calibration.tile_background(px, 4))


NEAR = "o AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dx, dy))"


@query(f"""{NEAR}, n AS (SELECT frame_id, x + dx AS x, y + dy AS y, median(v) AS med FROM px, o GROUP BY ALL),
s AS (SELECT frame_id, stddev_pop(v) AS s FROM px GROUP BY ALL)
SELECT frame_id, x, y, round(v, 6) AS v, round(med, 6) AS repaired FROM px JOIN n USING (frame_id, x, y) JOIN s USING (frame_id) WHERE abs(v - med) > 3 * s""")
def p15_hot_cells(px):
    return rounded(calibration.hot_cells(px, 3.0))


@query("""s AS (SELECT frame_id, (y * 8 + x)::INT AS pos, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM px WINDOW w AS (PARTITION BY frame_id ORDER BY y * 8 + x))
SELECT frame_id, pos, round(v, 6) AS v FROM s WHERE v > 0.1::DOUBLE AND v > a AND v > b""")
def p16_local_maxima_1d(px):
    return rounded(detection.local_maxima_1d(px, 8, 0.1))


@query("""k AS (SELECT px.*, list_max(list_transform([{'dx': -1, 'dy': -1}, {'dx': -1, 'dy': 0}, {'dx': -1, 'dy': 1}, {'dx': 0, 'dy': -1}, {'dx': 0, 'dy': 1}, {'dx': 1, 'dy': -1}, {'dx': 1, 'dy': 0}, {'dx': 1, 'dy': 1}],
lambda d: CASE WHEN x + d.dx BETWEEN 0 AND 7 AND y + d.dy BETWEEN 0 AND 7 THEN embedding[(y + d.dy) * 8 + x + d.dx + 1]::DOUBLE END)) AS m FROM px JOIN embeddings ON vec_id = frame_id WHERE v > 0.1::DOUBLE)
SELECT frame_id, group_id, x, y, round(v, 6) AS v FROM k WHERE v > m""")
def p17_local_maxima_2d(px):
    return rounded(detection.local_maxima_2d(px, 0.1))


@query(f"""{NEAR}, b AS (SELECT frame_id, x, y, y * 8 + x AS c FROM px WHERE v > 0.15::DOUBLE),
e AS (SELECT frame_id, b.c AS a, d.c AS b FROM b JOIN (SELECT frame_id, x + dx AS x, y + dy AS y, c FROM b, o) d USING (frame_id, x, y)),
reach AS (SELECT frame_id, c AS a, c AS b FROM b UNION SELECT r.frame_id, r.a, e.b FROM reach r JOIN e ON e.frame_id = r.frame_id AND e.a = r.b)
SELECT r.frame_id, (r.a % 8)::INT AS x, (r.a // 8)::INT AS y, min(r.b)::INT AS source FROM reach r GROUP BY r.frame_id, r.a""")
def p18_segments(px):
    return detection.segments(px, 8, 8, 0.15)


for name in ("p03_sigma_clip_converged", "p18_segments"):
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


@query("""s AS (SELECT frame_id, sum(v * v) AS f, sum(v * v * x) AS sx, sum(v * v * y) AS sy, sum(v * v * (x * x + y * y)) AS s2 FROM px GROUP BY ALL)
SELECT frame_id, round(f, 6) AS flux, round(sx / f, 6) AS cx, round(sy / f, 6) AS cy, round(s2 / f - (sx / f) * (sx / f) - (sy / f) * (sy / f), 6) AS m2 FROM s""")
def p19_source_moments(px):
    return rounded(detection.source_moments(px.withColumn("v", F.col("v") * F.col("v")), ["frame_id"]))


@query(f"""{NEAR}, n AS (SELECT frame_id, x + dx AS x, y + dy AS y, max(v) AS m FROM px, o GROUP BY ALL),
k AS (SELECT frame_id, x AS kx, y AS ky FROM px JOIN n USING (frame_id, x, y) WHERE v > 0.1::DOUBLE AND v > m),
c AS (SELECT k.frame_id, kx, ky, x, y, greatest(v, 0::DOUBLE) AS v FROM k JOIN px ON px.frame_id = k.frame_id AND abs(x - kx) <= 1 AND abs(y - ky) <= 1),
s AS (SELECT frame_id, kx, ky, sum(v) AS f, sum(v * x) AS sx, sum(v * y) AS sy, sum(v * (x * x + y * y)) AS s2 FROM c GROUP BY ALL)
SELECT frame_id, count(*) AS sources, round(avg(2.354820045::DOUBLE * sqrt(greatest((s2 / f - (sx / f) * (sx / f) - (sy / f) * (sy / f)) / 2, 0::DOUBLE))), 6) AS fwhm FROM s GROUP BY ALL""")
def p20_frame_quality(px):
    return rounded(detection.frame_quality(px, 0.1))


CATALOGUE = "c AS (SELECT frame_id AS id, group_id, max(v) FILTER (WHERE x = 0 AND y = 0) AS cx, max(v) FILTER (WHERE x = 1 AND y = 0) AS cy FROM px GROUP BY ALL)"


def _catalogue(px):
    """A point for each frame: two of its values."""
    at = lambda x: F.max(F.when((F.col("x") == x) & (F.col("y") == 0), F.col("v")))
    return px.groupBy(F.col("frame_id").alias("id"), "group_id").agg(at(0).alias("cx"), at(1).alias("cy"))


@query(f"""{CATALOGUE} SELECT a.id AS a_id, b.id AS b_id, round((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), 8) AS d2
FROM c a JOIN c b ON a.group_id < 5 AND b.group_id >= 5 WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 0.02::DOUBLE * 0.02::DOUBLE""")
def p21_cross_match(px):
    c = _catalogue(px)
    return rounded(registration.cross_match(c.where("group_id < 5"), c.where("group_id >= 5"), 0.02), 8)


STARS = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x) AS k FROM px) WHERE k <= 6)"


CORNER = "{{'d': ({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y), 'k': {c}.k, 'x': {c}.x, 'y': {c}.y}}"
ALIKE = " AND ".join(f"abs(t.c[{i}].d * r.c[3].d - r.c[{i}].d * t.c[3].d) * 20 <= t.c[3].d * r.c[3].d" for i in (1, 2))
TRIANGLES = f"""{STARS}, t AS (SELECT a.group_id, a.frame_id, list_sort([{CORNER.format(a="a", b="b", c="c")}, {CORNER.format(a="a", b="c", c="b")}, {CORNER.format(a="b", b="c", c="a")}]) AS c
FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.k < b.k JOIN s c ON b.frame_id = c.frame_id AND b.k < c.k),
f AS (SELECT group_id, min(frame_id) AS frame_id FROM px GROUP BY ALL),
alike AS (SELECT t.group_id, t.frame_id, t.c, r.c AS e FROM t JOIN f ON t.group_id = f.group_id AND t.frame_id <> f.frame_id JOIN t r ON r.frame_id = f.frame_id
WHERE t.c[3].d > 0 AND r.c[3].d > 0 AND {ALIKE})"""


@query(f"{TRIANGLES} SELECT group_id, frame_id, count(*)::BIGINT AS votes FROM alike GROUP BY ALL")
def p22_triangle_votes(px):
    return registration.triangle_votes(registration.brightest(px, 6), 20)


#: Least squares over pairs p of stars.
FIT = """z AS (SELECT frame_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(w) AS sw, sum(x*x+y*y) AS sq, sum(x*u+y*w) AS dt, sum(x*w-y*u) AS cr FROM p GROUP BY ALL),
ab AS (SELECT *, (dt - (sx*su+sy*sw)/n) / nullif(sq - (sx*sx+sy*sy)/n, 0) AS a, (cr - (sx*sw-sy*su)/n) / nullif(sq - (sx*sx+sy*sy)/n, 0) AS b FROM z)
SELECT frame_id, round(a, 6) AS a, round(b, 6) AS b, round((su - a*sx + b*sy)/n, 6) AS tx, round((sw - b*sx - a*sy)/n, 6) AS ty FROM ab"""


@query(f"""{STARS}, f AS (SELECT group_id, min(frame_id) AS frame_id FROM px GROUP BY ALL),
r AS (SELECT s.group_id, k, x AS u, y AS w FROM s JOIN f USING (group_id, frame_id)),
p AS (SELECT s.frame_id, x::DOUBLE AS x, y::DOUBLE AS y, u::DOUBLE AS u, w::DOUBLE AS w FROM s JOIN r USING (group_id, k)),
{FIT}""")
def p23_similarity_transform(px):
    return rounded(registration.similarity_transform(registration.rank_pairs(registration.brightest(px, 6))))


def _drift(px):
    """A small transform for each frame, from its own brightness: quarter steps, exact in binary."""
    level = F.floor(F.abs(F.avg("v")) * 1024)
    return px.groupBy("frame_id").agg(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (F.pmod(level, F.lit(4)) / 4).alias("tx"), (F.pmod(level, F.lit(3)) / 2).alias("ty"))


DRIFT = """l AS (SELECT frame_id, floor(abs(avg(v)) * 1024)::BIGINT AS l FROM px GROUP BY ALL),
m AS (SELECT group_id, v, x + (l % 4) / 4::DOUBLE AS u, y + (l % 3) / 2::DOUBLE AS w FROM px JOIN l USING (frame_id)),
d AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(di, dj)),
p AS (SELECT group_id, v, floor(u)::BIGINT + di AS x, floor(w)::BIGINT + dj AS y,
(CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS c FROM m, d),
s AS (SELECT group_id, x, y, sum(v * c) / sum(c) AS value, sum(c) AS coverage FROM p WHERE c > 0 GROUP BY ALL)"""


@query(f"{DRIFT} SELECT group_id, x, y, round(value, 6) AS value, round(coverage, 6) AS coverage FROM s")
def p24_bilinear_resample(px):
    return rounded(resample.bilinear_resample(px, _drift(px)))


@query("""m AS (SELECT group_id, x, y, avg(v) AS m FROM px GROUP BY ALL)
SELECT frame_id, round(regr_slope(v, m), 5) AS slope, round(regr_intercept(v, m), 5) AS intercept, round(corr(v, m), 5) AS r FROM px JOIN m USING (group_id, x, y) GROUP BY ALL""")
def p25_photometric_scale(px):
    return rounded(registration.photometric_scale(px), 5)


@query(f"{DRIFT} SELECT x + 4 * group_id AS x, y + 2 * group_id AS y, round(sum(value * coverage) / sum(coverage), 6) AS value, round(sum(coverage), 6) AS weight FROM s GROUP BY 1, 2")
def p26_mosaic(px):
    stacks = resample.bilinear_resample(px, _drift(px)).withColumnRenamed("coverage", "weight")
    offsets = px.select("group_id").distinct().select("group_id", (F.col("group_id") * 4).alias("dx"), (F.col("group_id") * 2).alias("dy"))
    return rounded(resample.mosaic(stacks, offsets))


@query("""b AS (SELECT CASE WHEN v < -0.5 THEN 0 WHEN v >= 0.5 THEN 65 ELSE floor((v + 0.5) * 64)::INT + 1 END AS bucket, asinh(v / 0.05::DOUBLE) / asinh(1 / 0.05::DOUBLE) AS s FROM px)
SELECT bucket::INT AS bucket, count(*) AS n, round(avg(s), 6) AS stretched FROM b GROUP BY ALL""")
def p27_histogram_stretch(px):
    return rounded(resample.histogram(px, -0.5, 0.5, 64, F.avg(resample.asinh_stretch(F.col("v"), 0.05)).alias("stretched")))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM s GROUP BY user_id, k""",
    pixels=False,
)
def p28_capture_sessions(spark, sf_dir):
    e = frames.events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    s = timeline.capture_sessions(e, "user_id", "10 minutes", "cents")
    return s.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n", F.col("total").alias("cents"))


@query(
    """WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events)
SELECT event_id, user_id, click_id FROM m WHERE event_type = 'purchase'""",
    pixels=False,
)
def p29_as_of(spark, sf_dir):
    kind = F.col("event_type")
    found = timeline.as_of(frames.events(spark, sf_dir), "user_id", kind == "click", kind == "purchase")
    return found.select("event_id", "user_id", F.col("match.event_id").alias("click_id"))


@query(
    "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS stddev, min(value) AS min, max(value) AS max FROM events GROUP BY ALL",
    pixels=False,
)
def p30_live_running(spark, sf_dir):
    stream = live.arriving(spark, sf_dir, "events")
    out = live.drained(live.running_stack(stream, ["event_type"]), "running", "complete")
    return out.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


CENTS = "sum(round(value * 100)::BIGINT)::BIGINT AS cents"


def _cents(spark, sf_dir):
    return live.arriving(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))


@query(
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, {CENTS} FROM events GROUP BY ALL)
SELECT epoch_us(h) AS started, event_type, n, cents FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    pixels=False,
)
def p30_live_windows(spark, sf_dir):
    """Hours that the watermark has passed, with an hour's patience."""
    out = live.drained(live.window_stack(_cents(spark, sf_dir), ["event_type"]), "windows")
    return out.select(F.unix_micros("started").alias("started"), "event_type", "n", F.col("total").alias("cents"))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
w AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS ended, count(*) AS n, {CENTS} FROM s GROUP BY user_id, k)
SELECT epoch_us(started) AS started, epoch_us(ended) AS ended, user_id, n, cents FROM w WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    pixels=False,
)
def p30_live_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    out = live.drained(live.session_stack(_cents(spark, sf_dir), "user_id"), "sessions")
    return out.select(F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "user_id", "n", F.col("total").alias("cents"))


@query(f"""{TRIANGLES}, n AS (SELECT frame_id, c[i] AS s, e[i] AS o, count(*) AS n FROM alike, range(1, 4) r(i) GROUP BY ALL),
k AS (SELECT frame_id, s, o, row_number() OVER (PARTITION BY frame_id, s.k ORDER BY n DESC, s.k, o.k) AS of_s, row_number() OVER (PARTITION BY frame_id, o.k ORDER BY n DESC, s.k, o.k) AS of_o
FROM (SELECT frame_id, {{'k': s.k, 'x': s.x, 'y': s.y}} AS s, {{'k': o.k, 'x': o.x, 'y': o.y}} AS o, sum(n) AS n FROM n GROUP BY 1, 2, 3)),
p AS (SELECT frame_id, s.x::DOUBLE AS x, s.y::DOUBLE AS y, o.x::DOUBLE AS u, o.y::DOUBLE AS w FROM k WHERE of_s = 1 AND of_o = 1
UNION ALL SELECT frame_id, x::DOUBLE, y::DOUBLE, x::DOUBLE, y::DOUBLE FROM s JOIN f USING (group_id, frame_id)),
tr AS ({FIT.replace("z AS", "SELECT * FROM (WITH z AS", 1)})),
m AS (SELECT group_id, v, a * x - b * y + tx AS u, b * x + a * y + ty AS w FROM px JOIN tr USING (frame_id) WHERE a IS NOT NULL),
d AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(di, dj)),
q AS (SELECT group_id, v, floor(u)::BIGINT + di AS x, floor(w)::BIGINT + dj AS y,
(CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS c FROM m, d)
SELECT group_id, x, y, round(sum(v * c) / sum(c) + 1e-9::DOUBLE, 5) AS value, round(sum(c) + 1e-9::DOUBLE, 5) AS coverage FROM q WHERE c > 0 GROUP BY ALL HAVING sum(c) > 0.001""")
def p31_registered_stack(px):
    """Frames brought onto their group's first one by the stars that triangles pair, and stacked there; sums moved off the ties of rounding."""
    pairs = registration.voted_pairs(registration.brightest(px, 6), 20)
    stack = resample.bilinear_resample(px, rounded(registration.similarity_transform(pairs)), least=0.001)
    off_ties = lambda c: (F.col(c) + 1e-9).alias(c)
    return rounded(stack.select("group_id", "x", "y", off_ties("value"), off_ties("coverage")), 5)


#: A turn, a shift and its scale for each frame, from its own brightness: rotations of right triangles, exact in small fractions.
TURNS = [(1.0, 0.0), (0.6, 0.8), (0.8, -0.6)]


def _turns(px):
    level = F.floor(F.abs(F.avg("v")) * 1024)
    turn = lambda k: F.array(*(F.lit(t[k]) for t in TURNS))[F.pmod(level, F.lit(3)).cast("int")]
    return px.groupBy("frame_id").agg(turn(0).alias("a"), turn(1).alias("b"), (F.pmod(level, F.lit(4)) / 4).alias("tx"), (F.pmod(level, F.lit(5)) / 8).alias("ty"))


@query("""l AS (SELECT frame_id, floor(abs(avg(v)) * 1024)::BIGINT AS l FROM px GROUP BY ALL),
t AS (SELECT frame_id, 1.5::DOUBLE * [1, 0.6, 0.8][l % 3 + 1]::DOUBLE AS a, 1.5::DOUBLE * [0, 0.8, -0.6][l % 3 + 1]::DOUBLE AS b, 1.5::DOUBLE * (l % 4) / 4 AS tx, 1.5::DOUBLE * (l % 5) / 8 AS ty FROM l),
m AS (SELECT group_id, v, a * x - b * y + tx AS u, b * x + a * y + ty AS w, a * 0.35::DOUBLE AS p, b * 0.35::DOUBLE AS q FROM px JOIN t USING (frame_id)),
c AS (SELECT *, unnest(range(floor(u - abs(p) - abs(q))::BIGINT, ceil(u + abs(p) + abs(q))::BIGINT + 1)) AS i FROM m),
d AS (SELECT *, unnest(range(floor(w - abs(p) - abs(q))::BIGINT, ceil(w + abs(p) + abs(q))::BIGINT + 1)) AS j FROM c),
k AS (SELECT group_id, v, p, q, i, j, [(u - p + q, w - q - p), (u + p + q, w + q - p), (u + p - q, w + q + p), (u - p - q, w - q + p), (u - p + q, w - q - p)] AS k FROM d),
e AS (SELECT group_id, v, p, q, i, j, k[n][1] - i AS x0, k[n][2] - j AS y0, k[n + 1][1] - i AS x1, k[n + 1][2] - j AS y1 FROM k, range(1, 5) r(n)),
h AS (SELECT *, least(greatest(x0, -0.5), 0.5) AS xa, least(greatest(x1, -0.5), 0.5) AS xb, CASE WHEN abs(x1 - x0) < 1e-9 THEN 0 ELSE (y1 - y0) / (x1 - x0) END AS s FROM e),
g AS (SELECT *, y0 + (xa - x0) * s + 0.5 AS ya, y0 + (xb - x0) * s + 0.5 AS yb FROM h),
f AS (SELECT group_id, i, j, v, p, q, (xa - xb) * CASE WHEN abs(yb - ya) < 1e-9 THEN least(greatest(ya, 0), 1) ELSE
((CASE WHEN yb < 0 THEN 0 WHEN yb < 1 THEN yb * yb / 2 ELSE yb - 0.5 END) - (CASE WHEN ya < 0 THEN 0 WHEN ya < 1 THEN ya * ya / 2 ELSE ya - 0.5 END)) / (yb - ya) END / (4 * (p * p + q * q)) AS c FROM g)
SELECT group_id, i AS x, j AS y, round(sum(v * c) / sum(c) + 1e-9::DOUBLE, 5) + 0 AS value, round(sum(c) + 1e-9::DOUBLE, 5) AS coverage, round(sum(v * c) + 1e-9::DOUBLE, 5) + 0 AS flux FROM f GROUP BY ALL HAVING sum(c) > 1e-12""")
def p32_drizzle(px):
    """Drops of 0.7 pixels on a grid of 1.5 cells a pixel; sums moved off the ties of rounding."""
    out = resample.drizzle(px, _turns(px), 0.7, 1.5)
    return rounded(out.select("group_id", "x", "y", *((F.col(c) + 1e-9).alias(c) for c in ("value", "coverage", "flux"))), 5)


@query("""o AS (SELECT frame_id, group_id * 64 + y * 8 + x AS star_id, v AS m, (1 + (x + y) % 3)::DOUBLE AS w FROM px WHERE v > 0.05::DOUBLE),
r AS (SELECT 0 AS round, frame_id, star_id, m, w, 0::DOUBLE AS z FROM o
UNION ALL SELECT round + 1, frame_id, star_id, m, w, sum(w * (m - t)) OVER (PARTITION BY frame_id) / sum(w) OVER (PARTITION BY frame_id) FROM
(SELECT *, sum(w * (m - z)) OVER (PARTITION BY star_id) / sum(w) OVER (PARTITION BY star_id) AS t FROM r WHERE round < 60)),
z AS (SELECT frame_id, any_value(z) AS z, count(*) AS n, any_value(star_id) // 64 AS g FROM r WHERE round = 60 GROUP BY frame_id)
SELECT frame_id, min(frame_id) OVER (PARTITION BY g) AS component, round(z - avg(z) OVER (PARTITION BY g), 6) AS zero_point, n FROM z""")
def p33_global_photometry(px):
    """Bright cells as stars that the frames of a group share; the counterpart repeats fits of stars and of frames by turns."""
    star = (F.col("group_id") * 64 + F.col("y") * 8 + F.col("x")).cast("long").alias("star_id")
    seen = px.where("v > 0.05").select("frame_id", star, F.col("v").alias("m"), (1 + (F.col("x") + F.col("y")) % 3).alias("w"))
    return rounded(photometry.zero_points(seen, weight="w")[0])


ORACLE_SQL["p33_global_photometry"] = ORACLE_SQL["p33_global_photometry"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""{CATALOGUE}, d AS (SELECT a.id AS a_id, b.id AS b_id, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2 FROM c a JOIN c b ON a.group_id < 5 AND b.group_id >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id)::INT AS rank FROM d)
SELECT a_id, b_id, round(d2, 8) AS d2, rank FROM r WHERE rank <= 3""")
def p34_nearest_entries(px):
    c = _catalogue(px)
    return rounded(nearest.nearest(c.where("group_id < 5"), c.where("group_id >= 5"), 3), 8)


@query(
    """WITH s AS (SELECT min(event_id) AS s FROM events WHERE event_type = 'signup'),
m AS (SELECT event_id AS master_id, ts AS valid_from, CASE WHEN event_id <> s THEN ts + INTERVAL 1 MINUTE * (5 * (event_id % 7 + 1)) END AS valid_to FROM events, s WHERE event_type = 'signup')
SELECT event_id, count(*) AS n, max(master_id) AS master_id FROM events JOIN m ON ts >= valid_from AND (valid_to IS NULL OR ts < valid_to) WHERE event_type <> 'signup' GROUP BY event_id""",
    pixels=False,
)
def p35_valid_masters(spark, sf_dir):
    """Signups as masters of 5 to 35 minutes, the first one without an end; the others as exposures, with the masters valid at their time."""
    e = frames.events(spark, sf_dir)
    first = e.where("event_type = 'signup'").agg(F.min("event_id")).first()[0]
    until = F.when(F.col("event_id") != F.lit(first), F.col("ts") + F.make_dt_interval(mins=(5 * (F.col("event_id") % 7 + 1)).cast("int")))
    masters = e.where("event_type = 'signup'").select(F.col("event_id").alias("master_id"), F.col("ts").alias("valid_from"), until.alias("valid_to"))
    found = validity.valid_at(e.where("event_type <> 'signup'").select("event_id", "ts"), masters)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.max("match.master_id").alias("master_id"))


@query(
    """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, value AS v FROM events),
c1 AS (SELECT *, avg(v) OVER c AS m, stddev_pop(v) OVER c AS s, count(*) OVER c AS n FROM w WINDOW c AS (PARTITION BY h, event_type)),
c2 AS (SELECT h, event_type, v, n, avg(v) OVER c AS m, stddev_pop(v) OVER c AS s FROM c1 WHERE abs(v - m) <= 2::DOUBLE * s WINDOW c AS (PARTITION BY h, event_type))
SELECT epoch_us(h) AS started, event_type, any_value(n) AS n, count(*) AS kept, round(avg(v), 5) AS mean FROM c2 WHERE abs(v - m) <= 2::DOUBLE * s AND h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY h, event_type""",
    pixels=False,
)
def p36_live_clipped(spark, sf_dir):
    """Clipped hours that the watermark has passed."""
    out = live.drained(live.clipped_stack(live.arriving(spark, sf_dir, "events"), ["event_type"]), "clipped", timers=True)
    return out.select(F.unix_micros("started").alias("started"), "event_type", "n", "kept", F.round("mean", 5).alias("mean"))


@query(
    """WITH f AS (SELECT * FROM events WHERE event_type = 'purchase'), m AS (SELECT * FROM events WHERE event_type = 'click'),
w AS (SELECT least((SELECT max(ts) FROM f), (SELECT max(ts) FROM m)) - INTERVAL 1 HOUR AS w)
SELECT f.event_id, m.event_id AS master_id FROM f LEFT JOIN m ON f.user_id = m.user_id AND m.ts >= f.ts - INTERVAL 30 MINUTE AND m.ts <= f.ts + INTERVAL 10 MINUTE, w WHERE m.event_id IS NOT NULL OR f.ts + INTERVAL 10 MINUTE <= w""",
    pixels=False,
)
def p37_live_calibrated(spark, sf_dir):
    """Purchases as exposures, clicks as masters: all matches, and those without one that the watermark has passed."""
    of = lambda kind: live.arriving(spark, sf_dir, "events").where(F.col("event_type") == kind)
    out = live.calibrated(of("purchase").select("event_id", "user_id", "ts"), of("click"), "user_id")
    return live.drained(out, "calibrated").select("event_id", "master_id")


@query("""c0 AS (SELECT frame_id, x, y, (x // 2)::INT AS tx, (y // 2)::INT AS ty, v FROM px),
c1 AS (SELECT *, median(v) OVER t AS m, stddev_pop(v) OVER t AS s FROM c0 WINDOW t AS (PARTITION BY frame_id, tx, ty)),
c2 AS (SELECT frame_id, tx, ty, v, median(v) OVER t AS m, stddev_pop(v) OVER t AS s FROM c1 WHERE abs(v - m) <= 1.4::DOUBLE * s WINDOW t AS (PARTITION BY frame_id, tx, ty)),
mesh AS (SELECT frame_id, tx, ty, median(v) AS l FROM c2 WHERE abs(v - m) <= 1.4::DOUBLE * s GROUP BY ALL),
p AS (SELECT frame_id, x, y, (x - 0.5::DOUBLE) / 2 AS u, (y - 0.5::DOUBLE) / 2 AS w FROM px),
o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(di, dj)),
k AS (SELECT frame_id, x, y, greatest(0, least(3, floor(u)::INT + di)) AS tx, greatest(0, least(3, floor(w)::INT + dj)) AS ty,
(CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS c FROM p, o)
SELECT frame_id, x, y, round(sum(c * l) + 1e-9::DOUBLE, 5) + 0 AS background FROM k JOIN mesh USING (frame_id, tx, ty) GROUP BY ALL""")
def p38_background_surface(px):
    """Tiles of 2 x 2 pixels, clipped twice at 1.4 deviations; sums moved off the ties of rounding."""
    out = background.background_surface(px, 2, k=1.4, passes=2)
    return rounded(out.select("frame_id", "x", "y", (F.col("background") + 1e-9).alias("background")), 5)


@query("SELECT group_id, x, y, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_disc(v, 0.5), 6) AS median FROM px GROUP BY ALL")
def p39_incremental_stack(px):
    """Frames that come in four batches, the second one twice; sketches that are exact up to 4,096 frames."""
    spark = px.sparkSession
    path = new_path(spark, "stack")
    until_exit(spark, path)
    stack = incremental.IncrementalStack(spark, path, k=4096)
    for k in (0, 1, 1, 2, 3):
        stack.add(px.where(F.pmod(F.col("frame_id"), F.lit(4)) == k), "frames", k)
    return rounded(stack.result().select("group_id", "x", "y", "n", "mean", "stddev", "min", "max", F.col("q")[0].alias("median")))
