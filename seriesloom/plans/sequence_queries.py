"""Queries over series: features, neighbours, rotations, windows, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import candidates as C
from ..operators import verify as V
from ..operators import windows as W
from ..operators.neighbours import k_nearest, most_similar_others
from .base import POINTS_SQL, SERIES, Registry, table, user_series

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


@R.add(f"""WITH {SERIES}, f AS (SELECT id, len(s) AS n, list_avg(s) AS m, list_stddev_pop(s) AS d, list_min(s) AS lo, list_max(s) AS hi FROM series),
z AS (SELECT id, n, (m - avg(m) OVER w) / coalesce(nullif(stddev_pop(m) OVER w, 0), 1) AS a, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS b,
  (lo - avg(lo) OVER w) / coalesce(nullif(stddev_pop(lo) OVER w, 0), 1) AS c, (hi - avg(hi) OVER w) / coalesce(nullif(stddev_pop(hi) OVER w, 0), 1) AS e FROM f WINDOW w AS (PARTITION BY n)),
p AS (SELECT x.id AS id, y.id AS cand_id, round(sqrt((x.a-y.a)**2 + (x.b-y.b)**2 + (x.c-y.c)**2 + (x.e-y.e)**2), 6) AS dist FROM z x JOIN z y ON x.id <> y.id AND x.n = y.n)
SELECT id, cand_id, CAST(rank AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cand_id) AS rank FROM p) WHERE rank <= 3""")
def candidate_negatives(spark, sf):
    """JOI6 SRT1 WIN3-4: three nearest other series of the same length by standardised features."""
    items = user_series(spark, sf).withColumn("f", C.features4(F.col("s"))).withColumn("n", F.size("s"))
    return k_nearest(C.standardised(items, "f", ["n"], 4), 3, ["n"])


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, d AS (SELECT id, pos, x, x - lag(x) OVER (PARTITION BY id ORDER BY pos) AS d, lead(x) OVER (PARTITION BY id ORDER BY pos) AS nx FROM points),
t AS (SELECT id, pos, x, d, nx, lag(d) OVER (PARTITION BY id ORDER BY pos) AS pd FROM d)
SELECT id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, min(x) AS low, max(x) AS high, round(regr_slope(x, pos), 6) AS slope, round(corr(x, nx), 6) AS lag1,
  round(avg(abs(d)), 6) AS step, CAST(count(*) FILTER (WHERE d * pd < 0) AS BIGINT) AS turns FROM t GROUP BY id""")
def series_summary(spark, sf):
    """WIN4 WIN5 WIN8: eight numbers of each series."""
    s = F.col("s")
    return user_series(spark, sf).select("id", r(S.mean(s)).alias("mean"), r(S.pop_std(s)).alias("sd"), F.array_min(s).alias("low"), F.array_max(s).alias("high"), r(S.slope(s)).alias("slope"), r(S.lag1_autocorrelation(s)).alias("lag1"), r(S.mean_abs_diff(s)).alias("step"), S.turning_points(s).alias("turns"))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, h AS (SELECT a.id AS a, b.id AS b, a.pos AS pa, a.pos - b.pos AS diag FROM points a JOIN points b ON round(a.x, 1) = round(b.x, 1) AND a.n = b.n AND a.id < b.id),
i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, diag ORDER BY pa) AS g FROM h), c AS (SELECT a, b, diag, g, count(*) AS run FROM i GROUP BY ALL)
SELECT a, b, CAST(max(run) AS BIGINT) AS run FROM c GROUP BY a, b""")
def longest_shared_run(spark, sf):
    """WIN6: longest run of equal rounded values that two series share."""
    return C.shared_runs(user_series(spark, sf).withColumn("n", F.size("s")), ["n"], 1)


@R.add(f"""WITH {SERIES}, f AS (SELECT id, len(s) AS n, list_avg(s) AS m, list_stddev_pop(s) AS d FROM series),
z AS (SELECT id, n, (m - avg(m) OVER w) / coalesce(nullif(stddev_pop(m) OVER w, 0), 1) AS za, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS zb FROM f WINDOW w AS (PARTITION BY n)),
{POINTS_SQL}, h AS (SELECT a.id AS a, b.id AS b, a.pos AS pa, a.pos - b.pos AS diag FROM points a JOIN points b ON round(a.x, 1) = round(b.x, 1) AND a.n = b.n AND a.id <> b.id),
i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, diag ORDER BY pa) AS g FROM h), runs AS (SELECT a, b, max(run) AS run FROM (SELECT a, b, diag, g, count(*) AS run FROM i GROUP BY ALL) GROUP BY a, b),
p AS (SELECT x.id AS id, y.id AS cand_id, round(sqrt((x.za-y.za)**2 + (x.zb-y.zb)**2), 6) AS dist FROM z x JOIN z y ON x.id <> y.id AND x.n = y.n LEFT JOIN runs ON a = x.id AND b = y.id WHERE coalesce(run, 0) < 0.04 * x.n)
SELECT id, cand_id, CAST(rank AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cand_id) AS rank FROM p) WHERE rank <= 3""")
def candidate_negatives_overlap(spark, sf):
    """SRT1 WIN6: nearest series whose shared run stays under a share of the length."""
    items = user_series(spark, sf).withColumn("n", F.size("s")).withColumn("f", F.array(S.mean(F.col("s")), S.pop_std(F.col("s"))))
    z = C.standardised(items, "f", ["n"], 2)
    return C.nearest_without_overlap(z, 3, ["n"], 0.04, 1)


@R.add("""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
p AS (SELECT a.id AS id, b.id AS cand_id, round(list_inner_product(a.e, b.e), 6) AS sim FROM u a JOIN u b ON a.id <> b.id AND a.label <> b.label WHERE a.id % 20 = 0)
SELECT id, cand_id, CAST(rank AS INTEGER) AS rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cand_id) AS rank FROM p) WHERE rank <= 3""")
def similar_other_class(spark, sf):
    """JOI8 FLT17 SRT6: most similar vectors of another class, for the query set of ids divisible by 20 against all rows."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    u = v.withColumn("e", F.transform("e", lambda x: x / F.sqrt(S.dot(F.col("e"), F.col("e")))))
    return most_similar_others(u, u.where("id % 20 = 0"), 3)


@R.add(f"""WITH {SERIES}, z AS (SELECT id, list_transform(s, lambda x: (x - list_avg(s)) / coalesce(nullif(list_stddev_pop(s), 0), 1)) AS z FROM series),
q AS (SELECT id, list_transform(range(0, 16), lambda i: z[CAST(floor(i * (len(z) - 1) / 15.0) AS BIGINT) + 1] * (1 - (i * (len(z) - 1) / 15.0 - floor(i * (len(z) - 1) / 15.0)))
  + z[least(CAST(floor(i * (len(z) - 1) / 15.0) AS BIGINT) + 2, len(z))] * (i * (len(z) - 1) / 15.0 - floor(i * (len(z) - 1) / 15.0))) AS v FROM z),
p AS (SELECT a.id AS id, b.id AS cand_id, round(list_distance(a.v, b.v), 5) AS dist FROM q a JOIN q b ON a.id <> b.id)
SELECT id, cand_id, CAST(rank AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist DESC, cand_id) AS rank FROM p) WHERE rank <= 3""")
def farthest_resampled(spark, sf):
    """JOI9 WIN26: farthest series after z-normalising and resampling to 16 points."""
    items = user_series(spark, sf).select("id", S.resampled(S.z_normalised(F.col("s")), 16).alias("v"))
    return k_nearest(items, 3, [], "v", digits=5, farthest=True)


@R.add(f"""WITH {SERIES}, x AS (SELECT id, s, list_position(s, list_max(s)) - 1 AS hi, list_position(s, list_min(s)) - 1 AS lo FROM series),
w AS (SELECT id, hi, lo, scope, CASE scope WHEN 'after_peak' THEN s[hi + 1:] WHEN 'before_peak' THEN s[1:hi] WHEN 'after_trough' THEN s[lo + 1:] WHEN 'before_trough' THEN s[1:lo] ELSE s END AS p FROM x, (VALUES ('whole'), ('after_peak'), ('before_peak'), ('after_trough'), ('before_trough')) t(scope))
SELECT id, scope, CAST(hi AS BIGINT) AS argmax, CAST(lo AS BIGINT) AS argmin, CAST(len(p) AS BIGINT) AS n, round(list_avg(p), 6) AS mean, list_min(p) AS low, list_max(p) AS high FROM w""")
def scope_windows(spark, sf):
    """WIN9 WIN10: places of the extremes, and the five windows that they bound."""
    s = F.col("s")
    scopes = F.array(*(F.struct(F.lit(n).alias("scope"), S.scope_window(s, F.lit(n)).alias("p")) for n in ("whole", "after_peak", "before_peak", "after_trough", "before_trough")))
    rows = user_series(spark, sf).select("id", S.argmax(s).cast("long").alias("argmax"), S.argmin(s).cast("long").alias("argmin"), F.explode(scopes).alias("w"))
    p = F.col("w.p")
    return rows.select("id", "w.scope", "argmax", "argmin", F.size(p).cast("long").alias("n"), r(S.mean(p)).alias("mean"), F.array_min(p).alias("low"), F.array_max(p).alias("high"))


METRICS = ("max", "min", "mean_high", "mean_low", "steepest_rise", "steepest_fall", "net_rise", "net_fall", "most_volatile", "least_volatile")


def _regions(spark, sf, metrics=("mean_high",)):
    cuts = F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for c, a, b in (("A", 0.0, 0.25), ("B", 0.25, 0.5), ("C", 0.4, 0.7), ("D", 0.7, 1.0))))
    rows = user_series(spark, sf).select("id", "s", F.explode(cuts).alias("o"))
    rows = rows.select("id", "s", F.col("o.letter").alias("letter"), S.fraction_index(F.col("s"), F.col("o.lo")).alias("first"), S.fraction_index(F.col("s"), F.col("o.hi")).alias("last"))
    own = S.part(F.col("s"), F.col("first"), F.col("last"))
    scores = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(S.region_score(own, F.lit(m)), 9).alias("score")) for m in metrics)))
    return rows.select("id", "letter", "first", "last", scores.alias("m")).select("id", "m.metric", "letter", "first", "last", "m.score")


def _regions_sql(metrics) -> str:
    """regions, best and rival by id and metric."""
    listed = ", ".join(f"('{m}')" for m in metrics)
    return f"""{SERIES}, cuts(letter, lo, hi) AS (VALUES ('A', 0.0, 0.25), ('B', 0.25, 0.5), ('C', 0.4, 0.7), ('D', 0.7, 1.0)),
parts AS (SELECT id, letter, f AS first, l AS last, s[f + 1:l + 1] AS p FROM (SELECT *, CAST(round_even(CAST(lo AS DOUBLE) * (len(s) - 1), 0) AS INTEGER) AS f, CAST(round_even(CAST(hi AS DOUBLE) * (len(s) - 1), 0) AS INTEGER) AS l FROM series, cuts)),
steps AS (SELECT *, list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]) AS d FROM parts),
regions AS (SELECT id, metric, letter, first, last, round(CASE metric WHEN 'max' THEN list_max(p) WHEN 'min' THEN -list_min(p) WHEN 'mean_high' THEN list_avg(p) WHEN 'mean_low' THEN -list_avg(p) WHEN 'steepest_rise' THEN list_max(d)
  WHEN 'steepest_fall' THEN -list_min(d) WHEN 'net_rise' THEN p[len(p)] - p[1] WHEN 'net_fall' THEN p[1] - p[len(p)] WHEN 'most_volatile' THEN list_stddev_pop(d) ELSE -list_stddev_pop(d) END, 9) AS score FROM steps, (VALUES {listed}) m(metric)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, metric ORDER BY score >= top - 1e-6 * (abs(top) + 1) DESC, last - first, letter) AS rn FROM (SELECT *, max(score) OVER (PARTITION BY id, metric) AS top FROM regions)) WHERE rn = 1),
rival AS (SELECT r.id, r.metric, max(r.score) AS rival FROM regions r JOIN best b ON r.id = b.id AND r.metric = b.metric AND r.letter <> b.letter WHERE least(r.last, b.last) - greatest(r.first, b.first) + 1 < 2 GROUP BY r.id, r.metric)"""


@R.add(f"WITH {_regions_sql(METRICS)} SELECT b.id, b.metric, b.letter, round(b.score, 6) AS best, round((b.score - rival) / nullif(abs(b.score), 0), 6) AS margin FROM best b LEFT JOIN rival USING (id, metric)")
def region_winner(spark, sf):
    """WIN11 WIN12 WIN13: the winning region by each of ten metrics, its margin over rivals that do not overlap."""
    return V.region_winners(_regions(spark, sf, METRICS), ["id", "metric"]).select("id", "metric", "letter", r("best").alias("best"), r("margin").alias("margin"))


REGIONS_SQL = _regions_sql(("mean_high",))


@R.add(f"""WITH {REGIONS_SQL}, j AS (SELECT b.id, b.letter AS computed, (b.score - rival) / nullif(abs(b.score), 0) AS margin, chr(65 + CAST(b.id % 4 AS INTEGER)) AS stated FROM best b LEFT JOIN rival USING (id))
SELECT id, CASE WHEN id % 7 = 3 THEN 'DROP' WHEN coalesce(margin, 1.0) < 0.05 THEN 'DROP' WHEN stated = computed THEN 'KEEP' ELSE 'CORRECT' END AS decision,
  CASE WHEN id % 7 = 3 OR coalesce(margin, 1.0) < 0.05 THEN NULL ELSE computed END AS truth FROM j""")
def decision_cascade(spark, sf):
    """FLT16: keep, correct or drop a stated answer, first rule first."""
    won = V.region_winners(_regions(spark, sf), ["id"])
    stated = F.char(65 + F.col("id") % 4)
    d = V.decide(F.lit("region"), stated, F.col("letter"), F.col("margin"), 0.05, F.col("id") % 7 != 3, F.lit(False), F.lit(True))
    return won.select("id", d.alias("d")).select("id", "d.decision", "d.truth")


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, g AS (SELECT id, regr_slope(x, pos) AS b, regr_intercept(x, pos) AS a, max(x) - min(x) AS spread, first(n) AS n FROM points GROUP BY id),
q AS (SELECT p.id, stddev_pop(x - (a + b * pos)) / any_value(spread) AS rough FROM points p JOIN g USING (id) GROUP BY p.id),
w AS (SELECT id, s, (s[len(s)] - s[1]) / (list_max(s) - list_min(s)) AS net, (list_position(s, list_max(s)) - 1) / (len(s) - 1) AS top, (list_position(s, list_min(s)) - 1) / (len(s) - 1) AS low FROM series)
SELECT w.id, CASE WHEN net >= 0.6 AND rough < 0.2 THEN 'rising' WHEN net <= -0.6 AND rough < 0.2 THEN 'falling' WHEN top BETWEEN 0.25 AND 0.75 AND abs(net) < 0.4 AND NOT low BETWEEN 0.25 AND 0.75 THEN 'peak'
  WHEN low BETWEEN 0.25 AND 0.75 AND abs(net) < 0.4 AND NOT top BETWEEN 0.25 AND 0.75 THEN 'valley' WHEN rough >= 0.25 THEN 'volatile' ELSE 'mixed' END AS shape, round(rough, 6) AS rough FROM w JOIN q USING (id)""")
def shape_class(spark, sf):
    """WIN14 WIN21: shape of a series, and the spread left after its line."""
    s = F.col("s")
    return user_series(spark, sf).select("id", S.shape(s).alias("shape"), r(S.roughness(s)).alias("rough"))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, forms AS (SELECT id, pos, f, CASE f WHEN 'own' THEN x WHEN 'steps' THEN floor(x / 40) ELSE 7.5 END AS x FROM points, (VALUES ('own'), ('steps'), ('constant')) t(f)),
e AS (SELECT id, f, x, lag(x) OVER w AS p, lead(x) OVER w AS q, 0.12 * (max(x) OVER (PARTITION BY id, f) - min(x) OVER (PARTITION BY id, f) + 1e-9) AS need FROM forms WINDOW w AS (PARTITION BY id, f ORDER BY pos))
SELECT id, f AS form, CAST(count(*) FILTER (WHERE x > p AND x >= q AND x - greatest(p, q) >= need) AS BIGINT) AS peaks, CAST(count(*) FILTER (WHERE x < p AND x <= q AND least(p, q) - x >= need) AS BIGINT) AS dips FROM e GROUP BY id, f""")
def local_feature_count(spark, sf):
    """WIN16: inner points that stand out from both neighbours: of the series, of its values in steps of 40, and of a constant one."""
    s = F.col("s")
    forms = {"own": s, "steps": F.transform(s, lambda x: F.floor(x / 40).cast("double")), "constant": F.transform(s, lambda x: F.lit(7.5))}
    rows = user_series(spark, sf).select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("form"), c.alias("s")) for n, c in forms.items()))).alias("f"))
    return rows.select("id", "f.form", S.local_features(F.col("f.s"), "peak").alias("peaks"), S.local_features(F.col("f.s"), "dip").alias("dips"))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, d AS (SELECT id, pos, coalesce(abs(x - lag(x) OVER w) > 0.1 * (max(x) OVER (PARTITION BY id) - min(x) OVER (PARTITION BY id)), false) AS brk FROM points WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT id, pos, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY id ORDER BY pos) AS g FROM d), c AS (SELECT id, g, min(pos) AS start, count(*) AS length FROM g GROUP BY id, g)
SELECT id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length DESC, start) AS rn FROM c) WHERE rn = 1""")
def flat_run(spark, sf):
    """WIN19: longest stretch of small steps."""
    return user_series(spark, sf).select("id", S.flat_run(F.col("s"), 0.1).alias("f")).select("id", "f.start", "f.length")


@R.add(f"""WITH {SERIES}, p AS (SELECT id, s[5:21] AS p FROM series)
SELECT id, round(list_avg(p), 4) AS mean, round(list_min(p), 4) AS min, round(list_max(p), 4) AS max, CAST(list_position(p, list_max(p)) + 3 AS BIGINT) AS argmax, CAST(list_position(p, list_min(p)) + 3 AS BIGINT) AS argmin, round(p[17] - p[1], 4) AS net FROM p""")
def segment_tool(spark, sf):
    """WIN20 WIN22: statistics of positions 4 to 20."""
    got = user_series(spark, sf).select("id", V.segment_statistics(F.col("s"), F.lit(4), F.lit(20)).alias("t"))
    return got.select("id", "t.mean", "t.min", "t.max", "t.argmax", "t.argmin", "t.net")


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, t AS (SELECT id, regr_slope(x, pos) * count(*) / nullif(stddev_pop(x), 0) AS m FROM points GROUP BY id)
SELECT id, CASE WHEN m > 0.5 THEN 'upward' WHEN m < -0.5 THEN 'downward' ELSE 'flat' END AS trend, round(m, 5) AS move FROM t""")
def trend_word(spark, sf):
    """WIN23: upward, downward or flat."""
    s = F.col("s")
    return user_series(spark, sf).select("id", S.trend_word(s).alias("trend"), r(S.slope(s) * F.size(s) / S.pop_std(s), 5).alias("move"))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, c AS (SELECT id, pos, n, x - avg(x) OVER (PARTITION BY id) AS x FROM points), v AS (SELECT id, sum(x * x) AS v, any_value(n) AS n FROM c GROUP BY id),
k AS (SELECT a.id, b.pos - a.pos AS lag, round(sum(a.x * b.x) / any_value(v.v), 9) AS r FROM c a JOIN c b ON a.id = b.id AND b.pos - a.pos BETWEEN 2 AND a.n // 2 JOIN v ON v.id = a.id GROUP BY a.id, b.pos - a.pos),
m AS (SELECT id, lag, r, row_number() OVER (PARTITION BY id ORDER BY r DESC, lag) AS rn FROM k)
SELECT id, CASE WHEN r > 0.3 THEN CAST(lag AS BIGINT) END AS season FROM m WHERE rn = 1""")
def season_lag(spark, sf):
    """WIN24: lag of the highest autocorrelation, if it is high."""
    return user_series(spark, sf).select("id", S.season(F.col("s")).alias("season"))


@R.add(f"""WITH {SERIES} SELECT id, round(list_avg(s[1:(n + 3) // 4]), 6) AS q1, round(list_avg(s[(n + 3) // 4 + 1:(n + 3) // 4 + (n + 2) // 4]), 6) AS q2, round(list_avg(s[(n + 3) // 4 + (n + 2) // 4 + 1:n - n // 4]), 6) AS q3, round(list_avg(s[n - n // 4 + 1:]), 6) AS q4,
  array_to_string(list_distinct(list_transform(range(0, 8), lambda i: CAST(round_even(i * (len(s) - 1) / 7.0, 0) AS INTEGER))).list_sort(), ',') AS points FROM (SELECT *, len(s) AS n FROM series)""")
def quarter_means(spark, sf):
    """WIN27 WIN28: means of quarters and evenly spaced sample places."""
    s, q = F.col("s"), F.col("q")
    got = user_series(spark, sf).select("id", S.block_means(s).alias("q"), F.array_join(F.array_sort(S.sample_points(s, 8)).cast("array<string>"), ",").alias("points"))
    return got.select("id", *(r(q[i]).alias(f"q{i + 1}") for i in range(4)), "points")


@R.add(f"""WITH {SERIES}, m AS (SELECT id, s, list_min(s) AS lo, list_max(s) - list_min(s) AS w FROM series)
SELECT id, round(list_avg(list_transform(s, lambda x: (greatest(ceil((x - lo) / w * 100), 1) - 0.5) / 100)), 6) AS mean_bin, CAST(len(list_distinct(list_transform(s, lambda x: greatest(ceil((x - lo) / w * 100), 1)))) AS BIGINT) AS bins FROM m""")
def quantised_bins(spark, sf):
    """WIN32: min-max scaled, right-closed bins."""
    q = S.quantised(F.col("s"), 100)
    return user_series(spark, sf).select("id", r(S.mean(q)).alias("mean_bin"), F.size(F.array_distinct(F.transform(q, lambda x: F.round(x, 6)))).cast("long").alias("bins"))


@R.add(f"""WITH {SERIES}, a AS (SELECT x.id AS id, x.s AS s, y.s AS o FROM series x JOIN series y ON y.id = x.id + 1)
SELECT a.id, CAST(len(list_filter(o, lambda x: list_contains(list_transform(s, lambda y: round(y, 1)), round(x, 1)))) AS BIGINT) AS shared FROM a""")
def shared_values(spark, sf):
    """WIN7: how many values of the next series occur in this one."""
    base = user_series(spark, sf)
    nxt = base.select((F.col("id") - 1).alias("id"), F.col("s").alias("o"))
    return base.join(nxt, "id").select("id", S.shared_values(F.col("s"), F.col("o"), 1).alias("shared"))


@R.add(f"""WITH {SERIES} SELECT id, (list_min(s) IS NOT NULL AND len(list_filter(s, lambda x: NOT isfinite(x))) = 0) AS finite, len(s) BETWEEN 8 AND 60 AND len(list_distinct(s)) > 3 AS legible FROM series""")
def finite_filter(spark, sf):
    """FLT4 FLT10: finite values, and few enough to read."""
    return user_series(spark, sf).select("id", S.is_finite(F.col("s")).alias("finite"), S.legible(F.col("s")).alias("legible"))


@R.add(f"""WITH {SERIES}, e AS (SELECT user_id AS id, max(value) AS v FROM events GROUP BY user_id)
SELECT id, round(list_min(list_transform(s, lambda x: abs(v - x))) / nullif(list_stddev_pop(s), 0), 6) AS gap FROM series JOIN e USING (id)""")
def nearest_value(spark, sf):
    """JOI19: a stated number against the closest value of the series."""
    top = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("v"))
    return user_series(spark, sf).join(top, "id").select("id", r(S.nearest_gap(F.col("s"), F.col("v"))).alias("gap"))


@R.add(f"""WITH {SERIES}, f AS (SELECT id, list_avg(s) AS m FROM series), p AS (SELECT x.id AS id, y.id AS cand, row_number() OVER (PARTITION BY x.id ORDER BY round(abs(x.m - y.m), 6), y.id) AS rk FROM f x JOIN f y ON x.id <> y.id),
d AS (SELECT id, list(cand ORDER BY rk) AS d FROM p WHERE rk <= 3 GROUP BY id)
SELECT id, g AS place, array_to_string(list_concat(list_concat(d[1:g], [id]), d[g + 1:3]), ',') AS options FROM d, unnest(range(0, 4)) AS t(g)""")
def rotation_items(spark, sf):
    """RNG6 JOI20 UDF10: the gold series at each of four places among its nearest three."""
    items = user_series(spark, sf).select("id", F.array(S.mean(F.col("s"))).alias("z"))
    near = k_nearest(items, 3, []).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]).alias("d"))
    return C.rotations(near, "id", "d", 4).select("id", F.col("place").cast("long").alias("place"), F.array_join(F.col("options").cast("array<string>"), ",").alias("options"))


@R.add(f"""WITH {SERIES}, m AS (SELECT id, id % 5 AS g FROM series), f AS (SELECT id, list_avg(s) AS v FROM series),
c AS (SELECT id, cand FROM (SELECT x.id AS id, y.id AS cand, row_number() OVER (PARTITION BY x.id ORDER BY round(abs(x.v - y.v), 6), y.id) AS rk FROM f x JOIN f y ON x.id <> y.id AND x.id % 5 = y.id % 5) WHERE rk <= 3),
p AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY id) AS pos, count(*) OVER (PARTITION BY g) AS n FROM m),
w AS (SELECT a.id, b.id AS donor, (b.pos - a.pos + a.n) % a.n AS step FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id),
fr AS (SELECT id, min_by(donor, step) AS donor FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE (c.id = w.id AND c.cand = w.donor) OR (c.id = w.donor AND c.cand = w.id)) GROUP BY id)
SELECT w.id, coalesce(fr.donor, w.donor) AS donor, fr.donor IS NULL AS clash FROM w LEFT JOIN fr USING (id) WHERE step = 1""")
def donor_assignment(spark, sf):
    """JOI17 UDF12: a donor for each mismatched control."""
    base = user_series(spark, sf).select("id", (F.col("id") % 5).alias("g"), F.array(S.mean(F.col("s"))).alias("z"))
    return C.donors(base.select("id", "g"), k_nearest(base, 3, ["g"]), ["g"])


@R.add("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS o, v, count(*) OVER () AS n FROM d),
w AS (SELECT a.o AS start, any_value(a.n) AS n, list(b.v ORDER BY b.o) AS w FROM n a JOIN n b ON b.o BETWEEN a.o AND a.o + 19 WHERE a.o % 4 = 0 GROUP BY a.o HAVING count(*) = 20)
SELECT start, CASE WHEN start + 16 < 0.6 * n THEN 'train' WHEN start + 16 < 0.8 * n THEN 'val' ELSE 'test' END AS split, round(list_sum(w[1:16]), 2) AS past, round(list_sum(w[17:20]), 2) AS future FROM w""")
def sliding_windows(spark, sf):
    """WIN1 RNG10: windows of 16 days and the 4 after, every 4 days."""
    rows = _days(spark, sf)
    got = W.sliding(rows, [], "o", "v", 16, 4, 4)
    return got.select("start", "split", r(S.total(F.col("series")), 2).alias("past"), r(S.total(F.col("future")), 2).alias("future"))


def _days(spark, sf):
    """Daily sums, numbered: as many rows as days, so one window over them is small whatever the number of orders."""
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return W.numbered(days, [], ["day"])


@R.add("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS o, v, count(*) OVER () AS n FROM d),
s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM n WHERE o < 0.6 * n) SELECT o, round(CAST(CAST((v - m) / (d + 1e-8) AS FLOAT) AS DOUBLE), 4) AS z FROM n, s""")
def prefix_standardised(spark, sf):
    """WIN2: standardised by the statistics of the first part only."""
    return W.prefix_standardised(_days(spark, sf), [], "o", "v").select(F.col("o").cast("long").alias("o"), r(F.col("z").cast("double"), 4).alias("z"))


@R.add("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY ALL), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS o, v, count(*) OVER () AS n FROM d),
w AS (SELECT a.o AS start, any_value(a.n) AS n, list(b.v ORDER BY b.o) AS w FROM n a JOIN n b ON b.o BETWEEN a.o AND a.o + 19 GROUP BY a.o HAVING count(*) = 20),
e AS (SELECT CASE WHEN start + 16 < 0.6 * n THEN 'train' WHEN start + 16 < 0.8 * n THEN 'val' ELSE 'test' END AS split, list_transform(range(1, 5), lambda i: w[16 + i] - w[9 + i]) AS g, list_transform(range(1, 5), lambda i: w[16 + i] - w[16]) AS h FROM w)
SELECT split, CAST(count(*) AS BIGINT) AS windows, round(sum(list_inner_product(g, g)) / (4 * count(*)), 6) AS mse, round(sum(list_sum(list_transform(g, lambda x: abs(x)))) / (4 * count(*)), 6) AS mae,
  round(sum(list_inner_product(h, h)) / (4 * count(*)), 6) AS naive_mse, round(1 - sum(list_inner_product(g, g)) / sum(list_inner_product(h, h)), 6) AS skill FROM e GROUP BY split""")
def forecast_skill(spark, sf):
    """AGG10 AGG11 WIN25: a weekly seasonal guess against the last value."""
    days = _days(spark, sf).withColumn("v", F.col("v") / 1e6)
    got = W.sliding(days, [], "o", "v", 16, 4).withColumns({"guess": S.seasonal_naive(F.col("series"), 4, F.lit(7)), "naive": S.seasonal_naive(F.col("series"), 4, F.lit(1))})
    rep = W.forecast_report(got, ["split"], "future", "guess", "naive")
    return rep.select("split", "windows", *(r(c).alias(c) for c in ("mse", "mae", "naive_mse", "skill")))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, signed AS (SELECT id, kind, pos, x * k AS v FROM points, (VALUES ('peak', 1), ('trough', -1)) t(kind, k)),
near AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q, max(v) OVER (PARTITION BY id, kind) - min(v) OVER (PARTITION BY id, kind) AS spread FROM signed WINDOW w AS (PARTITION BY id, kind ORDER BY pos)),
top AS (SELECT * FROM near WHERE p < v AND v >= q),
walls AS (SELECT c.id, c.kind, c.pos, c.v, c.spread, coalesce(max(o.pos) FILTER (WHERE o.pos < c.pos AND o.v > c.v), -1) AS l, coalesce(min(o.pos) FILTER (WHERE o.pos > c.pos AND o.v > c.v), 1000000) AS r FROM top c JOIN signed o ON o.id = c.id AND o.kind = c.kind GROUP BY ALL),
lows AS (SELECT b.id, b.kind, b.pos, b.v, b.spread, min(o.v) FILTER (WHERE o.pos <= b.pos AND o.pos > b.l) AS a, min(o.v) FILTER (WHERE o.pos >= b.pos AND o.pos < b.r) AS z FROM walls b JOIN signed o ON o.id = b.id AND o.kind = b.kind GROUP BY ALL)
SELECT id, CAST(pos AS BIGINT) AS pos, kind, round(v - greatest(a, z), 6) AS prominence FROM lows WHERE v - greatest(a, z) >= 0.1 * spread""")
def peak_prominence(spark, sf):
    """WIN17 WIN18: prominent peaks and troughs of each series."""
    base = user_series(spark, sf)
    need = base.select("id", (0.1 * (F.array_max("s") - F.array_min("s"))).alias("need"))
    return V.prominences(base).join(need, "id").where("prominence >= need").select("id", "pos", "kind", r("prominence").alias("prominence"))


@R.add(f"""WITH {SERIES} SELECT id, CASE WHEN f < 1/3 THEN 'early' WHEN f < 2/3 THEN 'mid' ELSE 'late' END AS peak_at, CAST(b AS BIGINT) AS bin FROM (SELECT id, (list_position(s, list_max(s)) - 1) / (len(s) - 1) AS f, least(9, floor((list_position(s, list_max(s)) - 1) / len(s) * 10)) AS b FROM series)""")
def peak_position(spark, sf):
    """WIN31 WIN33: where the peak lies, as a word and as a tenth of the axis."""
    s = F.col("s")
    return user_series(spark, sf).select("id", S.position_word(S.argmax(s) / (F.size(s) - 1)).alias("peak_at"), S.axis_bins(F.array(S.argmax(s)), F.size(s))[0].cast("long").alias("bin"))


@R.add(f"""WITH {SERIES}, k AS (SELECT id, s, md5(array_to_string(list_transform(s, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',')) AS key FROM series) SELECT min(id) AS id, CAST(count(*) AS BIGINT) AS copies FROM k GROUP BY key""")
def distinct_series(spark, sf):
    """SET4 SRT3: the first of equal series."""
    key = F.md5(F.array_join(F.transform("s", lambda x: F.round(x * 100).cast("long").cast("string")), ","))
    return user_series(spark, sf).groupBy(key.alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("k")


@R.add(f"""WITH {SERIES} SELECT id, array_to_string(list_transform(list_concat(s[25:], s[1:24]), lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ' ') AS swapped, array_to_string(list_transform(list_reverse(s), lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ' ') AS backward FROM series""")
def perturbed_series(spark, sf):
    """WIN29 SCL31: halves swapped, and reversed, as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), " ")
    return user_series(spark, sf).select("id", text(S.reversed_segments(F.col("s"), F.lit(24))).alias("swapped"), text(F.reverse("s")).alias("backward"))
