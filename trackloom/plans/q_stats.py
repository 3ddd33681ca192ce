"""Queries on statistics, bootstrap, graphs, distances and attributions."""

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import distances as D, report as R, stats as S
from .base import query
from .q_motion import r6, r9
from .q_report import OK, poly, rep, rounded, two_sided


@query("t01_correlations", "T1", "SELECT 'latitude' AS a, 'env' AS b, round(corr(latitude,env),6)+0.0 AS r, count(env) AS n FROM fixes UNION ALL SELECT 'latitude','longitude', round(corr(latitude,longitude),6)+0.0, count(*) FROM fixes UNION ALL SELECT 'longitude','env', round(corr(longitude,env),6)+0.0, count(env) FROM fixes")
def _(read):
    df = S.correlations(read("fixes"), ["latitude", "longitude", "env"])
    return rounded(df, "r")


@query("t01_spearman", "T1 L6", "WITH f AS (SELECT * FROM fixes WHERE env IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY latitude)+(count(*) OVER (PARTITION BY latitude)-1)/2.0 AS a, rank() OVER (ORDER BY env)+(count(*) OVER (PARTITION BY env)-1)/2.0 AS b FROM f) SELECT 'latitude' AS a, 'env' AS b, round(corr(a,b),6)+0.0 AS r, count(*) AS n FROM r")
def _(read):
    return rounded(S.correlations(read("fixes").filter("env is not null"), ["latitude", "env"], "spearman"), "r")


# Student's distribution of n - 2 degrees as a finite sum over powers of the cosine of the angle whose sine is r.
STUDENT = """1-CASE WHEN n%2=0 THEN r*(SELECT sum(exp(lgamma(k+0.5)-lgamma(k+1))/sqrt(pi())*pow(1-r*r,k)) FROM range(CAST((n-2)//2 AS BIGINT)) t(k))
    ELSE 2/pi()*(asin(r)+r*(SELECT coalesce(sum(sqrt(pi())/2*exp(lgamma(k+1)-lgamma(k+1.5))*pow(1-r*r,k+0.5)),0) FROM range(CAST((n-3)//2 AS BIGINT)) t(k))) END"""


@query("t02_significant_correlations", "T2", f"""WITH c AS (SELECT 'latitude' AS a, 'env' AS b, corr(latitude,env) AS x, count(env) AS n FROM fixes UNION ALL SELECT 'latitude','longitude', corr(latitude,longitude), count(*) FROM fixes UNION ALL SELECT 'longitude','env', corr(longitude,env), count(env) FROM fixes),
    p AS (SELECT a, b, x, n, {STUDENT} AS p FROM (SELECT *, abs(x) AS r FROM c)) SELECT a, b, round(CASE WHEN p<=0.05 THEN x END,6)+0.0 AS r, n, round(p,6)+0.0 AS p FROM p""")
def _(read):
    return rounded(S.significant(S.correlations(read("fixes"), ["latitude", "longitude", "env"])), "r", "p")


@query("t03_mean_correlation", "T3", "WITH c AS (SELECT species, corr(env,latitude) AS la, corr(env,longitude) AS lo FROM fixes JOIN animals USING (id) GROUP BY species) SELECT 'latitude' AS feature, round(avg(la),6)+0.0 AS r, count(la) AS n_groups FROM c UNION ALL SELECT 'longitude', round(avg(lo),6)+0.0, count(lo) FROM c")
def _(read):
    return rounded(S.mean_correlation(read("fixes").join(read("animals"), "id").filter("env is not null"), "env", ["latitude", "longitude"]), "r")


@query("t05_vif", "T5 T6")
def _(read):
    df = read("fixes").filter("env is not null").withColumn("near", F.col("latitude") * 2 + F.col("env") / 1000)
    columns = ["latitude", "longitude", "env", "near"]
    left = S.eliminate_by_vif(df, columns)
    found = S.vif(df, columns)
    return df.sparkSession.createDataFrame([(c, found[c], c in left) for c in columns], "feature string, vif double, kept boolean")


MI = """b AS (SELECT species, latitude, quantile_cont(latitude,[0.125,0.25,0.375,0.5,0.625,0.75,0.875]) OVER () AS e FROM fixes JOIN animals USING (id)),
    x AS (SELECT species, len(list_filter(e, lambda v: v<latitude)) AS k FROM b), n AS (SELECT species, k, count(*) AS n FROM x GROUP BY ALL),
    m AS (SELECT sum(n)/(SELECT sum(n) FROM n)*log2(sum(n)*(SELECT sum(n) FROM n)/((SELECT sum(n) FROM n a WHERE a.species=n.species)*(SELECT sum(n) FROM n c WHERE c.k=n.k))) AS m FROM n GROUP BY species, k),
    h AS (SELECT -sum(p*log2(p)) AS h FROM (SELECT count(*)/(SELECT count(*) FROM x) AS p FROM x GROUP BY species))"""


@query("t07_feature_information", "T7 T9", f"WITH {MI} SELECT 'latitude' AS feature, round(sum(m),6)+0.0 AS mi, round(sum(m)/(SELECT h FROM h),6)+0.0 AS normalised FROM m")
def _(read):
    return rounded(S.feature_information(read("fixes").join(read("animals"), "id"), ["latitude"], "species"), "mi", "normalised")


@query("t08_feature_redundancy", "T8 M16 M17", """WITH e AS (SELECT latitude, longitude, quantile_cont(latitude,[0.25,0.5,0.75]) OVER () AS a, quantile_cont(longitude,[0.25,0.5,0.75]) OVER () AS b FROM fixes),
    n AS (SELECT len(list_filter(a, lambda v: v<latitude)) AS i, len(list_filter(b, lambda v: v<longitude)) AS j, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT 'latitude' AS a, 'longitude' AS b, round(sum(n/t*log2(n*t/(ni*nj))),6)+0.0 AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj FROM n)""")
def _(read):
    return rounded(S.feature_redundancy(read("fixes"), ["latitude", "longitude"], 4), "mi")


def _mrmr_sql(columns=("latitude", "longitude", "env"), bins=8):
    """Information and redundancy by bins as in t07 and t08, and the two choices of three features one after the other."""
    levels = [k / bins for k in range(1, bins)]
    edges = ", ".join(f"quantile_cont({c},{levels}) OVER () AS e{k}" for k, c in enumerate(columns))
    bin_sql = ", ".join(f"len(list_filter(e{k}, lambda v: v<{c})) AS b{k}" for k, c in enumerate(columns))
    joint = lambda a, b: f"(SELECT sum(n/t*log2(n*t/(na*nb))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM x GROUP BY 1, 2)))"
    info = " UNION ALL ".join(f"SELECT '{c}' AS f, {joint(f'b{k}', 'species')} AS m" for k, c in enumerate(columns))
    red = " UNION ALL ".join(f"SELECT '{columns[i]}' AS a, '{columns[j]}' AS b, {joint(f'b{i}', f'b{j}')} AS m" for i in range(3) for j in range(3) if i != j)
    worst = lambda left: f"SELECT f FROM (SELECT i.f, i.m-coalesce(avg(r.m),0) AS score FROM i LEFT JOIN r ON r.a=i.f AND r.b IN ({left}) WHERE i.f IN ({left}) GROUP BY i.f, i.m) ORDER BY score, f LIMIT 1"
    return f"""WITH e AS (SELECT species, {", ".join(columns)}, {edges} FROM fixes JOIN animals USING (id) WHERE env IS NOT NULL), x AS (SELECT species, {bin_sql} FROM e), i AS ({info}), r AS ({red}),
        w1 AS ({worst("SELECT f FROM i")}), w2 AS ({worst("SELECT f FROM i WHERE f NOT IN (SELECT f FROM w1)")})
        SELECT CAST(0 AS INTEGER) AS dropped, f AS feature FROM w1 UNION ALL SELECT 1, f FROM w2 UNION ALL SELECT 2, f FROM i WHERE f NOT IN (SELECT f FROM w1) AND f NOT IN (SELECT f FROM w2)"""


@query("t10_mrmr_order", "T10", _mrmr_sql())
def _(read):
    df = read("fixes").filter("env is not null").join(read("animals"), "id")
    columns = ["latitude", "longitude", "env"]
    return S.mrmr_order(S.feature_information(df, columns, "species"), S.feature_redundancy(df, columns))


VIF = ("latitude", "longitude", "env", "near")


def _vif_sql(most=10):
    """Factors of every set of columns by determinants of the scaled sums of products; sets lose their largest factor until none is large."""

    def det(rows, columns):
        if not rows:
            return "1.0"
        return "(" + "+".join(f"{(-1) ** k}*r{min(rows[0], c)}{max(rows[0], c)}*{det(rows[1:], columns[:k] + columns[k + 1 :])}" for k, c in enumerate(columns)) + ")"

    n = range(len(VIF))
    sums = ", ".join(f"sum({VIF[i]}*{VIF[j]}) AS g{i}{j}" for i in n for j in n if i <= j)
    scaled = ", ".join(f"g{i}{j}/sqrt(g{i}{i}*g{j}{j}) AS r{i}{j}" for i in n for j in n if i <= j)
    rows = []
    for s in range(1, 16):
        held = [i for i in n if s >> i & 1]
        rows += [f"SELECT {s} AS s, {i} AS i, {det([k for k in held if k != i], [k for k in held if k != i])}/{det(held, held)} AS v FROM c" for i in held]
    return f"""WITH RECURSIVE d AS (SELECT latitude, longitude, env, latitude*2+(fix_id%97)/2.0 AS near FROM fixes WHERE env IS NOT NULL), g AS (SELECT {sums} FROM d), c AS (SELECT {scaled} FROM g),
        v AS ({" UNION ALL ".join(rows)}), m AS (SELECT s, arg_max(i, v) AS i, max(v) AS v, count(*) AS n FROM v GROUP BY s),
        r AS (SELECT 15 AS s UNION ALL SELECT r.s-CAST(pow(2, m.i) AS INTEGER) FROM r JOIN m ON m.s=r.s WHERE m.v>={most} AND m.n>1)
        SELECT ['{"','".join(VIF)}'][i+1] AS feature, round(v,4)+0.0 AS vif, ((SELECT min(s) FROM r)//CAST(pow(2,i) AS INTEGER))%2=1 AS kept FROM v WHERE s=15"""


@query("t05_vif_elimination", "T5 T6", _vif_sql())
def _(read):
    df = read("fixes").filter("env is not null").withColumn("near", F.col("latitude") * 2 + F.col("fix_id") % 97 / 2)
    left, found = S.eliminate_by_vif(df, list(VIF)), S.vif(df, list(VIF))
    return df.sparkSession.createDataFrame([(c, round(found[c], 4) + 0.0, c in left) for c in VIF], "feature string, vif double, kept boolean")


def hashed(*parts):
    """A 32-bit hash of texts joined by dashes."""
    return f"CAST(concat('0x', substr(md5(concat_ws('-', {', '.join(parts)})),1,8)) AS BIGINT)"


def counts_sql(row, rep):
    """How often a row with a hash counts in a replicate, by the limits of the Poisson distribution."""
    return f"len(list_filter({S.poisson_limits()}, lambda t: t <= ({row} * ({hashed(repr('rep'), f'CAST({rep} AS STRING)')} % {S.PRIME - 1} + 1)) % {S.PRIME}))"


def boot(source, by, value, order, replicates=200):
    """``m (g, rep, mean)``: bootstrap means of groups of a table."""
    return f"""w AS (SELECT CAST({by} AS STRING) AS g, {value} AS v, {hashed(f"CAST({by} AS STRING)", f"CAST({order} AS STRING)")} % {S.PRIME} AS h FROM {source} WHERE {value} IS NOT NULL),
    m AS (SELECT g, rep, sum(n*v)/sum(n) AS mean FROM (SELECT g, rep, v, {counts_sql("h", "rep")} AS n FROM w, range({replicates}) t(rep)) GROUP BY g, rep HAVING sum(n) > 0)"""


def bca(alpha=0.05):
    """``i (g, low, high)`` after :func:`boot`: corrected intervals."""
    tail = lambda q: f"{poly(S.QUANTILE_TAIL[0], f'sqrt(-2*ln({q}))')}/{poly(S.QUANTILE_TAIL[1], f'sqrt(-2*ln({q}))')}"
    middle = f"(p-0.5)*{poly(S.QUANTILE_MIDDLE[0], '((p-0.5)*(p-0.5))')}/{poly(S.QUANTILE_MIDDLE[1], '((p-0.5)*(p-0.5))')}"
    z = [float(NormalDist().inv_cdf(q)) for q in (alpha / 2, 1 - alpha / 2)]
    half = lambda x: f"({two_sided(x)}/2)"
    cdf = lambda x: f"CASE WHEN {x} < 0 THEN {half(x)} ELSE 1-{half(x)} END"
    at = lambda x: f"v[CAST(floor({x}) AS BIGINT)+1]+({x}-floor({x}))*(coalesce(v[CAST(floor({x}) AS BIGINT)+2], v[CAST(floor({x}) AS BIGINT)+1])-v[CAST(floor({x}) AS BIGINT)+1])"
    return f"""k AS (SELECT g, count(*) AS n, avg(v) AS m FROM w GROUP BY g HAVING count(*) > 1),
    j AS (SELECT g, any_value(k.m) AS m, coalesce(sum(pow(v-k.m,3))/nullif(pow(sum(pow(v-k.m,2)),1.5),0)/6, 0) AS a FROM w JOIN k USING (g) GROUP BY g),
    s AS (SELECT g, any_value(a) AS a, least(greatest(avg(CASE WHEN mean-j.m < -{S.SAME!r}*greatest(1.0,abs(j.m)) THEN 1.0 WHEN mean-j.m <= {S.SAME!r}*greatest(1.0,abs(j.m)) THEN 0.5 ELSE 0.0 END), 1e-9), 1-1e-9) AS p, list(mean ORDER BY mean) AS v FROM m JOIN j USING (g) GROUP BY g),
    zs AS (SELECT g, a, v, CASE WHEN p < 0.02425 THEN {tail("p")} WHEN p > 1-0.02425 THEN -({tail("(1-p)")}) ELSE {middle} END AS z FROM s),
    q AS (SELECT g, v, z+(z+({z[0]!r}))/(1-a*(z+({z[0]!r}))) AS x, z+(z+({z[1]!r}))/(1-a*(z+({z[1]!r}))) AS y FROM zs),
    l AS (SELECT g, v, ({cdf("x")})*(len(v)-1) AS x, ({cdf("y")})*(len(v)-1) AS y FROM q),
    i AS (SELECT g, {at("x")} AS low, {at("y")} AS high FROM l)"""


FIRST_SEED = f"{OK}, o AS (SELECT * FROM ok WHERE random_state=1)"


@query("t11_bootstrap_interval", "T11", f"WITH {FIRST_SEED}, {boot('o', 'species', 'ok', 'id')} SELECT g AS species, round(quantile_cont(mean,0.025),6)+0.0 AS low, round(quantile_cont(mean,0.975),6)+0.0 AS high FROM m GROUP BY g")
def _(read):
    return rounded(S.percentile_interval(rep(read).filter("random_state = 1"), "species", "ok"), "low", "high")


@query("t12_bca_interval", "T12 X4", f"WITH {FIRST_SEED}, {boot('o', 'species', 'ok', 'id')}, {bca()} SELECT g AS species, round(low,6)+0.0 AS low, round(high,6)+0.0 AS high FROM i")
def _(read):
    return rounded(S.bca_interval(rep(read).filter("random_state = 1"), "species", "ok"), "low", "high")


MEDIANS = f"""r AS (SELECT species AS g, avg(env) AS v, {hashed("species", "CAST(f.id AS STRING)")} % {S.PRIME} AS h FROM fixes f JOIN animals USING (id) WHERE env IS NOT NULL GROUP BY f.id, species),
    c AS (SELECT g, rep, v, {counts_sql("h", "rep")} AS n, h FROM r, range(100) t(rep)),
    s AS (SELECT g, rep, v, sum(n) OVER (PARTITION BY g, rep ORDER BY v, h) AS upto, sum(n) OVER (PARTITION BY g, rep) AS total FROM c),
    d AS (SELECT g, rep, (min(v) FILTER (upto > (total-1)//2) + min(v) FILTER (upto > total//2))/2 AS median FROM s WHERE total > 0 GROUP BY g, rep),
    e AS (SELECT rep, median, {counts_sql(f"({hashed(repr('group'), 'g')} % {S.PRIME})", "rep")} AS n FROM d), a AS (SELECT rep, sum(n*median)/nullif(sum(n),0) AS m FROM e GROUP BY rep)"""


@query("t13_mean_of_medians", "T13", f"WITH {MEDIANS} SELECT round(quantile_cont(m,0.025),6)+0.0 AS low, round(quantile_cont(m,0.975),6)+0.0 AS high FROM a")
def _(read):
    return rounded(S.mean_of_medians_interval(read("fixes").filter("env is not null").groupBy("id").agg(F.avg("env").alias("v")).join(read("animals"), "id"), "species", "v"), "low", "high")


CURVE = "curve AS (SELECT species, 10*(1+id%5) AS n, avg(1-0.5*exp(-0.02*(10*(1+id%5)))*(1+(id%7)/50.0)) AS accuracy FROM animals GROUP BY ALL)"


def curve(read):
    n = 10 * (1 + F.col("id") % 5)
    y = 1 - 0.5 * F.exp(-0.02 * n) * (1 + (F.col("id") % 7) / 50)
    return read("animals").groupBy("species", n.alias("n")).agg(F.avg(y).alias("accuracy"))


@query("t14_learning_curve", "T14 T15 T16", f"WITH {CURVE}, f AS (SELECT species, exp(nullif(regr_intercept(ln(1-accuracy),n), CAST('nan' AS DOUBLE))) AS a, nullif(regr_slope(ln(1-accuracy),n), CAST('nan' AS DOUBLE)) AS b, nullif(regr_slope(accuracy,n), CAST('nan' AS DOUBLE)) AS slope FROM curve GROUP BY species) SELECT species, round(a,6)+0.0 AS a, round(b,6)+0.0 AS b, round(slope,6)+0.0 AS slope, round(CASE WHEN b<0 THEN greatest(1.0, ln((1-0.9)/a)/b) END,4)+0.0 AS n_required FROM f")
def _(read):
    c = curve(read)
    df = S.required_samples(S.exponential_fit(c, "species"), 0.9).join(S.linear_fit(c, "species"), "species")
    return df.select("species", r6("a").alias("a"), r6("b").alias("b"), r6("slope").alias("slope"), (F.round("n_required", 4) + 0.0).alias("n_required"))


@query("t17_sample_size_by_group", "T17", f"WITH {CURVE}, f AS (SELECT species, exp(nullif(regr_intercept(ln(1-accuracy),n), CAST('nan' AS DOUBLE))) AS a, nullif(regr_slope(ln(1-accuracy),n), CAST('nan' AS DOUBLE)) AS b, nullif(regr_slope(accuracy,n), CAST('nan' AS DOUBLE)) AS s, nullif(regr_intercept(accuracy,n), CAST('nan' AS DOUBLE)) AS i FROM curve GROUP BY species) SELECT species, round(CASE WHEN b<0 THEN greatest(1.0, ln((1-0.9)/a)/b) ELSE greatest(1.0,(0.9-i)/s) END,4)+0.0 AS n_required FROM f")
def _(read):
    return S.sample_size_by_group(curve(read), "species", 0.9).select("species", (F.round("n_required", 4) + 0.0).alias("n_required"))


ATTR = "attr AS (SELECT id, predicted AS class, concat('f', CAST(kfold AS STRING)) AS feature, sum((id*13+random_state*5)%41-20)/10.0 AS value FROM reports GROUP BY ALL)"


def attributions(read):
    return read("reports").groupBy("id", F.col("predicted").alias("class"), F.concat(F.lit("f"), F.col("kfold").cast("string")).alias("feature")).agg((F.sum((F.col("id") * 13 + F.col("random_state") * 5) % 41 - 20) / 10).alias("value"))


@query("t18_mean_attribution", "T18 T20", f"WITH {ATTR}, s AS (SELECT feature, species, avg(abs(value)) AS v FROM attr JOIN animals USING (id) GROUP BY ALL) SELECT feature, round(avg(v),9)+0.0 AS importance FROM s GROUP BY feature")
def _(read):
    df = S.mean_attribution(attributions(read), read("animals"), "species")
    return df.select("feature", r9("importance").alias("importance"))


@query("t19_grouped_attribution", "T19", f"WITH {ATTR} SELECT id, class, CASE WHEN feature IN ('f0','f1') THEN 'Location' ELSE feature END AS feature, round(sum(value),6)+0.0 AS value FROM attr JOIN animals USING (id) WHERE class=species GROUP BY ALL")
def _(read):
    own = S.of_class(attributions(read), read("animals"), "species")
    return rounded(S.grouped_features(own, {"f0": "Location", "f1": "Location"}), "value").select("id", "class", "feature", "value")


CONF = "conf AS (SELECT species AS src, predicted AS dst, count(*)/(SELECT count(*) FROM reports x WHERE x.species=r.species) AS weight FROM reports r GROUP BY species, predicted), edges AS (SELECT * FROM conf WHERE src<>dst AND weight>0.01), mem AS (SELECT DISTINCT species AS node, taxa AS community FROM animals)"


def graph(read):
    confused = R.confusion(rep(read))
    return confused, S.confusion_graph(confused, 0.01), read("animals").select(F.col("species").alias("node"), F.col("taxa").alias("community")).distinct()


@query("t21_confusion_graph", "T21", f"WITH {CONF} SELECT dst, round(sum(weight),6)+0.0 AS in_degree FROM edges GROUP BY dst")
def _(read):
    return rounded(S.in_degree(graph(read)[1]), "in_degree")


@query("t22_communities", "T22", f"""WITH {CONF}, e AS (SELECT weight, a.community AS ca, b.community AS cb FROM edges JOIN mem a ON a.node=src JOIN mem b ON b.node=dst),
    i AS (SELECT ca AS community, sum(weight) AS w, avg(weight) AS m FROM e WHERE ca=cb GROUP BY 1), o AS (SELECT community, sum(weight) AS w FROM (SELECT ca AS community, weight FROM e WHERE ca<>cb UNION ALL SELECT cb, weight FROM e WHERE ca<>cb) GROUP BY 1),
    s AS (SELECT community, count(*) AS size FROM mem GROUP BY 1)
    SELECT s.community, size, round(coalesce(i.w,0),6)+0.0 AS inner, round(coalesce(i.m,0),6)+0.0 AS mean_inner, round(coalesce(o.w,0),6)+0.0 AS outer FROM s LEFT JOIN i USING (community) LEFT JOIN o ON o.community=s.community""")
def _(read):
    _, e, m = graph(read)
    return rounded(S.communities(e, m), "inner", "mean_inner", "outer").drop("share", "cumulative")


@query("t23_modularity", "T23", f"""WITH {CONF}, k AS (SELECT node, sum(weight) AS k FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY node), t AS (SELECT 2*sum(weight) AS m FROM edges)
    SELECT round(coalesce(sum((weight-a.k*b.k/m)/m),0),6)+0.0 AS modularity FROM edges JOIN k a ON a.node=src JOIN k b ON b.node=dst JOIN mem x ON x.node=src JOIN mem y ON y.node=dst, t WHERE x.community=y.community""")
def _(read):
    _, e, m = graph(read)
    return rounded(S.modularity(e, m), "modularity")


@query("t24_threshold_sweep", "T24", f"""WITH {CONF} SELECT CAST(l AS DOUBLE) AS "limit", count(*) AS n_edges, round(sum(weight),6)+0.0 AS weight, round(sum(CASE WHEN a.community=b.community THEN weight ELSE 0 END),6)+0.0 AS inner FROM conf JOIN mem a ON a.node=src JOIN mem b ON b.node=dst, (VALUES (0.0),(0.02),(0.05)) t(l) WHERE src<>dst AND weight>l GROUP BY l""")
def _(read):
    c, _, m = graph(read)
    return rounded(S.threshold_sweep(c, m, [0.0, 0.02, 0.05]), "weight", "inner")


DIST = f"{CONF}, f AS (SELECT a.node AS real, b.node AS pred, coalesce(c.weight,0) AS x, coalesce(d.weight,0) AS y FROM mem a JOIN mem b ON a.node<b.node LEFT JOIN conf c ON c.src=a.node AND c.dst=b.node LEFT JOIN conf d ON d.src=b.node AND d.dst=a.node)"


@query("t25_symmetric_distance", "T25", f"WITH {DIST} SELECT real, pred, round(1-(x+y)/2,6)+0.0 AS d FROM f")
def _(read):
    return rounded(S.symmetric_distance(graph(read)[0]), "d")


@query("t26_single_linkage", "T26", f"""WITH RECURSIVE {DIST}, e AS (SELECT real AS a, pred AS b FROM f WHERE 1-(x+y)/2<=0.975 UNION SELECT pred, real FROM f WHERE 1-(x+y)/2<=0.975),
    r AS (SELECT a AS node, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a=r.node) SELECT node, min(m) AS cluster FROM r GROUP BY node""")
def _(read):
    return S.single_linkage(S.symmetric_distance(graph(read)[0]), 0.975)


PD = "p AS (SELECT id, class, CAST(embedding AS DOUBLE[]) AS v FROM points), d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v,b.v) AS d FROM p a JOIN p b ON a.id<b.id)"


def labelled_points(read):
    return read("points").withColumn("species", F.concat(F.lit("c"), F.col("class").cast("string")))


@query("t27_pooled_distances", "T27 X5", f"WITH {PD} SELECT concat('c',CAST(least(x.class,y.class) AS STRING)) AS sp_i, concat('c',CAST(greatest(x.class,y.class) AS STRING)) AS sp_j, round(quantile_cont(d,0.5),6)+0.0 AS d FROM d JOIN p x ON x.id=i JOIN p y ON y.id=j GROUP BY 1, 2")
def _(read):
    return rounded(D.pooled_quantile(labelled_points(read)), "d").drop("n")


@query("t27_pooled_means", "T27 X5", f"WITH {PD} SELECT concat('c',CAST(least(x.class,y.class) AS STRING)) AS sp_i, concat('c',CAST(greatest(x.class,y.class) AS STRING)) AS sp_j, round(avg(d),6)+0.0 AS d FROM d JOIN p x ON x.id=i JOIN p y ON y.id=j GROUP BY 1, 2")
def _(read):
    return rounded(D.pooled_mean(labelled_points(read)), "d").drop("n")


@query("t28_knn_accuracy", "T28", f"""WITH {PD}, b AS (SELECT i AS id, j AS o, d FROM d UNION ALL SELECT j, i, d FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM b),
    v AS (SELECT n.id, k, p.class AS vote, count(*) AS c FROM n JOIN p ON p.id=o, range(1,6) t(k) WHERE r<=k GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY c DESC, vote) AS q FROM v)
    SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN vote=class THEN 1.0 ELSE 0.0 END),6)+0.0 AS accuracy FROM w JOIN p ON p.id=w.id WHERE q=1 GROUP BY k""")
def _(read):
    return rounded(S.knn_accuracy(D.nearest_rows(read("points"), 5), read("points").select("id", "class")), "accuracy")


@query("t29_stress", "T29", f"WITH {PD}, e AS (SELECT a.id AS i, b.id AS j, list_distance(a.v[1:8],b.v[1:8]) AS e FROM p a JOIN p b ON a.id<b.id) SELECT round(sum((e-d)*(e-d))/sum(d*d),6)+0.0 AS stress FROM d JOIN e USING (i, j)")
def _(read):
    return rounded(D.stress(read("points").withColumn("cut", F.slice("embedding", 1, 8)), "cut"), "stress")


# The correlation matrix of three columns has its eigenvalues in closed form; a vector is the cross product of two rows of it minus one.
@query("t30_pca", "T30", """WITH m AS (SELECT corr(latitude,longitude) AS a, corr(latitude,env) AS b, corr(longitude,env) AS c FROM fixes WHERE env IS NOT NULL),
    p AS (SELECT *, sqrt((a*a+b*b+c*c)/3) AS p FROM m), e AS (SELECT *, acos(greatest(-1,least(1,a*b*c/(p*p*p))))/3 AS phi FROM p),
    l AS (SELECT a, b, c, 1+2*p*cos(phi) AS l FROM e UNION ALL SELECT a, b, c, 1-2*p*cos(phi)-2*p*cos(phi+2*pi()/3) FROM e),
    v AS (SELECT l/3 AS share, [a*c-b*(1-l), a*b-c*(1-l), (1-l)*(1-l)-a*a] AS v FROM l),
    w AS (SELECT unnest(['latitude','longitude','env']) AS feature, unnest(v) AS x, sqrt(list_inner_product(v,v)) AS n, share FROM v)
    SELECT feature, round(sum(abs(x)/n*share),6)+0.0 AS importance FROM w GROUP BY feature""")
def _(read):
    return rounded(S.pca(read("fixes").filter("env is not null"), ["latitude", "longitude", "env"], 2)[1], "importance")


@query("t31_device_effect", "T31", f"WITH {OK}, s AS (SELECT species, avg(CASE WHEN id%5<2 THEN 1.0 ELSE 0.0 END) AS share, avg(ok) AS accuracy FROM ok WHERE random_state=1 GROUP BY species) SELECT 'share' AS a, 'accuracy' AS b, round(nullif(corr(share,accuracy), CAST('nan' AS DOUBLE)),6)+0.0 AS r, count(*) AS n FROM s WHERE share>0 AND share<1")
def _(read):
    df = rep(read).filter("random_state = 1").withColumn("tag", F.when(F.col("id") % 5 < 2, "M").otherwise("F"))
    return rounded(S.device_effect(df, "M", "ok").withColumn("b", F.lit("accuracy")), "r")


@query("t32_group_difference", "T32", f"WITH {ATTR}, x AS (SELECT feature, taxa, abs(value) AS v FROM attr JOIN animals USING (id)) SELECT feature, taxa, round(avg(v)-(SELECT avg(v) FROM x y WHERE y.feature=x.feature AND y.taxa<>x.taxa),6)+0.0 AS difference FROM x GROUP BY feature, taxa")
def _(read):
    return rounded(S.group_difference(attributions(read), read("animals")), "difference")


@query("t32_group_pair_difference", "T32", f"WITH {ATTR}, x AS (SELECT feature, taxa, avg(abs(value)) AS v FROM attr JOIN animals USING (id) GROUP BY ALL) SELECT a.feature, a.taxa, b.taxa AS other, round(a.v-b.v,9)+0.0 AS difference FROM x a JOIN x b ON a.feature=b.feature AND a.taxa<b.taxa")
def _(read):
    return S.group_pair_difference(attributions(read), read("animals")).withColumn("difference", r9("difference"))


@query("t33_compare_settings", "T33", f"WITH {ATTR}, a AS (SELECT feature, round(avg(abs(value)),9) AS v FROM attr GROUP BY 1), b AS (SELECT feature, round(avg(abs(value)),9) AS v FROM attr WHERE id%2=0 GROUP BY 1) SELECT feature, CAST(row_number() OVER (ORDER BY a.v DESC, feature) AS INTEGER) AS rank_a, CAST(row_number() OVER (ORDER BY b.v DESC, feature) AS INTEGER) AS rank_b FROM a JOIN b USING (feature)")
def _(read):
    a = attributions(read)
    mean = lambda d: S.mean_attribution(d).withColumn("importance", F.round("importance", 9))
    return S.compare_settings(mean(a), mean(a.filter("id % 2 = 0"))).select("feature", "rank_a", "rank_b")


@query("t34_join_difference", "T34", f"""WITH {ATTR}, g AS (SELECT id, CASE WHEN feature IN ('f0','f1','f2') THEN 'Location' ELSE 'Time' END AS g, sum(abs(value)) AS s, abs(sum(value)) AS a FROM attr GROUP BY 1, 2) SELECT g AS "group", round(avg(s),9)+0.0 AS sum_abs, round(avg(a),9)+0.0 AS abs_sum, round(max(s-a),6)+0.0 AS max_gap FROM g GROUP BY g""")
def _(read):
    df = S.join_difference(attributions(read), {"f0": "Location", "f1": "Location", "f2": "Location", "f3": "Time", "f4": "Time"})
    return df.select("group", r9("sum_abs").alias("sum_abs"), r9("abs_sum").alias("abs_sum"), r6("max_gap").alias("max_gap"))


@query("t35_reference_sample", "T35", """WITH r AS (SELECT fix_id, taxa, row_number() OVER (PARTITION BY taxa ORDER BY env, fix_id)-1 AS r, count(*) OVER (PARTITION BY taxa) AS n FROM fixes JOIN animals USING (id) WHERE env IS NOT NULL),
    p AS (SELECT DISTINCT r.taxa, CAST(floor(i*(n-1)/199.0) AS BIGINT) AS r FROM r, range(200) t(i) WHERE r.r=0) SELECT fix_id FROM r JOIN p ON r.taxa=p.taxa AND r.r=p.r""")
def _(read):
    return S.reference_sample(read("fixes").join(read("animals"), "id"), "env", "taxa", 200).select("fix_id")


@query("t36_median_member", "T36", "WITH n AS (SELECT id, id%7 AS cluster, count(*) AS length FROM fixes GROUP BY id), m AS (SELECT cluster, quantile_cont(length,0.5) AS m FROM n GROUP BY cluster), r AS (SELECT n.cluster, id, row_number() OVER (PARTITION BY n.cluster ORDER BY abs(length-m), id) AS k FROM n JOIN m USING (cluster)) SELECT cluster, id FROM r WHERE k=1")
def _(read):
    return S.median_member(read("fixes").groupBy("id").agg(F.count(F.lit(1)).alias("length")).withColumn("cluster", F.col("id") % 7))
