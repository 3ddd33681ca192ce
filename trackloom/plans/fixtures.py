"""Track-shaped views over the given tables; the same SQL runs in Spark and in the checking engine."""

VIEWS = {
    "fixes": """SELECT event_id AS fix_id, user_id AS id, ts AS date_time,
       CAST(-60.0 + (user_id % 25) * 5.0 + CAST((event_id * 7919) % 1001 AS DOUBLE) / 500.0 AS DOUBLE) AS latitude,
       CAST(-180.0 + ((user_id * 29) % 358) + CAST((event_id * 104729) % 1001 AS DOUBLE) / 500.0 AS DOUBLE) AS longitude,
       CASE (CAST(floor(day(ts) / 6) AS BIGINT) + user_id) % 4
            WHEN 0 THEN 'breeding: incubation' WHEN 1 THEN 'breeding: chick-rearing'
            WHEN 2 THEN 'non-breeding' ELSE 'unknown' END AS stage,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS env
       FROM {events}""",
    "animals": """SELECT id, concat('S', CAST(sp AS STRING)) AS species, concat('X', CAST(sp % 4 AS STRING)) AS taxa,
       CASE id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'U' END AS sex,
       CASE id % 4 WHEN 0 THEN 'Argos' WHEN 1 THEN 'GPS' WHEN 2 THEN 'GLS' ELSE 'Fastloc GPS' END AS tag
       FROM (SELECT DISTINCT user_id AS id, user_id % 12 AS sp FROM {events}) u""",
    "long_fixes": """SELECT o_orderkey AS fix_id, o_custkey AS id, o_orderdate AS date_time,
       CAST(-80.0 + CAST((o_orderkey * 7919) % 16001 AS DOUBLE) / 100.0 AS DOUBLE) AS latitude,
       CAST(-180.0 + CAST((o_orderkey * 104729) % 36000 AS DOUBLE) / 100.0 AS DOUBLE) AS longitude,
       o_totalprice AS env FROM {orders}""",
    "grid1": """SELECT CAST(la.i - 90 AS BIGINT) AS cell_lat, CAST(lo.i - 180 AS BIGINT) AS cell_lon,
       CASE WHEN (la.i * 31 + lo.i * 17) % 5 = 0 THEN NULL
            ELSE CAST((la.i * 131 + lo.i * 71) % 997 AS DOUBLE) / 10.0 END AS value
       FROM (SELECT DISTINCT l_partkey % 181 AS i FROM {lineitem}) la
       CROSS JOIN (SELECT DISTINCT o_orderkey % 361 AS i FROM {orders}) lo""",
    "reports": """SELECT a.id, a.species, a.taxa, a.tag, a.sex, rs.random_state, (a.id + rs.random_state) % 5 AS kfold,
       CASE WHEN (a.id * 7 + rs.random_state * 3) % 5 = 0
            THEN concat('S', CAST((a.id + 5 + rs.random_state) % 12 AS STRING)) ELSE a.species END AS predicted
       FROM {animals} a CROSS JOIN (SELECT DISTINCT l_linenumber AS random_state FROM {lineitem} WHERE l_linenumber BETWEEN 1 AND 5) rs""",
    "points": "SELECT vec_id AS id, label AS class, embedding FROM {embeddings}",
}
_NEEDS = {"fixes": ["events"], "animals": ["events"], "long_fixes": ["orders"], "grid1": ["lineitem", "orders"], "reports": ["animals", "lineitem"], "points": ["embeddings"]}


def load(spark, sf_dir, name):
    """A view, or a given table, as a DataFrame; timestamps are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spark.sql(VIEWS[name], **{t: load(spark, sf_dir, t) for t in _NEEDS[name]})
    return df.withColumn("date_time", df["date_time"].cast("timestamp")) if "date_time" in df.columns else df


def with_views(sql, *names):
    """``sql`` of the checking engine preceded by the views it names."""
    names = [n for n in VIEWS if n in names or (n == "animals" and "reports" in names)]
    views = ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in _NEEDS[n]})})" for n in names)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    return f"WITH {views},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views}\n{body}"
