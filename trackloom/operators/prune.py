"""Row and track selection, sampling by hash, set operations, labels.

Random choices order rows by ``md5(id || seed)``, which any SQL engine repeats.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, times


def hash_order(column="id", seed=0):
    return F.md5(F.concat_ws("-", F.col(column).cast("string"), F.lit(str(seed))))


def track_table(fixes: DataFrame) -> DataFrame:
    """``id, length, days`` of each track."""
    us = times.micros("date_time")
    return fixes.groupBy("id").agg(F.count(F.lit(1)).alias("length"), ((F.max(us) - F.min(us)) / 86_400_000_000).alias("days"))


def keep_tracks(tracks: DataFrame, column=None, values=None, label="species", null_words=times.NULL_WORDS, min_animals=1, min_length=0, min_days=0.0, mapping=None, fn=None) -> DataFrame:
    """Main pruner of a table with one row for each track (``length``, ``days`` and label columns).

    ``fn`` is applied first, ``mapping`` (a Column function or a dict) recodes the label. ``min_length`` acts on
    the count of animals of a label alone; days must be above ``min_days``.
    """
    if fn is not None:
        tracks = tracks.transform(fn)
    if column is not None:
        tracks = tracks.filter(F.col(column).isin(*values))
    tracks = tracks.withColumn(label, times.words_to_null(label, null_words)).filter(F.col(label).isNotNull())
    if mapping is not None:
        recoded = mapping(F.col(label)) if callable(mapping) else lookup(label, mapping)
        tracks = tracks.withColumn(label, recoded).filter(F.col(label).isNotNull())
    long = F.sum(F.when(F.col("length") > min_length, 1).otherwise(0)).over(Window.partitionBy(label))
    return tracks.withColumn("_n", long).filter((F.col("_n") >= min_animals) & (F.col("days") > min_days)).drop("_n")


def min_length(tracks, least):
    return tracks.filter(F.col("length") > least)


def min_days(tracks, least):
    return tracks.filter(F.col("days") > least)


def min_animals(tracks, least, label="species"):
    """Labels with at most a few tracks go; the label counts are joined back, so no label's tracks meet in one task."""
    few = tracks.groupBy(label).count().filter(F.col("count") < least)
    return tracks.join(few, label, "left_anti")


def binary_target(tracks, column, value, name="target"):
    """1 for ``value``, 0 for others, with the labels ``value`` and ``Not value``."""
    hit = F.col(column) == value
    return tracks.withColumns({name: F.when(hit, 1).otherwise(0), f"{name}_label": F.when(hit, value).otherwise(f"Not {value}")})


def delete_random(tracks, share, seed=0):
    """A share of all tracks goes, by hash and independent of the layout."""
    draw = F.conv(F.substring(hash_order("id", seed), 1, 8), 16, 10).cast("double") / 2.0**32
    return tracks.filter(draw >= share)


def delete_stratified(tracks, share, by="species", seed=0):
    """Of each class the first ceil((1 - share) n) tracks in hash order stay."""
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(hash_order("id", seed), "id"))
    keep = F.ceil(F.lit(1 - share) * F.count(F.lit(1)).over(w))
    return tracks.withColumns({"_r": rank, "_k": keep}).filter("_r <= _k").drop("_r", "_k")


def delete_by_class(tracks, share, by="species", seed=0):
    """Classes lose tracks evenly: tracks are taken by rank within their class, then hash of the class, until (1 - share) n are kept."""
    n = tracks.count()
    ranked = tracks.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(hash_order("id", seed), "id"))).withColumn("_h", F.md5(F.col(by)))
    return ranked.orderBy("_r", "_h", "id").limit(round((1 - share) * n)).drop("_r", "_h")


def downsample(tracks, column, value, n=None, share=None, seed=0):
    """One group cut to n tracks, or by a share; the others stay."""
    own = tracks.filter(F.col(column) == value)
    size = own.count()
    keep = n if n is not None else round((1 - share) * size)
    if keep > size:
        raise ValueError(f"{value} has {size} tracks, fewer than {keep}")
    return own.orderBy(hash_order("id", seed), "id").limit(keep).unionByName(tracks.filter(~F.col(column).eqNullSafe(F.lit(value))))


def subset(tracks, n, min_obs, label="species"):
    """The first n tracks by id, without labels of fewer than ``min_obs``, with codes."""
    return dense_codes(min_animals(tracks.orderBy("id").limit(n), min_obs, label), label)


def select_columns(df, names, sets=None):
    """Projection by a named set or an ``a+b+c`` list, keys kept."""
    found = [c for part in names.split("+") for c in (sets or {}).get(part, [part])]
    return df.select(*dict.fromkeys(["id", *found]))


def drop_columns(df, names):
    return df.drop(*names)


def drop_padding(df, columns):
    """Rows whose values are all (nearly) zero go."""
    return df.filter(F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in columns], F.lit(0.0)) >= 1e-8)


def replace_inf(df, columns, largest=3.4028234663852886e38):
    """Infinite values become the largest single-precision number."""
    inf = lambda c: F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(inf(c), F.lit(largest)).otherwise(F.col(c)) for c in columns})


def reported(report, condition, within=None, columns=("id",), classes="species"):
    """Different ``columns`` of the rows of a report that meet a condition, of a set of classes if one is given.

    ``condition``: a column or SQL text (such as ``prediction = 'Wrong'``). ``within``: any number of class names, or a table with one column of them, which
    is matched by a join; a null class is in no set. Nulls in the condition count as false.
    """
    rows = report.filter(F.expr(condition) if isinstance(condition, str) else condition)
    if isinstance(within, DataFrame):
        rows = rows.join(within.select(F.col(within.columns[0]).alias(classes)).distinct(), classes, "left_semi")
    elif within is not None:
        rows = rows.filter(F.col(classes).isin(*within) if within else F.lit(False))
    return rows.select(*columns).distinct()


def add_confident(train, side, most_loss):
    """Training rows and the side rows whose loss is below a limit."""
    return train.unionByName(side.filter(F.col("loss") < most_loss).drop("loss"))


def longest_inside(fixes, vertices):
    """``id, start, n`` of the longest run of fixes inside a polygon; the first on a tie; tracks without one go."""
    w = Window.partitionBy("id").orderBy("date_time", "fix_id")
    df = fixes.withColumns({"_in": geo.in_polygon("latitude", "longitude", vertices), "_rn": F.row_number().over(w)})
    df = df.filter("_in").withColumn("_g", F.col("_rn") - F.row_number().over(w))
    runs = df.groupBy("id", "_g").agg(F.min("_rn").alias("start"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("id").agg(F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start"))).alias("b")).select("id", "b.start", "b.n")


def keep_inside(fixes, vertices):
    """Fixes of each track's longest run inside a polygon."""
    w = Window.partitionBy("id").orderBy("date_time", "fix_id")
    df = fixes.withColumn("_rn", F.row_number().over(w)).join(longest_inside(fixes, vertices), "id")
    return df.filter("_rn >= start and _rn < start + n").drop("_rn", "start", "n")


def common_window(fixes, length):
    """``start, n_tracks``: the ``length`` days in a row of the year in which most tracks have a fix each day; the first on a tie."""
    slots = fixes.select("id", F.floor(times.day_of_year("date_time")).cast("int").alias("slot")).distinct()
    starts = slots.select("id", F.explode(F.sequence(F.col("slot") - (length - 1), F.col("slot"))).alias("start")).filter("start >= 0")
    full = starts.groupBy("id", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == length)
    return full.groupBy("start").agg(F.count(F.lit(1)).alias("n_tracks")).orderBy(F.desc("n_tracks"), "start").limit(1)


def evenly_spaced(df, most, by=("id",), order=("date_time", "fix_id")):
    """At most ``most`` rows of each group, evenly spaced, ends included."""
    w = Window.partitionBy(*by)
    df = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # Row r is picked if it is floor(i (n-1) / (m-1)) for a whole i: the least i that reaches it must not pass it.
    i = F.ceil(F.col("_r") * (most - 1) / (F.col("_n") - 1))
    picked = F.floor(i * (F.col("_n") - 1) / (most - 1)) == F.col("_r")
    return df.filter((F.col("_n") <= most) | picked).drop("_r", "_n")


def partition(tracks, parts, number, seed=0):
    """Part ``number`` of a seeded split, by hash and so without a global sort."""
    return tracks.filter(F.pmod(F.conv(F.substring(hash_order("id", seed), 1, 8), 16, 10).cast("long"), F.lit(parts)) == number)


def sample_by_hash(tracks, n, seed=0):
    return tracks.orderBy(hash_order("id", seed), "id").limit(n)


def folds(tracks, k, by, seed=0):
    """``fold`` 0 .. k-1, stratified: classes differ by at most one track between folds."""
    w = Window.partitionBy(by).orderBy(hash_order("id", seed), "id")
    return tracks.withColumn("fold", (F.row_number().over(w) - 1) % k)


def dense_codes(df, label, name="code"):
    """Labels to codes in sorted order; the codes come from the distinct labels."""
    codes = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(codes, label)


def split_by_value(df, column, values, label, name="code"):
    """Main and side rows with the same codes; labels of the side alone come after the main ones."""
    side = df.filter(F.col(column).isin(*values))
    main = df.filter(~F.col(column).isin(*values) | F.col(column).isNull())
    kinds = main.select(label, F.lit(0).alias("_s")).unionAll(side.select(label, F.lit(1).alias("_s"))).groupBy(label).agg(F.min("_s").alias("_s"))
    codes = kinds.withColumn(name, F.row_number().over(Window.orderBy("_s", label)) - 1).drop("_s")
    return main.join(codes, label), side.join(codes, label)


def lookup(column, mapping):
    """Values of a dict, others as they are."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column))


def relabel_stages(df, generic_to_null=False, remap=None):
    """Unknown stages become null, migration and its like non-breeding; a bare ``breeding`` of a species with finer stages becomes null on demand."""
    s = times.words_to_null("stage")
    df = df.withColumn("stage", F.when(F.lower(s).rlike("non-breeding|migration|hivernage"), "non-breeding").otherwise(s))
    if remap:
        df = df.withColumn("stage", lookup("stage", remap))
    if generic_to_null:
        fine = F.max(F.col("stage").contains(":")).over(Window.partitionBy("species"))
        df = df.withColumn("stage", F.when(~(fine & (F.col("stage") == "breeding")), F.col("stage")))
    return df


def remap_to_known(df, known, column="predicted"):
    """Predictions that the species' known stages lack become their general class if that is known, else the row goes."""
    has = known.groupBy("species").agg(F.collect_set("stage").alias("_known"))
    general = F.split_part(F.col(column), F.lit(":"), F.lit(1))
    df = df.join(has, "species")
    kept = F.when(F.array_contains("_known", F.col(column)), F.col(column)).when(F.array_contains("_known", general), general)
    return df.withColumn(column, kept).filter(F.col(column).isNotNull()).drop("_known")


def switch_binary(df, column, species, a, b):
    """The two labels exchanged for the chosen species."""
    hit = F.col("species").isin(*species)
    return df.withColumn(column, F.when(hit & (F.col(column) == a), b).when(hit & (F.col(column) == b), a).otherwise(F.col(column)))


def one_hot(df, column, levels):
    """A 0/1 column for each given level."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in levels})


def missing_ids(left, right, key="id"):
    return left.join(right, key, "left_anti")


def present_ids(left, right, key="id"):
    return left.join(right, key, "left_semi")
