"""RFM customer segmentation.

Everything after the first aggregate works on one row per customer. The
tercile scores use exact distributed quantiles (the same edges pandas
``qcut`` computes); k-means uses MLlib on a checkpointed three-column
feature frame. The elbow scan takes only its starting centres from MLlib and
makes the steps of its 39 fits side by side, one pass for all.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.hashing import mix
from mercata.functions.joins import attach
from mercata.functions.lineage import materialize
from mercata.functions.quantiles import exact_quantiles, quantile_bins

RFM_COLS = ("Recency", "Frequency", "MonetaryValue")

# Fixed values of the reference: action segments attached to RFM codes
# (R, F, M digits; 3 = best).
SEGMENT_CODES = {
    "best": ("333",),
    "frequent_low_spend": ("331", "332"),
    "lapsed_frequent": ("133", "132", "131"),
    "cooling": ("233", "232", "231", "222", "212"),
    "newcomer": ("311", "312", "313"),
}
OTHER_SEGMENT = "other"
KMEANS_SEEDS = (1, 2, 3)
#: Customers in a partition of the k-means features.
KMEANS_ROWS = 200_000
#: Customers in a partition of the elbow's passes; starts that are looked for at a time.
BLOCK_ROWS, STARTS = 10_000, 8
#: Up to so many partitions, their sums go straight to the driver; beyond, they're added up on the way.
FEW_BLOCKS = 64
#: (k, seed) of a fit.
Fit = tuple[int, int]


def with_line_total(
    tx: DataFrame, price: str = "UnitPrice", quantity: str = "Quantity", out: str = "TotalSum"
) -> DataFrame:
    """Line value = unit price x quantity (exact decimal)."""
    return tx.withColumn(out, F.col(price) * F.col(quantity))


def snapshot_date(tx: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """R2: the "as of" moment, one day after the last transaction."""
    return tx.agg(F.timestamp_add("DAY", F.lit(1), F.max(ts)).alias("snapshot_date"))


def rfm_matrix(
    tx: DataFrame,
    customer: str = "CustomerID",
    ts: str = "InvoiceDate",
    invoice: str = "InvoiceNo",
    amount: str = "TotalSum",
    distinct_invoices: bool = False,
) -> DataFrame:
    """Per customer Recency (whole days from last purchase to the
    snapshot), Frequency (invoice lines with an invoice number, or distinct
    invoices), MonetaryValue (sum of line values).

    The snapshot is taken over all lines; lines without a customer then belong
    to nobody and drop out (``anonymous_lines`` counts them). The aggregate is
    written once and read for both, so the lines are read once."""
    freq = F.count_distinct(invoice) if distinct_invoices else F.count(invoice)
    per = tx.groupBy(customer).agg(
        F.max(ts).alias("_last"), freq.alias("Frequency"), F.sum(amount).alias("_m")
    )
    per = materialize(per)
    snap = per.agg(F.timestamp_add("DAY", F.lit(1), F.max("_last"))).scalar()
    return per.where(F.col(customer).isNotNull()).select(
        customer,
        F.timestamp_diff("DAY", F.col("_last"), snap).alias("Recency"),
        "Frequency",
        F.col("_m").cast("double").alias("MonetaryValue"),
    )


def anonymous_lines(tx: DataFrame, customer: str = "CustomerID") -> DataFrame:
    """Lines, and lines without a customer, which R3 leaves out."""
    return tx.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col(customer).isNull()).alias("anonymous"))


def undefined_logs(rfm: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Customers, and customers with a metric <= 0, which R4 makes NULL and k-means leaves out."""
    bad = reduce(operator.or_, [F.coalesce(F.col(c) <= 0, F.lit(True)) for c in cols])
    return rfm.agg(F.count(F.lit(1)).alias("customers"), F.count_if(bad).alias("undefined"))


def rfm_log(rfm: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Natural log of R, F, M; NULL for values <= 0 (undefined)."""
    return rfm.withColumns(
        {c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))) for c in cols}
    )


def rfm_standardize(df: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Z-scores with the population standard deviation (as a fitted
    scikit-learn StandardScaler would produce: a constant column becomes 0).
    Mean and std come from one aggregate row broadcast to every task."""
    moments = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]
    out = attach(df, materialize(df.agg(*moments)), [])
    spread = lambda c: F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))
    return out.withColumns({c: (F.col(c) - F.col(f"_mu_{c}")) / spread(c) for c in cols}).select(*df.columns)


def _features(scaled: DataFrame, cols: Sequence[str], customer: str = "CustomerID") -> DataFrame:
    """Feature vectors of customers with all metrics, in a layout that follows
    from the data alone, not from the session's shuffle partitions: MLlib's
    sampled starting centres follow the layout, and so do the labels."""
    from pyspark.ml.feature import VectorAssembler

    keys = [customer] if customer in scaled.columns else []
    clean = scaled.dropna(subset=list(cols)).select(*keys, *cols)
    parts = max(1, -(-clean.count() // KMEANS_ROWS))
    placed = clean.repartitionByRange(parts, *(keys or cols)).sortWithinPartitions(*keys, *cols)
    return materialize(VectorAssembler(inputCols=list(cols), outputCol="features").transform(placed))


#: Centres that move less than this a step have settled.
KMEANS_TOL, SETTLED = 1e-4, 1e-12


def _best_fit(feats: DataFrame, k: int, seeds: Sequence[int], max_iter: int, tol: float = KMEANS_TOL):
    """The fit with the lowest cost over several starts (the first of equals)."""
    from pyspark.ml.clustering import KMeans

    fits = [KMeans(k=k, seed=s, maxIter=max_iter, tol=tol).fit(feats) for s in seeds]
    return min(fits, key=lambda m: m.summary.trainingCost)


def total_inertia(scaled: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """R6 at k = 1: the sum of squares around the mean (one centroid)."""
    clean = scaled.dropna(subset=list(cols))
    return clean.agg(sum((F.count(c) * F.var_pop(c) for c in cols), F.lit(0.0)).alias("inertia")).select(
        F.lit(1).alias("k"), "inertia"
    )


def _start(feats: DataFrame, k: int, seed: int) -> np.ndarray:
    """The centres a fit begins with: k-means|| of MLlib, without a step."""
    from pyspark.ml.clustering import KMeans

    return np.array(KMeans(k=k, seed=seed, maxIter=0).fit(feats).clusterCenters())


def _blocks(feats: DataFrame, cols: Sequence[str], rows: int = BLOCK_ROWS) -> RDD:
    """The customers' metrics as arrays, an Arrow batch each, dealt round to partitions of about ``rows`` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))])
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary())], names=["block"])

    points = feats.select(*[F.col(c).cast("double").alias(c) for c in cols])
    dealt = points.repartition(max(1, -(-feats.count() // rows)))
    width = len(cols)
    return dealt.mapInArrow(pack, "block binary").rdd.map(lambda r: np.frombuffer(r.block).reshape(-1, width))


def _assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and its squared distance."""
    near = ((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)).argmin(axis=1)
    return near, ((x - centres[near]) ** 2).sum(axis=1)


def _sums(fits: dict[Fit, np.ndarray]) -> Callable[[np.ndarray], dict[Fit, np.ndarray]]:
    """Per fit and centre of a block: customers, squared distances and the sum of each metric."""

    def of(x: np.ndarray) -> dict[Fit, np.ndarray]:
        out = {}
        for fit, centres in fits.items():
            near, square = _assign(x, centres)
            columns = [None, square, *x.T]
            out[fit] = np.column_stack([np.bincount(near, c, len(centres)) for c in columns])
        return out

    return of


def _together(a: dict[Fit, np.ndarray], b: dict[Fit, np.ndarray]) -> dict[Fit, np.ndarray]:
    return {fit: a[fit] + b[fit] for fit in a}


def _summed(blocks: RDD, fits: dict[Fit, np.ndarray]) -> dict[Fit, np.ndarray]:
    return blocks.map(_sums(fits)).treeReduce(_together, depth=1 if blocks.getNumPartitions() <= FEW_BLOCKS else 2)


def _lloyd(
    blocks: RDD, fits: dict[Fit, np.ndarray], max_iter: int, tol: float = KMEANS_TOL
) -> dict[Fit, tuple[float, np.ndarray]]:
    """Lloyd's steps of all fits side by side: cost and centres of each.

    A pass over the customers makes one step of every fit that still moves,
    so there are as many passes as the longest fit has steps, however many
    fits there are. A fit ends as in MLlib: once no centre moves farther than
    ``tol``. What leaves a task is a row of sums a centre; the last pass sums
    the cost of all final centres.
    """
    centres = dict(fits)
    moving = list(centres)
    for _ in range(max_iter):
        if not moving:
            break
        sums = _summed(blocks, {fit: centres[fit] for fit in moving})
        still = []
        for fit in moving:
            n, old = sums[fit][:, 0], centres[fit]
            centres[fit] = np.where(n[:, None] > 0, sums[fit][:, 2:] / np.maximum(n, 1)[:, None], old)
            if (((centres[fit] - old) ** 2).sum(axis=1) > tol * tol).any():
                still.append(fit)
        moving = still
    costs = _summed(blocks, centres)
    return {fit: (float(costs[fit][:, 1].sum()), centres[fit]) for fit in centres}


def _farthest(blocks: RDD, centres: np.ndarray) -> np.ndarray:
    """The customer farthest from its nearest centre (the first in the metrics' order of equals)."""

    def of(x: np.ndarray) -> tuple:
        square = _assign(x, centres)[1]
        return max((float(square[i]), *(-x[i]).tolist()) for i in np.flatnonzero(square == square.max()))

    return -np.array(blocks.map(of).treeReduce(max)[1:])


def elbow_fits(
    feats: DataFrame, ks: Sequence[int], cols: Sequence[str], seeds: Sequence[int], max_iter: int
) -> dict[int, tuple[float, np.ndarray]]:
    """Cost and centres of each k > 1 of ``ks``: the best of several starts.

    No k costs more than a smaller one: where all starts of a k end in a worse
    solution, one more begins with the smaller k's centres and the customers
    farthest from them.
    """
    ks = sorted({k for k in ks if k > 1})
    pairs = [(k, seed) for k in ks for seed in seeds]
    # k-means|| is a few short jobs a start, which don't depend on each other
    with ThreadPool(STARTS) as pool:
        starts = pool.map(inheritable_thread_target(feats.sparkSession)(lambda p: _start(feats, *p)), pairs, chunksize=1)
    blocks = _blocks(feats, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = _lloyd(blocks, dict(zip(pairs, starts, strict=True)), max_iter)
        best: dict[int, tuple[float, np.ndarray]] = {}
        for at, k in enumerate(ks):
            best[k] = min((done[k, seed] for seed in seeds), key=lambda f: f[0])
            if at and best[k][0] > best[ks[at - 1]][0]:
                centres = best[ks[at - 1]][1]
                while len(centres) < k:
                    centres = np.vstack([centres, _farthest(blocks, centres)])
                best[k] = min(best[k], _lloyd(blocks, {(k, 0): centres}, max_iter)[k, 0], key=lambda f: f[0])
    finally:
        blocks.unpersist()
    return best


def kmeans_elbow(
    scaled: DataFrame,
    ks: Sequence[int] = tuple(range(1, 15)),
    cols: Sequence[str] = RFM_COLS,
    seeds: Sequence[int] = KMEANS_SEEDS,
    max_iter: int = 300,
) -> DataFrame:
    """Within-cluster sum of squares for each k, the lowest of several starts.

    k = 1 is the total sum of squares around the mean (MLlib rejects k=1).
    The features (three doubles a customer) are written once and persisted
    across the fits, which read them many times, and released after.
    """
    feats = _features(scaled, cols).select(*cols, "features").persist()
    try:
        rows = [(k, cost) for k, (cost, _) in elbow_fits(feats, ks, cols, seeds, max_iter).items()]
    finally:
        feats.unpersist()
    out = scaled.sparkSession.createDataFrame(rows, "k int, inertia double")
    if 1 in ks:
        out = total_inertia(feats, cols).unionByName(out)
    return out.orderBy("k")


def kmeans_segments(
    rfm: DataFrame,
    scaled: DataFrame,
    k: int = 3,
    customer: str = "CustomerID",
    cols: Sequence[str] = RFM_COLS,
    seeds: Sequence[int] = KMEANS_SEEDS,
    max_iter: int = 300,
) -> DataFrame:
    """K-means cluster per customer, renumbered 0..k-1 by ascending mean
    MonetaryValue. The features are laid out by customer in a fixed number of
    partitions and the best of several seeds is kept, so the labels don't move
    with the session's partitioning. Customers with an undefined metric have
    no cluster (``undefined_logs`` counts them)."""
    feats = _features(scaled, cols, customer).persist()
    try:
        model = _best_fit(feats, k, seeds, max_iter, SETTLED)
    finally:
        feats.unpersist()
    labelled = model.transform(feats).select(customer, F.col("prediction").alias("_raw"))
    with_m = labelled.join(rfm.select(customer, "MonetaryValue"), customer)
    # one row a cluster: k of them
    order = F.broadcast(
        with_m.groupBy("_raw")
        .agg(F.avg("MonetaryValue").alias("_mean_m"))
        .withColumn("cluster", F.row_number().over(Window.orderBy("_mean_m", "_raw")) - 1)
        .select("_raw", "cluster")
    )
    return labelled.join(order, "_raw").select(customer, F.col("cluster").cast("int"))


def clustering_certificate(
    assigned: DataFrame, centres: Sequence[Sequence[float]], cols: Sequence[str] = RFM_COLS, cluster: str = "cluster"
) -> DataFrame:
    """What makes an assignment a k-means solution, checked without the solver.

    ``assigned`` holds the features and a cluster 0..k-1 a row; ``centres`` are
    the solver's (k of them). One row: customers, clusters (that have any),
    misplaced (customers nearer to another cluster's mean), centres_off
    (centres that aren't their customers' mean), within (sum of squares
    around the means), between (of the means around the grand mean, weighed by
    size), total (around the grand mean, from the variances alone) and
    decomposed (within + between is total). Distances are compared to a part
    in 10^9. Only k means are gathered.
    """
    k = len(centres)
    means = assigned.groupBy(F.col(cluster).cast("int").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in cols]).alias("_mean")
    )
    known = F.map_from_entries(F.array(*[F.struct(F.lit(i), F.array(*[F.lit(float(v)) for v in c])) for i, c in enumerate(centres)]))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    means = materialize(means.withColumn("_off", F.coalesce(square(F.col("_mean"), known[F.col("_c")]) > 1e-12, F.lit(True))))
    table = means.agg(F.map_from_entries(F.collect_list(F.struct("_c", "_mean"))).alias("_means"))
    own = F.array(*[F.col(c).cast("double") for c in cols])
    rows = attach(assigned.select(F.col(cluster).cast("int").alias("_c"), own.alias("_x")), table, [])
    rows = rows.withColumn("_all", F.transform(F.map_values("_means"), lambda m: square(F.col("_x"), m))).withColumn(
        "_own", square(F.col("_x"), F.col("_means")[F.col("_c")])
    )
    within = rows.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("_own") > F.array_min("_all") * (1 + 1e-9) + 1e-12).alias("misplaced"),
        F.sum("_own").alias("within"),
    )
    total = sum((F.count(c) * F.var_pop(c) for c in cols), F.lit(0.0))
    grand = attach(means, assigned.agg(F.array(*[F.avg(c) for c in cols]).alias("_grand"), total.alias("_total")), [])
    between = grand.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if("_off").alias("centres_off"),
        F.sum(F.col("_n") * square(F.col("_mean"), F.col("_grand"))).alias("between"),
        F.max("_total").alias("total"),
    )
    out = attach(within, between, [])
    gap = F.abs(F.col("within") + F.col("between") - F.col("total"))
    return out.select(
        F.lit(k).alias("k"), "customers", "clusters", "misplaced", "centres_off", "within", "between", "total",
        (gap <= F.col("total") * 1e-9).alias("decomposed"),
    )


def kmeans_certificate(
    scaled: DataFrame, k: int = 3, customer: str = "CustomerID", cols: Sequence[str] = RFM_COLS,
    seeds: Sequence[int] = KMEANS_SEEDS, max_iter: int = 300,
) -> DataFrame:
    """The certificate of the labels that ``kmeans_segments`` gives, over written assignments."""
    feats = _features(scaled, cols, customer).persist()
    try:
        model = _best_fit(feats, k, seeds, max_iter, SETTLED)
        assigned = materialize(model.transform(feats).select(*cols, F.col("prediction").alias("cluster")))
    finally:
        feats.unpersist()
    return clustering_certificate(assigned, [list(c) for c in model.clusterCenters()], cols)


def kmeans_elbow_certificate(
    scaled: DataFrame, ks: Sequence[int] = tuple(range(1, 15)), cols: Sequence[str] = RFM_COLS,
    seeds: Sequence[int] = KMEANS_SEEDS, max_iter: int = 300,
) -> DataFrame:
    """Per k, whether the elbow's cost is what its assignment costs.

    The cost is summed anew from the solver's centres, every customer at its
    nearest; ``cost_agrees`` compares it with the solver's own, and
    ``no_worse`` says that it isn't above the cost of a smaller k.
    """
    feats = _features(scaled, cols).select(*cols, "features").persist()
    x = F.array(*[F.col(c).cast("double") for c in cols])
    square = lambda m: F.aggregate(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    told, sums = [], []
    try:
        for k, (cost, found) in elbow_fits(feats, ks, cols, seeds, max_iter).items():
            told.append((k, cost))
            centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in found])
            sums.append(F.sum(F.array_min(F.transform(centres, square))).alias(f"k{k}"))
        summed = materialize(feats.agg(F.count(F.lit(1)).alias("customers"), *sums))
        one = materialize(total_inertia(feats, cols))
    finally:
        feats.unpersist()
    costs = scaled.sparkSession.createDataFrame(told, "k int, told double")
    again = summed.unpivot(["customers"], [f"k{k}" for k, _ in told], "name", "cost").select(
        "customers", F.substring("name", 2, 9).cast("int").alias("k"), "cost"
    )
    rows = costs.join(again, "k")
    if 1 in ks:
        single = attach(summed.select("customers"), one, []).select("k", F.col("inertia").alias("told"), "customers", F.col("inertia").alias("cost"))
        rows = rows.unionByName(single)
    below = F.min("cost").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))  # a row a k
    return rows.select(
        "k", "customers", (F.abs(F.col("told") - F.col("cost")) <= 1e-6 * F.col("told")).alias("cost_agrees"),
        F.coalesce(F.col("cost") <= below * (1 + 1e-9), F.lit(True)).alias("no_worse"),
    ).orderBy("k")


def cluster_profile(rfm: DataFrame, cluster_col: str, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Per cluster mean of R, F, M and the number of customers."""
    return (
        rfm.groupBy(cluster_col)
        .agg(
            *[F.avg(c).alias(f"{c}_mean") for c in cols],
            F.count(F.lit(1)).alias("count"),
        )
        .orderBy(cluster_col)
    )


def cluster_sizes(rfm: DataFrame, cluster_col: str) -> DataFrame:
    """Customers per cluster."""
    return rfm.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster_col)


def cluster_mean_bars(
    rfm: DataFrame, cluster_col: str, cols: Sequence[str] = RFM_COLS, level: float = 0.95
) -> DataFrame:
    """Per cluster and metric, mean with a normal-approximation
    confidence interval (mean +- z * sd / sqrt(n))."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    long = rfm.select(cluster_col, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [cluster_col], list(cols), "metric", "value"
    )
    g = long.groupBy(cluster_col, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("_sd"),
        F.count("value").alias("n"),
    )
    half = F.lit(z) * F.col("_sd") / F.sqrt(F.col("n"))
    return g.select(
        cluster_col,
        "metric",
        "n",
        "mean",
        (F.col("mean") - half).alias("ci_low"),
        (F.col("mean") + half).alias("ci_high"),
    ).orderBy(cluster_col, "metric")


#: Upper ends of u in [0, 2^32) for weights 0, 1, 2, ... of a Poisson variable of mean 1.
POISSON_ENDS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]
REPLICATES = 1000


def cluster_mean_bars_bootstrap(
    rfm: DataFrame,
    cluster_col: str,
    customer: str = "CustomerID",
    cols: Sequence[str] = RFM_COLS,
    level: float = 0.95,
    replicates: int = REPLICATES,
    seed: int = 1,
) -> DataFrame:
    """Per cluster and metric, mean with a bootstrap percentile interval.

    Poisson bootstrap: in each replicate a customer counts as often as a
    Poisson variable of mean 1 says, which an integer hash of (customer,
    replicate, seed) draws. So no resample is ever drawn or stored, the result
    doesn't depend on partitioning, and any part of the customers can be
    summed first: one aggregate with map-side combine, a row per cluster and
    replicate. ``cluster_mean_bars`` has the normal interval.

    Customers with a null metric don't count for it; a null customer draws as
    one customer. A replicate in which a cluster has no weight is left out.
    """
    own = rfm.select(
        F.col(cluster_col).alias("_cluster"),
        *[F.col(c).cast("double").alias(c) for c in cols],
        mix(F.coalesce(F.col(customer).cast("bigint"), F.lit(0))).alias("_own"),
    )
    # a customer is a narrow row, but ``replicates`` rows of work: dealt round before
    spread = int(rfm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = own.repartition(spread).withColumn("_replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # a column a step, as each step reads the one before several times
    draws = draws.withColumn("_draw", mix(F.col("_replicate").cast("bigint") + F.lit(seed * 1_000_003)))
    draws = draws.withColumn("_both", F.col("_own").bitwiseXOR(F.col("_draw"))).withColumn("_u", mix(F.col("_both")))
    weight = F.lit(len(POISSON_ENDS))
    for k in range(len(POISSON_ENDS) - 1, -1, -1):
        weight = F.when(F.col("_u") < POISSON_ENDS[k], F.lit(k)).otherwise(weight)
    # rows of weight 0 stay: a filter would be pushed below these columns, with a copy of them for each mention
    drawn = draws.withColumn("_w", weight)
    per_replicate = drawn.groupBy("_cluster", "_replicate").agg(
        *[F.try_divide(F.sum(F.col("_w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(c) for c in cols]
    )
    tail = (1 - level) / 2
    # at most ``replicates`` rows a cluster
    intervals = per_replicate.unpivot(["_cluster"], list(cols), "metric", "_mean").groupBy("_cluster", "metric").agg(
        F.percentile("_mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci")
    )
    long = rfm.select(F.col(cluster_col).alias("_cluster"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["_cluster"], list(cols), "metric", "_value"
    )
    means = long.groupBy("_cluster", "metric").agg(F.count("_value").alias("n"), F.avg("_value").alias("mean"))
    both = means.withColumnRenamed("_cluster", "_key").join(
        intervals.withColumnRenamed("metric", "_metric"), F.col("_key").eqNullSafe(F.col("_cluster")) & (F.col("metric") == F.col("_metric")), "left"
    )
    return both.select(
        F.col("_key").alias(cluster_col), "metric", "n", "mean", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")
    ).orderBy(cluster_col, "metric")


def rfm_scores(rfm: DataFrame, q: int = 3, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Quantile scores 1..q per metric, like pandas ``qcut``: edges are
    exact interpolated quantiles 0, 1/q, .., 1, bins right-closed with the
    lowest edge included. Recency is reversed (most recent = q). Duplicate
    edges raise, as in pandas."""
    probs = [i / q for i in range(q + 1)]
    # All metrics in one grouped quantile computation (keyed by metric), then
    # folded to a single row of edges that every task receives.
    long = rfm.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "metric", "value"
    )
    per_metric = exact_quantiles(long, "value", probs, [f"e{i}" for i in range(q + 1)], by=["metric"])
    edges = per_metric.agg(
        F.struct(
            *[
                F.max(F.when(F.col("metric") == c, F.col(f"e{i}"))).alias(f"{c}_e{i}")
                for c in cols
                for i in range(q + 1)
            ]
        )
    ).scalar()
    # The edge row is attached once; each score reads its fields.
    out = rfm.withColumn("_edges", edges)
    scored = {}
    for c, name in zip(cols, ("R", "F", "M")):
        es = [F.col(f"_edges.{c}_e{i}") for i in range(q + 1)]
        dup = reduce(operator.or_, [es[i] >= es[i + 1] for i in range(q)])
        b = quantile_bins(F.col(c).cast("double"), es)
        score = (F.lit(q + 1) - b) if name == "R" else b
        scored[name] = F.when(
            dup, F.raise_error(F.lit(f"rfm_scores: duplicate bin edges for {c}"))
        ).otherwise(score.cast("int"))
    return out.withColumns(scored).select(*rfm.columns, "R", "F", "M")


def rfm_code(scored: DataFrame) -> DataFrame:
    """RFM_cluster = "RFM" digits, RFM_score = R + F + M."""
    return scored.withColumns(
        {
            "RFM_cluster": F.concat(
                F.col("R").cast("string"), F.col("F").cast("string"), F.col("M").cast("string")
            ),
            "RFM_score": (F.col("R") + F.col("F") + F.col("M")).cast("int"),
        }
    )


def rfm_code_count(coded: DataFrame) -> DataFrame:
    """Number of distinct RFM codes."""
    return coded.agg(F.count_distinct("RFM_cluster").alias("n_codes"))


def rfm_code_frequency(coded: DataFrame) -> DataFrame:
    """Customers per RFM code, most frequent first."""
    return (
        coded.groupBy("RFM_cluster")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "RFM_cluster")
    )


def rfm_segment_label(coded: DataFrame) -> DataFrame:
    """Action segment of each customer from its RFM code."""
    expr = None
    for seg, codes in SEGMENT_CODES.items():
        cond = F.col("RFM_cluster").isin(*codes)
        expr = F.when(cond, F.lit(seg)) if expr is None else expr.when(cond, F.lit(seg))
    return coded.withColumn("segment", expr.otherwise(F.lit(OTHER_SEGMENT)))


def rfm_density(
    rfm: DataFrame, cols: Sequence[str] = RFM_COLS, bins: int = 50, grid: int = 100
) -> DataFrame:
    """Histogram and Gaussian kernel density per metric.

    The KDE is binned: values are first counted into ``bins`` equal-width
    bins (one distributed aggregate), then the density on a ``grid``-point
    axis is summed over the bin centres (an array of at most ``bins``
    entries per metric), so the cost is bins x grid per metric whatever the
    number of customers. Bandwidth: Scott's rule.
    A metric without spread has a histogram and no density.
    Output rows: metric, kind ('histogram' | 'kde'), x, value.
    """
    long = rfm.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "metric", "x"
    ).where(F.col("x").isNotNull())
    st = long.groupBy("metric").agg(
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.count("x").alias("n"),
        F.stddev_samp("x").alias("sd"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))
    )
    # st has one row per metric: a bounded broadcast on the metric key.
    hist = (
        long.join(F.broadcast(st), "metric")
        .groupBy("metric", b.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .join(F.broadcast(st), "metric")
        .withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    )
    # Each metric's non-empty bins as one array of at most `bins` entries;
    # every grid point sums its kernel over that array.
    per_metric = hist.where(F.col("sd") > 0).groupBy("metric", "lo", "hi", "n", "sd").agg(
        F.collect_list(F.struct("centre", "count")).alias("_bins")
    )
    axis = (
        per_metric.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("gx", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1)))
        .withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    )
    norm = F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5) * F.col("n")
    kernel_sum = F.aggregate(
        "_bins",
        F.lit(0.0),
        lambda acc, e: acc
        + e["count"] * F.exp(-0.5 * F.pow((F.col("gx") - e["centre"]) / F.col("bw"), 2)),
    )
    density = axis.select("metric", F.col("gx").alias("x"), (kernel_sum / norm).alias("density"))
    counts = hist.select(
        "metric",
        F.lit("histogram").alias("kind"),
        (F.col("lo") + F.col("bin") * width).alias("x"),
        F.col("count").cast("double").alias("value"),
    )
    kde = density.select("metric", F.lit("kde").alias("kind"), "x", F.col("density").alias("value"))
    return counts.unionByName(kde).orderBy("metric", "kind", "x")


#: Terms of the expansion about a box's centre, and boxes to either side that a grid point reads.
GAUSS_TERMS, GAUSS_REACH = 20, 10


def rfm_density_exact(rfm: DataFrame, cols: Sequence[str] = RFM_COLS, grid: int = 200) -> DataFrame:
    """The Gaussian kernel density of every customer on ``grid`` points a metric.

    A fast Gauss sum: values fall into boxes one bandwidth wide (Scott's
    rule); one aggregate with map-side combine sums, per box, the first
    ``GAUSS_TERMS`` powers of the distance to its centre. The kernel is then
    expanded in Hermite polynomials about the centres, and a grid point reads
    the boxes in reach. A value lies at most half a bandwidth from its centre,
    so by Cramer's bound the terms left out are below 0.5^20 / sqrt(20!) < 1e-15
    of a kernel's height a value; boxes out of reach are nine bandwidths or
    more away, and hold below exp(-40) of it. So the density is within 1e-14
    of its kernel's height of the all-pairs sum, at a cost a grid point that
    doesn't depend on the number of customers.

    Columns: metric, x, density. A metric without spread has no density; NULLs
    don't count.
    """
    long = rfm.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "metric", "v").where("v IS NOT NULL")
    spread = long.groupBy("metric").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.stddev_samp("v").alias("sd")
    )
    # one row a metric
    shape = F.broadcast(
        materialize(spread.where("sd > 0").withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))))
    )
    unit = F.col("h") * F.lit(math.sqrt(2.0))
    centre = F.col("lo") + (F.col("box") + F.lit(0.5)) * F.col("h")
    boxed = long.join(shape, "metric").withColumn("box", F.floor((F.col("v") - F.col("lo")) / F.col("h")))
    t = F.col("t")
    boxes = (
        boxed.select("metric", "box", ((F.col("v") - centre) / unit).alias("t"))
        .groupBy("metric", "box")
        .agg(F.array(*[F.sum(F.pow(t, F.lit(float(k)))) for k in range(GAUSS_TERMS)]).alias("moments"))
    )
    axis = shape.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    )
    near = axis.withColumn("_own", F.floor((F.col("x") - F.col("lo")) / F.col("h"))).withColumn(
        "box", F.explode(F.sequence(F.col("_own") - GAUSS_REACH, F.col("_own") + GAUSS_REACH))
    )
    met = near.join(boxes, ["metric", "box"]).withColumn("t", (F.col("x") - centre) / unit)

    # Hermite polynomials over factorials: c(k + 1) = (2 t c(k) - 2 c(k - 1)) / (k + 1)
    def term(s: F.Column, k: F.Column) -> F.Column:
        here = F.get("moments", k)
        return F.struct(
            s["b"].alias("a"),
            ((F.lit(2.0) * t * s["b"] - F.lit(2.0) * s["a"]) / (k + 1)).alias("b"),
            (s["sum"] + s["b"] * here).alias("sum"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("sum"))
    kernel = F.exp(-t * t) * F.aggregate(F.sequence(F.lit(0), F.lit(GAUSS_TERMS - 1)), zero, term, lambda s: s["sum"])
    height = F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi))
    sums = met.groupBy("metric", "g").agg(F.sum(kernel).alias("_k"))
    return (
        axis.join(sums, ["metric", "g"], "left")
        .select("metric", "x", (F.coalesce("_k", F.lit(0.0)) / height).alias("density"))
        .orderBy("metric", "x")
    )
