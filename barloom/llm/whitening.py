"""Whitening of embeddings: rows are centred and projected on the scaled principal components.

Entries are rounded down to 256ths, so vectors, sums and squared deviations are whole numbers
and exact.  The components come from MLlib's ``computeSVD`` of the distributed centred rows:
a singular value s of n rows is a variance of s * s / n.  The total variance does not rest on
that factorisation, but on the exact deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: A component of less than this share of the first one's variance is rounding, and left out.
LEAST_SHARE = 1e-10


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, x): the entries in 256ths, rounded down.

    Vectors that are null or empty, or hold null or non-finite entries, are left out, and so
    are those whose length is not that of most vectors (of equally many: the longest).
    Entries beyond a long become its bounds.
    """
    entry = F.col("v").cast("array<double>")
    slim = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = slim.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    usual = good.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    rows = good.where(F.size("v") == (usual or 0))
    bound = lambda c: F.greatest(F.least(c, F.lit(float(2**63))), F.lit(-float(2**63)))
    return rows.select("id", F.transform(entry, lambda c: F.floor(bound(c * SCALE)).cast("long")).alias("x"))


def _matrix(column):
    """The lists of an Arrow column as rows of an array, whatever their slices."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def _sums(batches: Iterator) -> Iterator:
    """Vectors to the exact sums of their dimensions, as text, one row a dimension."""
    import numpy as np
    import pyarrow as pa

    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        fits = int(np.abs(x.astype(float)).max()) < 2**62 // len(x)
        part = (x if fits else x.astype(object)).sum(0).astype(object)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total])], ["dim", "sum"])


def _squares(x, n: int, sums):
    """Sums over the dimensions of (n * x - sums) squared, exact: longs where they surely fit, else Python's numbers."""
    import numpy as np

    bound = n * int(np.abs(x.astype(float)).max()) + max(abs(s) for s in sums)
    if x.shape[1] * bound**2 < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1).tolist()


class Whitening:
    """What the fit gives: n, exact sums and total of the squared deviations, components (as columns) and their variances."""

    def __init__(self, n: int, sums: list[int], total: int, components, variances) -> None:
        self.n, self.sums, self.total = n, sums, total
        self.components, self.variances = components, variances

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    @property
    def explained(self) -> list[float]:
        """Share of each component in the total variance, which is the total deviation over n to the third."""
        return [float(v) * self.n**3 / self.total for v in self.variances]

    def project(self, x):
        """The whitened coordinates of whole-number vectors."""
        import numpy as np

        return (x - np.array(self.mean)) @ self.components / np.sqrt(self.variances)


def _applied(rows: DataFrame, fit: Whitening) -> DataFrame:
    """Add (deviation, w): the exact squared deviation and the whitened coordinates."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1))
            squares = pa.array([str(s) for s in _squares(x, fit.n, fit.sums)])
            w = fit.project(x)
            offsets = pa.array(range(0, w.size + 1, max(1, w.shape[1])) if w.shape[1] else [0] * (len(w) + 1), pa.int32())
            coordinates = pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], squares, coordinates], [*batch.schema.names[:-1], "deviation", "w"])

    kept = [c for c in rows.columns if c != "x"]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    found = rows.select(*kept, "x").mapInArrow(run, ", ".join([*kinds, "deviation string", "w array<double>"]))
    return found.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def fit(different: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (x) of equal length, each of which counts; none without rows.

    What reaches the driver grows with the dimensions alone: their sums, and the Gram matrix
    inside ``computeSVD``.  All components are asked for, so MLlib factorises that matrix by
    LAPACK, to double precision.
    """
    import numpy as np

    n = different.count()
    if not n:
        return None
    parts = different.mapInArrow(_sums, "dim int, sum string")
    sums = [int(r["s"]) for r in parts.groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()]
    first = Whitening(n, sums, 0, np.zeros((len(sums), 0)), np.zeros(0))
    total = int(_applied(different, first).agg(F.sum("deviation")).first()[0] or 0)
    if not total:
        return first
    centred = different.select(F.zip_with("x", F.lit(first.mean), lambda x, m: x - m).alias("c"))
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c")), "c")
    found = RowMatrix(rows, n, len(sums)).computeSVD(len(sums))
    variances = found.s.toArray() ** 2 / n
    held = int(np.count_nonzero(variances[:most] > LEAST_SHARE * variances[0]))
    return Whitening(n, sums, total, found.V.toArray()[:, :held].copy(), variances[:held])


def identity_error(different: DataFrame, found: Whitening) -> float:
    """Largest entry, less its sign, of the covariance of the whitened rows minus the identity."""
    k = len(found.variances)
    if not k:
        return 0.0
    at = lambda i: F.col("w")[i]
    places = [(i, j) for i in range(k) for j in range(i, k)]
    # a covariance of Spark is centred as it is summed
    row = _applied(different, found).agg(*[F.covar_pop(at(i), at(j)).alias(f"v{i}_{j}") for i, j in places]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, places, strict=True))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, fit, identity error): rows (id, n, deviation, whitened) of all usable vectors.

    Each different vector counts once in the fit, however many copies it has; copies meet
    before they are shuffled.  ``whitened`` has a coordinate for each of the first ``most``
    components that have any variance: fewer where the vectors differ in fewer directions,
    none where all are equal.  ``deviation`` is the exact sum of (n * x - sum) squared, a
    decimal of 38 digits (null beyond).  Repeated rows and null ids come back as given, a
    table without usable vectors gives no rows, and other columns are ignored.  Vectors of any
    length are taken whole; the driver holds a matrix of length by length.
    """
    rows = whole_vectors(table, id_col, vector_col)
    different = stored(rows.select("x").distinct())
    found = fit(different, most)
    if found is None:
        empty = rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit([0.0]).alias("whitened"))
        return empty.where(F.lit(False)), None, 0.0
    out = _applied(rows, found).select("id", F.lit(found.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"))
    return out, found, identity_error(different, found)
