"""Connected components of a graph held as an edge table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own, which
    goes when Python ends; any other raises, as its executors would not see a folder of the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="spark-steps-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[context.applicationId] = "file://" + folder
    return _own_dirs[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and a lost
    executor costs a reread instead of a recomputation. The folder's owner clears what discard() leaves."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of written() tables that no plan will read again; other tables are left alone."""
    for t in tables:
        if path := _paths.pop(t, None):
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, parent) of a forest whose parents are smaller than their nodes -> (node, root), by pointer jumping."""
    jumped = None
    while True:
        before = jumped
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.coalesce(F.col("grand") < F.col("parent"), F.lit(False)).alias("moved")), "roots"
        )
        if before is not None:
            discard(before)
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); a component is its smallest node.

    Every node points to its smallest neighbour if that is smaller than itself; the forest is flattened, its
    trees become the nodes of the next, smaller graph, and so on until no edge is left. Rounds grow with the
    logarithm of the number of nodes. Null ends and loops only add their nodes; an empty table gives none."""
    e = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    both = lambda x: x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both(e).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    edges = e
    e = edges.where("a <> b")
    while not e.isEmpty():
        old = [edges, found]
        parents = both(e).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select("node", F.least("node", "parent").alias("parent"))
        roots = _rooted(parents)
        top = roots.select(F.col("node").alias("component"), F.col("parent").alias("top"))
        found = written(found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
        a, b = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        e = edges = written(e.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        discard(*old, roots)
    return found
