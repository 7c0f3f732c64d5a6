"""The Parquet store and Matrix Market folders: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.plans import data as D
from helixframe.plans.registry import query
from helixframe.session import shared_folder
from helixframe.sources import h5ad as H
from helixframe.sources import matrix_market as M
from helixframe.sources import store as S


def _var(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


def _store(spark, sf_dir) -> S.CellStore:
    return S.CellStore.create(D.counts(spark, sf_dir), D.obs(spark, sf_dir), _var(spark, sf_dir), _folder(spark))


@query(f"WITH {D.OBS} SELECT cell, segment, true AS to_keep FROM obs")
def store_obs(spark, sf_dir):
    return _store(spark, sf_dir).obs(["cell", "segment", "to_keep"])


@query("SELECT p_partkey AS gene, p_brand AS brand, p_size AS size FROM part WHERE p_size > 25")
def store_var_filtered(spark, sf_dir):
    s = _store(spark, sf_dir)
    return s.updated(var=s.var().filter("size > 25")).var()


@query(f"WITH {D.COUNTS} SELECT cell, gene, raw FROM counts JOIN customer ON cell = c_custkey WHERE c_mktsegment = 'BUILDING'")
def store_kept_counts(spark, sf_dir):
    """Counts of the cells that are kept, from the copy that is sorted by gene."""
    s = _store(spark, sf_dir)
    return s.updated(obs=S.keep_cells(s.obs(), s.obs().filter("segment = 'BUILDING'"))).counts("gene").select("cell", "gene", "raw")


@query(f"WITH {D.OBS} SELECT cell, segment, batch, true AS to_keep FROM obs")
def store_reset_cells(spark, sf_dir):
    s = _store(spark, sf_dir)
    s = s.updated(obs=S.keep_cells(s.obs(), s.obs().limit(3)))
    return s.updated(obs=S.keep_cells(s.obs(), None)).obs()


@query(f"WITH {D.COUNTS}, {D.OBS}, m AS (SELECT cell, count(*) AS nnz, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts GROUP BY 1) SELECT cell, segment, batch, true AS to_keep, nnz, lib_size FROM obs LEFT JOIN m USING (cell)")
def store_added_columns(spark, sf_dir):
    from helixframe.operators.cells import cell_metrics

    s = _store(spark, sf_dir)
    return s.updated(obs=S.with_columns(s.obs(), cell_metrics(s.counts(kept=False)))).obs()


@query(f"WITH {D.COUNTS}, m AS (SELECT gene, count(*) AS n_cells, CAST(sum(raw) AS BIGINT) AS total FROM counts GROUP BY 1) SELECT p_partkey AS gene, p_brand AS brand, p_size AS size, n_cells, total FROM part LEFT JOIN m ON gene = p_partkey")
def store_added_gene_columns(spark, sf_dir):
    from helixframe.operators.cells import gene_metrics

    s = _store(spark, sf_dir)
    return s.updated(var=S.with_columns(s.var(), gene_metrics(s.counts("gene", kept=False)), "gene")).var()


@query(f"WITH {D.OBS} SELECT cell, segment AS market_segment, true AS to_keep FROM obs")
def store_renamed_columns(spark, sf_dir):
    return S.snake_case(S.dropped(S.renamed(_store(spark, sf_dir).obs(), {"segment": "Market Segment"}), ["batch"]))


@query("SELECT unnest(['cell', 'segment', 'batch', 'to_keep']) AS feature, 'obs' AS kind UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'gene' FROM part")
def store_features(spark, sf_dir):
    return _store(spark, sf_dir).features()


@query(f"WITH {D.COUNTS} SELECT cell, p_brand AS gene, CAST(sum(raw) AS BIGINT) AS raw FROM counts JOIN part ON gene = p_partkey GROUP BY 1, 2")
def store_modality_counts(spark, sf_dir):
    """Brands as proteins beside parts as genes."""
    s = _store(spark, sf_dir)
    proteins = D.expr(spark, sf_dir).select(F.col("sample").alias("cell"), F.col("feature").alias("gene"), F.col("value").cast("long").alias("raw"))
    s.add_modality("adt", proteins, proteins.select("gene").distinct())
    return s.modality("adt")[0]


@query("SELECT p_brand AS gene, false AS is_isotype FROM part GROUP BY 1")
def store_modality_var(spark, sf_dir):
    from helixframe.operators.cells import isotype_controls

    s = _store(spark, sf_dir)
    proteins = D.expr(spark, sf_dir).select(F.col("sample").alias("cell"), F.col("feature").alias("gene"), F.col("value").cast("long").alias("raw"))
    brands = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
    s.add_modality("adt", proteins, isotype_controls(brands))
    return s.modality("adt")[1]


@query("SELECT p_partkey AS gene, p_brand AS brand, p_size AS size, CAST(row_number() OVER (ORDER BY p_partkey DESC) - 1 AS BIGINT) AS index FROM part WHERE p_partkey % 3 = 0")
def store_var_reordered(spark, sf_dir):
    """Every third gene, the last one first."""
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gene"))) - 1).cast("long")
    s = _store(spark, sf_dir)
    return S.reordered_var(s.var(), s.var().filter("gene % 3 = 0").select("gene", at.alias("position")))


@query(f"WITH {D.OBS} SELECT cell, segment, batch, CASE WHEN batch < 10 THEN 'low_' || batch WHEN batch >= 15 THEN 'high_' || batch END AS cluster FROM obs")
def merged_subset_columns(spark, sf_dir):
    o = D.obs(spark, sf_dir)
    part = lambda c: o.filter(c).select("cell", F.col("batch").alias("cluster"))
    return S.merged_subsets(o, {"low": part("batch < 10"), "high": part("batch >= 15")}, ["cluster"], prefix=True)


def _mtx(spark, sf_dir, where: str, genes: str) -> str:
    """A folder of the customers and parts that pass; indices are places in the order of keys."""
    from pyspark.sql import Window

    at = _folder(spark)
    place = lambda df, key: df.withColumn("index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("long"))
    c = place(D.table(spark, sf_dir, "customer").filter(where).select(F.col("c_custkey").alias("name")), "name")
    g = place(D.table(spark, sf_dir, "part").filter(genes).select(F.col("p_partkey").alias("name")), "name")
    x = D.counts(spark, sf_dir).join(c.select(F.col("name").alias("cell"), F.col("index").alias("i")), "cell").join(g.select(F.col("name").alias("gene"), F.col("index").alias("j")), "gene")
    M.write_folder(x.select(F.col("i").alias("cell"), F.col("j").alias("gene"), "raw"), c, g, at)
    return at


def _folders(spark, sf_dir) -> dict[str, str]:
    return {"a": _mtx(spark, sf_dir, "c_nationkey < 12", "p_size > 5"), "b": _mtx(spark, sf_dir, "c_nationkey >= 12", "p_size <= 45")}


@query(f"""WITH {D.COUNTS}, c AS (SELECT c_custkey AS cell, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_nationkey < 12), g AS (SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part WHERE p_size > 5)
SELECT i AS cell, j AS gene, raw FROM counts JOIN c USING (cell) JOIN g USING (gene)""")
def matrix_market_counts(spark, sf_dir):
    return M.read_matrix(spark, f"{_folders(spark, sf_dir)['a']}/matrix.mtx")[0]


@query(f"""WITH {D.COUNTS}, f AS (SELECT c_custkey AS cell, p_partkey AS gene FROM customer, part LIMIT 0) SELECT 'a' AS exp_id, (SELECT count(*) FROM customer WHERE c_nationkey < 12) AS cells, (SELECT count(*) FROM part WHERE p_size > 5) AS genes, count(*) AS entries FROM counts JOIN customer ON cell = c_custkey JOIN part ON gene = p_partkey WHERE c_nationkey < 12 AND p_size > 5
UNION ALL SELECT 'b', (SELECT count(*) FROM customer WHERE c_nationkey >= 12), (SELECT count(*) FROM part WHERE p_size <= 45), count(*) FROM counts JOIN customer ON cell = c_custkey JOIN part ON gene = p_partkey WHERE c_nationkey >= 12 AND p_size <= 45""")
def matrix_market_scan(spark, sf_dir):
    return M.scan_folders(spark, _folders(spark, sf_dir))


@query(f"WITH {D.COUNTS} SELECT CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END AS exp_id, CASE WHEN c_nationkey < 12 THEN 'a_' ELSE 'b_' END || cell AS cell, CAST(gene AS VARCHAR) AS gene, raw FROM counts JOIN customer ON cell = c_custkey JOIN part ON gene = p_partkey WHERE p_size > 5 AND p_size <= 45")
def matrix_market_experiments(spark, sf_dir):
    return M.read_folders(spark, _folders(spark, sf_dir))


@query("SELECT c_custkey AS cell, c_mktsegment AS segment FROM customer")
def plain_text_obs(spark, sf_dir):
    at = f"{_folder(spark)}/obs.tsv"
    D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).write.csv(at, sep="\t", header=True)
    return M.read_table(spark, at, "cell").withColumn("cell", F.col("cell").cast("long"))


def _h5(spark, sf_dir, where: str = "true", genes: str = "true", **more) -> str:
    """Counts of customers by parts as a file, with segments, balances and brands."""
    from pyspark.sql import Window

    at = f"{_folder(spark)}.h5"
    place = lambda df: df.withColumn("index", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))  # noqa: E731  a row a cell or gene
    obs = place(D.table(spark, sf_dir, "customer").filter(where).select(F.col("c_custkey").alias("key"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("positive")))
    var = place(D.table(spark, sf_dir, "part").filter(genes).select(F.col("p_partkey").alias("key"), F.concat(F.lit("g"), F.col("p_partkey")).alias("name"), F.col("p_brand").alias("gene_name"), F.col("p_size").alias("size")))
    x = D.counts(spark, sf_dir).join(obs.select(F.col("key").alias("cell"), F.col("index").alias("i")), "cell").join(var.select(F.col("key").alias("gene"), F.col("index").alias("j")), "gene")
    H.write_h5(x.select(F.col("i").alias("cell"), F.col("j").alias("gene"), "raw"), obs.drop("key"), var.drop("key"), at, **more)
    return at


_PLACED = "c AS (SELECT c_custkey AS cell, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), g AS (SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part)"
_H5_COUNTS = f"WITH {D.COUNTS}, {_PLACED} SELECT i AS cell, j AS gene, CAST(raw AS DOUBLE) AS raw FROM counts JOIN c USING (cell) JOIN g USING (gene)"


@query(_H5_COUNTS)
def h5ad_counts(spark, sf_dir):
    return H.read_h5(spark, _h5(spark, sf_dir))


@query(_H5_COUNTS)
def h5ad_counts_by_gene(spark, sf_dir):
    return H.read_h5(spark, _h5(spark, sf_dir, by="gene"))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "index", 'c' || c_custkey AS name, c_mktsegment AS segment, c_acctbal AS balance, c_acctbal > 0 AS positive FROM customer""")
def h5ad_obs(spark, sf_dir):
    return H.read_h5(spark, _h5(spark, sf_dir), "obs")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS "index", 'g' || p_partkey AS name, p_brand AS gene_name, p_size AS size FROM part""")
def h5ad_var(spark, sf_dir):
    return H.read_h5(spark, _h5(spark, sf_dir), "var").withColumn("size", F.col("size").cast("long"))


@query(_H5_COUNTS)
def tenx_counts(spark, sf_dir):
    return H.read_h5(spark, _h5(spark, sf_dir, layout="tenx"), layout="tenx")


@query(f"WITH {D.COUNTS} SELECT CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END AS exp_id, CASE WHEN c_nationkey < 12 THEN 'a_c' ELSE 'b_c' END || cell AS cell, 'g' || gene AS gene, CAST(raw AS DOUBLE) AS raw FROM counts JOIN customer ON cell = c_custkey JOIN part ON gene = p_partkey WHERE p_size > 5 AND p_size <= 45")
def h5ad_experiments(spark, sf_dir):
    """Two files; genes that both have."""
    files = {"a": _h5(spark, sf_dir, "c_nationkey < 12", "p_size > 5"), "b": _h5(spark, sf_dir, "c_nationkey >= 12", "p_size <= 45")}
    return H.read_many(spark, files)
