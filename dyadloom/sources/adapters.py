"""Canonical operator inputs from star-schema tables, and a small knowledge base."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LR_COLUMNS = ("lr_ix", "interaction_name", "pathway_name", "ligand", "receptor", "agonist", "antagonist", "co_a", "co_i", "annotation")
ANNOTATIONS = ("Secreted Signaling", "ECM-Receptor", "Non-protein Signaling", "Cell-Cell Contact")
LR = [
    (1, "B1_B2", "PA", "Brand#1", "Brand#2", "", "", "", "", "Secreted Signaling"),
    (2, "B3_B4", "PA", "Brand#3", "Brand#4", "AG1", "", "", "", "Secreted Signaling"),
    (3, "CX1_B5", "PB", "CX1", "Brand#5", "", "AN1", "", "", "Secreted Signaling"),
    (4, "B6_CX2", "PB", "Brand#6", "CX2", "", "", "CA1", "", "ECM-Receptor"),
    (5, "B7_B8", "PB", "Brand#7", "Brand#8", "", "", "", "CI1", "ECM-Receptor"),
    (6, "CX3_B1", "PC", "CX3", "Brand#1", "AG1", "AN1", "", "", "ECM-Receptor"),
    (7, "B9_B10", "PC", "Brand#9", "Brand#10", "", "", "", "", "Cell-Cell Contact"),
    (8, "B11_B12", "PD", "Brand#11", "Brand#12", "", "", "CA1", "CI1", "Non-protein Signaling"),
    (9, "B2_CX1", "PD", "Brand#2", "CX1", "", "", "", "", "Cell-Cell Contact"),
]
#: Empty places in a complex or cofactor keep their position.
COMPLEX = [("CX1", 1, "Brand#13"), ("CX1", 2, ""), ("CX1", 3, "Brand#14"), ("CX2", 1, "Brand#15"), ("CX2", 2, "Brand#16"), ("CX3", 1, "Brand#17"), ("CX3", 2, "Brand#18"), ("CX3", 3, "Brand#19")]
COFACTOR = [("AG1", 1, "Brand#20"), ("AG1", 2, "Brand#21"), ("AN1", 1, "Brand#22"), ("CA1", 1, "Brand#23"), ("CA1", 2, "Absent#1"), ("CI1", 1, "Brand#24"), ("CI1", 2, "Brand#25")]


@dataclass(frozen=True)
class Study:
    """Named DataFrames of one analysis. Operators take what they need of it and return
    new frames; ``with_`` gives a study in which some are replaced."""

    expr: DataFrame  # cell, gene, value; zeros implicit
    cells: DataFrame  # cell, grp, sample
    lr: DataFrame | None = None
    complexes: DataFrame | None = None  # name, pos, member
    cofactors: DataFrame | None = None
    parameters: dict = field(default_factory=dict)

    def with_(self, **named) -> Study:
        return replace(self, **named)

    def __repr__(self) -> str:
        return f"Study(expr={self.expr.columns}, cells={self.cells.columns}, parameters={self.parameters})"


def knowledge_base(spark: SparkSession) -> dict[str, DataFrame]:
    part = "name string, pos int, member string"
    return {
        "lr": spark.createDataFrame(LR, "lr_ix int, " + ", ".join(f"{c} string" for c in LR_COLUMNS[1:])),
        "complexes": spark.createDataFrame(COMPLEX, part),
        "cofactors": spark.createDataFrame(COFACTOR, part),
    }


def _tables(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """(text, MD5) of each file of a folder, by name, wherever Spark can read."""
    rows = spark.read.format("binaryFile").load(f"{folder}/*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.md5("content").alias("md5")).collect()
    return {r["name"]: (bytes(r["content"]).decode(), r["md5"]) for r in rows}


def _fields(text: str) -> list[list[str]]:
    """Tab-separated rows, without a header; empty fields keep their places."""
    return [line.rstrip("\r").split("\t") for line in text.split("\n") if line.strip()]


def _long(rows: list[list[str]]) -> list[tuple[str, int, str]]:
    width = max((len(r) for r in rows), default=1)
    return [(r[0], k, r[k] if k < len(r) else "") for r in rows for k in range(1, width)]


def load_knowledge_base(spark: SparkSession, folder: str, pinned: str | None = None) -> dict:
    """``lr``, ``complexes``, ``cofactors`` and ``symbols`` of an exported folder, and its
    ``manifest``. Every file that the manifest has an MD5 of must have that MD5, numbers of
    rows and the last diffusible interaction must be as it says, and, if ``pinned`` is
    given, its version too. A folder without interactions gives an empty ``lr``."""
    files = _tables(spark, folder)
    if "MANIFEST.tsv" not in files:
        raise FileNotFoundError(f"{folder} has no manifest")
    manifest = dict(line.split("\t", 1) for line in files["MANIFEST.tsv"][0].split("\n") if "\t" in line and not line.startswith("#"))
    found = {name.rsplit(".", 1)[0]: v for name, v in files.items()}
    for name, (_, md5) in found.items():
        if manifest.get(f"md5_{name}", md5) != md5:
            raise ValueError(f"{name} is not the file that the manifest describes")
    if pinned is not None and manifest.get("upstream_commit", pinned) != pinned:
        raise ValueError(f"version {manifest['upstream_commit']} where {pinned} is pinned")
    rows = _fields(found["interactions"][0]) if "interactions" in found else []
    short = [r for r in rows if len(r) != len(LR_COLUMNS) - 1]
    if short:
        raise ValueError(f"an interaction has {len(short[0])} fields")
    lr = [(k, *r) for k, r in enumerate(rows, 1)]
    unknown = {r[-1] for r in lr} - set(ANNOTATIONS)
    if unknown:
        raise ValueError(f"unknown annotation {min(unknown)!r}")
    parts = {k: _fields(found[k][0]) if k in found else [] for k in ("complexes", "cofactors")}
    last = max((r[0] for r in lr if r[-1] != ANNOTATIONS[-1]), default=0)
    said = {"n_interactions": len(lr), "n_complexes": len(parts["complexes"]), "n_cofactors": len(parts["cofactors"]), "nlr1": last}
    for key, n in said.items():
        if key in manifest and int(manifest[key]) != n and (lr or key in ("n_complexes", "n_cofactors")):
            raise ValueError(f"{key} is {n}, not {manifest[key]} as the manifest says")
    part = "name string, pos int, member string"
    return {
        "lr": spark.createDataFrame(lr, "lr_ix int, " + ", ".join(f"{c} string" for c in LR_COLUMNS[1:])),
        **{k: spark.createDataFrame(_long(v), part) for k, v in parts.items()},
        "symbols": spark.createDataFrame([(s,) for s in found.get("symbols", ("", ""))[0].split("\n") if s], "symbol string"),
        "manifest": manifest,
    }


def write_knowledge_base(kb: dict, folder: str, species: str = "") -> None:
    """A folder that ``load_knowledge_base`` reads, manifest included. Through Spark's
    file systems, so the folder may be anywhere that Spark writes."""
    spark = kb["lr"].sparkSession
    order = lambda df, *by: [tuple("" if v is None else str(v) for v in r) for r in df.orderBy(*by).collect()]
    rows = order(kb["lr"].select("lr_ix", *LR_COLUMNS[1:]), "lr_ix")
    texts = {"interactions.tsv": ["\t".join(r[1:]) for r in rows]}
    counts = {"n_interactions": len(rows)}
    for k in ("complexes", "cofactors"):
        wide: dict[str, dict[int, str]] = {}
        for name, pos, member in order(kb[k].select("name", "pos", "member"), "name", "pos"):
            wide.setdefault(name, {})[int(pos)] = member
        width = max((max(v) for v in wide.values()), default=0)
        texts[f"{k}.tsv"] = ["\t".join([n, *(v.get(i, "") for i in range(1, width + 1))]) for n, v in wide.items()]
        counts[f"n_{k}"] = len(wide)
    if "symbols" in kb:
        texts["symbols.txt"] = [r[0] for r in order(kb["symbols"], "symbol")]
    done = {name: "\n".join(lines) + "\n" for name, lines in texts.items()}
    last = max((int(r[0]) for r in rows if r[-1] != ANNOTATIONS[-1]), default=0)
    md5 = {f"md5_{name.rsplit('.', 1)[0]}": hashlib.md5(text.encode()).hexdigest() for name, text in done.items()}
    done["MANIFEST.tsv"] = "".join(f"{k}\t{v}\n" for k, v in {"species": species, **counts, "nlr1": last, **md5}.items())
    jvm = spark.sparkContext._jvm
    for name, text in done.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


_named: dict[str, str] = {}


def register_knowledge_base(name: str, folder: str) -> None:
    """Give a folder a name; it is read when ``named_knowledge_base`` first asks for it."""
    _named[name] = folder


def named_knowledge_base(spark: SparkSession, name: str) -> dict:
    if name == "retail":
        return knowledge_base(spark)
    if name not in _named:
        raise KeyError(f"no knowledge base is named {name!r}; known: {', '.join(sorted(['retail', *_named]))}")
    return load_knowledge_base(spark, _named[name])


def study_of(values: DataFrame, meta: DataFrame, kb: dict | None = None, group_by: str = "grp", coordinates: DataFrame | None = None, ratio: float | None = None, tol: float | None = None) -> Study:
    """A study from the user's own tables: ``values`` (cell, gene, value), ``meta`` (cell,
    ``group_by`` and, if there are several, samples), and places (cell, x, y) with the
    factors that turn their units into distances.

    Zeros need not be given. Every cell of ``values`` must be in ``meta`` once and have a
    group, which may not be "0"; values may be neither negative nor missing."""
    lost = {"cell", "gene", "value"} - set(values.columns) | {"cell", group_by} - set(meta.columns)
    if lost:
        raise ValueError(f"columns are missing: {', '.join(sorted(lost))}")
    sample = next((c for c in ("sample", "samples") if c in meta.columns), None)
    cells = meta.select("cell", F.col(group_by).alias("grp"), (F.col(sample) if sample else F.lit("sample1")).alias("sample"))
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell").alias("own"), F.count_if(F.col("grp").isNull()).alias("without"), F.count_if(F.col("grp").cast("string") == "0").alias("zero")).first()
    if found["n"] != found["own"]:
        raise ValueError("cells occur more than once, or without an id, in the metadata")
    if found["without"]:
        raise ValueError(f"{found['without']} cells have no group")
    if found["zero"]:
        raise ValueError('a group cannot be named "0"')
    wrong = values.filter(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0)).limit(1).count()
    if wrong:
        raise ValueError("values may be neither missing nor negative")
    if not values.join(cells, "cell", "left_anti").isEmpty():
        raise ValueError("a cell has values but no metadata")
    parameters = {"mode": "single", "spatial": coordinates is not None}
    if coordinates is not None:
        if ratio is None or tol is None:
            raise ValueError("places need the factors ratio and tol")
        if not {"cell", "x", "y"} <= set(coordinates.columns):
            raise ValueError("places need two coordinates, x and y")
        cells = cells.join(coordinates.select("cell", "x", "y"), "cell", "left")
        parameters |= {"ratio": ratio, "tol": tol}
    return Study(values.select("cell", "gene", F.col("value").cast("double").alias("value")), cells, **{k: (kb or {}).get(k) for k in ("lr", "complexes", "cofactors")}, parameters=parameters)


def add_meta(study: Study, more: DataFrame) -> Study:
    """``more`` (cell, any columns) beside the cells; columns of the same name give way."""
    kept = [c for c in study.cells.columns if c == "cell" or c not in more.columns]
    return study.with_(cells=study.cells.select(*kept).join(more.dropDuplicates(["cell"]), "cell", "left"))


def add_reduction(study: Study, places: DataFrame, name: str) -> Study:
    """An embedding (cell, dims array<double>) under a name."""
    unknown = places.join(study.cells, "cell", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("the embedding has cells that the study has not")
    held = {**study.parameters.get("reductions", {}), name: places.select("cell", "dims")}
    return study.with_(parameters={**study.parameters, "reductions": held})


def update_study(study: Study) -> Study:
    """A study of an older layout in today's: cells without samples are one sample, and
    earlier names of columns get their present ones."""
    older = {"barcode": "cell", "cell_id": "cell", "idents": "grp", "labels": "grp", "samples": "sample", "symbol": "gene", "x_cent": "x", "y_cent": "y"}

    def renamed(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        return df.withColumnsRenamed({a: b for a, b in older.items() if a in df.columns and b not in df.columns})

    cells, expr = renamed(study.cells), renamed(study.expr)
    if "sample" not in cells.columns:
        cells = cells.withColumn("sample", F.lit("sample1"))
    return study.with_(cells=cells, expr=expr, parameters={"mode": "single", **study.parameters})


def retail(spark: SparkSession, sf_dir: str) -> Study:
    """Customers as cells, market segments as groups, quantities by brand as values."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    sold = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    expr = sold.groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    cells = read("customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") % 2).cast("int").alias("sample"))
    cells = cells.join(read("orders").select(F.col("o_custkey").alias("cell")), "cell", "left_semi")
    return Study(expr, cells, **knowledge_base(spark))


def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, grp, sample, x, y) from vectors: label as group, two components as place."""
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000, 3)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cell"), F.col("label").alias("grp"), (F.col("vec_id") % 2).cast("int").alias("sample"), at(1).alias("x"), at(2).alias("y"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, grp, sample, x, y) of customers: their balance by their nation."""
    read = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return read.select(
        F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") % 2).cast("int").alias("sample"),
        F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 400).cast("double").alias("y"),
    )
