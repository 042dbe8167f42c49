"""Views of the domain over the driver's tables, as SQL that Spark and DuckDB both read.

``with_views(sql)`` puts the views that a statement names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Our own models and prices; some event models match a price in part only, one not at all.
PRICES = [
    (0, "alder-large", 5.0, 15.0),
    (1, "alder", 0.5, 1.5),
    (2, "birch-7b", 0.1, 0.2),
    (3, "cedar-instruct", 1.0, 3.0),
    (4, "dogwood", 0.0, 0.4),
    (5, "elm-mini", 0.15, 0.6),
]
MODELS = ["alder-large", "alder", "birch-7b", "birch", "cedar-instruct_batch", "dogwood-v2", "elm-mini", "fir", "alder-large-2"]
ALIASES = [("birch", "birch-7b"), ("dogwood-v2", "dogwood")]
DATASETS = ["AIME", "ArcMMLU", "Ethics_justice", "GeoGraphyData", "SuperGLUE", "WMT19", "ChessInstruct_mcq", "GSM8K"]


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "'" + v + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _case(of: str, names: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


VIEWS = {
    "prices": _values(PRICES, "pos, model, in_price, out_price"),
    "registry": _values([(n,) for n in ["alder-large", "alder", "birch-7b", "cedar-instruct_batch", "dogwood", "elm-mini"]], "model"),
    "aliases": _values(ALIASES, "alias, model"),
    "predictions": f"""SELECT event_id AS pos, concat('router', CAST(user_id % 12 AS VARCHAR(9))) AS router,
        concat({_case('event_id % 8', DATASETS)}, '_', CAST(event_id AS VARCHAR(19))) AS global_index,
        {_case(f'user_id % {len(MODELS)}', MODELS)} AS model, event_type <> 'error' AS success,
        CAST(floor(value * 10) AS BIGINT) AS in_tok, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS out_tok,
        CASE event_type WHEN 'purchase' THEN CAST(1.0 AS DOUBLE) WHEN 'click' THEN CAST(0.0 AS DOUBLE) WHEN 'signup' THEN CAST(0.5 AS DOUBLE) END AS accuracy
        FROM events""",
    "cache": f"""SELECT event_id AS pos, {_case(f'user_id % {len(MODELS)}', MODELS)} AS model, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        event_type <> 'error' AS success, CASE WHEN event_type = 'purchase' THEN value END AS score, value FROM events""",
    "answers": r"""SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
        chr(CAST(65 + l_linenumber AS INT)) AS truth,
        CASE CAST(l_orderkey % 6 AS INT) WHEN 0 THEN concat('so \boxed{', chr(CAST(65 + l_partkey % 7 AS INT)), '} it is')
          WHEN 1 THEN concat('Answer: ', chr(CAST(65 + l_suppkey % 7 AS INT)), ' because') WHEN 2 THEN concat('we choose option ', chr(CAST(65 + l_linenumber AS INT)))
          WHEN 3 THEN concat('perhaps it is ', chr(CAST(65 + l_linenumber AS INT))) WHEN 4 THEN concat('the answer: ', chr(CAST(97 + l_linenumber AS INT)))
          ELSE 'no idea at all' END AS text FROM lineitem""",
    "pairs": "SELECT d.doc_id, d.text AS text, b.text AS truth FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names, and those that they name, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    sql = sql.strip()
    if not need:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head} {sql}"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])])
    sql = VIEWS[name].replace("\\", "\\\\")
    return spark.sql(sql)
