"""Data sources and batches of edits to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.operators import associations, edit_log
from kinefuse.workloads.registry import query, table
from kinefuse.workloads.standins import SQL_DATA_SOURCES, SQL_ROADS, data_sources, roads, with_sql

_SHOWN = ("path", "association_type", "associated_element_id")

# Orders as edits: the customer number names the source, the order number gives the sequence.
_PATH = "concat('Supplier#', lpad(CAST(o_custkey AS STRING), 9, '0'))"
_SQL_EDITS = """
edits AS (
  SELECT 'Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS path, o_orderkey AS seq,
         CAST(o_orderkey % 25 AS VARCHAR) AS element_id,
         CASE o_orderstatus WHEN 'O' THEN 'GLOBAL' WHEN 'F' THEN 'LOCAL' END AS new_type
  FROM orders
)"""


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.expr(_PATH).alias("path"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") % 25).cast("string").alias("element_id"),
        F.when(status == "O", "global").when(status == "F", "Local").otherwise("somewhere").alias("new_type"),
    )


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS)
    + """
SELECT path, CASE WHEN n IS NULL THEN association_type
                  WHEN (association_type = 'GLOBAL') = (n % 2 = 0) THEN 'GLOBAL' ELSE 'LOCAL' END AS association_type,
       CASE WHEN n IS NULL THEN associated_element_id END AS associated_element_id
FROM data_sources LEFT JOIN (SELECT path, count(*) AS n FROM edits GROUP BY path) USING (path)"""
)
def toggle_association(spark: SparkSession, folder: str) -> DataFrame:
    """Sources after many toggles each."""
    return associations.toggle_association(data_sources(spark, folder), _edits(spark, folder)).select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS)
    + """
SELECT path, coalesce(last_type, association_type) AS association_type,
       CASE WHEN last_type IS NULL THEN associated_element_id END AS associated_element_id
FROM data_sources LEFT JOIN (SELECT path, arg_max(new_type, seq) AS last_type FROM edits WHERE new_type IS NOT NULL GROUP BY path) USING (path)"""
)
def set_association(spark: SparkSession, folder: str) -> DataFrame:
    """Sources after their types were set; unknown types are ignored."""
    return associations.set_association(data_sources(spark, folder), _edits(spark, folder)).select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS)
    + """
SELECT path, CASE WHEN associated_element_id IS NULL AND first_element IS NOT NULL THEN 'LOCAL' ELSE association_type END AS association_type,
       coalesce(associated_element_id, first_element) AS associated_element_id
FROM data_sources LEFT JOIN (SELECT path, arg_min(element_id, seq) AS first_element FROM edits GROUP BY path) USING (path)"""
)
def associate_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Free sources take the first element asked for; others keep theirs."""
    return associations.associate_batch(data_sources(spark, folder), _edits(spark, folder)).select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES)
    + """
SELECT path, association_type, associated_element_id FROM data_sources
WHERE associated_element_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)"""
)
def element_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources on the elements of one region."""
    elements = table(spark, folder, "nation").filter("n_regionkey = 1").select(
        F.col("n_nationkey").cast("string").alias("element_id")
    )
    return associations.element_sources(data_sources(spark, folder), elements).select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES)
    + """
SELECT path, association_type, associated_element_id FROM data_sources
WHERE association_type = 'LOCAL' AND (associated_element_id IS NULL OR associated_element_id = '7')"""
)
def available_sources(spark: SparkSession, folder: str) -> DataFrame:
    """LOCAL sources free for one element, or already on it."""
    return associations.available_sources(data_sources(spark, folder), "7").select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES, SQL_ROADS)
    + """
SELECT (SELECT count(*) FROM roads) AS node_count,
       (SELECT count(*) FROM data_sources WHERE association_type = 'LOCAL' AND associated_element_id IS NULL) AS open_local_sources,
       (SELECT count(*) FROM roads) > 0 AND NOT EXISTS
         (SELECT 1 FROM data_sources WHERE association_type = 'LOCAL' AND associated_element_id IS NULL) AS is_ready"""
)
def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the dataset may be made."""
    return associations.readiness(roads(spark, folder), data_sources(spark, folder))


@query(
    with_sql(_SQL_EDITS)
    + "\nSELECT path, min(seq) AS seq, arg_min(element_id, seq) AS element_id FROM edits GROUP BY path"
)
def dedupe_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per path, the first one."""
    return associations.dedupe_sources(_edits(spark, folder).select("path", "seq", "element_id"))


# Edited elements are the nations of two regions; wishes come from the edits that name them.
_SQL_WISHES = """
edited AS (SELECT CAST(n_nationkey AS VARCHAR) AS element_id FROM nation WHERE n_regionkey IN (0, 2)),
wishes AS (SELECT path, element_id, seq FROM edits WHERE element_id IN (SELECT element_id FROM edited)
             AND path IN (SELECT path FROM data_sources))"""


def _wishes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements = table(spark, folder, "nation").filter("n_regionkey IN (0, 2)").select(
        F.col("n_nationkey").cast("string").alias("element_id")
    )
    sources = data_sources(spark, folder)
    edits = _edits(spark, folder).select("path", "element_id", "seq")
    wishes = edits.join(elements, "element_id", "left_semi").join(sources, "path", "left_semi")
    return sources, elements, wishes


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS, _SQL_WISHES)
    + """
, present AS (SELECT associated_element_id AS element_id, path FROM data_sources
             WHERE associated_element_id IN (SELECT element_id FROM edited))
SELECT element_id, path, 'add' AS change FROM (SELECT DISTINCT element_id, path FROM wishes EXCEPT SELECT element_id, path FROM present)
UNION ALL
SELECT element_id, path, 'remove' FROM (SELECT element_id, path FROM present EXCEPT SELECT element_id, path FROM wishes)"""
)
def assignment_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What saving the edited elements adds and removes."""
    return associations.assignment_diff(*_wishes(spark, folder)).select("element_id", "path", "change")


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS, _SQL_WISHES)
    + """
SELECT path, CASE WHEN last_wish IS NOT NULL AND NOT (n = 1 AND last_wish IS NOT DISTINCT FROM associated_element_id)
                  THEN 'LOCAL' ELSE association_type END AS association_type,
       CASE WHEN last_wish IS NOT NULL THEN last_wish
            WHEN associated_element_id NOT IN (SELECT element_id FROM edited) THEN associated_element_id END AS associated_element_id
FROM data_sources LEFT JOIN (SELECT path, arg_max(element_id, seq) AS last_wish, count(DISTINCT element_id) AS n
                             FROM wishes GROUP BY path) USING (path)"""
)
def assignment_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Sources after the edited elements were saved."""
    return associations.apply_assignments(*_wishes(spark, folder)).select(*_SHOWN)


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_EDITS)
    + """
SELECT path, association_type, associated_element_id FROM data_sources
WHERE path NOT IN (SELECT path FROM edits WHERE new_type IS NULL)"""
)
def delete_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without those an edit of unknown type names."""
    deleted = _edits(spark, folder).filter("new_type = 'somewhere'")
    return associations.delete_sources(data_sources(spark, folder), deleted).select(*_SHOWN)


# Orders as one log of all kinds of edits. A save names the source of its customer and that of the next one.
_EDITED = "concat('Supplier#', lpad(CAST({0} AS STRING), 9, '0'))"
_SQL_LOG = """
log AS (
  SELECT 'Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS path, 'Supplier#' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0') AS other,
         o_orderkey AS seq, CAST(o_orderkey % 25 AS VARCHAR) AS element_id,
         CASE o_orderstatus WHEN 'O' THEN 'GLOBAL' WHEN 'F' THEN 'LOCAL' END AS new_type,
         CASE WHEN o_orderkey % 48 = 6 THEN 'save' WHEN o_orderkey % 24 = 7 THEN 'delete' WHEN o_orderkey % 8 < 2 THEN 'toggle'
              WHEN o_orderkey % 8 = 2 THEN 'set' WHEN o_orderkey % 8 < 6 THEN 'request' ELSE 'add' END AS kind
  FROM orders
),
named AS (SELECT path FROM data_sources UNION SELECT path FROM log WHERE kind = 'add' AND path <= 'Supplier#000000120'),
ev AS (
  SELECT l.path, seq, kind, element_id, new_type, FALSE AS is_named FROM log l JOIN named USING (path) WHERE kind <> 'save'
  UNION ALL SELECT n.path, seq, kind, element_id, NULL, n.path IN (l.path, l.other) FROM log l, named n WHERE kind = 'save'
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS k FROM ev)"""


@query(
    with_sql(SQL_DATA_SOURCES, _SQL_LOG).replace("WITH", "WITH RECURSIVE", 1)
    + """,
state AS (
  SELECT n.path, CAST(0 AS BIGINT) AS k, d.path IS NOT NULL AS there, association_type AS t, associated_element_id AS e
  FROM named n LEFT JOIN data_sources d USING (path)
  UNION ALL
  SELECT s.path, v.k,
    CASE WHEN s.there THEN kind <> 'delete' ELSE kind = 'add' END,
    CASE WHEN NOT s.there THEN CASE WHEN kind = 'add' THEN coalesce(new_type, 'UNASSOCIATED') END
         WHEN kind = 'delete' THEN NULL
         WHEN kind = 'toggle' THEN CASE WHEN t = 'GLOBAL' THEN 'LOCAL' ELSE 'GLOBAL' END
         WHEN kind = 'set' THEN coalesce(new_type, t)
         WHEN kind = 'request' AND e IS NULL THEN 'LOCAL'
         WHEN kind = 'save' AND is_named AND e IS DISTINCT FROM element_id THEN 'LOCAL' ELSE t END,
    CASE WHEN NOT s.there OR kind IN ('delete', 'toggle') THEN NULL
         WHEN kind = 'set' THEN CASE WHEN new_type IS NULL THEN e END
         WHEN kind = 'request' THEN coalesce(e, element_id)
         WHEN kind = 'save' THEN CASE WHEN is_named THEN element_id WHEN e <> element_id THEN e END
         ELSE e END
  FROM state s JOIN numbered v ON v.path = s.path AND v.k = s.k + 1
)
SELECT path, t AS association_type, e AS associated_element_id
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k DESC) AS last FROM state) WHERE last = 1 AND there"""
)
def edit_log_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Sources after one log of adds, deletes, toggles, types, requests and saves."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = (
        F.when(key % 48 == 6, "save").when(key % 24 == 7, "delete").when(key % 8 < 2, "toggle").when(key % 8 == 2, "set").when(key % 8 < 6, "request").otherwise("add")
    )
    path, other = F.expr(_EDITED.format("o_custkey")), F.expr(_EDITED.format("o_custkey + 1"))
    log = table(spark, folder, "orders").select(
        path.alias("path"),
        key.alias("seq"),
        kind.alias("kind"),
        (key % 25).cast("string").alias("element_id"),
        F.when(status == "O", "global").when(status == "F", "Local").otherwise("somewhere").alias("new_type"),
        F.when(kind == "save", F.array(path, other)).alias("paths"),
    )
    # Only the first few of the added sources; the others are edited like any name that is no source.
    sources = data_sources(spark, folder)
    known = log.where((F.col("kind") != "add") | (F.col("path") <= "Supplier#000000120"))
    return edit_log.apply_edits(sources, known).select(*_SHOWN)
