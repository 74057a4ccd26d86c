"""Queries and SQL of the general problems (skewed keys, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import eager, references
from corvane.session import materialize, table


def _totals(spark: SparkSession, sf_dir: str, count_sources: bool = True) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return eager.edge_key_totals(
        t("edges"),
        t("manifest").select("file").unionByName(t("shared_files").select("file")),
        t("symbols").select("symbol").unionByName(t("shared_symbols").select("symbol")),
        count_sources,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.heavy_keys(materialize(_totals(spark, sf_dir, count_sources=False), "edge-key-totals"))


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    files, symbols = references.record_lives(t("manifest"), t("shared_files"), t("symbols"), t("shared_symbols"))
    return references.find_orphans(t("edges"), files, symbols)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("edge_id", "ref_field", "reason")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals, "p6_found": p6_found, "p6_report": p6_report}

_PATH = r"regexp_replace(translate({0}, '\', '/'), '^\./', '')"
_EDGES = f"""d AS (
  SELECT {_PATH.format('source_file')} AS source_file, source_symbol, {_PATH.format('target_file')} AS target_file,
         target_symbol, edge_type, count(*) AS n_rows
  FROM edges GROUP BY ALL)"""
_KEYS = f"""{_EDGES}, k AS (
  SELECT 'target_file' AS field, target_file AS key_value, source_file, n_rows FROM d
  UNION ALL SELECT 'target_symbol', target_symbol, source_file, n_rows FROM d)"""
_LIVES = f"""fl AS (
  SELECT {_PATH.format('file')} AS f, first_seen_at AS s, deleted_at AS e FROM manifest
  UNION ALL SELECT {_PATH.format('file')}, first_seen_at, deleted_at FROM shared_files),
sl AS (
  SELECT {_PATH.format('file')} AS f, symbol AS y, defined_at AS s, removed_at AS e FROM symbols
  UNION ALL SELECT {_PATH.format('file')}, symbol, defined_at, removed_at FROM shared_symbols),
ed AS (SELECT edge_id, {_PATH.format('source_file')} AS sf, {_PATH.format('target_file')} AS tf, target_symbol AS y,
         edge_type, extracted_at AS t FROM edges),
fr AS (SELECT edge_id, 'source_file' AS ref_field, sf AS f, t FROM ed WHERE sf NOT IN ('', '_external_')
  UNION ALL SELECT edge_id, 'target_file', tf, t FROM ed WHERE tf NOT IN ('', '_external_')),
fj AS (SELECT edge_id, ref_field, fr.f, any_value(t) AS t, count(fl.f) AS n,
         coalesce(bool_or(s <= t AND (e IS NULL OR t < e)), false) AS alive, coalesce(bool_or(e <= t), false) AS ended
  FROM fr LEFT JOIN fl ON fr.f = fl.f GROUP BY edge_id, ref_field, fr.f),
sr AS (SELECT ed.edge_id, ed.tf AS f, ed.y, ed.t FROM ed JOIN fj ON fj.edge_id = ed.edge_id AND fj.ref_field = 'target_file' AND alive
  WHERE ed.y IS NOT NULL AND ed.edge_type IS DISTINCT FROM 'imports'),
sj AS (SELECT edge_id, any_value(t) AS t, count(sl.f) AS n,
         coalesce(bool_or(s <= t AND (e IS NULL OR t < e)), false) AS alive, coalesce(bool_or(e <= t), false) AS ended
  FROM sr LEFT JOIN sl ON sr.f = sl.f AND sr.y = sl.y GROUP BY edge_id),
o AS (SELECT edge_id, ref_field, t, n, alive, ended FROM fj UNION ALL SELECT edge_id, 'target_symbol', t, n, alive, ended FROM sj),
orphans AS (SELECT edge_id, ref_field, t, CASE WHEN n = 0 THEN 'missing' WHEN ended THEN 'deleted' ELSE 'late' END AS reason
  FROM o WHERE NOT alive)"""

SQL = {
    "p1_found": f"""WITH {_KEYS} SELECT field, key_value FROM k WHERE key_value <> '' GROUP BY field, key_value
        HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM d)""",
    "p1_totals": f"""WITH {_KEYS}, r AS (
          SELECT 'target_file' AS field, {_PATH.format('file')} AS key_value FROM manifest
          UNION ALL SELECT 'target_file', {_PATH.format('file')} FROM shared_files
          UNION ALL SELECT 'target_symbol', symbol FROM symbols UNION ALL SELECT 'target_symbol', symbol FROM shared_symbols),
        rn AS (SELECT field, key_value, count(*) AS n_records FROM r GROUP BY ALL),
        kn AS (SELECT field, key_value, sum(n_rows)::BIGINT AS n_rows, count(*) AS n_edges, count(DISTINCT source_file) AS n_sources
          FROM k GROUP BY ALL)
        SELECT kn.field, kn.key_value, n_rows, n_edges, n_sources, coalesce(n_records, 0) AS n_records,
               n_edges * coalesce(n_records, 0) AS n_pairs
        FROM kn LEFT JOIN rn ON kn.field = rn.field AND kn.key_value = rn.key_value""",
    "p6_found": f"WITH {_LIVES} SELECT edge_id, ref_field, reason FROM orphans",
    "p6_report": f"""WITH {_LIVES} SELECT ref_field, reason, strftime(t, '%Y-%m') AS month, count(*) AS n
        FROM orphans GROUP BY ALL""",
}
