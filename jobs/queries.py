"""The jobs as queries: each runs its job twice on a whole table, into a new shared folder, and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import changes, health
from jobs.common import read_config
from tessera.plans.queries import query
from tessera.plans.tables import shared_folder


def _new_folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/jobs/{label}-{uuid.uuid4().hex}"


def _documents(sf_dir: str) -> str:
    """The table as a pattern, which a file stream takes whether it is a file or a folder."""
    return f"{sf_dir}/documents.parque[t]"


HEALTH = r"""
WITH f AS (SELECT concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text FROM documents),
i AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END AS area, text, (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines,
  strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM f),
l AS (SELECT path, area, ls[n] AS content, n::INTEGER AS line FROM (SELECT path, area, ls, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT path, area, string_split(text, chr(10)) AS ls FROM i))),
r(path, type, severity, kritik, detail, line, priority, area) AS (
  SELECT path, 'buyuk_dosya', 'orta', false, lines || ' lines', NULL, 47, area FROM i WHERE lines > 200
  UNION ALL SELECT path, 'security_hardcoded_secret', 'yuksek', true, n || ' times', NULL, 1061, area FROM (SELECT path, area, len(regexp_extract_all(text, '(password|secret|token|key)\s*=\s*["'']')) AS n FROM i) WHERE n > 0
  UNION ALL SELECT path, 'fix_tag', 'dusuk', false, upper(regexp_extract(content, '(?i)(licensed|released|token|todo|fixme|hack)', 1)) || ': ' || substr(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 200), line, 21, area
    FROM l WHERE regexp_matches(content, '(?i)(licensed|released|token|todo|fixme|hack)')
  UNION ALL SELECT path, 'copy', 'orta', false, 'of ' || first, NULL, 41, area FROM (SELECT path, area, min(path) OVER (PARTITION BY sha256) AS first FROM i WHERE size > 0) WHERE path > first),
s AS (SELECT area, count(*) AS files, sum(lines)::BIGINT AS lines FROM i GROUP BY area),
c AS (SELECT area, count(*) AS findings, count(*) FILTER (kritik) AS critical FROM r GROUP BY area)
SELECT path, type, severity, kritik, detail, line, priority, area, NULL::INTEGER AS lines, NULL::BIGINT AS size, NULL AS sha256 FROM r
UNION ALL SELECT NULL, 'summary', NULL, false, s.files || ' files, ' || s.lines || ' lines, ' || coalesce(findings, 0) || ' findings, ' || coalesce(critical, 0) || ' critical', NULL, 0, s.area, NULL, NULL, NULL FROM s LEFT JOIN c ON s.area = c.area
UNION ALL SELECT path, 'file', NULL, NULL, NULL, NULL, NULL, area, lines, size, sha256 FROM i"""


@query(HEALTH)
def job1_health(spark, sf_dir):
    """The job jobs/health.py: large files, tagged lines, secrets and copies, by area, and the inventory"""
    output, config = _new_folder(spark, "health"), read_config(spark, None, "health")
    for _ in range(2):
        health.run(spark, _documents(sf_dir), output, config)
    files, report = health.written(spark, output)
    return report.unionByName(files.drop("findings").withColumn("type", F.lit("file")), allowMissingColumns=True)


@query("""
WITH v AS (SELECT concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT path, sha256(text) AS sha256, strlen(text) AS size, (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines FROM v),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY sha256 DESC) = 1)
SELECT path, 'added' AS status, sha256, lines, CASE WHEN size > 0 AND path <> min(path) OVER (PARTITION BY sha256) THEN min(path) OVER (PARTITION BY sha256) END AS copy_of, 0::BIGINT AS batch FROM f""")
def job2_changes(spark, sf_dir):
    """The streaming job jobs/changes.py: all is new to the first run, and nothing to the second"""
    output, config = _new_folder(spark, "changes"), read_config(spark, None, "changes")
    for _ in range(2):
        changes.run(spark, _documents(sf_dir), f"{output}/out", f"{output}/checkpoint", config)
    return changes.written(spark, f"{output}/out")
