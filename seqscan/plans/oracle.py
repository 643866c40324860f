"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

from seqscan.functions import residues
from seqscan.plans.config import SearchConfig

ALPHABET = residues.ALPHABET


def letters(column: str) -> str:
    return f"upper(regexp_replace({column}, '[^A-Za-z]', '', 'g'))"


def code(character: str) -> str:
    return f"coalesce(nullif(instr('{ALPHABET}', {character}), 0) - 1, 20)"


def bucket(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} <= {b} THEN {i}" for i, b in enumerate(residues.BOUNDS)) + " END"


BOUNDS = "(SELECT unnest(range(36))::INTEGER AS length_partition, unnest([" + ", ".join(map(str, residues.BOUNDS)) + "])::INTEGER AS upper_bound)"


def db(table: str, key: str, text: str) -> str:
    """The subjects of a table: ordinal, header, sequence, length, ref_id, length_partition."""
    return f"""
    SELECT *, ({bucket("length")})::INTEGER AS length_partition FROM (
      SELECT *, (row_number() OVER (ORDER BY length, ordinal) - 1)::INTEGER AS ref_id FROM (
        SELECT {key} AS ordinal, {key}::VARCHAR AS header, {letters(text)} AS sequence, length({letters(text)})::INTEGER AS length FROM {table}))"""


def matrix_list(name: str) -> str:
    return "[" + ", ".join(str(int(x)) for x in residues.matrix(name).ravel()) + "]"


def scores(pairs: str, config: SearchConfig = SearchConfig()) -> str:
    """CTEs that end in `scores` (q, s, score) for the distinct pairs (q, s) that `pairs` selects.

    The recurrence goes by antidiagonals: a row is a cell (i, d - i) with what the two diagonals before it left.
    """
    gop, gex = config.gaps
    return f"""
pairs AS (SELECT DISTINCT q, s FROM ({pairs})),
step AS (
  SELECT q, s, i, 1 AS d, 0 AS h, 0 AS h1, -10000 AS e, -10000 AS f FROM (SELECT q, s, unnest(range(1, length(q) + 1)) AS i FROM pairs WHERE q <> '' AND s <> '')
  UNION ALL
  SELECT q, s, i, d + 1,
    CASE WHEN d + 1 - i BETWEEN 1 AND length(s) THEN greatest(0, coalesce(lag(h1) OVER w, 0) + ({matrix_list(config.matrix)})[21 * ({code("substr(q, i::INTEGER, 1)")}) + ({code("substr(s, (d + 1 - i)::INTEGER, 1)")}) + 1],
      e + {gex}, h + {gop}, coalesce(lag(f) OVER w, -10000) + {gex}, coalesce(lag(h) OVER w, 0) + {gop}) ELSE 0 END,
    h, greatest(e + {gex}, h + {gop}), greatest(coalesce(lag(f) OVER w, -10000) + {gex}, coalesce(lag(h) OVER w, 0) + {gop})
  FROM step WHERE d < length(q) + length(s) WINDOW w AS (PARTITION BY q, s ORDER BY i)),
scores AS (SELECT p.q, p.s, coalesce(max(h), 0)::INTEGER AS score FROM pairs p LEFT JOIN step ON step.q = p.q AND step.s = p.s GROUP BY p.q, p.s)"""


QUERIES_SQL = "SELECT n_nationkey::BIGINT AS query_num, n_name AS header, " + letters("n_name") + " AS sequence FROM nation"


def hits(config: SearchConfig, queries: str = QUERIES_SQL, subjects: str | None = None) -> str:
    """`hits` with the eight result columns, after WITH RECURSIVE."""
    subjects = subjects or db("part", "p_partkey", "p_name")
    return f"""
queries AS ({queries}),
db AS ({subjects}),
{scores("SELECT queries.sequence AS q, db.sequence AS s FROM queries, db", config)},
ranked AS (
  SELECT query_num, length(queries.sequence)::INTEGER AS query_length, queries.header AS query_header, score, db.length AS reference_length, db.header AS reference_header, ref_id,
         (row_number() OVER (PARTITION BY query_num ORDER BY score DESC, ref_id) - 1)::INTEGER AS result_num
  FROM queries CROSS JOIN db JOIN scores ON q = queries.sequence AND s = db.sequence),
hits AS (SELECT query_num, query_length, query_header, result_num, score, reference_length, reference_header, ref_id FROM ranked WHERE result_num < {config.top})"""


def hits_by_rows(config: SearchConfig, queries: str, subjects: str) -> str:
    """`hits` as above, for few short queries and long subjects: a step for each query residue, all positions at once.

    Gaps along a subject are a running maximum, which needs that opening a gap costs no less than extending one.
    """
    gop, gex = config.gaps
    left = "PARTITION BY query_num, ref_id ORDER BY j"
    scored = f"coalesce(lag(h) OVER ({left}), 0) + ({matrix_list(config.matrix)})[21 * qc + sc + 1]"
    return f"""
queries AS ({queries}),
db AS ({subjects}),
letters AS (SELECT ref_id, j, {code("substr(sequence, j::INTEGER, 1)")} AS sc FROM (SELECT ref_id, sequence, unnest(range(1, length(sequence) + 1)) AS j FROM db)),
asked AS (SELECT query_num, i, {code("substr(sequence, i::INTEGER, 1)")} AS qc FROM (SELECT query_num, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM queries)),
rows AS (
  SELECT query_num, ref_id, j, sc, 0::BIGINT AS i, 0 AS h, -10000 AS f, 0 AS best FROM letters, queries
  UNION ALL
  SELECT query_num, ref_id, j, sc, i, h, f, greatest(best, h) FROM (
    SELECT *, greatest(t, coalesce(max(t - {gex} * j) OVER (PARTITION BY query_num, ref_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gop - gex} + {gex} * j, -10000))::INTEGER AS h FROM (
      SELECT query_num, ref_id, j, sc, i, best, greatest(f + {gex}, h + {gop}) AS f, greatest(0, f + {gex}, h + {gop}, {scored}) AS t
      FROM (SELECT rows.query_num, rows.ref_id, j, sc, asked.i, h, f, best, qc FROM rows JOIN asked ON asked.query_num = rows.query_num AND asked.i = rows.i + 1)))),
scores AS (SELECT query_num, ref_id, max(best)::INTEGER AS score FROM rows GROUP BY ALL),
ranked AS (
  SELECT query_num, length(queries.sequence)::INTEGER AS query_length, queries.header AS query_header, coalesce(score, 0) AS score, db.length AS reference_length, db.header AS reference_header, ref_id,
         (row_number() OVER (PARTITION BY query_num ORDER BY coalesce(score, 0) DESC, ref_id) - 1)::INTEGER AS result_num
  FROM queries CROSS JOIN db LEFT JOIN scores USING (query_num, ref_id)),
hits AS (SELECT query_num, query_length, query_header, result_num, score, reference_length, reference_header, ref_id FROM ranked WHERE result_num < {config.top})"""
