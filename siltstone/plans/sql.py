"""The same rows in DuckDB's SQL: shared parts."""

#: Documents as files: the language decides the extension.
FILES = """files AS (
  SELECT doc_id, source, lang, text, source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.GZ' WHEN 'fr' THEN '.jpg' ELSE '' END AS path,
         CAST(420 AS BIGINT) AS mode, doc_id * 1000000000 AS mtime_ns, CAST(strlen(text) AS BIGINT) AS size FROM documents)"""

#: Two snapshots of these files: one without Spanish, one without French and with changes by source.
SNAPSHOTS = (
    FILES
    + """, base AS (SELECT path, source, mode, mtime_ns, size, text FROM files WHERE lang <> 'es'),
cur AS (SELECT path, source, CASE WHEN source = 'src1' THEN CAST(384 AS BIGINT) ELSE mode END AS mode, CASE WHEN source = 'src2' THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns,
  CASE WHEN source = 'src3' THEN size + 1 ELSE size END AS size, CASE WHEN source = 'src3' THEN text || '!' ELSE text END AS text FROM files WHERE lang <> 'fr')"""
)

#: Events as names: clicks and views are bit streams, the rest snapshots.
METADATA = """metadata AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'bits-' ELSE 'backup-' END || event_type || '@' || strftime(ts, '%Y%m%d%H%M%S') AS name, min(ts) AS created FROM events GROUP BY 1)"""


def chunks(bits: int) -> str:
    """Chunks of all documents, closed form: candidates from sums over 64 bytes, then a fold that keeps cuts 512 apart."""
    mask = (1 << bits) - 1
    return f"""d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 AS i FROM d),
y AS (SELECT doc_id, i, CAST('0x' || b AS BIGINT) AS v FROM x),
w AS (SELECT doc_id, i, sum(v) OVER s AS total, sum(v * i) OVER s AS placed FROM y WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
c AS (SELECT doc_id, list([i + 1] ORDER BY i) AS ends, count(*) AS n_candidates FROM w WHERE i >= 511 AND (CAST(124992 + (i + 1) * total - placed AS BIGINT) & {mask}) = {mask} GROUP BY doc_id),
f AS (SELECT d.doc_id, h, n, list_reduce(list_concat([[CAST(0 AS BIGINT)]], coalesce(ends, [])), lambda a, e: CASE WHEN e[1] - a[len(a)] >= 512 THEN list_concat(a, e) ELSE a END) AS cuts
      FROM d LEFT JOIN c USING (doc_id) WHERE n > 0),
g AS (SELECT doc_id, h, CASE WHEN cuts[len(cuts)] < n THEN list_concat(cuts, [n]) ELSE cuts END AS cuts FROM f),
chunks AS (SELECT doc_id, h, seq, cuts[seq + 1] AS "offset", cuts[seq + 2] - cuts[seq + 1] AS length FROM (SELECT doc_id, h, cuts, unnest(range(len(cuts) - 1)) AS seq FROM g))"""


def varint_length(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {1 << (7 * k - 1)} THEN {k}" for k in range(1, 10)) + " ELSE 10 END"


def format_bytes(n: str) -> str:
    return f"""CASE WHEN {n} >= {1 << 40} THEN printf('%.2f TiB', {n} / {float(1 << 40)!r}::DOUBLE) WHEN {n} >= {1 << 30} THEN printf('%.2f GiB', {n} / {float(1 << 30)!r}::DOUBLE)
      WHEN {n} > {1 << 20} THEN printf('%.2f MiB', {n} / {float(1 << 20)!r}::DOUBLE) WHEN {n} > 1024 THEN printf('%.2f kiB', {n} / 1024.0::DOUBLE) ELSE printf('%d B', CAST({n} AS BIGINT)) END"""
