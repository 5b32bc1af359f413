"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.durable import scratch, written
from siltstone.functions import binary
from siltstone.model import INCOMPRESSIBLE
from siltstone.operators import chunking, metadata, parity, snapshots, store, verify
from siltstone.plans import sql
from siltstone.plans.registry import ORACLES, QUERIES
from siltstone.session import importable

BITS = 10
RS = {"n_data": 5, "hash_rate": 256}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".GZ").when(F.col("lang") == "fr", ".jpg").otherwise("")
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", "source", "lang", "text", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), extension).alias("path"), F.lit("file").alias("kind"),
        F.lit(420).cast("long").alias("mode"), (F.col("doc_id") * 1_000_000_000).alias("mtime_ns"), F.octet_length("text").cast("long").alias("size"),
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("lang <> 'es'")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("lang <> 'fr'").withColumns({
        "mode": F.when(F.col("source") == "src1", F.lit(384).cast("long")).otherwise(F.col("mode")),
        "mtime_ns": F.when(F.col("source") == "src2", F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")),
        "size": F.when(F.col("source") == "src3", F.col("size") + 1).otherwise(F.col("size")),
        "text": F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")),
    })


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("event_type").isin("click", "view"), metadata.BITS).otherwise(metadata.BACKUP)
    return read(spark, sf_dir, "events").groupBy(F.concat(prefix, metadata.stamped(F.col("event_type"), F.col("ts"))).alias("name")).agg(F.min("ts").alias("created"))


def digest(column: str = "text"):  # noqa: ANN201
    return F.sha2(F.col(column), 256)


def chunks(spark: SparkSession, sf_dir: str, payload: bool = True) -> DataFrame:
    return chunking.chunk(read(spark, sf_dir, "documents"), "doc_id", "text", BITS, payload)


# chunks


@query(f"""WITH {sql.chunks(BITS)}, u AS (SELECT substr(h, 2 * "offset" + 1, 2 * length) AS k, max(length) AS size, count(*) AS n FROM chunks GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS stored_bytes FROM u""")
def chunk_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the chunks of all documents take, all and distinct."""
    return store.dedup_report(chunks(spark, sf_dir).select(F.sha2("data", 256).alias("hash"), "length"))


@query(f"""WITH {sql.chunks(BITS)} SELECT doc_id, seq, "offset", length, sha256(unhex(substr(h, 2 * "offset" + 1, 2 * length))) AS hash FROM chunks""")
def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every document."""
    return chunks(spark, sf_dir).select("doc_id", "seq", "offset", "length", F.sha2("data", 256).alias("hash"))


@query(f"WITH {sql.chunks(BITS)} SELECT d.doc_id, coalesce(n_candidates, 0) AS n_candidates FROM d LEFT JOIN c USING (doc_id)")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where the rolling checksum allows a cut."""
    return chunking.count_candidates(read(spark, sf_dir, "documents"), "doc_id", "text", BITS)


@query("SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT sha256(text)) AS distinct_n FROM documents GROUP BY source")
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", digest().alias("hash"), F.octet_length("text").cast("long").alias("size"))
    by_hash = rows.groupBy("source", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return by_hash.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("distinct_n"))


@query("SELECT DISTINCT sha256(text) AS hash FROM documents")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_hashes(read(spark, sf_dir, "documents").select(digest().alias("hash")))


@query(f"WITH {sql.SNAPSHOTS} SELECT DISTINCT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS length FROM cur WHERE sha256(text) NOT IN (SELECT sha256(text) FROM base)")
def new_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second snapshot has to store."""
    now = current(spark, sf_dir).select(digest().alias("hash"), F.octet_length("text").cast("long").alias("length"))
    return store.new_chunks(now, base(spark, sf_dir).select(digest().alias("hash")))


@query(f"WITH {sql.SNAPSHOTS} SELECT path, sha256(text) AS hash FROM cur WHERE sha256(text) IN (SELECT sha256(text) FROM base)")
def existing_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.existing(current(spark, sf_dir).select("path", digest().alias("hash")), base(spark, sf_dir).select(digest().alias("hash"))).select("path", "hash")


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_index_entries(read(spark, sf_dir, "documents").select(digest().alias("hash")))


# packs

_RECORD = f"4 + ({sql.varint_length('n')}) + n"


@query(f"""WITH r AS (SELECT source, doc_id, n, {_RECORD} AS record FROM (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents))
SELECT source, doc_id, CAST(record AS BIGINT) AS record, CAST(coalesce(sum(record) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r""")
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's record would stand in its source's pack."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("length"))
    return store.running_offsets(rows, ["doc_id"], group=["source"]).drop("length")


@query(f"""WITH RECURSIVE r AS (SELECT source, doc_id, n, {_RECORD} AS record, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents)),
t AS (SELECT source, doc_id, k, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS "offset", CAST(record AS BIGINT) AS upto FROM r WHERE k = 1
UNION ALL SELECT r.source, r.doc_id, r.k, CASE WHEN t.upto + r.n + 16 > 65536 THEN t.pack + 1 ELSE t.pack END, CASE WHEN t.upto + r.n + 16 > 65536 THEN 0 ELSE t.upto END,
  CAST(CASE WHEN t.upto + r.n + 16 > 65536 THEN r.record ELSE t.upto + r.record END AS BIGINT) FROM t JOIN r ON r.source = t.source AND r.k = t.k + 1)
SELECT source, doc_id, pack, "offset" FROM t""")
def pack_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with packs of 64 KiB."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("length"))
    return store.assign_packs(rows, ["doc_id"], "source", 65536).select("source", "doc_id", "pack", "offset")


@query("""WITH l AS (SELECT sha256(text) AS hash, 'pack-' || min(source) AS pack_name, CAST(min(strlen(text)) AS BIGINT) AS length FROM documents GROUP BY 1)
SELECT doc_id, pack_name, length FROM documents JOIN l ON l.hash = sha256(text)""")
def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", digest().alias("hash"), F.octet_length("text").cast("long").alias("size"))
    index = rows.groupBy("hash").agg(F.concat(F.lit("pack-"), F.min("source")).alias("pack_name"), F.min("size").alias("length"))
    return store.locate(rows.select("doc_id", "hash"), index).select("doc_id", "pack_name", "length")


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) > 0")
def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as pack and index files, both read back and joined."""
    docs = read(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", "source", F.col("text").cast("binary").alias("data"))
    places = store.assign_packs(docs.select("doc_id", "source", F.octet_length("data").cast("long").alias("length")), ["doc_id"], "source", 1 << 20)
    places = places.select(F.col("doc_id").alias("seq"), F.concat_ws("-", "source", F.col("pack").cast("string")).alias("pack"))
    rows = docs.join(places, F.col("doc_id") == F.col("seq")).select("doc_id", "pack", "seq", "data")
    packs = store.encode_packs(rows)
    index = store.read_index(packs).select(F.col("pack_name").alias("pack"), "offset", F.col("hash").alias("id")).dropDuplicates(["pack", "offset"])
    blobs = store.read_packs(packs).join(index, ["pack", "offset"]).where(binary.hash_bytes("data") == F.col("id"))
    order = Window.partitionBy("pack").orderBy("offset")
    back = blobs.withColumn("k", F.row_number().over(order))
    ids = rows.select("pack", "doc_id", F.row_number().over(Window.partitionBy("pack").orderBy("seq")).alias("k"))
    return back.join(ids, ["pack", "k"]).select("doc_id", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("length"))


@query(f"SELECT CAST({sql.varint_length('n')} AS BIGINT) AS bytes, count(*) AS n FROM (SELECT CAST(l_orderkey AS BIGINT) * l_partkey * l_suppkey AS n FROM lineitem) GROUP BY 1")
def varint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").groupBy(binary.varint_length(n).cast("long").alias("bytes")).agg(F.count("*").alias("n"))


# recipes and identities


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) > 0")
def recipe_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from distinct chunks that were verified."""
    cut = written(chunking.hashed(chunks(spark, sf_dir)), "cut")
    sound = store.verified(cut.select("hash", "data").dropDuplicates(["hash"])).where("intact")
    back = store.reassemble(cut.select("doc_id", "seq", "hash"), sound, "doc_id")
    return back.select("doc_id", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("length"))


@query("SELECT doc_id, lower(sha256(text) || printf('%02x', CAST(n_chars % 10 AS INTEGER))) AS wire, CAST(n_chars % 10 AS BIGINT) AS level, sha256(text) AS hash FROM documents")
def merkle_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities as 33 bytes, and parsed again."""
    rows = read(spark, sf_dir, "documents").select("doc_id", store.merkle_bytes(F.unhex(digest()), F.col("n_chars") % 10).alias("wire"))
    parsed = store.merkle_parse(F.col("wire"))
    return rows.select("doc_id", binary.hex_of(F.col("wire")).alias("wire"), parsed["level"].cast("long").alias("level"), binary.hex_of(parsed["hash"]).alias("hash"))


@query("SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS seq, sha256(text) AS hash FROM documents")
def merkle_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of each source's documents, put together, cut into nodes of 100 bytes, and expanded again."""
    rows = read(spark, sf_dir, "documents").select("source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("i"), F.unhex(digest()).alias("hash"))
    parts = rows.select("source", "i", "hash", F.explode(F.expr("sequence(32 * i div 100, (32 * i + 31) div 100)")).alias("seq"))
    piece = F.expr("substring(hash, cast(greatest(100 * seq - 32 * i, 0) + 1 as int), cast(100 * seq + 100 - greatest(32 * i, 100 * seq) as int))")
    nodes = parts.groupBy("source", "seq").agg(F.sort_array(F.collect_list(F.struct("i", piece.alias("piece")))).alias("parts")).select("source", "seq", store.join_pieces("parts").alias("data"))
    return store.expand_level(nodes, "source").select("source", "seq", binary.hex_of(F.col("hash")).alias("hash"))


@query()
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every document; interior nodes are cut as data is."""
    roots = store.merkle_roots(chunking.hashed(chunks(spark, sf_dir)), 8, "doc_id")
    return roots.select("doc_id", binary.hex_of(F.col("hash")).alias("root"), F.col("level").cast("long").alias("level"))


@query()
def chunk_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHAKE256 and Castagnoli checksums of all documents."""
    text = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", binary.hex_of(binary.hash_bytes(text)).alias("hash"), binary.checksum(text).alias("crc32c"))


@query("SELECT doc_id, substr(hex(encode(text)), 201, 128) AS part, substr(hex(encode(text)), 2001) AS rest FROM documents")
def ranged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.sources.files import read_range

    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    one = read_range(rows, 100, 64).withColumnRenamed("part", "first")
    return read_range(one, 1000, 0).select("doc_id", F.hex("first").alias("part"), F.hex("part").alias("rest"))


@query("""SELECT count(*) AS n, CAST(count_if(len = 64 AND regexp_full_match(h, '[0-9a-fA-F]+')) AS BIGINT) AS n_valid FROM (SELECT h, length(h) AS len FROM (
  SELECT CASE source WHEN 'src1' THEN substr(sha256(text), 2) WHEN 'src2' THEN 'x' || substr(sha256(text), 2) WHEN 'src3' THEN upper(sha256(text)) ELSE sha256(text) END AS h FROM documents))""")
def hash_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts name a hash."""
    h = F.when(F.col("source") == "src1", F.substring(digest(), 2, 64)).when(F.col("source") == "src2", F.concat(F.lit("x"), F.substring(digest(), 2, 64))).when(F.col("source") == "src3", F.upper(digest())).otherwise(digest())
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(binary.is_hash_text(h)).alias("n_valid"))


# snapshots


@query(f"""WITH {sql.FILES}, e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM files)
SELECT path, ext, CAST(CASE WHEN ext IN {INCOMPRESSIBLE} THEN 18 ELSE 14 END AS BIGINT) AS bits, CASE WHEN size = 0 THEN 'empty' WHEN size < 8192 THEN 'inline' ELSE 'chunks' END AS keep FROM e""")
def file_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file would be kept."""
    name = snapshots.base_name(F.col("path"))
    return files(spark, sf_dir).select("path", snapshots.extension(name).alias("ext"), snapshots.split_bits(name).cast("long").alias("bits"), snapshots.storage_of(F.col("kind"), F.col("size")).alias("keep"))


@query(f"""WITH {sql.SNAPSHOTS} SELECT cur.path, CASE WHEN base.path IS NULL THEN 'added' WHEN base.mode = cur.mode AND base.size = cur.size AND base.mtime_ns = cur.mtime_ns THEN 'unchanged' ELSE 'modified' END AS status
FROM cur LEFT JOIN base ON base.path = cur.path""")
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental snapshot reads again."""
    columns = ["path", "kind", "mode", "size", "mtime_ns"]
    return snapshots.incremental(current(spark, sf_dir).select(columns), base(spark, sf_dir).select(columns)).select("path", "status")


_DIFFERENCES = f"""{sql.SNAPSHOTS}, x AS (SELECT coalesce(base.path, cur.path) AS path, CASE WHEN cur.path IS NULL THEN 'only_a' WHEN base.path IS NULL THEN 'only_b' WHEN base.mode <> cur.mode THEN 'mode'
  WHEN base.mtime_ns <> cur.mtime_ns THEN 'mtime_ns' WHEN base.size <> cur.size THEN 'size' WHEN base.text <> cur.text THEN 'digest' END AS difference FROM base FULL JOIN cur ON base.path = cur.path)"""


@query(f"WITH {_DIFFERENCES} SELECT path, difference FROM x WHERE difference IS NOT NULL")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths that differ between two snapshots."""
    a, b = (t(spark, sf_dir).withColumn("digest", digest()) for t in (base, current))
    return snapshots.compare(a, b)


@query(f"WITH {_DIFFERENCES} SELECT difference, count(*) AS n FROM x WHERE difference IS NOT NULL GROUP BY 1")
def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_compare(spark, sf_dir).groupBy("difference").agg(F.count("*").alias("n"))


@query(f"WITH {sql.FILES} SELECT path FROM files WHERE NOT (contains(path, 'src1/') OR contains(path, '/de/') OR contains(path, '7.'))")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when parts of paths are excluded."""
    return files(spark, sf_dir).where(~snapshots.excluded(F.col("path"), ["src1/", "/de/", "7."])).select("path")


@query(f"WITH {sql.FILES}, p AS (SELECT DISTINCT source || '/en' AS pattern FROM documents WHERE lang = 'es') SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(path, pattern))")
def excluded_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with patterns from a table."""
    patterns = read(spark, sf_dir, "documents").where("lang = 'es'").select(F.concat("source", F.lit("/en")).alias("pattern")).distinct()
    return snapshots.without_excluded(files(spark, sf_dir), patterns).select("path")


@query(f"""WITH {sql.FILES}, a AS (SELECT size, unnest(['', source, source || '/' || lang]) AS path FROM files) SELECT path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY 1""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below every directory."""
    return snapshots.rollup(snapshots.entries(files(spark, sf_dir)))


@query(f"""WITH {sql.FILES}, e AS (SELECT path, source || '/' || lang AS parent, 'file' AS kind, mode, size FROM files UNION ALL SELECT DISTINCT source || '/' || lang, source, 'dir', 2147484141, 0 FROM files
  UNION ALL SELECT DISTINCT source, '', 'dir', 2147484141, 0 FROM files)
SELECT path, parent, regexp_extract(path, '([^/]*)$', 1) AS name, kind, CAST(mode & 511 AS BIGINT) AS perm, CAST(CASE WHEN kind = 'file' THEN size ELSE 0 END AS BIGINT) AS size FROM e""")
def mounted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the tree with the attributes that a mounted one shows."""
    every = snapshots.entries(files(spark, sf_dir))
    return snapshots.attributes(every).join(every.select("path", "parent"), "path").select("path", "parent", "name", "kind", "perm", "size")


@query("""WITH m AS (SELECT CAST(CASE WHEN p_size % 7 = 0 THEN 2147483648 WHEN p_size % 5 = 0 THEN 134217728 WHEN p_size % 3 = 0 THEN 67108864 ELSE 0 END + p_partkey % 512 AS BIGINT) AS mode FROM part)
SELECT count(*) AS n, CAST(count_if(mode & 2147483648 <> 0) AS BIGINT) AS dirs, CAST(count_if(mode & 134217728 <> 0) AS BIGINT) AS links, CAST(count_if(mode & (2147483648 + 134217728 + 67108864) = 0) AS BIGINT) AS files FROM m""")
def kind_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds from mode bits."""
    size = F.col("p_size")
    mode = (F.when(size % 7 == 0, F.lit(1 << 31)).when(size % 5 == 0, F.lit(1 << 27)).when(size % 3 == 0, F.lit(1 << 26)).otherwise(F.lit(0)) + F.col("p_partkey") % 512).cast("long")
    return read(spark, sf_dir, "part").select(mode.alias("mode")).agg(
        F.count("*").alias("n"), F.count_if(snapshots.is_dir(F.col("mode"))).alias("dirs"), F.count_if(snapshots.is_symlink(F.col("mode"))).alias("links"), F.count_if(snapshots.is_file(F.col("mode"))).alias("files")
    )


@query(f"WITH {sql.FILES} SELECT item_id, path, size FROM benchmark JOIN files ON path = 'src' || (item_id % 20) || '/en/' || item_id || '.txt'")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries at wanted paths: equality on the whole path."""
    want = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/en/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"))
    return want.join(files(spark, sf_dir).select("path", "size"), "path").select("item_id", "path", "size")


@query(f"WITH {sql.FILES} SELECT path, sha256(text) AS hash FROM files")
def content_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents from where they are kept: in the entry, nowhere (empty), or in chunks."""
    rows = files(spark, sf_dir).withColumn("keep", snapshots.storage_of(F.col("kind"), F.col("size"))).withColumn("content", F.col("text").cast("binary"))
    cut = written(chunking.hashed(chunking.chunk(rows.where("keep = 'chunks'"), "path", "content", BITS)), "cut")
    joined = store.reassemble(cut.select("path", "seq", "hash"), cut.select("hash", "data").dropDuplicates(["hash"]), "path").withColumnRenamed("data", "joined")
    held = rows.select("path", "kind", "size", F.when(F.col("keep") == "inline", F.col("content")).alias("inline")).join(joined, "path", "left")
    return held.select("path", F.sha2(snapshots.contents(F.col("kind"), F.col("size"), F.col("inline"), F.col("joined")), 256).alias("hash"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as a snapshot for each source, with the identity of each file's content."""
    every, held = snapshots.entries(files(spark, sf_dir)), files(spark, sf_dir).select("path", digest().alias("content_id"))
    return every.join(held, "path", "left").withColumn("snapshot", F.split("path", "/")[0])


def _sha(data):  # noqa: ANN001, ANN202
    return F.unhex(F.sha2(data, 256))


def _rolled(level: str) -> str:
    return f"""SELECT snapshot, parent AS path, sha256(string_agg(d, '' ORDER BY part)) AS children FROM (SELECT snapshot, parent, substr(digest, 1, 3) AS part, sha256(string_agg(digest, '' ORDER BY digest)) AS d FROM {level} GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(f"""WITH {sql.FILES}, a AS (SELECT source AS snapshot, source || '/' || lang AS parent, sha256(concat_ws('|', 'file', CAST(mode AS VARCHAR), CAST(mtime_ns AS VARCHAR), CAST(size AS VARCHAR), sha256(text), regexp_extract(path, '([^/]*)$', 1))) AS digest FROM files),
ra AS ({_rolled('a')}), b AS (SELECT snapshot, snapshot AS parent, sha256('dir|2147484141||0|' || children || '|' || split_part(path, '/', 2)) AS digest FROM ra),
rb AS ({_rolled('b')}), c AS (SELECT snapshot, '' AS parent, sha256('dir|2147484141||0|' || children || '|' || path) AS digest FROM rb),
rc AS ({_rolled('c')}) SELECT snapshot, children AS digest FROM rc""")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each source's tree, rolled up from its entries."""
    return snapshots.root_digests(_trees(spark, sf_dir), hasher=_sha)


@query("""SELECT DISTINCT 'root' AS "check", source AS object, '' AS detail FROM documents WHERE source = 'src3'""")
def root_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that aren't those whose roots are known: the size of each entry of one source was changed."""
    known = snapshots.root_digests(_trees(spark, sf_dir), hasher=_sha).withColumnRenamed("digest", "root")
    hurt = _trees(spark, sf_dir).withColumn("size", F.when(F.col("snapshot") == "src3", F.col("size") + 1).otherwise(F.col("size")))
    return verify.roots(snapshots.root_digests(hurt, hasher=_sha), known)


@query(f"""WITH {sql.FILES}, idx AS (SELECT sha256(text) AS hash FROM files) SELECT DISTINCT 'orphan' AS "check", sha256(text) AS object, '' AS detail FROM files WHERE sha256(text) NOT IN (SELECT sha256(text) FROM files WHERE lang <> 'fr')""")
def unneeded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blobs that no recipe needs once one language is gone."""
    rows = files(spark, sf_dir).select("lang", F.unhex(digest()).alias("hash"))
    return verify.unneeded(rows.where("lang <> 'fr'"), rows.select("hash"))


# names


@query(f"WITH {sql.METADATA} SELECT CASE WHEN name LIKE 'bits-%' THEN 'bits' ELSE 'backup' END AS kind, regexp_replace(name, '^(backup|bits)-', '') AS name, created FROM metadata")
def metadata_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.listing(names(spark, sf_dir))


@query(f"WITH {sql.METADATA} SELECT CASE WHEN name LIKE 'bits-%' THEN 'bits' ELSE 'backup' END AS kind, count(*) AS n FROM metadata GROUP BY 1")
def metadata_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.totals(names(spark, sf_dir))


@query(f"WITH {sql.METADATA} SELECT name, created FROM metadata WHERE name LIKE 'backup-p%' ORDER BY created DESC, name DESC LIMIT 1")
def latest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot whose name begins so."""
    return metadata.latest(names(spark, sf_dir), "backup-p").select("name", "created")


@query(f"WITH {sql.METADATA}, k AS (SELECT *, row_number() OVER (PARTITION BY split_part(name, '@', 1) ORDER BY created DESC, name DESC) AS k FROM metadata) SELECT name, created FROM k WHERE k = 1")
def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = names(spark, sf_dir).groupBy(F.substring_index("name", "@", 1).alias("own")).agg(F.max(F.struct("created", "name")).alias("best"))
    return best.select("best.name", "best.created")


@query(f"""WITH {sql.METADATA} SELECT split_part(name, '@', 1) AS name, substr(s, 1, 4) AS year, substr(s, 5, 2) AS month, substr(s, 7, 2) AS day, substr(s, 9) AS time FROM (SELECT name, split_part(name, '@', 2) AS s FROM metadata)""")
def name_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select(metadata.hierarchy(F.col("name")).alias("at")).select("at.*")


@query(f"WITH {sql.METADATA} SELECT 'backup-' || event_type || '@' || strftime(ts, '%Y%m%d%H%M%S') AS name FROM events WHERE 'backup-' || event_type || '@' || strftime(ts, '%Y%m%d%H%M%S') IN (SELECT name FROM metadata)")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names that must not be written."""
    new = read(spark, sf_dir, "events").select(F.concat(F.lit(metadata.BACKUP), metadata.stamped(F.col("event_type"), F.col("ts"))).alias("name"))
    return metadata.collisions(names(spark, sf_dir), new)


@query(f"WITH {sql.METADATA} SELECT name FROM metadata WHERE starts_with(name, 'bits-')")
def names_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.of_kind(names(spark, sf_dir), metadata.BITS).select("name")


@query(f"WITH {sql.FILES} SELECT path, ends_with(path, '.txt') AS accepted FROM files")
def suffix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the wanted suffix, and the rejects."""
    good, bad = metadata.suffixed(files(spark, sf_dir), ".txt", "path")
    return good.select("path", F.lit(True).alias("accepted")).unionByName(bad.select("path", F.lit(False).alias("accepted")))


@query("""SELECT doc_id, octet_length(unhex(CASE WHEN source = 'src1' THEN substr(sha256(text), 3) ELSE sha256(text) END)) = 32 AS valid FROM documents""")
def pointer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names must point to one hash."""
    data = F.unhex(F.when(F.col("source") == "src1", F.substring(digest(), 3, 64)).otherwise(digest()))
    return read(spark, sf_dir, "documents").select("doc_id", metadata.valid_pointer(data).alias("valid"))


@query("SELECT doc_id, sha256(text) AS salt, sha256(source) AS passphrase_hash, sha256(lang) AS encrypted_key, md5(text) AS iv FROM documents")
def key_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key records of four hex lines, parsed."""
    record = F.concat_ws("\n", digest(), digest("source"), digest("lang"), F.md5(F.col("text").cast("binary")))
    rows = read(spark, sf_dir, "documents").select("doc_id", metadata.parse_key_record(record).alias("k"))
    return rows.select("doc_id", *(binary.hex_of(F.col(f"k.{c}")).alias(c) for c in ("salt", "passphrase_hash", "encrypted_key", "iv")))


@query("""WITH l AS (SELECT sha256(text) AS plain, sha256(text || doc_id) AS enc, doc_id AS k FROM documents WHERE lang <> 'es'), m AS (SELECT plain, arg_max(enc, k) AS enc FROM l GROUP BY 1)
SELECT doc_id, enc AS encrypted FROM documents LEFT JOIN m ON plain = sha256(text)""")
def encryption_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain hashes with what they were last encrypted to, null where they weren't."""
    docs = read(spark, sf_dir, "documents")
    log = docs.where("lang <> 'es'").select(digest().alias("plain"), F.sha2(F.concat("text", F.col("doc_id").cast("string")), 256).alias("encrypted"), F.col("doc_id").alias("written"))
    return metadata.encrypted_names(docs.select("doc_id", digest().alias("hash")), log).select("doc_id", "encrypted")


# statistics


@query(f"""SELECT source, n, bytes, average, {sql.format_bytes('bytes')} AS shown FROM (SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) // count(*) AS BIGINT) AS average FROM documents GROUP BY 1)""")
def save_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, bytes, and averages by integer division."""
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return rows.select("source", "n", "bytes", F.expr("bytes div n").alias("average"), binary.format_bytes(F.col("bytes")).alias("shown"))


@query(f"SELECT o_orderkey, {sql.format_bytes('b')} AS shown FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_custkey * (1 + o_orderkey % 5000) AS b FROM orders)")
def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", binary.format_bytes(F.col("o_orderkey") * F.col("o_custkey") * (1 + F.col("o_orderkey") % 5000)).alias("shown"))


@query()
def compression_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents get smaller, and by how much, before dedup."""
    rows = read(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("raw"), binary.compress(F.col("text").cast("binary")).alias("packed"))
    small = F.substring("packed", 1, 1) == F.lit(b"\1")
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(small).alias("n_compressed"), F.sum("raw").alias("bytes_in"), F.sum(F.octet_length("packed").cast("long")).alias("bytes_out"))
    return sums.withColumn("percent", F.expr("100 * n_compressed div n"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def compression_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = binary.compress(F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", packed.alias("x")).select("doc_id", F.sha2(binary.decompress("x"), 256).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def encryption_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.unhex(digest("lang"))
    rows = read(spark, sf_dir, "documents").select("doc_id", key.alias("k"), binary.encrypt(F.col("text").cast("binary"), key).alias("x"))
    return rows.select("doc_id", F.sha2(binary.decrypt(F.col("x"), F.col("k")), 256).alias("hash"))


# integrity

_BROKEN = f"""{sql.FILES}, idx AS (SELECT sha256(text) AS hash FROM files WHERE lang <> 'es'),
v AS (SELECT 'rehash' AS "check", sha256(text) AS object, '' AS detail FROM files WHERE source = 'src3'
  UNION ALL SELECT DISTINCT 'orphan', sha256(text), '' FROM files WHERE sha256(text) NOT IN (SELECT hash FROM idx)
  UNION ALL SELECT DISTINCT 'missing', path, sha256(text) FROM files WHERE sha256(text) NOT IN (SELECT hash FROM idx)
  UNION ALL SELECT 'duplicate', hash, CAST(count(*) AS VARCHAR) FROM idx GROUP BY hash HAVING count(*) > 1)"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("hash", F.unhex(digest()))
    index = rows.where("lang <> 'es'").select("hash")
    stored = rows.select("hash", F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("data"))
    sha = lambda data: F.unhex(F.sha2(data, 256))
    return verify.union(verify.rehash(stored, hasher=sha), verify.orphans(rows, index), verify.missing(rows, index, "path"), verify.duplicates(index))


@query(f"WITH {_BROKEN} SELECT * FROM v")
def fsck_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation in a store that lacks a language and has changed a source's bytes."""
    return _broken(spark, sf_dir)


@query(f'WITH {_BROKEN} SELECT "check", count(*) AS n FROM v GROUP BY 1')
def fsck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).groupBy("check").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT sha256(text || source) AS enc, lang FROM documents) SELECT DISTINCT 'unmapped' AS "check", enc AS object, '' AS detail FROM e WHERE enc NOT IN (SELECT enc FROM e WHERE lang <> 'fr')""")
def unmapped_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted hashes in the map that aren't stored."""
    rows = read(spark, sf_dir, "documents").select(F.unhex(F.sha2(F.concat("text", "source"), 256)).alias("encrypted"), "lang")
    return verify.unmapped(rows, rows.where("lang <> 'fr'").select(F.col("encrypted").alias("hash")))


# parity


@query("""WITH s AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents), t AS (SELECT doc_id, n, unnest(range((n + 1279) // 1280)) AS seg FROM s)
SELECT doc_id, seg, least(1280, n - seg * 1280) AS seg_bytes, (least(1280, n - seg * 1280) + 4) // 5 AS shard_bytes FROM t""")
def parity_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return parity.layout(rows, "doc_id", "size", **RS)


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "source", F.col("text").cast("binary").alias("content"))
    protected = parity.encode(rows, n_parity=2, **RS)
    hurt = F.concat(F.lit(b"\0"), F.expr("substring(content, 2)"))
    return rows.withColumn("content", F.when((F.col("source") == "src3") & (F.octet_length("content") > 0), hurt).otherwise(F.col("content"))), protected


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(0 AS BIGINT) AS seg, CAST(0 AS INTEGER) AS shard, 'data' AS kind FROM documents WHERE source = 'src3' AND strlen(text) > 0")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that were changed: the first byte of every file of one source."""
    return parity.check(*_damaged(spark, sf_dir), **RS)


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(0 AS BIGINT) AS seg, CAST(1 AS BIGINT) AS bad FROM documents WHERE source = 'src3' AND strlen(text) > 0")
def damaged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shards of each segment were changed."""
    return parity.corrupt_shards(parity.check(*_damaged(spark, sf_dir), **RS))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) AS hash, CAST(CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS BIGINT) AS bad FROM documents WHERE strlen(text) > 0")
def parity_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they were."""
    back = parity.restore(*_damaged(spark, sf_dir), **RS)
    whole = back.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seg", F.col("data").alias("piece")))).alias("parts"), F.sum(F.size("bad")).alias("bad"))
    return whole.select("file", F.sha2(store.join_pieces("parts"), 256).alias("hash"), "bad")


# streams


@query(ORACLES["chunk_dedup_report"])
def streamed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first report again, from documents that came as a stream."""
    from siltstone.streaming import ingest

    folder = scratch(spark, "stream")
    source = read(spark, sf_dir, "documents").select("doc_id", "text")
    stream = spark.readStream.schema(read(spark, sf_dir, "documents").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(_stream_folder(spark, sf_dir)).select(source.columns)
    ingest.ingest(stream, "doc_id", "text", BITS, f"{folder}/landed", f"{folder}/checkpoint").awaitTermination()
    recipes = ingest.read(spark, f"{folder}/landed", "recipes")
    return store.dedup_report(recipes.select("hash", "length"))


def _stream_folder(spark: SparkSession, sf_dir: str) -> str:
    """Streams read folders: where the table is one file, it is written to a folder first."""
    folder = scratch(spark, "stream-source")
    read(spark, sf_dir, "documents").write.parquet(folder)
    return folder
