"""One query for each operator over the given tables, with equivalent SQL where SQL can express it.

Texts serve as sequences: their ASCII letters, in upper case.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscan.functions import residues
from seqscan.functions import registry
from seqscan.functions.registry import aa_decode, aa_encode, code_counts, self_score, sw_score
from seqscan.operators import database
from seqscan.operators.search import search
from seqscan.plans import oracle
from seqscan.plans.config import SearchConfig
from seqscan.sources import sinks
from seqscan.sources.fasta import pairs, parsed, read_sequences
from seqscan.sources.folders import shared_folder
from seqscan.streaming.live import Dialogue, Session, in_batches, numbered, several_files, stream_search

Query = Callable[[SparkSession, str], DataFrame]
CUSTOM = SearchConfig(top=5, matrix="blosum45", gop=-5, gex=-2)


def new_place(spark: SparkSession) -> str:
    """A folder's name of its own, in the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    return read(spark, sf_dir, name).select(F.col(key).cast("long").alias("ordinal"), F.col(key).cast("string").alias("header"), letters(F.col(text)).alias("sequence"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "documents", "doc_id", "text")


def document_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.subjects(documents(spark, sf_dir))


def part_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.subjects(records(spark, sf_dir, "part", "p_partkey", "p_name"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_num"), F.col("n_name").alias("header"), letters(F.col("n_name")).alias("sequence"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_num"), F.col("item_id").cast("string").alias("header"), letters(F.col("text")).alias("sequence"))


def encoded(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(F.col("ordinal").alias("doc_id"), F.md5(F.hex(aa_encode("sequence"))).alias("codes_md5"))


def decoded(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(F.col("ordinal").alias("doc_id"), F.md5(aa_decode(aa_encode("sequence"))).alias("letters_md5"))


def composition(spark, sf_dir):
    """Counts of the 21 codes over all documents."""
    counted = code_counts(documents(spark, sf_dir), "sequence").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(21)])
    pairs_of = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(c).alias("residue"), F.col(f"n{i}").alias("n")) for i, c in enumerate(residues.ALPHABET + "-")])
    return counted.select(F.inline(pairs_of))


def buckets(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.length("sequence").alias("length"))
    return d.select("doc_id", "length", residues.length_partition(F.col("length")).alias("length_partition"))


def matrices(spark, sf_dir):
    """Scores of all pairs of the residues that documents hold, by each matrix."""
    rows = [(m, a, b, int(residues.matrix(m)[a, b])) for m in sorted(residues.LOWER_TRIANGLES) for a in range(21) for b in range(21)]
    held = F.broadcast(composition(spark, sf_dir).where("n > 0").select("code"))  # 21 at most
    table = spark.createDataFrame(rows, "matrix string, a int, b int, score int")
    return table.join(held.withColumnRenamed("code", "a"), "a", "left_semi").join(held.withColumnRenamed("code", "b"), "b", "left_semi").select("matrix", "a", "b", "score")


def self_scores(spark, sf_dir):
    """Sum of the diagonal over a document's residues."""
    return documents(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), self_score("sequence").alias("self_score"))


def part_pairs(spark, sf_dir, config: SearchConfig, left: str = "p_name", right: str = "p_type") -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("p_partkey"), sw_score(letters(F.col(left)), letters(F.col(right)), config.matrix, *config.gaps).alias("score"))


def pair_sql(config: SearchConfig, left: str = "p_name", right: str = "p_type") -> str:
    a, b = oracle.letters(left), oracle.letters(right)
    return f"WITH RECURSIVE {oracle.scores(f'SELECT {a} AS q, {b} AS s FROM part', config)} SELECT p_partkey::BIGINT AS p_partkey, score FROM part JOIN scores ON q = {a} AND s = {b}"


def name_hits(spark, sf_dir, config: SearchConfig = SearchConfig()) -> DataFrame:
    return search(nations(spark, sf_dir), part_db(spark, sf_dir), config).hits()


def all_matrices(spark, sf_dir):
    found = [search(nations(spark, sf_dir), part_db(spark, sf_dir), SearchConfig(top=3, matrix=m)).top_scores().withColumn("matrix", F.lit(m)) for m in sorted(residues.LOWER_TRIANGLES)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def all_matrices_sql() -> str:
    return " UNION ALL ".join(f"SELECT query_num, result_num, score, ref_id, '{m}' AS matrix FROM (WITH RECURSIVE {oracle.hits(SearchConfig(top=3, matrix=m))} SELECT * FROM hits)" for m in sorted(residues.LOWER_TRIANGLES))


def stats(spark, sf_dir):
    return search(nations(spark, sf_dir), document_db(spark, sf_dir), SearchConfig(top=0)).stats()


def two_files(spark, sf_dir):
    """Nations and regions as two query files, numbered anew in each."""
    nation = read(spark, sf_dir, "nation").select(F.lit("a").alias("file"), F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_name").alias("header"))
    region = read(spark, sf_dir, "region").select(F.lit("b").alias("file"), F.col("r_regionkey").cast("long").alias("ordinal"), F.col("r_name").alias("header"))
    queries = several_files(nation.unionByName(region).withColumn("sequence", letters(F.col("header"))))
    hits = search(queries, part_db(spark, sf_dir), SearchConfig(top=2)).hits()
    return hits.join(queries.select("query_num", "file_idx", "file_query_num"), "query_num").select("file_idx", "file_query_num", "result_num", "score", "ref_id")


TWO_FILES = f"""
SELECT (query_num // 1000)::BIGINT AS file_idx, query_num % 1000 AS file_query_num, result_num, score, ref_id FROM (WITH RECURSIVE {oracle.hits(SearchConfig(top=2), f'''
  SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS query_num, n_name AS header, {oracle.letters("n_name")} AS sequence FROM nation
  UNION ALL SELECT 999 + row_number() OVER (ORDER BY r_regionkey), r_name, {oracle.letters("r_name")} FROM region''')} SELECT * FROM hits)"""


def query_folder(spark, sf_dir):
    """Nations and regions as two FASTA files in one folder: a number stands in both."""
    place = new_place(spark)
    for table, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        lines = read(spark, sf_dir, table).orderBy(key).select(F.concat(F.lit(">"), name, F.lit("\n"), letters(F.col(name))))
        lines.coalesce(1).write.text(f"{place}/{table}")
    hits = search(numbered(read_sequences(spark, f"{place}/*/*.txt")), part_db(spark, sf_dir), SearchConfig(top=2)).hits()
    return hits.select(F.regexp_extract("file", "/(nation|region)/[^/]*$", 1).alias("file"), "query_num", "query_header", "result_num", "score", "ref_id")


QUERY_FOLDER = f"""
SELECT CASE WHEN query_num < 1000 THEN 'nation' ELSE 'region' END AS file, query_num % 1000 AS query_num, query_header, result_num, score, ref_id FROM (WITH RECURSIVE {oracle.hits(SearchConfig(top=2), f'''
  SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS query_num, n_name AS header, {oracle.letters("n_name")} AS sequence FROM nation
  UNION ALL SELECT 999 + row_number() OVER (ORDER BY r_regionkey), r_name, {oracle.letters("r_name")} FROM region''')} SELECT * FROM hits)"""


def ids_of_files(spark, sf_dir):
    """One database of two files, parts and nations, whose records have the same positions and often the same length."""
    p = records(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("file", F.lit("part"))
    n = records(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumn("file", F.lit("nation"))
    return database.subjects(p.unionByName(n)).select("ref_id", "length", "header", aa_decode("residues").alias("sequence"))


IDS_OF_FILES = f"""
SELECT (row_number() OVER (ORDER BY length(s), file, k) - 1)::INTEGER AS ref_id, length(s)::INTEGER AS length, k::VARCHAR AS header, regexp_replace(s, '[^{residues.ALPHABET}]', '-', 'g') AS sequence
FROM (SELECT 'part' AS file, p_partkey::BIGINT AS k, {oracle.letters('p_name')} AS s FROM part UNION ALL SELECT 'nation', n_nationkey::BIGINT, {oracle.letters('n_name')} FROM nation)"""


def best_from_sql(spark, sf_dir):
    """The best of a whole table by the SQL functions alone."""
    registry.register(spark)
    # SQL knows tables by name; one for each call.
    view = f"subjects_{uuid.uuid4().hex}"
    part_db(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM align_best(TABLE(SELECT * FROM align_topk(TABLE(SELECT ref_id, residues FROM {view}), 'HREDWIDGET', 10)), 10)")


def talked(spark, sf_dir):
    """A dialogue in which a sequence goes on over several lines, answered in plain lines."""
    talk = Dialogue(Session(part_db(spark, sf_dir)), tsv=False)
    for line in ("s HRED", "WID", "GET"):
        talk.take(line)
    return talk.take("").lines.select("line")


def tsv(spark, sf_dir):
    return sinks.tsv_lines(name_hits(spark, sf_dir)).select("line")


def plain(spark, sf_dir):
    queries = nations(spark, sf_dir)
    found = search(queries, part_db(spark, sf_dir))
    return sinks.plain_lines(found.hits(), queries, found.stats()).select("line")


PLAIN = f"""
WITH RECURSIVE {oracle.hits(SearchConfig())}
SELECT format('Result {{}}. Score: {{}}. Length: {{}}. Header {{}}. referenceId {{}}', result_num, score, reference_length, reference_header, ref_id) AS line FROM hits
UNION ALL SELECT format('Query {{}}, header{{}}, length {{}}, num overflows 0', query_num, header, length(sequence)) FROM queries"""


def pseudo(spark, sf_dir):
    """All subjects are equal: equal scores, lowest numbers first."""
    db = database.pseudo_db(spark, 1000, 128)
    return search(nations(spark, sf_dir), db).top_scores().select("query_num", "result_num", "ref_id")


def fewer(spark, sf_dir):
    return name_hits(spark, sf_dir, SearchConfig(top=20)).where("score >= 6")


def looked_up(spark, sf_dir):
    wanted = search(nations(spark, sf_dir), part_db(spark, sf_dir), SearchConfig(top=1)).top_scores()
    return database.lookup(part_db(spark, sf_dir), wanted)


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the content of a FASTA file of one record, wrapped at 70."""
    d = documents(spark, sf_dir)
    body = F.regexp_replace("sequence", "(.{70})", "$1\n")
    return d.select(F.col("header").alias("path"), F.concat(F.lit(">"), "header", F.lit(" of documents\r\n"), body, F.lit("\n")).cast("binary").alias("content"))


def fasta(spark, sf_dir):
    return parsed(fasta_files(spark, sf_dir)).select(F.col("file").cast("long").alias("doc_id"), "header", F.md5("sequence").alias("letters_md5"))


def fastq(spark, sf_dir):
    """Part names as FASTQ records, their types as qualities cut or filled to the same length."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), letters(F.col("p_name")).alias("s"), letters(F.col("p_type")).alias("q"))
    filled = p.withColumn("q", F.expr("rpad(q, length(s), '@')"))
    files = filled.select("path", F.concat(F.lit("junk @"), "path", F.lit("\n"), "s", F.lit("\n+\n"), "q", F.lit("\n")).cast("binary").alias("content"))
    return parsed(files).select(F.col("file").cast("long").alias("p_partkey"), "header", "sequence", "quality")


def content_told(spark, sf_dir):
    """Documents as gzip files that are not called so and parts as plain files that are, of a size that is not read whole."""
    place = new_place(spark)
    d = documents(spark, sf_dir).select(F.concat(F.lit(">d"), "header", F.lit("\n"), F.regexp_replace("sequence", "(.{70})", "$1\n")))
    d.repartition(3).write.option("compression", "gzip").text(f"{place}/documents")
    p = records(spark, sf_dir, "part", "p_partkey", "p_name").select(F.concat(F.lit("@p"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), F.translate("sequence", "ABC", "@>+")))
    p.repartition(3).write.text(f"{place}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, suffix in (("documents", ".fa"), ("parts", ".gz")):
        for n, found in enumerate(files.globStatus(path(f"{place}/{folder}/part-*"))):
            files.rename(found.getPath(), path(f"{place}/{folder}/{n}{suffix}"))
    got = read_sequences(spark, f"{place}/documents/*.fa", f"{place}/parts/*.gz", large=1 << 10)
    return got.select("header", F.md5("sequence").alias("letters_md5"), F.md5("quality").alias("quality_md5"))


CONTENT_TOLD = f"""
SELECT 'd' || doc_id AS header, md5({oracle.letters('text')}) AS letters_md5, NULL::VARCHAR AS quality_md5 FROM documents
UNION ALL SELECT 'p' || p_partkey, md5(s), md5(translate(s, 'ABC', '@>+')) FROM (SELECT p_partkey, {oracle.letters('p_name')} AS s FROM part)"""


def mates_of_folders(spark, sf_dir):
    """Names and types of parts, each in two files; files are mates in order of their names."""
    p = read(spark, sf_dir, "part")
    side = lambda column: p.select(F.concat(F.lit(f"{column}/"), F.col("p_partkey") % 2).alias("file"), F.col("p_partkey").cast("long").alias("ordinal"), F.col(column).alias("header"), letters(F.col(column)).alias("sequence"), F.lit(None).cast("string").alias("quality"))
    return pairs(side("p_name"), side("p_type")).select("file_idx", "pair", "header_1", "sequence_1", "header_2", "sequence_2")


def mates(spark, sf_dir):
    """Neighbouring parts, in order of their keys, as pairs of one file."""
    p = read(spark, sf_dir, "part").select(F.lit("parts").alias("file"), F.col("p_partkey").cast("long").alias("ordinal"), F.col("p_name").alias("header"), letters(F.col("p_name")).alias("sequence"), F.lit(None).cast("string").alias("quality"))
    return pairs(p).select("pair", "header_1", "sequence_1", "header_2", "sequence_2")


def mate_files(spark, sf_dir):
    """Names and types of parts as two files, their records in lockstep."""
    p = read(spark, sf_dir, "part")
    side = lambda column: p.select(F.lit(column).alias("file"), F.col("p_partkey").cast("long").alias("ordinal"), F.col(column).alias("header"), letters(F.col(column)).alias("sequence"), F.lit(None).cast("string").alias("quality"))
    return pairs(side("p_name"), side("p_type")).select("pair", "header_1", "sequence_1", "header_2", "sequence_2")


def large_files(spark, sf_dir, compression: str):
    """All documents written as files of many records each, read line by line as files too large for memory are."""
    place = new_place(spark)
    d = documents(spark, sf_dir)
    text = F.concat(F.lit(">"), "header", F.lit(" of documents\n"), F.regexp_replace("sequence", "(.{70})", "$1\n"))
    d.select(text).coalesce(3).write.option("compression", compression).text(place)
    found = read_sequences(spark, place, large=1 << 10)
    return found.select(F.split("header", " ")[0].cast("long").alias("doc_id"), "header", F.md5("sequence").alias("letters_md5"))


def mixed_files(spark, sf_dir):
    """Documents and parts as FASTA and FASTQ records of one gzipped file each key's last digit."""
    place = new_place(spark)
    d = documents(spark, sf_dir).select((F.col("ordinal") % 10).alias("k"), F.concat(F.lit(">d"), "header", F.lit("\n"), "sequence").alias("text"))
    p = records(spark, sf_dir, "part", "p_partkey", "p_name").select((F.col("ordinal") % 10).alias("k"), F.concat(F.lit("@p"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), F.translate("sequence", "ABC", "@>+")).alias("text"))
    d.unionByName(p).repartition(4, "k").select("text").write.option("compression", "gzip").text(place)
    return read_sequences(spark, place).select("header", "sequence", "quality")


def reloaded(spark, sf_dir):
    """The parts' database written and loaded again."""
    place = new_place(spark)
    database.build_db(records(spark, sf_dir, "part", "p_partkey", "p_name"), place)
    return database.load_db(spark, place).select("ref_id", "length", "length_partition", "header", aa_decode("residues").alias("sequence"))


PSEUDO = residues.decode(database.pseudo_residues(600))


def overflows(spark, sf_dir):
    """Beginnings of a sequence against copies of it: those that score more than the 16-bit kernel holds overflow."""
    sizes = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("query_num")).distinct()
    asked = sizes.select("query_num", F.col("query_num").cast("string").alias("header"), F.substring(F.lit(PSEUDO), F.lit(1), (F.col("query_num") * 12).cast("int")).alias("sequence"))
    return search(asked, database.pseudo_db(spark, 5, 600), SearchConfig(top=0)).stats()


def run_totals(spark, sf_dir):
    return search(nations(spark, sf_dir), part_db(spark, sf_dir)).metrics().select("cells", "num_overflows")


def recoded(spark, sf_dir):
    again = database.recode(document_db(spark, sf_dir))
    return again.select("ref_id", F.md5(F.hex("residues")).alias("codes_md5"))


def streamed(spark, sf_dir):
    """Nations written as a query file, found by the stream, hits of the last micro-batch."""
    place = new_place(spark)
    lines = nations(spark, sf_dir).orderBy("query_num").select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence"))
    lines.coalesce(1).write.text(f"{place}/in")
    stream_search(spark, f"{place}/in", part_db(spark, sf_dir), in_batches(f"{place}/hits"), f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/hits").select("file_query_num", "query_header", "result_num", "score", "ref_id")


def interactive(spark, sf_dir):
    session = Session(part_db(spark, sf_dir))
    return session.search("HRED WIDGET")


def benchmark_in_documents(spark, sf_dir):
    """The flagship: every benchmark passage against every whole document."""
    return search(items(spark, sf_dir), document_db(spark, sf_dir)).hits()


def names_in_documents(spark, sf_dir):
    return search(nations(spark, sf_dir), document_db(spark, sf_dir)).hits()


def twentieth_names(spark, sf_dir):
    """Every nation whose number is divisible by 20 against all documents."""
    return search(nations(spark, sf_dir).where("query_num % 20 = 0"), document_db(spark, sf_dir)).hits()


TWENTIETH_NAMES = f"WITH RECURSIVE {oracle.hits_by_rows(SearchConfig(), oracle.QUERIES_SQL + ' WHERE n_nationkey % 20 = 0', oracle.db('documents', 'doc_id', 'text'))} SELECT * FROM hits"
DOCS = oracle.db("documents", "doc_id", "text")
HITS = "query_num, query_length, query_header, result_num, score, reference_length, reference_header, ref_id"
DIAGONAL = " + ".join(f"{int(residues.matrix('blosum62')[i, i])} * (length(s) - length(replace(s, '{c}', '')))" for i, c in enumerate(residues.ALPHABET + "-"))
KNOWN = f"regexp_replace({oracle.letters('text')}, '[^{residues.ALPHABET}]', '-', 'g')"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "aa_encode": (encoded, f"SELECT doc_id, md5(array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '' THEN '' ELSE printf('%02X', {oracle.code('c')}) END), '')) AS codes_md5 FROM (SELECT doc_id, {oracle.letters('text')} AS t FROM documents)"),
    "aa_decode_roundtrip": (decoded, f"SELECT doc_id, md5({KNOWN}) AS letters_md5 FROM documents"),
    "residue_composition": (composition, f"SELECT unnest(range(21))::INTEGER AS code, unnest(string_split('{residues.ALPHABET}-', '')) AS residue, unnest([{', '.join(f'''sum(length(s) - length(replace(s, '{c}', '')))::BIGINT''' for c in residues.ALPHABET + '-')}]) AS n FROM (SELECT {KNOWN} AS s FROM documents)"),
    "length_partition": (buckets, f"SELECT ordinal AS doc_id, length, length_partition FROM ({DOCS})"),
    "length_histogram": (lambda s, d: database.length_histogram(database.sized(documents(s, d))), f"SELECT b.length_partition, upper_bound, count(ordinal) AS num_sequences FROM {oracle.BOUNDS} b LEFT JOIN ({DOCS}) d ON d.length_partition = b.length_partition GROUP BY ALL"),
    "partition_prefix_sums": (lambda s, d: database.partition_prefix_sums(database.sized(documents(s, d))), f"SELECT length_partition, n AS num_sequences, (sum(n) OVER (ORDER BY length_partition) - n)::BIGINT AS first_row FROM (SELECT b.length_partition, count(ordinal) AS n FROM {oracle.BOUNDS} b LEFT JOIN ({DOCS}) d ON d.length_partition = b.length_partition GROUP BY ALL)"),
    "db_info": (lambda s, d: database.db_info(database.sized(documents(s, d))), f"SELECT count(*) AS num_sequences, sum((length + 3) // 4 * 4)::BIGINT AS num_chars, min(length) AS min_length, max(length) AS max_length, (sum(length) // count(*))::BIGINT AS avg_length FROM ({DOCS})"),
    "dense_ref_id": (lambda s, d: document_db(s, d).select("ref_id", F.col("header").cast("long").alias("doc_id"), "length"), f"SELECT ref_id, ordinal AS doc_id, length FROM ({DOCS})"),
    "padded_offsets": (lambda s, d: database.residue_offsets(document_db(s, d)), f"SELECT ref_id, (sum((length + 3) // 4 * 4) OVER (ORDER BY ref_id) - (length + 3) // 4 * 4)::BIGINT AS start FROM ({DOCS})"),
    "lengths_as_bigint": (lambda s, d: database.lengths_as(document_db(s, d), "bigint"), f"SELECT ref_id, length::BIGINT AS length FROM ({DOCS})"),
    "recode_database": (recoded, f"SELECT ref_id, md5(repeat('14', length)) AS codes_md5 FROM ({DOCS})"),
    "matrix_table": (matrices, f"WITH held AS (SELECT unnest(range(21)) AS code, unnest([{', '.join(f'''bool_or(contains(s, '{c}'))''' for c in residues.ALPHABET + '-')}]) AS there FROM (SELECT {KNOWN} AS s FROM documents)), tables AS (" + " UNION ALL ".join(f"SELECT '{m}' AS matrix, (k // 21)::INTEGER AS a, (k % 21)::INTEGER AS b, ({oracle.matrix_list(m)})[k + 1]::INTEGER AS score FROM (SELECT unnest(range(441)) AS k)" for m in sorted(residues.LOWER_TRIANGLES)) + ") SELECT * FROM tables WHERE a IN (SELECT code FROM held WHERE there) AND b IN (SELECT code FROM held WHERE there)"),
    "ungapped_self_score": (self_scores, f"SELECT doc_id, ({DIAGONAL})::BIGINT AS self_score FROM (SELECT doc_id, {KNOWN} AS s FROM documents)"),
    **{f"sw_score_{m}": (lambda s, d, m=m: part_pairs(s, d, SearchConfig(matrix=m)), pair_sql(SearchConfig(matrix=m))) for m in sorted(residues.LOWER_TRIANGLES)},
    "sw_custom_gaps": (lambda s, d: part_pairs(s, d, CUSTOM), pair_sql(CUSTOM)),
    "sw_self": (lambda s, d: part_pairs(s, d, SearchConfig(), "p_name", "p_name"), pair_sql(SearchConfig(), "p_name", "p_name")),
    "search_topk": (name_hits, f"WITH RECURSIVE {oracle.hits(SearchConfig())} SELECT {HITS} FROM hits"),
    "search_custom": (lambda s, d: name_hits(s, d, CUSTOM), f"WITH RECURSIVE {oracle.hits(CUSTOM)} SELECT {HITS} FROM hits"),
    "search_all_matrices": (all_matrices, all_matrices_sql()),
    "search_stats": (stats, f"SELECT n_nationkey::BIGINT AS query_num, 0::BIGINT AS num_overflows, (length({oracle.letters('n_name')}) * (SELECT sum(length) FROM ({DOCS})))::BIGINT AS cells FROM nation"),
    "multi_file_queries": (two_files, TWO_FILES),
    "tsv_lines": (tsv, f"WITH RECURSIVE {oracle.hits(SearchConfig())} SELECT concat_ws(chr(9), query_num, query_length, query_header, result_num, score, reference_length, reference_header, ref_id) AS line FROM hits"),
    "plain_lines": (plain, PLAIN),
    "pseudo_db_search": (pseudo, "SELECT n_nationkey::BIGINT AS query_num, k::INTEGER AS result_num, k::INTEGER AS ref_id FROM nation, (SELECT unnest(range(10)) AS k)"),
    "min_score_filter": (fewer, f"WITH RECURSIVE {oracle.hits(SearchConfig(top=20))} SELECT {HITS} FROM hits WHERE score >= 6"),
    "reference_lookup": (looked_up, f"WITH RECURSIVE {oracle.hits(SearchConfig(top=1))} SELECT DISTINCT db.ref_id, db.length, db.header, regexp_replace(db.sequence, '[^{residues.ALPHABET}]', '-', 'g') AS sequence FROM hits JOIN db ON db.ref_id = hits.ref_id"),
    "fasta_scan": (fasta, f"SELECT doc_id, doc_id || ' of documents' AS header, md5({oracle.letters('text')}) AS letters_md5 FROM documents"),
    "fastq_scan": (fastq, f"SELECT p_partkey::BIGINT AS p_partkey, p_partkey::VARCHAR AS header, s AS sequence, rpad(q, length(s)::INTEGER, '@') AS quality FROM (SELECT p_partkey, {oracle.letters('p_name')} AS s, {oracle.letters('p_type')} AS q FROM part)"),
    "pair_scan": (mates, f"SELECT a.p_partkey // 2 AS pair, a.p_name AS header_1, {oracle.letters('a.p_name')} AS sequence_1, b.p_name AS header_2, {oracle.letters('b.p_name')} AS sequence_2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0"),
    "mate_files_scan": (mate_files, f"SELECT p_partkey::BIGINT AS pair, p_name AS header_1, {oracle.letters('p_name')} AS sequence_1, p_type AS header_2, {oracle.letters('p_type')} AS sequence_2 FROM part"),
    **{f"large_{kind}_scan": (lambda s, d, kind=kind: large_files(s, d, kind), f"SELECT doc_id, doc_id || ' of documents' AS header, md5({oracle.letters('text')}) AS letters_md5 FROM documents") for kind in ("gzip", "none")},
    "mixed_gzip_scan": (mixed_files, f"SELECT 'd' || doc_id AS header, {oracle.letters('text')} AS sequence, NULL::VARCHAR AS quality FROM documents UNION ALL SELECT 'p' || p_partkey, s, translate(s, 'ABC', '@>+') FROM (SELECT p_partkey, {oracle.letters('p_name')} AS s FROM part)"),
    "database_reload": (reloaded, f"SELECT ref_id, length, length_partition, header, regexp_replace(sequence, '[^{residues.ALPHABET}]', '-', 'g') AS sequence FROM ({oracle.db('part', 'p_partkey', 'p_name')})"),
    "overflow_counts": (overflows, f"SELECT query_num, CASE WHEN {DIAGONAL} >= 2048 THEN 5 ELSE 0 END::BIGINT AS num_overflows, (length(s) * 600 * 5)::BIGINT AS cells FROM (SELECT DISTINCT p_size::BIGINT AS query_num, substr('{PSEUDO}', 1, p_size::INTEGER * 12) AS s FROM part)"),
    "search_run_totals": (run_totals, f"SELECT (SELECT sum(length({oracle.letters('n_name')})) FROM nation)::BIGINT * (SELECT sum(length({oracle.letters('p_name')})) FROM part)::BIGINT AS cells, 0::BIGINT AS num_overflows"),
    "stream_search": (streamed, f"WITH RECURSIVE {oracle.hits(SearchConfig(), oracle.QUERIES_SQL.replace('n_nationkey::BIGINT AS query_num', 'row_number() OVER (ORDER BY n_nationkey) - 1 AS query_num'))} SELECT query_num AS file_query_num, query_header, result_num, score, ref_id FROM hits"),
    "interactive_search": (interactive, f"WITH RECURSIVE {oracle.hits(SearchConfig(), '''SELECT -1::BIGINT AS query_num, '-' AS header, 'HREDWIDGET' AS sequence''')} SELECT {HITS} FROM hits"),
    "query_folder_search": (query_folder, QUERY_FOLDER),
    "ids_of_several_files": (ids_of_files, IDS_OF_FILES),
    "align_best_sql": (best_from_sql, f"WITH RECURSIVE {oracle.hits(SearchConfig(), '''SELECT -1::BIGINT AS query_num, '-' AS header, 'HREDWIDGET' AS sequence''')} SELECT ref_id, score, result_num FROM hits"),
    "dialogue_plain_lines": (talked, f"WITH RECURSIVE {oracle.hits(SearchConfig(), '''SELECT -1::BIGINT AS query_num, '-' AS header, 'HREDWIDGET' AS sequence''')} SELECT format('Result {{}}. Score: {{}}. Length: {{}}. Header {{}}. referenceId {{}}', result_num, score, reference_length, reference_header, ref_id) AS line FROM hits"),
    "content_told_scan": (content_told, CONTENT_TOLD),
    "mate_folders_scan": (mates_of_folders, f"SELECT p_partkey % 2 AS file_idx, p_partkey::BIGINT AS pair, p_name AS header_1, {oracle.letters('p_name')} AS sequence_1, p_type AS header_2, {oracle.letters('p_type')} AS sequence_2 FROM part"),
    "twentieth_names_in_documents": (twentieth_names, TWENTIETH_NAMES),
    "names_in_documents": (names_in_documents, None),
    "benchmark_in_documents": (benchmark_in_documents, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
